"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of `length` tokens takes from each source what the target proportions give it; what a source
got too much or too little, its deficit, is carried to the next window. The plan is one for the whole corpus: it says how many tokens
of each source the first x tokens of the output hold, by the targets until a source runs out, then by those of the
rest. Each source's documents stand on a line of tokens, in the order of the input. Buckets of about `bucket_tokens`
of output cut all lines where the plan says, so a bucket holds the part of every source that its windows need, and
goes on in the window, and with the deficits, where the last one stopped. A bucket is one task's; documents are cut where a
bucket, a window or a source's share of it ends."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, send_if_small
from .tokens import Encoder, slices, tokenizer_path

GROUP = 1024  # buckets, or tasks, in a block of the running sums
SLICE = 2 << 20  # bytes of text that are encoded together


def encode(docs: DataFrame, vocabulary: str, ranks: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, part, inside, n and ids (little-endian, in two bytes each where the vocabulary allows) of every row; null texts are
    empty. part: the task; inside: tokens of the row's source before it in that task."""

    def run(batches):
        to = Encoder.get(vocabulary, ranks)
        part_id, upto = TaskContext.get().partitionId(), {}
        end = np.array([end_id], np.uint32)
        for b in batches:
            at = 0
            for part in slices(b.column("text"), SLICE):
                ids, count = to.batch(part)
                ends = np.cumsum(count)
                all_ids = [np.concatenate([ids[e - c : e], end]) for e, c in zip(ends.tolist(), count.tolist())]
                narrow = np.uint16 if max(end_id, int(to.size.shape[0])) < 1 << 16 else np.uint32
                inside = []
                for source, c in zip(b.column("source").slice(at, len(part)).to_pylist(), (count + 1).tolist()):
                    inside.append(upto.get(source, 0))
                    upto[source] = inside[-1] + c
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(at, len(part)) for c in ("id", "source")), pa.array(np.full(len(part), part_id, np.int64)), pa.array(inside, pa.int64()), pa.array(count + 1, pa.int64()), pa.array([x.astype(narrow).tobytes() for x in all_ids], pa.binary())],
                    ["id", "source", "part", "inside", "n", "ids"],
                )
                at += len(part)

    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(source, F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, source string, part bigint, inside bigint, n bigint, ids binary")


def shares(want: np.ndarray, left: np.ndarray, weight: np.ndarray, room: int) -> np.ndarray:
    """Whole numbers near `want` that sum to room, or to all that is left, none over `left`."""
    take = np.minimum(left, np.maximum(0, np.floor(want)).astype(np.int64))
    over = int(take.sum()) - room
    if over > 0:
        order = np.argsort(-want, kind="stable")
        before = np.cumsum(take[order]) - take[order]
        take[order] = np.clip(room - before, 0, take[order])
    while (short := min(room, int(left.sum())) - int(take.sum())) > 0:
        open_ = left > take
        w = np.where(open_, weight, 0.0)
        more = np.floor(short * w / w.sum()).astype(np.int64) if w.sum() > 0 else np.zeros_like(take)
        more = np.minimum(more, left - take)
        if not more.any():
            for k in np.argsort(np.where(open_, take - want, np.inf), kind="stable")[: int(open_.sum())]:
                more[k] = 1
                if more.sum() == short:
                    break
        take += more
    return take


class Plan:
    """How many tokens of a source the first x tokens of the output hold: straight between knots (xs, ys), whole numbers that end in the
    numbers of all tokens and of the source's."""

    def __init__(self, xs: list[int], ys: list[int]):
        self.xs, self.ys = np.array(xs, np.float64), np.array(ys, np.float64)

    def of(self, x: float) -> float:
        return float(np.interp(x, self.xs, self.ys))

    def upto(self, x: float) -> int:
        return int(self.of(x))

    def bucket(self, token: int, size: int) -> int:
        """The bucket whose part of the source's line holds a token."""
        k = int(np.interp(token, self.ys, self.xs)) // size
        while k and self.upto(k * size) > token:
            k -= 1
        while self.upto((k + 1) * size) <= token:
            k += 1
        return k


def knots(totals: dict[str, int], weights: dict[str, float], rest: int) -> tuple[list[int], dict[str, list[int]], list[int]]:
    """xs; ys of each weighted source; ys of all others together. totals: tokens of the weighted sources; rest: of the others, which
    come when no weighted source is left."""
    left = {s: n for s, n in totals.items() if n and weights.get(s, 0) > 0}
    xs, ys, done = [0], {s: [0] for s in left}, dict.fromkeys(left, 0)
    while left:
        whole = sum(weights[s] for s in left)
        most = min(n * whole / weights[s] for s, n in left.items())
        ended = [s for s, n in left.items() if n * whole / weights[s] <= most * (1 + 1e-12)]
        for s in left:
            done[s] += left[s] if s in ended else min(left[s], int(most * weights[s] / whole))
        left = {s: totals[s] - done[s] for s in left if totals[s] > done[s]}
        xs.append(sum(done.values()))
        for s in ys:
            ys[s].append(done[s])
    return [*xs, xs[-1] + rest], {s: [*y, y[-1]] for s, y in ys.items()}, [*[0] * len(xs), rest]


def _cut(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (lo, n, xs, ys and others) cut where buckets end: bucket, lo (on the source's line), start (in the document), size. With ids if
    width, the bytes of one."""
    plans: dict[str, Plan] = {}
    for b in batches:
        at, cuts = [], []
        for i, (source, lo, n) in enumerate(zip(b.column("source").to_pylist(), b.column("lo").to_pylist(), b.column("n").to_pylist())):
            if source not in plans:
                plans[source] = Plan(b.column("xs")[i].as_py(), b.column("ys")[i].as_py())
            plan, place = plans[source], lo
            k = plan.bucket(lo, size)
            while place < lo + n:
                end = min(lo + n, plan.upto((k + 1) * size))
                if end > place:
                    at.append(i)
                    cuts.append((k, place, place - lo, end - place))
                place, k = end, k + 1
        longs = [pa.array([c[j] for c in cuts], pa.int64()) for j in range(4)]
        names = ["bucket", "lo", "start", "size"]
        take = pa.array(at, pa.int64())
        if not width:
            yield pa.RecordBatch.from_arrays([b.column("source").take(take), *longs], ["source", *names])
            continue
        ids = b.column("ids")
        parts = [ids[i].as_buffer()[width * c[2] : width * (c[2] + c[3])].to_pybytes() if c[3] < n else ids[i].as_py() for i, c, n in zip(at, cuts, b.column("n").take(take).to_pylist())]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "source", "n")), *longs, pa.array(parts, pa.binary())], ["id", "source", "n", *names, "ids"])


def _pack(docs: pa.Table, plan: pa.Table, length: int, size: int, narrow: np.dtype) -> pa.Table:
    """The pieces of one bucket. docs: what it holds of each document (n, lo, start, size, ids); plan: of each source in it, with base, the
    tokens of all buckets before, and first, the source's."""
    names = plan.column("source").to_pylist()
    lines = [Plan(x, y) for x, y in zip(plan.column("xs").to_pylist(), plan.column("ys").to_pylist())]
    base = place = plan.column("base")[0].as_py() if plan.num_rows else 0
    begin = plan.column("bucket")[0].as_py() * size if plan.num_rows else 0
    docs = docs.sort_by([("source", "ascending"), ("lo", "ascending")])
    code = {s: i for i, s in enumerate(names)}
    of = np.array([code[s] for s in docs.column("source").to_pylist()], np.int64)
    n, cut = docs.column("size").to_numpy(), docs.column("start").to_numpy()
    ids = docs.column("ids")
    queue = [np.flatnonzero(of == k) for k in range(len(names))]
    left = np.bincount(of, n, len(names)).astype(np.int64)
    served = plan.column("first").to_numpy().astype(np.int64).copy()
    head, used = [0] * len(names), [0] * len(names)  # next document of each queue, and how much of it is gone
    rows, start, long, crc, seq, offset = [], [], [], [], [], []
    held: dict[int, np.ndarray] = {}
    due = np.array([x.of(begin) for x in lines])
    while left.any():
        room = min(length - place % length, int(left.sum()))
        upto = np.array([x.of(begin + place + room - base) for x in lines])
        take = shares(upto - served, left, upto - due, room)  # what is due by the end of the window, deficits included
        due = upto
        served += take
        left -= take
        for k in np.flatnonzero(take).tolist():
            todo = int(take[k])
            while todo:
                d = int(queue[k][head[k]])
                if d not in held:
                    held[d] = np.frombuffer(ids[d].as_py(), narrow)
                c = min(todo, int(n[d]) - used[k])
                rows.append(d)
                start.append(int(cut[d]) + used[k])
                long.append(c)
                crc.append(zlib.crc32(held[d][used[k] : used[k] + c].astype("<u4").tobytes()))
                seq.append(place // length)
                offset.append(place % length)
                place += c
                todo -= c
                used[k] += c
                if used[k] == n[d]:
                    held.pop(d)
                    head[k] += 1
                    used[k] = 0
    longs = lambda x: pa.array(x, pa.int64())
    at = longs(rows)
    return pa.table({"id": docs.column("id").take(at), "start": longs(start), "length": longs(long), "ids_crc32": longs(crc), "doc_tokens": docs.column("n").take(at), "sequence_id": longs(seq), "offset": longs(offset), "source": docs.column("source").take(at)})


def running(df: DataFrame, by: list[str], turn: str, out: str) -> DataFrame:
    """by, turn and out: the sum of n over the rows before in turn, in blocks of turns; a row for each by and turn."""
    block = df.withColumn("block", F.floor(F.col(turn) / GROUP))
    inside = Window.partitionBy(*by, "block").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    blocks = block.groupBy(*by, "block").agg(F.sum("n").alias("b"))
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "block", F.coalesce(F.sum("b").over(across), F.lit(0)).alias("b"))
    return block.join(blocks, [*by, "block"]).select(*by, turn, (F.col("b") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias(out))


def planned(sums: DataFrame, total: int, weights: dict[str, float] | None) -> DataFrame:
    """source, xs, ys from sums (source, n). Only the sums of the weighted sources reach the driver."""
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        return totals.select("source", F.array(F.lit(0), F.lit(total)).cast("array<long>").alias("xs"), F.array(F.lit(0), F.col("n")).cast("array<long>").alias("ys"))
    have = {r.source: r.n for r in totals.where(F.col("source").isin(list(weights))).collect()}
    have = {s: n for s, n in have.items() if weights[s] > 0}
    xs, ys, rest = knots(have, weights, total - sum(have.values()))
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<long>")
    own = F.lit(None).cast("array<long>")
    for s, y in ys.items():
        own = F.when(F.col("source") == s, longs(y)).otherwise(own)
    # the others share what is left by their sizes
    other = F.array(*(F.lit(0) for _ in rest[:-1]), F.col("n")).cast("array<long>")
    return totals.select("source", longs(xs).alias("xs"), F.coalesce(own, other).alias("ys"))


def pack(docs: DataFrame, length: int = 2048, weights: dict[str, float] | None = None, bucket_tokens: int = 1 << 20, end_id: int = 1, vocabulary: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    weights: target token proportions by source; None: those of the corpus. When a source has run out, the others keep their proportions
    among themselves; sources without a weight come when all others have run out, by their sizes. Every document is packed. Null texts are
    empty (one token, end_id); null sources are one source; repeated rows are packed each; other columns are ignored; an
    empty table gives an empty result."""
    vocabulary = vocabulary or tokenizer_path("byte_bpe_50k.json")
    ranks = ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    rows = materialize(encode(docs, vocabulary, ranks, end_id, id_col, text_col, source_col), "packing-ids")
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    sums = materialize(rows.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    if not total:
        return docs.sparkSession.createDataFrame([], out)
    wide = rows.limit(1).select((F.length("ids") / F.col("n")).cast("int")).first()[0]
    narrow = np.dtype("<u4" if wide == 4 else "<u2")
    lines = running(sums, ["source"], "part", "before").join(planned(sums, total, weights), "source")
    lines = send_if_small(materialize(lines, "packing-lines"), row_bytes=200)
    placed = rows.join(lines, ["part", "source"]).withColumn("lo", F.col("before") + F.col("inside"))
    narrowed = placed.select("source", "lo", "n", "xs", "ys").mapInArrow(lambda it: _cut(it, bucket_tokens, 0), "source string, bucket bigint, lo bigint, start bigint, size bigint")
    held = materialize(narrowed.groupBy("bucket", "source").agg(F.sum("size").alias("n"), F.min("lo").alias("first")), "packing-buckets")
    base = running(held.groupBy("bucket").agg(F.sum("n").alias("n")), [], "bucket", "base")
    plan = held.join(base, "bucket").join(planned(sums, total, weights), "source").select("bucket", "source", "base", "first", "xs", "ys")
    parts = placed.select("id", "source", "n", "ids", "lo", "xs", "ys").mapInArrow(lambda it: _cut(it, bucket_tokens, wide), f"id {kind}, source string, n bigint, bucket bigint, lo bigint, start bigint, size bigint, ids binary")
    return parts.groupBy("bucket").cogroup(plan.groupBy("bucket")).applyInArrow(lambda d, p: _pack(d, p, length, bucket_tokens, narrow), out)


def digests(docs: DataFrame) -> DataFrame:
    return pack(docs).withColumnRenamed("id", "doc_id")
