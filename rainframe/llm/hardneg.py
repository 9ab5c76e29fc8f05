"""Hard-negative mining by a pivot table.

Vectors of integers get one more component that brings all to the greatest length M; queries get a zero there. Then the squared
distance of query and row is |q|^2 + M^2 - 2 q.x: the greatest inner products are the least distances, and the triangle inequality
holds. The table keeps each row's distances to a few pivots, and is written sorted by label, nearest pivot and distance. From
it alone, |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) brackets the scores of a block of neighbours, then those of its rows; only
rows whose bracket reaches into a window that a query asks for have their inner product worked out.

Queries (the anchors) are sent to all tasks in blocks of a fixed size, and every block meets all rows. A task keeps the best few of
each window, so what is shuffled grows with anchors and tasks, not with rows. The search runs twice: rows of the anchor's own label without
bounds give positives, rows of other labels within the windows of the positives' scores give negatives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

PIVOTS = 16
SAMPLE = 256  # rows from which pivots are taken; which they are changes the work, never the result
ANCHORS = 8192  # of a block, at most some 64 KB of components and bounds each
ROWS = 256  # of a block of neighbours
BUFFER = 200_000  # scores held before they are merged


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors stored as bytes of 64-bit integers; shorter ones are filled up with zeros."""
    raw = column.to_pylist()
    if all(len(x) == 8 * width for x in raw):
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), width)
    out = np.zeros((len(raw), width), np.int64)
    for i, x in enumerate(raw):
        out[i, : len(x) // 8] = np.frombuffer(x, "<i8")
    return out


def whole_numbers(vectors: DataFrame, anchor: Column, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, anchor, x (floor(scale * component), as bytes), width and norm2 of the rows that take part."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).alias("v"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            ends = np.cumsum(np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), np.int64))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = bad[ends] == bad[starts]
            whole = np.floor(np.where(np.isfinite(flat), flat, 0) * scale)
            if (np.abs(whole) >= 2.0**31).any():
                raise ValueError("components beyond 2**31 have no scores of 64 bits")
            whole = whole.astype("<i8")
            kept = np.flatnonzero(fine)
            out = b.select(["id", "label", "anchor"]).take(pa.array(kept))
            x = [whole[starts[i] : ends[i]].tobytes() for i in kept]
            norms = [float(np.dot(w := whole[starts[i] : ends[i]].astype(np.float64), w)) for i in kept]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(x, pa.binary()), pa.array((ends - starts)[kept].astype(np.int32)), pa.array(norms, pa.float64())], ["id", "label", "anchor", "x", "width", "norm2"])

    return rows.mapInArrow(floors, "id long, label string, anchor boolean, x binary, width int, norm2 double")


class Space:
    """Augmented vectors and their distances to the pivots."""

    def __init__(self, width: int, most: float):
        self.width, self.most = width, most
        self.slack = 1e-6 * (1 + math.sqrt(most))  # rounding of a distance is far below
        self.pivots = np.zeros((0, width + 1))

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))[:, None]])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * self.most - 2 * self.augmented(x) @ self.pivots.T))

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] + self.most - 2 * q @ self.pivots[:, :-1].T))

    def choose(self, sample: np.ndarray, n: int) -> None:
        """n pivots of the sample, each the farthest from those before it."""
        x = self.augmented(sample)
        picked = [0] if len(x) else []
        near = ((x - x[:1]) ** 2).sum(axis=1)
        while 0 < len(picked) < min(n, len(x)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        self.pivots = x[picked]


def pivot_table(rows: DataFrame, space: Space) -> DataFrame:
    """rows with d, the distances to the pivots as bytes, written in order of label, nearest pivot and distance."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = space.rows(_matrix(b.column("x"), space.width))
                near = d.argmin(axis=1)
                extra = [pa.array([r.tobytes() for r in d], pa.binary()), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "anchor", "x")), *extra], ["id", "label", "anchor", "x", "d", "near", "far"])

    order = ["label", "near", "far", "id"]
    found = rows.mapInArrow(measured, "id long, label string, anchor boolean, x binary, d binary, near int, far double")
    return materialize(found.repartitionByRange(*order).sortWithinPartitions(*order), "pivot-table")


class Asked:
    """A block of anchors with the windows lo..hi of scores that each asks for, and the best k found of each window."""

    def __init__(self, table: pa.Table, space: Space, k: int, buffer: int = BUFFER):
        windows = max((len(x) for x in table.column("lo").to_pylist()), default=0)
        self.k, self.buffer, self.key = k, buffer, table.column("aid").to_numpy()
        self.id, self.label = table.column("id").to_numpy(), np.asarray(table.column("label").to_pylist(), object)
        self.x = _matrix(table.column("x").combine_chunks(), space.width)
        self.norm = (self.x.astype(np.float64) ** 2).sum(axis=1)
        self.d = space.queries(self.x)
        top = 2**62
        self.lo, self.hi = np.full((len(self.key), windows), top, np.int64), np.full((len(self.key), windows), -top, np.int64)
        for name, to in (("lo", self.lo), ("hi", self.hi)):
            for i, x in enumerate(table.column(name).to_pylist()):
                to[i, : len(x)] = x
        empty = np.zeros(0, np.int64)
        self.best = [(empty, empty, empty)] * windows
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def offer(self, a: np.ndarray, score: np.ndarray, i: np.ndarray) -> None:
        fits = ((score[:, None] >= self.lo[a]) & (score[:, None] <= self.hi[a])).any(axis=1)
        self.waiting.append((a[fits], score[fits], i[fits]))
        self.n_waiting += int(fits.sum())
        if self.n_waiting > self.buffer:
            self.merge()

    def merge(self) -> None:
        """Take in what waits; a window that has k rows asks for no score below its last any more."""
        if not self.n_waiting:
            return
        a, score, i = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        for w, have in enumerate(self.best):
            fits = (score >= self.lo[a, w]) & (score <= self.hi[a, w])
            A, S, I = (np.concatenate([h, x[fits]]) for h, x in zip(have, (a, score, i)))
            order = np.lexsort((I, -S, A))
            A, S, I = A[order], S[order], I[order]
            first = np.flatnonzero(np.r_[True, A[1:] != A[:-1]]) if len(A) else np.zeros(0, np.int64)
            turn = np.arange(len(A)) - np.repeat(first, np.diff(np.r_[first, len(A)]))
            last = turn == self.k - 1
            self.lo[A[last], w] = np.maximum(self.lo[A[last], w], S[last])
            self.best[w] = tuple(x[turn < self.k] for x in (A, S, I))

    def scan(self, space: Space, same: bool, label: str, ids: np.ndarray, x: np.ndarray, d: np.ndarray) -> None:
        """A block of neighbours of one label."""
        who = np.flatnonzero((self.label == label) == same)
        need, limit = self.lo[who].min(axis=1), self.hi[who].max(axis=1)
        # distances at which a score is still need, and already limit
        total = self.norm[who] + space.most
        reach = np.sqrt(np.maximum(0, total - 2.0 * need)) + space.slack
        inner = np.sqrt(np.maximum(0, total - 2.0 * limit)) - space.slack
        least, most = d.min(axis=0), d.max(axis=0)
        mine = self.d[who]
        gap = np.maximum(least - mine, mine - most).max(axis=1)
        fits = (2.0 * need <= total + 1) & (need <= limit) & (gap <= reach) & ((mine + most).min(axis=1) >= inner)
        who, mine, reach, inner = who[fits], mine[fits], reach[fits], inner[fits]
        for s in range(0, len(who), 1024):
            w, m = who[s : s + 1024], mine[s : s + 1024]
            low = np.zeros((len(w), len(ids)))
            high = np.full((len(w), len(ids)), np.inf)
            for p in range(d.shape[1]):
                np.maximum(low, np.abs(m[:, p, None] - d[None, :, p]), out=low)
                np.minimum(high, m[:, p, None] + d[None, :, p], out=high)
            a, r = np.nonzero((low <= reach[s : s + 1024, None]) & (high >= inner[s : s + 1024, None]) & (self.id[w][:, None] != ids[None, :]))
            if not len(a):
                continue
            exact = np.float64 if space.most < 2.0**53 else np.int64
            if 8 * len(a) > low.size:
                score = (self.x[w].astype(exact) @ x.T.astype(exact))[a, r]
            else:
                score = np.einsum("ij,ij->i", self.x[w[a]].astype(exact), x[r].astype(exact))
            self.offer(w[a], score.astype(np.int64), ids[r])


def search(table: DataFrame, anchors: DataFrame, space: Space, k: int, same: bool, blocks: int, what: str) -> DataFrame:
    """aid, w, score, id, turn: of each anchor's window w the first k rows (ties by id) of its own label, or of other labels.

    anchors: aid, block, id, label, x, lo, hi. A block of them, which has a bounded number of rows, is sent to all tasks at a time."""
    spark = table.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    parts, rows, buffer = [], ROWS, BUFFER
    for block in range(blocks):
        sent = spark.sparkContext.broadcast(anchors.where(F.col("block") == block).toArrow())

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = Asked(sent.value, space, k, buffer)
            for b in batches if len(asked.key) else ():
                if not b.num_rows:
                    continue
                ids, labels = b.column("id").to_numpy(), np.asarray(b.column("label").to_pylist(), object)
                x, d = _matrix(b.column("x"), space.width), np.frombuffer(b"".join(b.column("d").to_pylist()), "<f8").reshape(b.num_rows, -1)
                cuts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
                for begin, end in zip(cuts, np.r_[cuts[1:], len(ids)]):
                    for s in range(begin, end, rows):
                        e = min(s + rows, end)
                        asked.scan(space, same, labels[s], ids[s:e], x[s:e], d[s:e])
                asked.merge()
            asked.merge()
            for w, (a, score, i) in enumerate(asked.best):
                yield pa.RecordBatch.from_arrays([pa.array(asked.key[a]), pa.array(np.full(len(a), w, np.int32)), pa.array(score), pa.array(i)], ["aid", "w", "score", "id"])

        found = table.select("id", "label", "x", "d").coalesce(tasks).mapInArrow(scan, "aid long, w int, score long, id long")
        parts.append(materialize(found, what))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    turn = F.row_number().over(Window.partitionBy("aid", "w").orderBy(F.desc("score"), "id"))
    return every.withColumn("turn", turn).where(F.col("turn") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x); scores are inner products of those, exact. An anchor's positives are the first `positives` rows
    of its label with another id, highest scores first, ties by smaller id; for each, the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Rows with a null id, label or vector, or a null or non-finite
    component, take no part; shorter vectors count as filled up with zeros. Repeated rows are rows each. Other columns are ignored; an empty
    table, or one without anchors, gives an empty result. Components of 2**31 or more after scaling are an error."""
    spark = vectors.sparkSession
    rows = materialize(whole_numbers(vectors, anchor, id_col, vec_col, label_col, scale), "pivot-rows")
    size = rows.agg(F.max("width").alias("width"), F.max("norm2").alias("most"), F.count_if("anchor").alias("n")).first()
    space = Space(size.width or 0, size.most or 0.0)
    if space.most >= 2.0**62:
        raise ValueError("inner products do not fit in 64 bits")
    sample = rows.orderBy(F.xxhash64("id", "x"), "id", "x").limit(SAMPLE).select("x").toArrow()
    space.choose(_matrix(sample.column("x").combine_chunks(), space.width), pivots)
    table = pivot_table(rows, space)
    blocks = max(1, -(-size.n // ANCHORS))
    found = table.where("anchor").select(F.monotonically_increasing_id().alias("aid"), "id", "label", "x")
    asking = materialize(found.withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int")), "pivot-anchors")
    far = F.array(F.lit(-(2**62)).cast("long")), F.array(F.lit(2**62).cast("long"))
    best = materialize(search(table, asking.withColumns({"lo": far[0], "hi": far[1]}), space, positives, True, blocks, "pivot-same"), "pivot-positives")
    # integer bounds: the least score of low % at least, the greatest of high % at most
    bounds = best.select("aid", F.struct(F.col("turn"), F.expr(f"({low} * score) div 100 + CASE WHEN ({low} * score) % 100 > 0 THEN 1 ELSE 0 END").alias("lo"), F.expr(f"({high} * score) div 100 - CASE WHEN ({high} * score) % 100 < 0 THEN 1 ELSE 0 END").alias("hi")).alias("b"))
    windows = bounds.groupBy("aid").agg(F.sort_array(F.collect_list("b")).alias("b"))
    asking2 = materialize(asking.join(windows, "aid").select("aid", "block", "id", "label", "x", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")), "pivot-windows")
    other = search(table, asking2, space, negatives, False, blocks, "pivot-other")
    head = best.join(asking.select("aid", F.col("id").alias("anchor_id")), "aid").select("aid", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("turn") - 1).alias("w"))
    tail = other.select("aid", "w", F.col("turn").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return head.join(tail, ["aid", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digests(embeddings: DataFrame) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)
