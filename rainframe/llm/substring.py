"""Substring dedup by compaction of a de Bruijn graph of word k-mers.

Every window of k words is an edge from the node of its first k - 1 words to that of its last. Few windows can occur
twice, so not all become rows: each window belongs to its anchor, the least hash among its shorter word runs, equal windows
share it, and only windows under anchors found twice go on. Consecutive ones of a text under one anchor are a path, one
row, known by a 128-bit digest of the words that stand there; equal paths are counted first.

The graph is of the edges that occur twice or more. A path that is the only one under its anchor is a segment as it is. Where
an anchor has several paths (the ends of repeated spans), their edges become rows; those that occur twice and follow one
another through a node with one way in and one way out are a segment. Segments are joined through such nodes, by joins that
double the reach of every pointer, into the repeated nonbranching paths, and what a text shares are runs of places
in those, with their source coordinates (document key, first word). Where a run is a part of a path, the words that stand
there are compared with those at the coordinates of the path's representative. Runs are put together to long
spans, and their words are cut.

Rows of one text are one text with its number of copies: copies add to how often a window occurs, and to nothing else until the
result is dealt to the rows. Keys that occur in many documents are pre-aggregated before they are shuffled, and joins with them are plain equi-joins that
adaptive execution can split; windows in Spark's sense hold one path of at most PATH edges, or the paths of one text."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .shared import materialize, send_if_small
from .tokens import pieces
from .words import Spans, hash_words, sliding

PATH = 60  # edges in a path at most


class Repeats(NamedTuple):
    """base: a row per document; texts: a row per different text with an anchor found elsewhere too; runs: for each
    text its verified runs (s: first word, len: windows, unit and at: the nonbranching path and the place in it).
    k1, k2: the text's key."""

    base: DataFrame
    texts: DataFrame
    runs: DataFrame
    k: int


def document_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of id and text. Rows alike in both share it; they are repeats of each other anyway."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2")]


def text_key(text_col: str) -> list[Column]:
    """128 bits of the text."""
    return [F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2")]


def anchors(x: Spans, k: int, a: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of each window's a-word runs, and the hashes of all a-word runs."""
    h = x.windows(a)
    return sliding(np.minimum, h, k - a + 1), h


def _scan(batches, k: int, a: int):
    w = k - a + 1
    for b in pieces(batches, "text"):
        n_words, shas, found, twice = [], [], [], []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            words = (t or b"").split()
            n_words.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if len(words) < k:
                found.append(None)
                twice.append(None)
                continue
            least, h = anchors(Spans(hash_words(words)), k, a)
            edge = np.zeros(w - 1, np.uint64)
            at = h[h == sliding(np.maximum, np.concatenate([edge, least, edge]), w)]
            u, n = np.unique(at, return_counts=True)
            found.append(u.view(np.int64))
            twice.append(u[n > 1].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("id", "k1", "k2")), pa.array(n_words, pa.int64()), pa.array(shas), pa.array(found, pa.list_(pa.int64())), pa.array(twice, pa.list_(pa.int64()))],
            ["id", "k1", "k2", "n_words", "sha", "anchors", "twice"],
        )


def _paths(batches, k: int, a: int):
    """The paths of each different text of a task; rid numbers the rows of all tasks."""
    squeeze = zstandard.ZstdCompressor()
    seen: set[tuple[int, int]] = set()
    rid = TaskContext.get().partitionId() << 40
    for b in pieces(batches, "text"):
        new = []
        for row, key in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist())):
            if key not in seen:
                seen.add(key)
                new.append(row)
        b = b.take(pa.array(new, pa.int64()))
        out = []
        for t, hit in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("hit")):
            words = t.split()
            x = Spans(hash_words(words))
            least, _ = anchors(x, k, a)
            hits = np.sort(hit.values.to_numpy().view(np.uint64))
            at = np.minimum(np.searchsorted(hits, least), len(hits) - 1)
            wanted = hits[at] == least
            first = np.flatnonzero(wanted & np.concatenate([[True], least[1:] != least[:-1]]))
            last = np.flatnonzero(wanted & np.concatenate([least[1:] != least[:-1], [True]])) + 1
            if (long := last - first > PATH).any():
                cut = [np.arange(s, e, PATH) for s, e in zip(first[long], last[long])]
                first = np.sort(np.concatenate([first, *(c[1:] for c in cut)]))
                last = np.sort(np.concatenate([last, *(c[1:] for c in cut)]))
            nodes = x.windows(k - 1).view(np.int64)
            ends = list(zip(first.tolist(), last.tolist()))
            out.append((squeeze.compress(t), [_digest(words[s : e + k - 1]) for s, e in ends], first, least[first].view(np.int64), [nodes[s : e + 1] for s, e in ends]))
        z, path, start, anchor, nodes = zip(*out) if out else [()] * 5
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rid, rid + len(out))), *(b.column(c) for c in ("k1", "k2", "copies")), pa.array(z, pa.binary()), pa.array(path, pa.list_(pa.binary())), pa.array([s.astype(np.int32) for s in start], pa.list_(pa.int32())), pa.array(anchor, longs), pa.array(nodes, pa.list_(longs))],
            ["rid", "k1", "k2", "copies", "ztext", "path", "start", "anchor", "nodes"],
        )
        rid += len(out)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def edges_of(paths: DataFrame) -> DataFrame:
    """path, n, i, u, v: the edges of each distinct path, in order."""
    m = F.size("nodes") - 1
    both = F.arrays_zip(F.slice("nodes", F.lit(1), m).alias("u"), F.slice("nodes", F.lit(2), m).alias("v"))
    return paths.select("path", "n", F.posexplode(both).alias("i", "e")).select("path", "n", "i", "e.u", "e.v")


def compact(edges: DataFrame, lone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places in repeated nonbranching paths (unit, at): of edges (path, n, i, u, v) that occur twice or more as u, v, home (the
    commonest path that holds the edge), h (its place there), start (where its segment starts there), unit, at; and of lone, whole
    repeated paths (path, u, v, len, and k1, k2, start, where they stand first), as path, len, unit, at."""
    home = F.min(F.struct((-F.col("n")).alias("rare"), "path", "i")).alias("x")  # the commonest path: most occurrences are its own
    again = edges.groupBy("u", "v").agg(F.sum("n").alias("times"), home).where("times > 1")
    again = materialize(again.select("u", "v", F.col("x.path").alias("home"), F.col("x.i").alias("h")), "substring-edges")
    ends = again.select("u", "v").unionByName(lone.select("u", "v"))
    one = lambda side: ends.groupBy(F.col(side).alias("node")).count().where("count = 1").select("node")
    through = materialize(one("v").join(one("u"), "node").withColumn("through", F.lit(True)), "substring-through")
    order = Window.partitionBy("home").orderBy("h")
    joined = again.join(through, again.u == through.node, "left").drop("node").withColumn("through", F.coalesce("through", F.lit(False)))
    goes_on = F.col("through") & (F.coalesce(F.lag("h").over(order), F.lit(-2)) == F.col("h") - 1)
    joined = joined.withColumn("start", F.max(F.when(~goes_on, F.col("h"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = materialize(joined.withColumn("seg", F.xxhash64("home", "start")), "substring-segments")

    segs = joined.groupBy("seg").agg(F.count("*").alias("len"), F.min_by("u", "h").alias("u"), F.max_by("v", "h").alias("v"))
    # lone paths that follow one another where they stand first are a segment from the outset
    line = Window.partitionBy("k1", "k2").orderBy("start")
    lone = lone.join(through, lone.u == through.node, "left").drop("node")
    follows = F.col("through").isNotNull() & (F.lag(F.col("start") + F.col("len")).over(line) == F.col("start"))
    lone = lone.withColumn("follows", F.coalesce(follows, F.lit(False))).withColumn("first", F.max(F.when(~F.col("follows"), F.col("start"))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    lone = lone.select("path", "len", "u", "v", "start", "first", F.xxhash64("k1", "k2", "first", F.lit("lone")).alias("seg"))
    lone = materialize(lone, "substring-lone")
    whole = lone.groupBy("seg").agg(F.sum("len").alias("len"), F.min_by("u", "start").alias("u"), F.max_by("v", "start").alias("v"))
    segs = segs.unionByName(whole)
    last = segs.select(F.col("v").alias("node"), F.col("seg").alias("head"), F.col("len").alias("far")).join(through, "node")
    after = segs.select("seg", F.col("u").alias("node")).join(last, "node").select("seg", "head", "far")
    count = Observation()
    moving = materialize(after.observe(count, F.count("*").alias("left")), "substring-pointers")  # segments with one before; all others are heads
    known, left, before, done = moving, count.get["left"], -1, None
    while left and left != before:  # each round ends some segments of every chain; when none ends, circles are left
        further = known.select(F.col("seg").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        met = moving.join(further, "head", "left").select("seg", F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0).cast("long"))).alias("far"), F.col("next").isNotNull().alias("moves"))
        count = Observation()
        met = materialize(met.observe(count, F.count_if("moves").alias("left")), "substring-pointers")
        at_end = met.where("not moves").drop("moves")
        done = at_end if done is None else done.unionByName(at_end)
        moving = met.where("moves").drop("moves")
        known, before, left = done.unionByName(moving), left, count.get["left"]
    # segments of circles stay as they are
    heads = done if done is not None else moving
    far = F.coalesce("far", F.lit(0).cast("long"))
    placed = joined.join(heads, "seg", "left").select("u", "v", "home", "h", "start", F.coalesce("head", "seg").alias("unit"), (far + F.col("h") - F.col("start")).cast("int").alias("at"))
    lone = lone.join(heads, "seg", "left").select("path", "len", F.coalesce("head", "seg").alias("unit"), (far + F.col("start") - F.col("first")).cast("int").alias("at"))
    return placed, lone


def runs_of(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """path, i, len, home, h, unit, at: runs of edges of a path that follow one another in one segment too."""
    met = edges.select("path", "i", "u", "v").join(placed, ["u", "v"])
    way = ["path", "home", "start", (F.col("h") - F.col("i")).alias("way")]
    turn = F.row_number().over(Window.partitionBy("path", "home", "start", F.col("h") - F.col("i")).orderBy("i"))
    met = met.withColumn("turn", F.col("i") - turn)
    return met.groupBy(*way, "turn").agg(F.min("i").alias("i"), F.count("*").cast("int").alias("len"), F.min("h").alias("h"), F.first("unit").alias("unit"), F.min("at").alias("at")).drop("start", "way", "turn")


def _digests(batches, k: int):
    """Rows (k1, k2, ztext, asked) -> a row for each asked run with the digest of the words that stand there."""
    grow = zstandard.ZstdDecompressor()
    for b in pieces(batches, "ztext", 1 << 20):
        asked = b.column("asked")
        flat = asked.flatten()
        n = asked.value_lengths().to_numpy()
        digs = []
        s, length = (flat.field(c).to_numpy().tolist() for c in ("s", "len"))
        ends = np.cumsum(n).tolist()
        for z, e, c in zip(b.column("ztext").to_pylist(), ends, n.tolist()):
            words = grow.decompress(z).split()
            digs += [_digest(words[s[j] : s[j] + length[j] + k - 1]) for j in range(e - c, e)]
        row = pa.array(np.repeat(np.arange(b.num_rows), n))
        kinds = [f.name for f in flat.type]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("k1", "k2")), *(flat.field(c) for c in kinds), pa.array(digs, pa.binary())], ["k1", "k2", *kinds, "dig"])


RUN = "k1 bigint, k2 bigint, s int, len int, home binary, h int, unit bigint, at int, shows boolean, dig binary"


def verified(texts: DataFrame, each: DataFrame, firsts: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """k1, k2, s, len, unit, at of runs in texts. firsts: where each path stands first (path, k1, k2, start). Runs of the home path itself are known by its digest; of any other path
    those whose words are those of the home path's representative, the occurrence with the least key and first word."""
    placed = lambda r: each.join(r, "path")
    own = placed(runs.where("path = home")).select("k1", "k2", (F.col("start") + F.col("i")).alias("s"), "len", "unit", "at")
    runs = runs.where("path != home")
    found = placed(runs).select("k1", "k2", (F.col("start") + F.col("i")).alias("s"), "len", "home", "h", "unit", "at", F.lit(False).alias("shows"))
    shown = runs.groupBy("home", "h", "len").agg(F.first("unit").alias("unit"), F.first("at").alias("at"))
    shown = shown.join(firsts.withColumnRenamed("path", "home"), "home").select("k1", "k2", (F.col("start") + F.col("h")).alias("s"), "len", "home", "h", "unit", "at", F.lit(True).alias("shows"))
    asked = found.unionByName(shown).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "len", "home", "h", "unit", "at", "shows")).alias("asked"))
    digs = texts.select("k1", "k2", "ztext").join(asked, ["k1", "k2"]).mapInArrow(lambda it: _digests(it, k), RUN)
    digs = materialize(digs, "substring-digests")
    right = digs.where("shows").groupBy("home", "h", "len").agg(F.first("dig").alias("right"))
    same = digs.where("not shows").join(right, ["home", "h", "len"]).where("dig = right")
    return own.unionByName(same.select("k1", "k2", "s", "len", "unit", "at"))


def find_repeats(docs: DataFrame, k: int = 35, anchor: int = 12, id_col: str = "doc_id", text_col: str = "text") -> Repeats:
    """Windows of k words that start at two places or more of all texts, the same text included.

    Null texts have no words; texts under k words have no window; rows alike in text, or in id and text, are repeats
    of each other, one text with a count in all that follows; any other columns are ignored, whatever their names; an empty table gives empty results."""
    if not 1 <= anchor <= k or k < 2:
        raise ValueError("k must be two words at least, and anchor between 1 and k")
    rows = docs.select(F.col(id_col).alias("id"), *text_key(text_col), F.col(text_col).alias("text"))
    of_id = f"id {docs.schema[id_col].dataType.simpleString()}, k1 bigint, k2 bigint"
    base = materialize(rows.mapInArrow(lambda it: _scan(it, k, anchor), f"{of_id}, n_words bigint, sha string, anchors array<bigint>, twice array<bigint>"), "substring-base")

    found = base.select("k1", "k2", F.explode("anchors").alias("anchor"))
    often = base.select(F.explode(F.concat("anchors", "twice")).alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor")
    hit = found.join(often, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("hit"), F.count("*").alias("n"))
    hit = hit.select("k1", "k2", "hit", F.expr("n div size(hit)").alias("copies"))  # every row of a text has all its anchors once
    texts = rows.where(F.octet_length("text") >= 2 * k - 1).join(hit, ["k1", "k2"])
    kinds = "rid bigint, k1 bigint, k2 bigint, copies bigint, ztext binary, path array<binary>, start array<int>, anchor array<bigint>, nodes array<array<bigint>>"
    texts = materialize(texts.mapInArrow(lambda it: _paths(it, k, anchor), kinds), "substring-paths")
    turn = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("rid"))  # a row for each task that met the text
    surplus = materialize(texts.select("rid", "k1", "k2").withColumn("turn", turn).where("turn > 1").select("rid"), "substring-surplus")
    texts = texts.join(send_if_small(surplus), "rid", "left_anti")

    zipped = lambda *c: texts.select("k1", "k2", "copies", F.explode(F.arrays_zip(*c)).alias("p")).select("k1", "k2", "copies", "p.*")
    stands = F.min(F.struct("k1", "k2", "start")).alias("at")
    paths = zipped("path", "start", "anchor", "nodes").groupBy("path").agg(F.sum("copies").alias("n"), stands, F.first("anchor").alias("anchor"), F.first("nodes").alias("nodes"))
    paths = materialize(paths, "substring-distinct")
    branching = paths.groupBy("anchor").count().where("count > 1").select("anchor", F.lit(True).alias("parts"))
    circles = F.size(F.array_distinct("nodes")) < F.size("nodes")
    ends = [F.get("nodes", F.lit(0)).alias("u"), F.element_at("nodes", -1).alias("v"), (F.size("nodes") - 1).alias("len")]
    paths = paths.join(branching, "anchor", "left").withColumn("parts", F.coalesce("parts", circles)).where("parts or n > 1")
    paths = materialize(paths.select("path", "n", "parts", "at.*", *ends, F.when(F.col("parts"), F.col("nodes")).alias("nodes")), "substring-kinds")
    lone = paths.where("not parts").select("path", "u", "v", "len", "k1", "k2", "start")
    edges = edges_of(paths.where("parts"))
    placed, lone = compact(edges, lone)
    each = zipped("path", "start").drop("copies")
    runs = verified(texts, each, paths.select("path", "k1", "k2", "start"), materialize(runs_of(edges, placed), "substring-runs"), k)
    runs = runs.unionByName(each.join(lone, "path").select("k1", "k2", F.col("start").alias("s"), "len", "unit", "at"))
    runs = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "len", "unit", "at")).alias("runs"))
    return Repeats(base, texts, materialize(runs, "substring-spans"), k)


def long_spans(runs: list[dict]) -> list[tuple[int, int, int, int]]:
    """(first word, windows, unit, place in it) of runs put together where one goes on from the other in text and unit."""
    out: list[tuple[int, int, int, int]] = []
    for s, n, unit, at in sorted({(r["s"], r["len"], r["unit"], r["at"]) for r in runs}):
        if out and out[-1][2] == unit and out[-1][0] + out[-1][1] == s and out[-1][3] + out[-1][1] == at:
            out[-1] = (out[-1][0], out[-1][1] + n, unit, out[-1][3])
        else:
            out.append((s, n, unit, at))
    return out


def covered(n: int, runs: list[dict], k: int) -> np.ndarray:
    """Which of n words lie in a window of the runs."""
    step = np.zeros(n + 1, np.int64)
    for s, length, _, _ in long_spans(runs):
        step[s] += 1
        step[s + length - 1 + k] -= 1
    return np.cumsum(step[:n]) > 0


def _cut(batches, k: int):
    grow = zstandard.ZstdDecompressor()
    for b in pieces(batches, "ztext", 1 << 20):
        out = []
        for z, runs in zip(b.column("ztext").to_pylist(), b.column("runs").to_pylist()):
            words = grow.decompress(z).split()
            gone = covered(len(words), runs, k)
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        r, s, t = zip(*out) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2")), pa.array(r, pa.int64()), pa.array(s, pa.string()), pa.array(t, pa.string())], ["k1", "k2", "n_removed", "cut_sha", "kept"])


def cut_texts(found: Repeats) -> DataFrame:
    """k1, k2, n_removed, cut_sha and kept (the words left, joined by one space) of every text that loses words; empty where none does."""
    k = found.k
    both = found.texts.select("k1", "k2", "ztext").join(found.runs, ["k1", "k2"])
    return both.mapInArrow(lambda it: _cut(it, k), "k1 bigint, k2 bigint, n_removed bigint, cut_sha string, kept string")


def repeated_spans(found: Repeats) -> DataFrame:
    """id, first_word, n_words, unit, place: the long repeated spans of every document, as places of nonbranching paths. Spans of
    one text overlap where the graph branches. Documents without repeats have no row; repeated rows have theirs each."""
    k = found.k

    def run(batches):
        for b in batches:
            spans = [long_spans(r) for r in b.column("runs").to_pylist()]
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(s) for s in spans]), pa.int64())
            flat = [x for s in spans for x in s]
            longs = [pa.array([x[j] + (k - 1 if j == 1 else 0) for x in flat], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("k1", "k2")), *longs], ["k1", "k2", "first_word", "n_words", "unit", "place"])

    spans = found.runs.mapInArrow(run, "k1 bigint, k2 bigint, first_word bigint, n_words bigint, unit bigint, place bigint")
    return found.base.select("id", "k1", "k2").join(spans, ["k1", "k2"]).drop("k1", "k2")


def remove_repeats(docs: DataFrame, k: int = 35, anchor: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated windows cut from text_col and n_removed added, in place of a column of that name; texts that lose
    none stay as they are, null texts too. Rows alike in text are repeats of each other and lose all their windows;
    rows of one id with unlike texts are documents of their own; an empty table stays empty."""
    cut = cut_texts(find_repeats(docs, k, anchor, id_col, text_col)).select(F.struct("k1", "k2").alias("cut_key"), "kept", F.col("n_removed").alias("gone"))
    keyed = docs.select(F.struct("*").alias("row"), F.struct(*text_key(text_col)).alias("key"))
    joined = keyed.join(cut, F.col("key") == F.col("cut_key"), "left")
    of = lambda c: F.col("row").getField(c)
    return joined.select(*((F.coalesce("kept", of(c)) if c == text_col else of(c)).alias(c) for c in docs.columns if c != "n_removed"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"))


def digests(docs: DataFrame, k: int = 35, anchor: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    found = find_repeats(docs, k, anchor)
    cut = cut_texts(found).select("k1", "k2", "n_removed", "cut_sha")
    rows = found.base.select("id", "k1", "k2", "n_words", "sha").join(cut, ["k1", "k2"], "left")
    return rows.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))
