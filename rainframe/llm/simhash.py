"""SimHash near-dedup: fingerprints, a binary trie self-join on them, and the groups of linked documents.

Two fingerprints of 64 bits that differ in at most b bits agree on one of b + 1 blocks of bits. For each
block there is one trie, over fingerprints rotated so that this block leads: below a node at the block's
depth the join starts with the pair (node, node) and no error. Pairs of nodes are traversed together, one
bit at a time; each step to different bits costs one error, and pairs over the budget end there.

Spark deals the nodes at the block's depth to tasks. A node with more than `leaf` fingerprints, such as one
that holds a third of the corpus, is first descended by joins on its children (pairs of children are found
from the few error masks the budget allows, never by pairing all), until every pair of nodes is small.
A task returns for its fingerprints one link to the least one reachable inside the task, so links never
number more than the fingerprints dealt out, while no connection is lost."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, send_if_small
from .substring import document_key
from .tokens import pieces
from .words import Spans, hash_words, mix, whole_groups

BITS = 64
FLAT = 32  # values in a node from which on pairs are compared directly, where the budget ends none of them before the leaves


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text: bits set in over half of its shingles' XXH64, 0 without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= shingle:
        h = np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
        cuts = map(whole.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(seed)), np.uint64, n - shingle + 1)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(h, range(1 << 14, len(h), 1 << 14)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (long) of every row. A-Z count as a-z; null and wordless texts have 0."""

    def scan(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of budget + 1 blocks."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def walk(v: np.ndarray, pairs: list[np.ndarray], budget: int, chunk: int = 1 << 18):
    """Traverse pairs of trie nodes over the sorted uint64 values v; yields arrays (i, j) of positions of
    values within the budget. pairs: depth, first and end of either node, errors so far; a node
    with itself is (lo, hi, lo, hi)."""
    start = np.stack([np.asarray(p, np.int64) for p in pairs])
    stack = [(int(d), start[1:, start[0] == d]) for d in np.unique(start[0])]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        depth, now = stack.pop()
        while now.shape[1] > chunk:
            stack.append((depth, now[:, chunk:]))
            now = now[:, :chunk]
        alo, ahi, blo, bhi, used = now
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            near = (i != j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            yield i[near], j[near]
            now = now[:, ~single]
            alo, ahi, blo, bhi, used = now
        most = np.maximum(ahi - alo, bhi - blo)
        flat = (np.minimum(ahi - alo, bhi - blo) >= FLAT) & (most <= np.left_shift(1, np.maximum(budget - used, 0)))
        if depth == BITS:  # equal values, if there are any
            flat[:] = True
        if flat.any():  # the budget outlasts the levels that are left, so no step down would end a pair
            for a, b, c, d, _ in now[:, flat].T.tolist():
                i, j = np.nonzero(np.bitwise_count(v[a:b, None] ^ v[None, c:d]) <= budget)
                apart = i + a != j + c
                yield i[apart] + a, j[apart] + c
            now = now[:, ~flat]
            alo, ahi, blo, bhi, used = now
        if not len(alo):
            continue
        if depth not in zeros:
            zeros[depth] = np.concatenate([[0], np.cumsum((v >> np.uint64(BITS - 1 - depth)) & np.uint64(1) == 0)])
        z = zeros[depth]
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        own = alo == blo
        out = [np.stack([alo, amid, blo, bmid, used]), np.stack([amid, ahi, bmid, bhi, used]), np.stack([alo, amid, bmid, bhi, used + 1]), np.stack([amid, ahi, blo, bmid, used + 1])[:, ~own]]
        new = np.concatenate(out, axis=1)
        new = new[:, (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= budget) & ~((new[0] == new[2]) & (new[1] - new[0] == 1))]
        if new.shape[1]:
            stack.append((depth + 1, new))


class Forest:
    """Least reachable position under links that come in pieces."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def _solve(batches, budget: int):
    """Rows (rot, depth, pa, pb, used, side, v) sorted by cell -> (a, b): each fingerprint and the least linked to it in some cells."""
    for table in whole_groups(batches, ("rot", "depth", "pa", "pb")):
        yield _solve_cells(table, budget)


def _solve_cells(table: pa.Table, budget: int) -> pa.RecordBatch:
    rot, depth, pa_, pb, used, side, v = (table.column(c).to_numpy() for c in ("rot", "depth", "pa", "pb", "used", "side", "v"))
    u = v.view(np.uint64)
    first = np.array([a for a, _ in _blocks(budget)], np.uint64)[rot]
    with np.errstate(over="ignore"):
        fp = np.where(first == 0, u, (u >> first) | (u << ((np.uint64(BITS) - first) % np.uint64(BITS))))
    fps = np.unique(fp.view(np.int64))
    forest = Forest(len(fps))
    order = np.lexsort((u, side, pb, pa_, depth, rot))
    u, side = u[order], side[order]
    at = np.searchsorted(fps, fp.view(np.int64)[order])
    cell = np.stack([x[order].astype(np.int64) for x in (rot, depth, pa_, pb)])
    new = np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(u))
    ones = np.concatenate([[0], np.cumsum(side)])
    mid = hi - (ones[hi] - ones[lo])
    own = cell[2, lo] == cell[3, lo]
    ok = np.where(own, hi - lo > 1, (mid > lo) & (mid < hi))
    pairs = [cell[1, lo], lo, np.where(own, hi, mid), np.where(own, lo, mid), hi, used[order][lo]]
    for i, j in walk(u, [np.asarray(p)[ok] for p in pairs], budget):
        forest.join(at[i], at[j])
    linked = np.flatnonzero(forest.root != np.arange(len(fps)))
    return pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[forest.root[linked]])], ["a", "b"])


def _masks(most: int, bits: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= most]


def links(fps: DataFrame, budget: int = 2, leaf: int = 200_000) -> DataFrame:
    """Links (a, b) that connect exactly those of the distinct long values fps.fp that chains of pairs with
    at most `budget` differing bits connect; no row for values without such a pair."""
    spin = lambda a: F.col("fp") if a == 0 else F.shiftleft("fp", a).bitwiseOR(F.shiftrightunsigned("fp", BITS - a))
    turned = F.explode(F.array(*(F.struct(F.lit(i).alias("rot"), F.lit(w).alias("depth"), spin(a).alias("v")) for i, (a, w) in enumerate(_blocks(budget)))))
    rows = fps.select(turned.alias("x")).select("x.*")
    prefix = F.expr("shiftrightunsigned(v, 64 - depth)")
    cells = rows.select("rot", "depth", prefix.alias("pa"), prefix.alias("pb"), F.lit(0).alias("used"), F.lit(0).alias("side"), "v")

    hot = materialize(cells.groupBy("rot", "depth", "pa", "pb", "used").count().where(F.col("count") > leaf).drop("count"), "simhash-hot")
    if not hot.isEmpty():
        cells = cells.join(hot.select("rot", "depth", "pa"), ["rot", "depth", "pa"], "left_anti").select(cells.columns)
        step, settled = 8, None
        while not hot.isEmpty():
            bits = min(step, BITS - hot.agg(F.max("depth")).first()[0])
            nodes = hot.select("rot", "depth", F.explode(F.array("pa", "pb")).alias("p")).distinct()
            down = F.expr(f"shiftrightunsigned(v, 64 - depth - {bits})")
            depths = [r[0] for r in nodes.select("depth").distinct().collect()]
            parts = [rows.select("rot", F.lit(d).alias("depth"), F.shiftrightunsigned("v", BITS - d).alias("p"), "v").join(nodes.where(F.col("depth") == d), ["rot", "depth", "p"]) for d in depths]
            kids = parts[0]
            for part in parts[1:]:
                kids = kids.unionByName(part)
            kids = materialize(kids.select("rot", "depth", "p", down.alias("kid")).groupBy("rot", "depth", "p", "kid").agg(F.count("*").alias("n")), "simhash-nodes")
            masks = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("e")) for m in _masks(budget, bits)))
            left = hot.join(kids.select("rot", "depth", F.col("p").alias("pa"), F.col("kid").alias("ka"), F.col("n").alias("na")), ["rot", "depth", "pa"])
            left = left.select("*", F.explode(masks).alias("x")).where("used + x.e <= %d" % budget)
            left = left.withColumn("kb", F.shiftleft("pb", bits).bitwiseOR(F.col("ka").bitwiseAND((1 << bits) - 1).bitwiseXOR(F.col("x.m"))))
            both = left.join(kids.select("rot", "depth", F.col("p").alias("pb"), F.col("kid").alias("kb"), F.col("n").alias("nb")), ["rot", "depth", "pb", "kb"])
            both = both.where("pa != pb or ka <= kb").select("rot", (F.col("depth") + bits).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("used") + F.col("x.e")).alias("used"), F.expr("if(ka = kb, na, na + nb)").alias("n"))
            both = materialize(both.where("pa != pb or n > 1"), "simhash-cells")
            done = both.where((F.col("n") <= leaf) | (F.col("depth") == BITS)).drop("n")
            settled = done if settled is None else settled.unionByName(done)
            hot = both.where((F.col("n") > leaf) & (F.col("depth") < BITS)).drop("n")
        for d in [r[0] for r in settled.select("depth").distinct().collect()]:
            at = rows.select("rot", F.shiftrightunsigned("v", BITS - d).alias("p"), "v")
            cell = settled.where(F.col("depth") == d)
            for side, p in enumerate(("pa", "pb")):
                part = cell.where("pa != pb") if side else cell
                cells = cells.unionByName(part.withColumn("side", F.lit(side)).withColumn("p", F.col(p)).join(at, ["rot", "p"]).select(cells.columns))
    by = ["rot", "depth", "pa", "pb"]
    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda it: _solve(it, budget), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node reachable. Alternating
    large and small stars; every round starts from a written table, until each node has one edge or
    is a root. Nodes in many edges are pre-aggregated to a minimum, then joined."""
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        if not ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0").agg(F.count("*")).first()[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "components")


def groups(docs: DataFrame, shingle: int = 3, budget: int = 2, leaf: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id (least id that chains of links reach, itself included) of every row.

    Rows with equal fingerprints are linked, so null and wordless texts form one group, with all other texts
    whose fingerprint has `budget` bits or fewer. A null id never is a component_id unless its group
    has no other. Other columns are ignored; an empty table gives an empty result."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    tied = components(links(distinct.select("fp"), budget, leaf)).select(F.col("node").alias("fp"), "root")
    rooted = materialize(distinct.join(tied, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    return groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id of each group, null ids last; rows alike in id and text are one."""
    return _rows_named(docs, groups(docs.select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text")), shingle, budget, id_col="id"), id_col, text_col)


SLOTS, SLOTS_ALIKE = 8, 3  # least hashes in a sketch, and how many of them texts must share to be compared


def sketch(terms: np.ndarray) -> int:
    """Eight least hashes of a set, eight bits of each. Of sets with a similarity of 0.8, one pair in 800 shares under three."""
    if not len(terms):
        return 0
    least = [mix(terms ^ key).min() for key in _SLOT_KEYS]
    return int(np.array(least, np.uint64).astype(np.uint8).view(np.int64)[0])


_SLOT_KEYS = np.random.default_rng(11).integers(0, 1 << 63, SLOTS).astype(np.uint64)


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; a shorter text with words is one run. A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return _shingles(Spans(hash_words(words)), len(words), n)


def _shingles(spans: Spans, words: int, n: int) -> np.ndarray:
    return np.unique(spans.windows(min(n, words)) ^ np.uint64(max(0, n - words)))


def traits(text: bytes | None, shingle: int, print_shingle: int) -> tuple[int, int, int, int, bytes]:
    """Of a text the hash of its words, the SimHash of its runs of print_shingle words, and of its shingles sketch, number and bins."""
    words = (text or b"").lower().split()
    th = xxhash.xxh3_64_intdigest(b" ".join(words))
    if not words:
        return th, 0, 0, 0, b""
    spans = Spans(hash_words(words))
    terms = _shingles(spans, len(words), shingle)
    return th, majority(spans.windows(min(print_shingle, len(words)))), sketch(terms), len(terms), spread(terms)


def table_count(width: int, errors: int, recall: float) -> int:
    """Tables (20 at least) of which a pair with `errors` differing bits shares the `width` leading bits in one, with
    probability recall."""
    if not width:
        return 1
    share = math.comb(BITS - width, errors) / math.comb(BITS, errors)
    return max(20, math.ceil(math.log(1 - recall) / math.log1p(-share)))


def deal(texts: DataFrame, n: int, errors: int = 8, recall: float = 0.95, per_cell: int = 64, leaf: int = 256, step: int = 8, seed: int = 7) -> DataFrame:
    """(t, level, cell, th, fp, sk): texts (th, fp, sk) in the cells of tries over differently ordered bits, each cell
    a node with about per_cell of n texts. A node with over `leaf` texts is left for its descendants `step` bits further down,
    until nodes are small or hold one fingerprint. Fingerprints in such nodes are written and counted from there, and a fingerprint's
    levels meet its texts before these are spread over the tries, once."""
    width = min(BITS, math.ceil(math.log2(n / per_cell))) if n > per_cell else 0
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(BITS) for _ in range(table_count(width, errors, recall))]
    signed = lambda bits: int(np.array(sum(1 << int(b) for b in bits), np.uint64).view(np.int64))
    cell = lambda upto: F.col("fp").bitwiseAND(F.get(F.array(*(F.lit(signed(o[:upto])) for o in orders)), F.col("t")))
    tries = F.sequence(F.lit(0), F.lit(len(orders) - 1))
    widths = [min(BITS, width + level * step) for level in range(BITS)]
    now, below = texts.select(F.explode(tries).alias("t"), "fp", F.lit(1).alias("n")), []
    for upto in widths[: widths.index(BITS)]:
        now = now.withColumn("cell", cell(upto))
        hot = materialize(now.groupBy("t", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > leaf).select("t", "cell"), "similar-hot")
        if hot.isEmpty():
            break
        now = materialize(now.join(send_if_small(hot), ["t", "cell"], "left_semi").groupBy("t", "fp").agg(F.sum("n").alias("n")), "similar-below")
        below.append(now.select("fp", "t"))
    if not below:
        out = texts.select(F.explode(tries).alias("t"), F.lit(0).alias("level"), "th", "fp", "sk")
    else:
        levels = reduce(DataFrame.unionByName, below).groupBy("fp", "t").agg(F.count("*").cast("int").alias("level"))
        levels = materialize(levels.groupBy("fp").agg(F.map_from_entries(F.collect_list(F.struct("t", "level"))).alias("levels")), "similar-levels")
        out = texts.join(levels, "fp", "left").select(F.explode(tries).alias("t"), "th", "fp", "sk", "levels")
        out = out.select("t", F.coalesce(F.try_element_at("levels", F.col("t")), F.lit(0)).alias("level"), "th", "fp", "sk")
    at = reduce(lambda other, i: F.when(F.col("level") == i, cell(widths[i])).otherwise(other), range(1, len(below) + 1), cell(width))
    return out.select("t", "level", at.alias("cell"), "th", "fp", "sk")


def _linked(batches, budget: int):
    """Rows (t, level, cell, th, fp, sk) sorted by cell and fp -> (a, b): each text and one that it is linked to in its cell."""
    for part in whole_groups(batches, ("t", "level", "cell")):
        th, sk = part.column("th").to_numpy(), part.column("sk").to_numpy()
        v = part.column("fp").to_numpy()
        cell = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("t", "level", "cell")])
        lo = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)]))
        hi = np.append(lo[1:], len(v))
        order = np.lexsort((v.view(np.uint64), np.repeat(np.arange(len(lo)), hi - lo)))
        v, th, sk = v.view(np.uint64)[order], th[order], sk[order]
        ok = hi - lo > 1
        lo, hi = lo[ok], hi[ok]
        forest = Forest(len(v))
        zero = np.zeros(len(lo), np.int64)
        for i, j in walk(v, [zero, lo, hi, lo, hi, zero], budget):
            alike = ((sk[i] ^ sk[j]).view(np.uint8).reshape(-1, SLOTS) == 0).sum(axis=1) >= SLOTS_ALIKE
            forest.join(i[alike], j[alike])
        linked = np.flatnonzero(forest.root != np.arange(len(v)))
        yield pa.RecordBatch.from_arrays([pa.array(th[linked]), pa.array(th[forest.root[linked]])], ["a", "b"])


def similar(sets: list[np.ndarray], percent: int = 80, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sets whose Jaccard similarity is percent / 100 or more, from exact counts."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, term, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times[term] > 1
    _, term = np.unique(term[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(term[-1]) + 1 if len(term) else 0, columns):
        lo, hi = np.searchsorted(term, [at, at + columns])
        has = np.zeros((len(sets), min(columns, int(term[-1]) + 1 - at)), np.float32)
        has[owner[lo:hi], term[lo:hi] - at] = 1
        both += (has @ has.T).astype(np.int64)
    near = (both > 0) & (100 * both >= percent * (size[:, None] + size[None] - both))
    i, j = np.nonzero(near)
    return i[i < j], j[i < j]


def _check(batches, shingle: int, percent: int):
    """Rows (cell, th, text) sorted by cell -> (a, b): each text and the least linked to it in its cell."""

    def solve(cell: pa.Table):
        th = cell.column("th").to_numpy()
        forest = Forest(len(th))
        order = np.argsort(th)
        texts = cell.column("text").cast(pa.binary()).to_pylist()
        i, j = similar([shingles(texts[k], shingle) for k in order], percent)
        forest.join(i, j)
        linked = np.flatnonzero(forest.root != np.arange(len(th)))
        return th[order][linked], th[order][forest.root[linked]]

    for part in whole_groups(batches, CELL, 1):
        cell = np.stack([part.column(c).to_numpy().astype(np.int64) for c in CELL])
        cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
        made = [solve(part.slice(lo, hi - lo)) for lo, hi in zip(cuts, cuts[1:]) if hi - lo > 1]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], ["a", "b"])


def reach(n: int, percent: int) -> int:
    """Least size that a set similar to one of n elements can't have."""
    return n * 100 // percent + 1


def zone_sizes(n: int, percent: int) -> list[int]:
    """Ends of the ranges of sizes up to n's: a similar set is in the same range as a set or in one next to it."""
    ends = [1]
    while ends[-1] <= n:
        ends.append(reach(ends[-1], percent))
    return ends


def signatures(terms: np.ndarray, percent: int = 80) -> np.ndarray:
    """Hashes of parts of a set of evenly spread hashes (sorted, distinct), such that any two sets with a Jaccard similarity of
    percent / 100 or more have one in common.

    A set of n can differ from such another in k elements at most. Hashes are dealt to parts, of which a pair differs in k at most, so among the
    first parts up to the (k + 1)th that is not empty one is alike and not empty. Sets without so many give all they have, and their least
    hashes, of which there is one more than they can miss: two of these share one of those. The number of parts goes by ranges of sizes: a set
    is in pairs with its own range and, as the larger side, with the range below."""
    n = len(terms)
    if not n:
        return np.zeros(0, np.uint64)
    ends = zone_sizes(n, percent)
    apart = lambda a, b: (a + b) * (100 - percent) // (100 + percent)
    out = []
    for zone in range(max(1, len(ends) - 2), len(ends)):
        m = ends[zone] - 1
        p = apart(m, m * 100 // percent)
        p += 3 + p // 8
        k = apart(n, m if m < n else n * 100 // percent)
        part = (terms >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        with np.errstate(over="ignore"):
            alike = mix(np.add.reduceat(mix(terms ^ _PART_KEY), first) + mix(np.uint64(zone << 32) + part[first]))
        out.append(alike[: k + 1])
        if len(first) <= k:
            out.append(mix(mix(terms[: n - (n * percent + 99) // 100 + 1]) + np.uint64(zone)))
    return np.concatenate(out)


_PART_KEY = np.uint64(0x5851F42D4C957F2D)


def spread(terms: np.ndarray) -> bytes:
    """How many of a set of evenly spread hashes (sorted) stand in each of 2 ** i equal bins, some four to a bin; 255 stands for more."""
    bits = max(4, int(len(terms) // 4).bit_length())
    return np.minimum(np.bincount((terms >> np.uint64(BITS - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, percent: int) -> bool:
    """Whether two sets of n elements together with these bins may have the similarity: bins differ by no more than the sets do."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (x, y))
    if len(x) < len(y):
        x, y = y, x
    return int(np.abs(x.reshape(len(y), -1).sum(axis=1) - y).sum()) * (100 + percent) <= n * (100 - percent)


def shared_signatures(rows: DataFrame) -> DataFrame:
    """The distinct rows (sig, th) whose signature several texts have. Rows of a signature are never held together: what goes from batch to
    batch is one row."""

    def scan(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            sig, th = b.column("sig").to_numpy(), b.column("th").to_numpy()
            if last is not None:
                sig, th = np.r_[last[0], sig], np.r_[last[1], th]
            own = np.concatenate([[True], (sig[1:] != sig[:-1]) | (th[1:] != th[:-1])])
            sig, th = sig[own], th[own]
            equal = sig[1:] == sig[:-1]
            out = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
            told = last is not None and last[2]
            last = sig[-1], th[-1], bool(out[-1]) or (told and len(sig) == 1)
            out[0] &= not told
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(th[out])], ["sig", "th"])

    return rows.select("sig", "th").repartition("sig").sortWithinPartitions("sig", "th").mapInArrow(scan, "sig bigint, th bigint")


def signed(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(sig, th): the signatures of rows.text. They are worked out where they are dealt, as they are too many to be stored."""

    def scan(batches):
        for b in pieces(batches, "text"):
            th, found = [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                words = (t or b"").lower().split()
                if words:
                    th.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                    found.append(signatures(_shingles(Spans(hash_words(words)), len(words), shingle), percent))
            if th:
                own = np.repeat(np.array(th, np.uint64), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (np.concatenate(found), own)], ["sig", "th"])

    return rows.select("text").mapInArrow(scan, "sig bigint, th bigint")


def rooted(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """rows (sig, th, n) with their root (tied: th, root; other texts are their own)."""
    return rows.join(tied, "th", "left").select("sig", "th", "n", F.coalesce("root", "th").alias("root"))


def of_several_roots(rows: DataFrame) -> DataFrame:
    """The rows (sig, th, n, root) whose signature texts of several roots have."""
    return rows.join(rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig"), "sig")


def alone(texts: DataFrame, shingle: int, one_in: int = 1) -> DataFrame:
    """th and alone (how many of its shingles no text of another root has) of different texts (th, root, text). Only a shingle in
    one_in is looked at, by its hash; the others don't count as alone."""

    def scan(batches):
        for b in pieces(batches, "text"):
            terms = [shingles(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            terms = [x[x % np.uint64(one_in) == 0].view(np.int64) for x in terms]
            size = [len(x) for x in terms]
            if any(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(terms)), *(pa.array(np.repeat(b.column(c).to_numpy(), size)) for c in ("th", "root"))], ["term", "th", "root"])

    by_term = Window.partitionBy("term")
    terms = texts.select("th", "root", "text").mapInArrow(scan, "term bigint, th bigint, root bigint")
    return terms.select("th", F.min("root").over(by_term).alias("lo"), F.max("root").over(by_term).alias("hi")).where("lo = hi").groupBy("th").agg(F.count("*").alias("alone"))


def most_pairs(rows: DataFrame, every: bool) -> int:
    """How many rows `sharing` makes of rows at most."""
    return rows.groupBy("sig").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0 if every else rows.count()


def still_open(rows: DataFrame, held: DataFrame, shingle: int, percent: int, every: bool, few: int, first: int = 1) -> DataFrame:
    """Of rows (sig, th, n, root) those of texts that may have the similarity with one of another root. held: th and text of all of them.

    A similar text has percent of a hundred of a text's shingles, so texts go of whose shingles too many are in no open text of
    another root: common passages alone keep no text open. When texts go, others have more shingles alone, so this is repeated while a quarter
    goes, or until the pairs that `sharing` makes are no more than `few`. At first one shingle in `first` is looked at."""
    last = None
    for one_in in chain([first], repeat(1)):
        if most_pairs(rows, every) <= few:
            return rows
        texts = materialize(rows.select("th", "n", "root").distinct(), "similar-open")
        n = texts.count()
        if not n or (last and 4 * n > 3 * last):
            return rows
        last = n if one_in == 1 else None
        found = alone(held.join(send_if_small(texts.select("th", "root"), 16), "th"), shingle, one_in)
        stay = texts.join(found, "th", "left").where(F.coalesce("alone", F.lit(0)) * 100 <= F.col("n") * (100 - percent))
        rows = materialize(of_several_roots(rows.join(send_if_small(materialize(stay.select("th"), "similar-stay"), 8), "th", "left_semi")), "similar-rows")


def sharing(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b, n): texts of different roots with a signature (rows: sig, th, n, root) in common whose sizes allow the similarity, and their
    sizes together. Of a signature each text is paired with one of the least root; with `every`, all with all."""
    side = lambda x, of: of.select("sig", *(F.col(c).alias(x + c) for c in ("th", "n", "root")))
    first = rows if every else rows.groupBy("sig").agg(F.min(F.struct("root", "th", "n")).alias("x")).select("sig", "x.*")
    sized = F.greatest("an", "bn") * percent <= F.least("an", "bn") * 100
    pairs = side("a", first).join(side("b", rows), "sig").where("aroot < broot").where(sized)
    return pairs.select(F.least("ath", "bth").alias("a"), F.greatest("ath", "bth").alias("b"), (F.col("an") + F.col("bn")).alias("n")).distinct()


def with_like_bins(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, n) whose bins allow the similarity."""
    pairs = materialize(pairs, "similar-pairs")
    bins = materialize(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct(), "th", "left_semi").select("th", "bins"), "similar-bins")
    met = pairs.join(bins.select(F.col("th").alias("a"), F.col("bins").alias("x")), "a").join(bins.select(F.col("th").alias("b"), F.col("bins").alias("y")), "b")

    def scan(batches):
        for b in batches:
            x, y, n = (b.column(c).to_pylist() for c in ("x", "y", "n"))
            ok = pa.array([may_be_similar(*v, percent) for v in zip(x, y, n)], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    return met.select("a", "b", "x", "y", "n").mapInArrow(scan, "a bigint, b bigint")


def left_out(signed_: DataFrame, texts: DataFrame, tied: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, percent: int) -> DataFrame:
    """tied (th, root) with the roots joined of all texts that have the similarity, and of some that don't: similar texts share a signature
    (signed_: sig, th), and only texts and pairs go that can't have it.

    Texts that share one are first tied to one text of each signature: what is like it needs no pairs among itself. All pairs are
    made of the texts that this leaves open only."""
    rows = materialize(rooted(shared_signatures(signed_).join(texts.select("th", "n"), "th"), tied), "similar-signed")
    rows = materialize(of_several_roots(rows), "similar-rows")
    held, few = texts_of(rows.select("th").distinct()), texts.count()
    for every in (False, True):
        rows = still_open(rows, held, shingle, percent, every, few, 1 if every else 3)  # a third of the shingles settles most texts
        if rows.isEmpty():
            break
        more = with_like_bins(sharing(rows, percent, every), texts, percent)
        tied = materialize(components(more.unionByName(tied.select(F.col("th").alias("a"), F.col("root").alias("b")))).select(F.col("node").alias("th"), "root"), "similar-candidates")
        rows = materialize(of_several_roots(rooted(rows.select("sig", "th", "n"), tied)), "similar-rows")
    return tied


CELL = ("root", "bi", "bj")


def row_key(id_col: str, text_col: str) -> Column:
    """A row's id and the hashes of its id and text; null ids come last."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), *document_key(id_col, text_col))


def similar_links(texts: DataFrame, block: int, shingle: int, percent: int) -> DataFrame:
    """(a, b), links that connect the texts (root, th, n, text; n: texts under the root) of each root just as all pairs of them
    with the similarity do.

    Up to `block` texts are compared all with all in one task. More are first dealt to blocks by two hashes and compared
    inside the blocks, in proportion to their number; that connects a family of copies. Pairs that this leaves open have a
    side outside the root's largest class: those texts are then compared with all others, block by block."""
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    deal = lambda seed, n: F.pmod(F.xxhash64("th", F.lit(seed)), n.cast("long")).cast("int")
    solve = lambda cells: cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(lambda it: _check(it, shingle, percent), "a bigint, b bigint")
    rounds = F.when(F.col("n") <= block, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    cells = texts.select("root", "th", "text", "n", F.explode(rounds).alias("bi"))
    own = F.when(F.col("n") <= block, 0).when(F.col("bi") == 0, deal(0, n_blocks)).otherwise(deal(1, n_blocks))
    near = materialize(solve(cells.select("root", "bi", own.alias("bj"), "th", "text")), "similar-near")
    large = texts.where(F.col("n") > block)
    if large.isEmpty():
        return near
    near = components(near).select(F.col("node").alias("a"), F.col("root").alias("b"))
    named = large.select("root", "th", "n").join(near.select(F.col("a").alias("th"), F.col("b").alias("class")), "th", "left").withColumn("class", F.coalesce("class", "th"))
    sizes = named.groupBy("root", "class").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    main = sizes.groupBy("root").agg(F.max_by("class", F.struct("c", "class")).alias("main"), (F.first("n") - F.max("c")).alias("n_rest")).where("n_rest > 0")
    main = materialize(main, "similar-main")
    if main.isEmpty():
        return near
    open_ = large.join(main, "root").join(named.select("th", "class"), "th")
    rest_blocks = F.ceil(F.col("n_rest") / block).cast("int")
    side = lambda who, bi, bj: who.select("root", bi.alias("bi"), bj.alias("bj"), "th", "text")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rest = open_.where(F.col("class") != F.col("main"))
    both = side(rest, deal(2, rest_blocks), every(n_blocks)).unionByName(side(open_, every(rest_blocks), deal(0, n_blocks)))
    return near.unionByName(materialize(solve(both.dropDuplicates([*CELL, "th"])), "similar-rest"))


def similar_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, budget: int = 12, print_shingle: int = 2, recall: float = 0.95, block: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (row_key), component_id (the least row_key of its group) and copies (rows with that key) of every row_key. Groups are exactly
    what chains of texts with a Jaccard similarity of percent / 100 on `shingle` words connect.

    Candidates: texts whose fingerprints (of print_shingle words) differ in `budget` bits or fewer, found by walking pairs of nodes of
    binary tries over differently ordered bits. A trie is entered at nodes of some 64 texts, so work grows with the texts,
    not with their square; there are so many tries that a pair with eight differing bits meets in one with probability
    `recall`, nearer ones more surely. Pairs with unlike sketches are passed over. What this leaves out is found by signatures:
    every pair with the similarity has one in common, whatever its fingerprints. Within what chains of candidates
    connect, texts are compared exactly (similar_links). Texts with the same words (A-Z as a-z, by a 64-bit hash) are one;
    wordless and null texts are alike; other columns are ignored; an empty table gives an empty result."""
    rows = docs.select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches):
        for b in pieces(batches, "text"):
            found = [traits(t, shingle, print_shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            th = np.array([x[0] for x in found], np.uint64).view(np.int64)
            more = [pa.array([x[i] for x in found], kind) for i, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(th), *more], ["id", "th", "fp", "sk", "n", "bins"])

    prints = materialize(rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, th bigint, fp bigint, sk bigint, n bigint, bins binary"), "similar-prints")
    texts = materialize(prints.groupBy("th").agg(*(F.first(c).alias(c) for c in ("fp", "sk", "n", "bins")), F.min("id").alias("id")), "similar-texts")
    cells = deal(texts, texts.count(), recall=recall)
    links_ = cells.repartition("t", "level", "cell").sortWithinPartitions("t", "level", "cell").mapInArrow(lambda it: _linked(it, budget), "a bigint, b bigint")
    tied = materialize(components(links_).select(F.col("node").alias("th"), "root"), "similar-near-prints")
    keyed = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))

    def texts_of(asked):  # asked: some ths and what goes with them
        keys = send_if_small(materialize(asked.join(texts.select("th", "id.k1", "id.k2"), "th"), "similar-asked"), 48)
        return materialize(keyed.join(keys, ["k1", "k2"]).dropDuplicates(["th"]).select(*asked.columns, "text"), "similar-held")

    tied = left_out(signed(rows, shingle, percent), texts, tied, texts_of, shingle, percent)
    held = texts_of(tied.join(tied.groupBy("root").agg(F.count("*").alias("n")), "root").select("root", "th", "n"))
    tied = components(similar_links(held, block, shingle, percent)).select(F.col("node").alias("th"), "root")
    roots = materialize(texts.join(tied, "th", "left").select("th", "id", F.coalesce("root", "th").alias("root")), "similar-roots")
    names = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    named = roots.select("root", "th").join(names, "root").select("th", "component_id")
    return prints.groupBy("id", "th").agg(F.count("*").alias("copies")).join(named, "th").select("id", "component_id", "copies")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """Of each of similar_groups the row with the least id, null ids last; rows alike in id and text are one."""
    return _rows_named(docs, similar_groups(docs, id_col=id_col, text_col=text_col, **rule), id_col, text_col)


def _rows_named(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each of the row keys found.id that name their group. Rows that go, and the few keys that several rows
    share, are written as narrow tables; whether they are sent or texts move for the join goes by their sizes."""
    key = F.struct("id.k1", "id.k2")
    own = F.col("id").eqNullSafe(F.col("component_id"))
    copies = F.sum("copies") if "copies" in found.columns else F.count("*")
    kinds = materialize(found.groupBy(key.alias("k")).agg(F.bool_or(own).alias("stays"), copies.alias("copies")).where("not stays or copies > 1"), "named-rows")
    keyed = docs.select(F.struct("*").alias("row"), F.struct(*document_key(id_col, text_col)).alias("key"))
    plain = keyed.join(send_if_small(kinds.select("k")), F.col("key") == F.col("k"), "left_anti")
    shared = kinds.where("stays").select("k")
    if not shared.isEmpty():
        plain = plain.unionByName(keyed.join(send_if_small(shared), F.col("key") == F.col("k"), "left_semi").dropDuplicates(["key"]))
    return plain.select("row.*")
