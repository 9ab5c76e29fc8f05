"""Forests and boosted trees for all groups (zones, months) in one job; models are rows of a table.

Every tree of a forest learns from all rows of its group. Features are binned at exact quantiles of the group, found by selection, and rows
travel packed: bins are bytes. A task grows some trees of a group of up to HELD rows, level by level, all nodes of a level from one count by
node, feature and bin. Of larger groups no task sees all rows: counts are made where rows lie and summed by node, a level a job, until what a
node has left fits a task, which grows the rest of its branch. What a tree draws hangs on its number, the rows' keys and a node's place
alone, so both ways grow the same tree. A model's row is a tree: by, tree, feature (-1: a leaf), threshold (left if at most), child (the left
one; the right is next to it) and value by node. To predict, models are sent to the tasks in blocks of groups of a bounded size, and every row
meets its group's trees in vectorised steps."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.missing import finite
from .quantiles import quantiles

BINS = 64
BLOCK = 8  # trees that one task grows
HELD = 2_000_000  # rows that one task grows trees from
PACKED = 1 << 14  # rows that travel as one
DEALT = 200_000_000  # rows, counted once for each tree, that go to the nodes of large groups at once
TASKS = 1024
ONE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])  # of Poisson's law of mean 1
SENT = 2_000_000  # nodes of models that are sent at once
NODES = "tree int, feature array<int>, threshold array<double>, child array<int>, value array<double>"


@dataclass(frozen=True)
class Forest:
    """Bootstrapped trees; their mean predicts. features: the share of features that a node looks at."""

    trees: int = 300
    depth: int = 12
    least: int = 1
    features: float = 1 / 3
    seed: int = 42


@dataclass(frozen=True)
class Boosted:
    """Trees on what those before leave; their sum predicts."""

    rounds: int = 400
    step: float = 0.05
    depth: int = 3
    least: int = 1
    seed: int = 42


def _mixed(v: np.ndarray) -> np.ndarray:
    """64 bits of each that look drawn (splitmix64)."""
    v = v + np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _salt(rng: np.random.Generator) -> np.uint64:
    return np.uint64(rng.integers(1 << 63))


def _spots(key: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A place in [0, 1) for each key."""
    return (_mixed(_mixed(key.view(np.uint64)) ^ salt) >> np.uint64(11)) * 2.0**-53


def _times(key: np.ndarray, salt: np.uint64) -> np.ndarray:
    """How often a tree's bootstrap draws each row."""
    return np.searchsorted(ONE, _spots(key, salt), "right")


def _looked(places: np.ndarray, features: int, some: int, salt: np.uint64) -> np.ndarray:
    """The features that each node looks at (nodes x some). places: 1 for the root, 2p and 2p + 1 below p."""
    return _mixed(_mixed(places.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)) ^ salt).argsort(axis=1)[:, :some]


def _better(w: np.ndarray, wy: np.ndarray, least: float, looked: np.ndarray, best: np.ndarray, which: np.ndarray, where: np.ndarray) -> None:
    """Sets the gain, feature and bin of nodes that are better cut at a feature. w, wy: weights, and weighted labels, by node and bin."""
    left_w, left_y = w.cumsum(axis=1), wy.cumsum(axis=1)
    all_w, all_y = left_w[:, -1:], left_y[:, -1:]
    right_w, right_y = all_w - left_w, all_y - left_y
    with np.errstate(all="ignore"):
        gain = left_y**2 / left_w + right_y**2 / right_w - all_y**2 / all_w
    gain = np.where((left_w >= max(least, 1e-9)) & (right_w >= max(least, 1e-9)), gain, -np.inf)
    at = gain.argmax(axis=1)
    got = gain[np.arange(len(at)), at]
    better = got > best
    best[better], which[better], where[better] = got[better], looked[better], at[better]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: float, some: int, rng: np.random.Generator | np.uint64, bins: int = BINS, place: int = 1) -> tuple[np.ndarray, ...]:
    """feature, bin, child and value by node of a tree over binned features (rows x features), with the least squared error. A row goes left if
    its bin is at most the node's; both sides weigh `least` at least. place: that of the first node, for a branch (see _looked)."""
    salt = rng if isinstance(rng, np.uint64) else _salt(rng)
    feature, cut, child, value = [-1], [0], [-1], [float((w * y).sum() / w.sum())]
    rows, node = np.flatnonzero(w > 0), np.zeros(int((w > 0).sum()), np.int64)
    flat, wide = np.ascontiguousarray(x).ravel(), x.shape[1]
    active, places = [0], np.array([place])
    for _ in range(depth):
        m = len(active)
        if not m or not len(rows):
            break
        looked = _looked(places, wide, some, salt)
        base, w_, key0 = rows * wide, w[rows], node * bins
        wy = w_ * y[rows]
        best, which, where = np.full(m, 1e-12), np.full(m, -1), np.zeros(m, np.int64)
        for j in range(some):
            of = np.ascontiguousarray(looked[:, j])
            key = key0 + flat.take(base + of.take(node))
            _better(np.bincount(key, w_, m * bins).reshape(m, bins), np.bincount(key, wy, m * bins).reshape(m, bins), least, of, best, which, where)
        first, start = np.full(m, -1), len(feature)
        for i in np.flatnonzero(which >= 0).tolist():
            first[i] = len(feature)
            feature[active[i]], cut[active[i]], child[active[i]] = int(which[i]), int(where[i]), len(feature)
            for _side in range(2):
                feature.append(-1)
                cut.append(0)
                child.append(-1)
                value.append(0.0)
        stays = first[node] >= 0
        rows, node = rows[stays], node[stays]
        node = first[node] + (flat.take(rows * wide + which[node]) > where[node]) - start
        active = list(range(start, len(feature)))
        places = (2 * places[which >= 0][:, None] + np.arange(2)).ravel()
        sums, sizes = np.bincount(node, w[rows] * y[rows], len(active)), np.bincount(node, w[rows], len(active))
        for k, s, n in zip(active, sums.tolist(), sizes.tolist()):
            value[k] = s / n if n else 0.0
    return np.array(feature), np.array(cut), np.array(child), np.array(value)


def levels(feature: np.ndarray, child: np.ndarray) -> int:
    """Steps from the root to the farthest leaf."""
    n, now = 0, np.zeros(1, np.int64)
    while len(now := now[feature[now] >= 0]):
        n, now = n + 1, np.concatenate([child[now], child[now] + 1])
    return n


def follow(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, chunk: int = 1 << 13) -> np.ndarray:
    """The leaf of each row. All rows of a chunk, small enough for a processor's cache, go down together; a leaf leads to itself."""
    leaf = feature < 0
    f, t = np.where(leaf, 0, feature).astype(np.intp), np.where(leaf, np.inf, threshold)
    c = np.where(leaf, np.arange(len(feature)), child).astype(np.intp)
    n = levels(feature, child)
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), chunk):
        flat = np.ascontiguousarray(x[lo : lo + chunk]).ravel()
        node = out[lo : lo + chunk]
        base = np.arange(len(node)) * x.shape[1]
        for _ in range(n):
            right = flat.take(base + f.take(node)) > t.take(node)
            c.take(node, out=node, mode="clip")
            node += right
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bins of each feature, and their upper edges: quantiles, where they are not given."""
    edges = edges or [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    return np.stack([np.searchsorted(e, c, "left").astype(np.uint8) for e, c in zip(edges, x.T)], axis=1), edges


def _thresholds(feature: np.ndarray, cut: np.ndarray, edges: list) -> list[float]:
    return [float(edges[f][min(c, len(edges[f]) - 1)]) if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist())]


def _some(how: Forest, features: int) -> int:
    return min(features, math.ceil(features * how.features - 1e-9))


def _salts(how: Forest, tree: int) -> tuple[np.uint64, np.uint64]:
    """What a tree draws rows and features by."""
    rng = np.random.default_rng((how.seed, tree))
    return _salt(rng), _salt(rng)


def _trees(key: np.ndarray, binned: np.ndarray, y: np.ndarray, w: np.ndarray, edges: list, first: int, how: Forest | Boosted, n: int) -> Iterator[tuple]:
    def row(tree: int, grown: tuple, scale: float = 1.0) -> tuple:
        feature, cut, child, value = grown
        return tree, feature.tolist(), _thresholds(feature, cut, edges), child.tolist(), (value * scale).tolist()

    if isinstance(how, Forest):
        for t in range(first, first + n):
            draw, look = _salts(how, t)
            drawn = w * _times(key, draw)
            yield row(t, grow(binned, y, drawn if drawn.any() else w, how.depth, how.least, _some(how, binned.shape[1]), look))
        return
    mean = float((w * y).sum() / w.sum())
    yield 0, [-1], [0.0], [-1], [mean]
    left = y - mean
    for t in range(1, how.rounds + 1):
        grown = grow(binned, left, w, how.depth, how.least, binned.shape[1], np.random.default_rng((how.seed, t)))
        left = left - how.step * grown[3][follow(binned, grown[0], grown[1], grown[2])]
        yield row(t, grown, how.step)


def _pack(key: np.ndarray, y: np.ndarray, w: np.ndarray, x: np.ndarray) -> bytes:
    """Rows as bytes, column by column; x is rows x features, of any kind."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in (key, y, w, x))


def _packs(key: np.ndarray, y: np.ndarray, w: np.ndarray, x: np.ndarray) -> Iterator[bytes]:
    for lo in range(0, len(key), PACKED):
        at = slice(lo, lo + PACKED)
        yield _pack(key[at], y[at], w[at], x[at])


def _unpacked(packs: list[bytes], features: int, kind: type = np.uint8) -> tuple[np.ndarray, ...]:
    """key, y, w and x of packs, in the order of keys where there are several."""
    size = 24 + features * np.dtype(kind).itemsize
    ns = [len(b) // size for b in packs]
    cut = [[np.frombuffer(b, t, n, 8 * i * n) for i, t in enumerate((np.int64, np.float64, np.float64))] + [np.frombuffer(b, kind, n * features, 24 * n).reshape(n, features)] for b, n in zip(packs, ns)]
    if len(cut) == 1:
        return tuple(cut[0])
    key = np.concatenate([c[0] for c in cut])
    order = np.argsort(key, kind="stable")
    return (key[order], *(np.concatenate([c[i] for c in cut])[order] for i in (1, 2, 3)))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


TREE = {"tree": pa.int32(), "feature": pa.list_(pa.int32()), "threshold": pa.list_(pa.float64()), "child": pa.list_(pa.int32()), "value": pa.list_(pa.float64())}


def fit(rows: DataFrame, by: list[str], features: list[str], label: str, how: Forest | Boosted, weight: Column | None = None, samples: int | None = None, least: int = 1, key: Column | None = None) -> DataFrame:
    """A model for each group with `least` rows: by and NODES, learned from all rows. Rows without a label or a finite feature take no part (impute
    before); groups of null keys have a model too. key: what tells rows apart in draws, their values where it is None. samples: learn each BLOCK
    trees from about so many rows of a group instead. Boosted trees of a group of over HELD rows need it. An empty table gives an empty result."""
    use = rows.where(F.col(label).isNotNull())
    for f in features:
        use = use.where(finite(f).isNotNull())
    key = F.xxhash64(*features, label) if key is None else key
    made = [F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_g"), key.alias("_key"), F.col(label).cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("_w")]
    use = use.select(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)), *made, *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)))
    sizes = use.groupBy("_g").agg(*(F.first(f"_by{i}").alias(f"_by{i}") for i in range(len(by))), F.count("*").alias("_n"))
    sizes = written(sizes.where(F.col("_n") >= max(1, least)), "tree-groups")
    names = [f"_x{i}" for i in range(len(features))]
    is_large = F.lit(samples is None) & (F.col("_n") > HELD)
    large = sizes.where(is_large).orderBy("_g").select("_g", "_n").collect()
    if large and isinstance(how, Boosted):
        raise ValueError(f"boosted trees of over {HELD} rows need samples: {large[0][0]}")
    few, many = (use.join(F.broadcast(sizes.where(c).select("_g", "_n")), "_g") for c in (~is_large, is_large))
    packed = few.select("_g", "_n", "_key", "_y", "_w", F.array(*names).alias("_x")).mapInArrow(_packed_by_group(len(features)), PACKS)
    parts = [_held(packed, _edges(packed if samples is None else None, few, names), len(features), how, samples, sizes.count() - len(large))]
    if large:
        packed = many.select("_g", "_n", "_key", "_y", "_w", F.array(*names).alias("_x")).mapInArrow(_packed_by_group(len(features)), PACKS)
        parts += _spread(packed, _edges(None, many, names), sum(r["_n"] for r in large), len(features), how)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(F.broadcast(sizes), "_g").select(*(F.col(f"_by{i}").alias(b) for i, b in enumerate(by)), *TREE)


PACKS = "_g string, _n long, _rows binary"


def _edges(packed: DataFrame | None, use: DataFrame, names: list[str]) -> DataFrame:
    """_g and _edges, the quantiles of each feature: by selection, or, of packed groups of up to HELD rows, of a feature's values in a task."""
    if packed is None:
        place = F.array_position(F.array(*map(F.lit, names)), F.col("column"))
        cuts = quantiles(use, ["_g"], names, [i / BINS for i in range(1, BINS)]).select("_g", place.alias("i"), F.array_distinct("values").alias("v"))
    else:

        def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    x = _unpacked([r["_rows"]], len(names), np.float64)[3]
                    yield _batch([(r["_g"], i, c.tobytes()) for i, c in enumerate(x.T)], {"_g": pa.string(), "i": pa.int64(), "_v": pa.binary()})

        def cut(group: tuple, table: pa.Table) -> pa.Table:
            x = np.concatenate([np.frombuffer(b) for b in table.column("_v").to_pylist()])
            return pa.Table.from_batches([_batch([(group[0].as_py(), group[1].as_py(), _binned(x[:, None])[1][0].tolist())], {"_g": pa.string(), "i": pa.int64(), "v": pa.list_(pa.float64())})])

        cuts = packed.mapInArrow(columns, "_g string, i long, _v binary").groupBy("_g", "i").applyInArrow(cut, "_g string, i long, v array<double>")
    return written(cuts.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("_edges")), "tree-edges")


def _packed_by_group(features: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            g = b.column("_g").dictionary_encode()
            codes = g.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            key, y, w = (b.column(c).to_numpy()[order] for c in ("_key", "_y", "_w"))
            x = b.column("_x").flatten().to_numpy().reshape(-1, features)[order]
            ends = np.searchsorted(codes[order], np.arange(len(g.dictionary) + 1))
            n = b.column("_n").to_numpy()[order]
            for i, name in enumerate(g.dictionary.to_pylist()):
                at = slice(ends[i], ends[i + 1])
                for p in _packs(key[at], y[at], w[at], x[at]):
                    yield _batch([(name, int(n[ends[i]]), p)], {"_g": pa.string(), "_n": pa.int64(), "_rows": pa.binary()})

    return pack


def _held(packed: DataFrame, edges: DataFrame, features: int, how: Forest | Boosted, samples: int | None, groups: int) -> DataFrame:
    """The trees of groups that a task can hold."""
    count = how.trees if isinstance(how, Forest) else 1
    blocks = -(-count // BLOCK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Binned rows to each block of trees."""
        for b in batches:
            for r in b.to_pylist():
                key, y, w, x = _unpacked([r["_rows"]], features, np.float64)
                x = _binned(x, [np.array(e) for e in r["_edges"]])[0]
                whole = _pack(key, y, w, x)
                for k in range(blocks):
                    if samples is not None and samples < r["_n"]:
                        at = _spots(key, _salt(np.random.default_rng((how.seed, k, 1)))) * r["_n"] < samples
                        whole = _pack(key[at], y[at], w[at], x[at])
                    yield _batch([(r["_g"], k, r["_edges"], whole)], {"_g": pa.string(), "_block": pa.int32(), "_edges": pa.list_(pa.list_(pa.float64())), "_rows": pa.binary()})

    def grown(group: tuple, table: pa.Table) -> pa.Table:
        block, edges = group[1].as_py(), table.column("_edges")[0].as_py()
        key, y, w, x = _unpacked(table.column("_rows").to_pylist(), features)
        made = [(group[0].as_py(), *t) for t in _trees(key, x, y, w, edges, block * BLOCK, how, min(BLOCK, count - block * BLOCK))] if len(y) else []
        return pa.Table.from_batches([_batch(made, {"_g": pa.string(), **TREE})])

    dealt = packed.join(F.broadcast(edges), "_g").mapInArrow(deal, "_g string, _block int, _edges array<array<double>>, _rows binary")
    return dealt.repartition(max(1, min(TASKS, groups * blocks)), "_g", "_block").groupBy("_g", "_block").applyInArrow(grown, f"_g string, {NODES}")


class _Tree:
    """A tree of a large group while its upper nodes are found."""

    def __init__(self) -> None:
        self.feature, self.cut, self.child, self.value, self.place = [-1], [0], [-1], [0.0], [1]
        self.depth, self.open, self.small = [0], [0], []

    def split(self, node: int, feature: int, cut: int, sides: list[tuple[float, int]], depth: int) -> None:
        """sides: value and rows of both. A side is counted on, or left to a task, where it may be cut further."""
        self.feature[node], self.cut[node], self.child[node] = feature, cut, len(self.feature)
        for i, (value, n) in enumerate(sides):
            k = len(self.feature)
            for of, v in ((self.feature, -1), (self.cut, 0), (self.child, -1), (self.value, value), (self.place, 2 * self.place[node] + i), (self.depth, self.depth[node] + 1)):
                of.append(v)
            if self.depth[k] < depth:
                (self.open if n > HELD else self.small).append(k)

    def sent(self, nodes: list[int]) -> tuple[np.ndarray, ...]:
        """feature, bin and child by node; the number among `nodes` of each, or -1; and their places."""
        number = np.full(len(self.feature), -1)
        number[nodes] = np.arange(len(nodes))
        return np.array(self.feature), np.array(self.cut), np.array(self.child), number, np.array(self.place)[nodes]


def _spread(packed: DataFrame, edges: DataFrame, size: int, features: int, how: Forest) -> list[DataFrame]:
    """The trees of groups that no task can hold: upper nodes from counts that are made where rows lie, a level a job, then a task for each
    node that has few rows left."""
    spark = packed.sparkSession
    some = _some(how, features)
    edges_of = {r["_g"]: [np.array(e) for e in r["_edges"]] for r in edges.collect()}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                key, y, w, x = _unpacked([r["_rows"]], features, np.float64)
                yield _batch([(r["_g"], _pack(key, y, w, _binned(x, edges_of[r["_g"]])[0]))], {"_g": pa.string(), "_rows": pa.binary()})

    rows = written(packed.mapInArrow(binned, "_g string, _rows binary"), "tree-rows")
    at_once = max(1, DEALT // size)
    done = []
    for lo in range(0, how.trees, at_once):
        state = {(g, t): _Tree() for g in edges_of for t in range(lo, min(lo + at_once, how.trees))}

        def reached(batches: Iterator[pa.RecordBatch], sent: dict) -> Iterator[tuple]:
            """For each tree of each pack: group, tree, rows drawn (y, weight and bins) at the nodes looked at, their number there, and what grows it."""
            for b in batches:
                for r in b.to_pylist():
                    key, y, w, x = _unpacked([r["_rows"]], features)
                    for t, (feature, cut, child, number, places) in sent.get(r["_g"], {}).items():
                        draw, look = _salts(how, t)
                        w_ = w * _times(key, draw)
                        node = number[follow(x, feature, cut, child)]
                        at = np.flatnonzero((w_ > 0) & (node >= 0))
                        yield r["_g"], t, key[at], y[at], w_[at], x[at], node[at], places, look

        def told(nodes: str):
            """A broadcast of the trees that have nodes of a kind."""
            out: dict[str, dict] = {}
            for (g, t), tree in state.items():
                if getattr(tree, nodes):
                    out.setdefault(g, {})[t] = tree.sent(getattr(tree, nodes))
            return spark.sparkContext.broadcast(out), len(out)

        while any(tree.open for tree in state.values()):
            sent, _ = told("open")

            def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                """Weights, weighted labels and rows by node, feature and bin."""
                sums: dict[tuple, np.ndarray] = {}
                for g, t, _, y, w, x, node, places, look in reached(batches, sent.value):
                    m = len(places)
                    looked = _looked(places, features, some, look)
                    held = sums.setdefault((g, t), np.zeros((m, some, 3, BINS)))
                    for j in range(some):
                        key = node * BINS + x[np.arange(len(node)), looked[node, j]]
                        for i, v in enumerate((w, w * y, None)):
                            held[:, j, i] += np.bincount(key, v, m * BINS).reshape(m, BINS)
                for (g, t), held in sums.items():
                    yield _batch([(g, t, k, h.tobytes()) for k, h in enumerate(held)], {"_g": pa.string(), "tree": pa.int32(), "node": pa.int32(), "_sums": pa.binary()})

            def best(group: tuple, table: pa.Table) -> pa.Table:
                g, t, k = (v.as_py() for v in group)
                sums = np.zeros((some, 3, BINS))
                for b in table.column("_sums").to_pylist():
                    sums += np.frombuffer(b).reshape(some, 3, BINS)
                looked = _looked(sent.value[g][t][4][k : k + 1], features, some, _salts(how, t)[1])
                gain, which, where = np.full(1, 1e-12), np.full(1, -1), np.zeros(1, np.int64)
                for j in range(some):
                    _better(sums[j, 0][None], sums[j, 1][None], how.least, looked[:, j], gain, which, where)
                own = sums[looked[0].tolist().index(which[0]) if which[0] >= 0 else 0]
                sides = [own[:, : where[0] + 1].sum(axis=1), own[:, where[0] + 1 :].sum(axis=1)]
                values = [float(s[1] / s[0]) if s[0] else 0.0 for s in sides]
                made = (g, t, k, int(which[0]), int(where[0]), float(own[1].sum() / own[0].sum()), *values, *(int(s[2]) for s in sides))
                return pa.Table.from_batches([_batch([made], SPLIT)])

            found = rows.mapInArrow(count, "_g string, tree int, node int, _sums binary").groupBy("_g", "tree", "node").applyInArrow(best, "_g string, tree int, node int, feature int, cut int, own double, left double, right double, n_left long, n_right long").collect()
            nodes = {k: tree.open for k, tree in state.items()}
            for tree in state.values():
                tree.open = []
            for r in sorted(found, key=lambda r: (r["_g"], r.tree, r.node)):
                tree, node = state[r["_g"], r.tree], nodes[r["_g"], r.tree][r.node]
                tree.value[node] = r.own
                if r.feature >= 0 and how.depth:
                    tree.split(node, r.feature, r.cut, [(r.left, r.n_left), (r.right, r.n_right)], how.depth)
        sent, left = told("small")

        def deal(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            """Drawn rows to the nodes that a task can hold."""
            for g, t, key, y, w, x, node, places, _ in reached(batches, sent.value):
                for k in range(len(places)):
                    at = node == k
                    if at.any():
                        yield _batch([(g, t, k, _pack(key[at], y[at], w[at], x[at]))], {"_g": pa.string(), "tree": pa.int32(), "node": pa.int32(), "_rows": pa.binary()})

        depths = {k: [tree.depth[n] for n in tree.small] for k, tree in state.items()}

        def branch(group: tuple, table: pa.Table) -> pa.Table:
            g, t, k = (v.as_py() for v in group)
            _, y, w, x = _unpacked(table.column("_rows").to_pylist(), features)
            grown = grow(x, y, w, how.depth - depths[g, t][k], how.least, some, _salts(how, t)[1], place=int(sent.value[g][t][4][k]))
            made = (g, t, k, *(v.tolist() for v in grown))
            return pa.Table.from_batches([_batch([made], BRANCH)])

        kind = "_g string, tree int, node int, feature array<int>, cut array<int>, child array<int>, value array<double>"
        tasks = max(1, min(TASKS, sum(map(len, depths.values())), max(4 * spark.sparkContext.defaultParallelism, size * len(state) // (HELD * len(edges_of)))))
        grown = rows.mapInArrow(deal, "_g string, tree int, node int, _rows binary").repartition(tasks, "_g", "tree", "node").groupBy("_g", "tree", "node").applyInArrow(branch, kind)
        grown = written(grown, "tree-branches") if left else None
        trunk = [(g, t, tree.feature, tree.cut, tree.child, tree.value, tree.small) for (g, t), tree in state.items()]
        trunks = spark.createDataFrame(trunk, "_g string, tree int, feature array<int>, cut array<int>, child array<int>, value array<double>, small array<int>")
        grown = spark.createDataFrame([], kind) if grown is None else grown
        done.append(written(trunks.groupBy("_g", "tree").cogroup(grown.groupBy("_g", "tree")).applyInArrow(_joined(edges_of), f"_g string, {NODES}"), "tree-models"))
    return done


SPLIT = {"_g": pa.string(), "tree": pa.int32(), "node": pa.int32(), "feature": pa.int32(), "cut": pa.int32(), "own": pa.float64(), "left": pa.float64(), "right": pa.float64(), "n_left": pa.int64(), "n_right": pa.int64()}
BRANCH = {"_g": pa.string(), "tree": pa.int32(), "node": pa.int32(), "feature": pa.list_(pa.int32()), "cut": pa.list_(pa.int32()), "child": pa.list_(pa.int32()), "value": pa.list_(pa.float64())}


def _joined(edges_of: dict[str, list]):
    def join(group: tuple, trunk: pa.Table, branches: pa.Table) -> pa.Table:
        """A tree of its upper nodes and the branches below."""
        tree = trunk.to_pylist()[0]
        feature, cut, child, value = (list(tree[c]) for c in ("feature", "cut", "child", "value"))
        for b in sorted(branches.to_pylist(), key=lambda b: b["node"]):
            root, off = tree["small"][b["node"]], len(feature) - 1
            below = [c + off if c >= 0 else -1 for c in b["child"]]
            feature[root], cut[root], child[root], value[root] = b["feature"][0], b["cut"][0], below[0], b["value"][0]
            feature, cut, child, value = feature + b["feature"][1:], cut + b["cut"][1:], child + below[1:], value + b["value"][1:]
        made = (tree["_g"], tree["tree"], feature, _thresholds(np.array(feature), np.array(cut), edges_of[tree["_g"]]), child, value)
        return pa.Table.from_batches([_batch([made], {"_g": pa.string(), **TREE})])

    return join


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of `rows` rows or more, but for the last, so that a group has many rows in one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def predict(rows: DataFrame, models: DataFrame, by: list[str], features: list[str], out: str = "prediction", boosted: bool = False, only: Column | None = None) -> DataFrame:
    """rows with `out`, NULL where a feature or the group's model is missing, or `only` does not hold. models: a written table of fit's rows."""
    spark = rows.sparkSession
    own = [f for f in rows.schema if f.name != out]
    keyed = models.withColumn("_key", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    groups = [(r["_key"], r.n) for r in keyed.groupBy("_key").agg(F.sum(F.size("feature")).alias("n")).orderBy("_key").collect()]
    parts, size = [[]], 0
    for k, n in groups:
        if parts[-1] and size + n > SENT:
            parts.append([])
            size = 0
        parts[-1].append(k)
        size += n
    x = F.array(*(finite(f) for f in features))
    todo = rows.select(*(F.col(f"`{f.name}`") for f in own), F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_key"), F.when(~F.exists(x, lambda v: v.isNull()) & (F.lit(True) if only is None else only), x).alias("_x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", _key string, _x array<double>"
    for part in parts:
        table = keyed.where(F.col("_key").isin(part)).select("_key", "feature", "threshold", "child", "value").toArrow() if part else None
        trees: dict[str, list[tuple]] = {}
        for batch in table.to_batches() if table is not None else ():
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(n) for n in ("feature", "threshold", "child", "value"))]
            for i, k in enumerate(batch.column("_key").to_pylist()):
                trees.setdefault(k, []).append(tuple(v[o[i] : o[i + 1]] for o, v in lists))
        sent = spark.sparkContext.broadcast(trees)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for b in _gathered(batches):
                keys = np.asarray(b.column("_key").to_pylist(), object)
                full = b.column("_x").is_valid().to_numpy(zero_copy_only=False)
                value = np.full(b.num_rows, np.nan) if "_p" not in b.schema.names else b.column("_p").to_numpy(zero_copy_only=False).astype(float)
                for k in set(keys[full]) & set(known):
                    at = np.flatnonzero(full & (keys == k))
                    x = b.column("_x").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                    sums = sum(v[follow(x, f, t, c)] for f, t, c, v in known[k])
                    value[at] = sums if boosted else sums / len(known[k])
                names = [n for n in b.schema.names if n != "_p"]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(value, mask=np.isnan(value))], [*names, "_p"])

        todo = todo.mapInArrow(score, schema + ", _p double")
    return todo.select(*(F.col(f"`{f.name}`") for f in own), F.col("_p").alias(out))
