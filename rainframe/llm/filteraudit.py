"""Filter interaction audit: what every filter of a chain removes, in every order of the chain, by part of the corpus.

Documents reduce to masks, a bit for each filter that they fail; all orders follow from counts by mask. Whether a text stands
under a smaller id too needs the other documents: texts are routed as pairs of an RDD by their XXH64 and sorted there by
fingerprint and id, so a task holds one fingerprint's collision chain at a time: its full texts, each with the least id, which comes
first. Later ids of a chain's text are emitted as failing. Before that, tasks chain the texts of slices of their own input:
what is not the least of its slice is settled there and moves without its text, so a text that a third of all
documents share moves once a slice. combineByKey then merges vectors of counts by mask for each part."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE = 32 << 20  # characters of different texts that a task chains at once before they are routed
ROUTED = 64 << 20  # bytes of text that a partition of the routed pairs holds on average at most


class Text(NamedTuple):
    text: str
    raw: bytes  # UTF-8
    words: list[bytes]


#: Failure conditions by letter; None stands for the condition that a smaller id has the same text.
FILTERS: dict[str, Callable[[Text], bool] | None] = {
    "A": lambda t: len(t.words) < 50,
    "B": lambda t: 100 * len(set(t.words)) < 65 * len(t.words),
    "C": lambda t: 100 * (len(t.raw) - len(t.raw.translate(None, UPPER))) > 5 * len(t.text),
    "D": lambda t: len(t.raw.translate(None, b"#$%&*|")) < len(t.raw),
    "E": None,
}
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _spread(x: object) -> int:
    return xxhash.xxh64_intdigest(str(x).encode())


def _chained(rows: Iterator, conditions: list[Callable[[Text], bool] | None], seen: int, most: int) -> Iterator[tuple]:
    """Pairs to route: ((hash, 0, 0), (id, mask, parts)) of settled rows, and ((fingerprint, 1, id), (text, mask, parts)) of the least
    id of each text of a slice; parts: how many rows by part."""
    held: dict[str, list] = {}  # text: id, mask, rows by part
    size = 0

    def routed():
        for text, (i, mask, parts) in held.items():
            yield (xxhash.xxh64_intdigest(text.encode()), 1, i), (text, mask, parts)

    for i, text, part in rows:
        text, part = text or "", part or ""
        have = held.get(text)
        if have is None:
            raw = text.encode()
            t = Text(text, raw, raw.split())
            mask = sum(1 << b for b, fails in enumerate(conditions) if fails and fails(t))
        else:
            mask = have[1]
        if i is None:
            yield (xxhash.xxh64_intdigest(raw) if have is None else _spread((part, mask)), 0, 0), (None, mask, {part: 1})
        elif have is None:
            held[text] = [i, mask, {part: 1}]
            size += len(text)
        elif i == have[0]:
            have[2][part] = have[2].get(part, 0) + 1
        elif i > have[0]:
            yield (_spread(i), 0, 0), (i, mask | seen, {part: 1})
        else:
            yield (_spread(have[0]), 0, 0), (have[0], mask | seen, have[2])
            held[text] = [i, mask, {part: 1}]
        if size > most:
            yield from routed()
            held, size = {}, 0
    yield from routed()


def _settled(pairs: Iterator, seen: int) -> Iterator[tuple]:
    """(id, part, mask, rows) from pairs sorted by fingerprint and id."""
    now, chain = None, {}
    for (fingerprint, kind, i), (x, mask, parts) in pairs:
        if kind:
            if fingerprint != now:
                now, chain = fingerprint, {}
            if chain.setdefault(x, i) < i:
                mask |= seen
        else:
            i = x
        for part, n in parts.items():
            yield i, part, mask, n


def masks(docs: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", partitions: int | None = None) -> RDD:
    """(id, part, mask, rows) of all documents; rows alike in id, part and text may be one entry. The texts' bytes are counted first, and
    set the number of partitions at least."""
    conditions = list(filters.values())
    seen = sum(1 << b for b, fails in enumerate(conditions) if fails is None)
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(part_col).cast("string")).rdd
    size = 0 if partitions else docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = partitions or max(-(-size // ROUTED), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = SLICE
    pairs = rows.mapPartitions(lambda x: _chained(x, conditions, seen, most))
    return pairs.repartitionAndSortWithinPartitions(n, lambda key: key[0] % n).mapPartitions(lambda x: _settled(x, seen))


def labelled(found: RDD, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good and toxic: rows, and rows whose id has a label row of quality 1, or of toxic 1. Ids are counted by part and mask
    first, so an id that many rows have is a few rows in the join; null ids have no label."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    rows = docs.sparkSession.createDataFrame(found, schema, verifySchema=False).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality").alias("q"), is_one("toxic").alias("t"))
    times = lambda c: (F.coalesce(F.col(c), F.lit(0)) * F.col("n")).cast("long")
    return rows.join(known, "id", "left").select("part", "mask", "n", times("q").alias("good"), times("t").alias("toxic"))


def orders(counts: np.ndarray, letters: list[str]) -> Iterator[tuple]:
    """(order, step, COUNTS) for every order and step, of counts of all, good and toxic rows by mask (3 x 2**k)."""
    k = len(letters)
    every = np.arange(1 << k)
    failing = [(every >> b & 1).astype(bool) for b in range(k)]
    out, total = [], dict.fromkeys(letters, 0)
    for order in permutations(range(k)):
        left = np.ones(1 << k, bool)
        for step, b in enumerate(order, 1):
            here = left & failing[b]
            left &= ~failing[b]
            removed, good, toxic = (int(x) for x in counts[:, here].sum(axis=1))
            total[letters[b]] += removed
            out.append(("".join(letters[x] for x in order), step, letters[b], int(counts[0, left].sum()), removed, int(counts[0, failing[b]].sum()) - removed, int(counts[0, 1 << b]), good, toxic))
    for order, step, letter, *rest in out:
        yield (order, step, *rest, total[letter])


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", partitions: int | None = None) -> DataFrame:
    """part, filter_order, step and COUNTS: a row for each part, order of the filters and step.

    Null texts are empty ones; a null part is the part of the empty string. Rows of one id and text are documents each, none of which
    fails for the other; null ids fail for no other and have no labels. An id has a label if any of its rows in labels has. Other columns
    are ignored; an empty table gives an empty result. filters: letter to condition, in the order of the masks' bits; masks are counted in
    vectors of 2**len(filters), and all orders are listed, so there should be seven at most."""
    letters = list(filters)
    if len(letters) > 7 or any(len(x) != 1 for x in letters):
        raise ValueError("filters are named by one letter each, and all orders of over seven are too many to list")
    rows = labelled(masks(docs, filters, id_col, text_col, part_col, partitions), docs, labels, id_col)
    size = 1 << len(letters)

    def added(vector: np.ndarray, row: tuple) -> np.ndarray:
        vector[:, row[0]] += row[1:]
        return vector

    pairs = rows.rdd.map(lambda r: (r[0], tuple(r[1:])))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = pairs.combineByKey(lambda row: added(np.zeros((3, size), np.int64), row), added, lambda a, b: a + b, n, _spread)
    listed = vectors.flatMap(lambda x: ((x[0], *row) for row in orders(x[1], letters)))
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return docs.sparkSession.createDataFrame(listed, f"part string, filter_order string, step int, {kinds}", verifySchema=False)
