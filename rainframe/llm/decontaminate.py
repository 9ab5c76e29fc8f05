"""Benchmark decontamination over a stored positional inverted index of all training tokens.

Texts are cut into segments of a few megabytes, in which a word's place is a number (with a gap after each text, so
that no match runs over an end). The index has a row for each term and segment with the term's places, a posting list,
and for each segment a row that names its texts. The lists are dealt by term, a frequent term's
segments to several partitions, sorted by term (segments' own rows first) and written once to the shared folder.

A search takes a block of test items. Of the lists, the scan gets ranges of terms and skips pages of files without any (a
block of up to RANGES terms has a range for each). The lists meet again by segment; there the items with a window
whose words the segment has all are found first, for all items at once, and for these the lists, shifted by the terms' places in the item, are intersected from the rarest term of every window
on: what is left are the alignments on which neighbours agree, and only those are held against the other lists. Texts
are never shuffled. Blocks have at most about `block_words` words, so what is sent at once has a bound however large
the benchmark is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, send_if_small
from .substring import document_key
from .tokens import slices

#: Bytes that stand in words: 0-9, a-z and all of other characters; A-Z count as a-z.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))

SEGMENT_BYTES = 4 << 20  # of text in a segment, or one text
RANGES = 16  # ranges of terms that a scan of the index takes
GAP = 2  # places between two texts of a segment
SPREAD = 16  # partitions that share a term's lists
MOST_SENT = 64 << 20  # bytes of a block's terms up to which they are broadcast
INDEX = "seg bigint, term binary, places binary, ids array<{id}>, n_words array<bigint>"
HITS = "seg bigint, i int, spans array<struct<s:bigint,e:bigint>>, items array<string>, near array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def starts_of(n_words: np.ndarray) -> np.ndarray:
    """The first place of each text of a segment."""
    return np.cumsum(n_words + GAP) - n_words - GAP


def pack_lists(places: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of ascending places as their differences, little-endian in four bytes."""
    first = np.concatenate([[0], ends[:-1]])
    gaps = np.diff(places, prepend=0)
    gaps[first] = places[first]
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes()), pa.py_buffer(gaps.astype("<u4").tobytes())])


def unpack_list(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<u4"), dtype=np.int64)


def _index(batches, segment_bytes: int):
    from pyspark import TaskContext

    seg = TaskContext.get().partitionId() << 32
    for b in batches:
        at = 0
        for part in slices(b.column("text"), segment_bytes):
            own = b.column("id").slice(at, len(part))
            at += len(part)
            folded = pa.array([(t or b"").translate(FOLD).strip() for t in part.cast(pa.binary()).to_pylist()], pa.binary()).view(pa.string())
            cut = pc.ascii_split_whitespace(folded)
            some = pc.binary_length(folded).to_numpy() > 0
            n = np.where(some, cut.value_lengths().to_numpy(), 0).astype(np.int64)
            coded = cut.filter(pa.array(some)).flatten().dictionary_encode()
            term = coded.indices.to_numpy()
            place = np.arange(len(term)) + np.repeat(starts_of(n) - (np.cumsum(n) - n), n)
            order = np.argsort(term, kind="stable")
            terms = coded.dictionary.cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([seg]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([n.tolist()], pa.list_(pa.int64()))],
                ["seg", "term", "places", "ids", "n_words"],
            )
            if len(terms):
                lists = pack_lists(place[order], np.cumsum(np.bincount(term, minlength=len(terms))))
                none = [pa.nulls(len(terms), pa.list_(k)) for k in (own.type, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), seg)), terms, lists, *none], ["seg", "term", "places", "ids", "n_words"])
            seg += 1


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all words of all texts, written and read back. Null and wordless texts are named and have no word; rows that
    repeat an id are texts of their own; other columns are ignored; an empty table has no segment."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(lambda it: _index(it, segment_bytes), INDEX.format(id=docs.schema[id_col].dataType.simpleString()))
    share = F.when(F.col("term").isNull(), F.col("seg")).otherwise(F.pmod("seg", F.lit(SPREAD)))
    return materialize(made.repartition("term", share).sortWithinPartitions("term", "seg"), "decontaminate-index")


def ranges_of(terms: list[bytes], most: int = RANGES) -> list[tuple[bytes, bytes]]:
    """First and last of at most `most` runs of sorted terms: one for each where these are few, else runs of like length."""
    each = -(-len(terms) // most)
    return [(terms[i], terms[min(i + each, len(terms)) - 1]) for i in range(0, len(terms), each)] if terms else []


def _in_ranges(ranges: list[tuple[bytes, bytes]]) -> Column:
    """Whether a term lies in a range. Halves are asked only within their own bounds, so a row meets as many as the ranges' logarithm."""
    if not ranges:
        return F.lit(False)
    first, last = ranges[0][0], ranges[-1][1]
    own = F.col("term") == F.lit(bytearray(first)) if first == last else (F.col("term") >= F.lit(bytearray(first))) & (F.col("term") <= F.lit(bytearray(last)))
    mid = len(ranges) // 2
    return own & (_in_ranges(ranges[:mid]) | _in_ranges(ranges[mid:])) if mid else own


def asked_lists(index: DataFrame, terms: set[bytes]) -> DataFrame:
    """(seg, term, places, n_words) of the terms and of the segments' own rows, in partitions of whole segments, sorted by both."""
    order = sorted(terms)
    asked = index.sparkSession.createDataFrame([(bytearray(t),) for t in order], "term binary")
    if sum(map(len, order)) <= MOST_SENT:
        asked = F.broadcast(asked)
    lists = index.where(_in_ranges(ranges_of(order))).select("seg", "term", "places", "n_words").join(asked, "term", "left_semi")
    own = index.where("term is null").select("seg", "term", "places", "n_words")
    return own.unionByName(lists).repartition("seg").sortWithinPartitions("seg", F.col("term").asc_nulls_first())


class Windows:
    """All windows of a block of items, as runs of one long row of term numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        self.terms = np.array([self.number.setdefault(w, len(self.number)) for _, words in items for w in words], np.int64)
        n = np.array([len(words) for _, words in items], np.int64)
        size = np.minimum(n, window)
        many = n - size + 1
        self.item = np.repeat(np.arange(len(items)), many)
        self.first = np.arange(len(self.item)) + np.repeat(np.cumsum(n) - n - (np.cumsum(many) - many), many)
        self.end = self.first + size[self.item]

    def items_in(self, terms) -> list[int]:
        """Items that have a window all of whose words are among the terms, in order."""
        here = np.zeros(len(self.number) + 1, bool)
        here[[self.number.get(t, -1) for t in terms]] = True
        absent = np.concatenate([[0], np.cumsum(~here[self.terms])])
        return np.unique(self.item[absent[self.end] == absent[self.first]]).tolist()


class Segment:
    """The asked posting lists of a segment."""

    def __init__(self, n_words: np.ndarray, lists: dict[bytes, bytes]):
        self.n_words, self.starts, self.packed, self.open = n_words, starts_of(n_words), lists, {}

    def of(self, term: bytes) -> np.ndarray:
        if term not in self.open:
            self.open[term] = unpack_list(self.packed[term])
        return self.open[term]

    def size(self, term: bytes) -> int:
        return len(self.packed.get(term, b"")) // 4

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def alignments(self, words: list[bytes], window: int, slop: bool) -> np.ndarray:
        """Places at which the item's first word would stand, for every alignment that may hold some of a window: the rarest
        word's places, shifted, that a neighbour's shifted list shares. slop: also where the neighbour, or what comes after, is one
        place further off."""
        size = np.fromiter(map(self.size, words), np.int64, len(words))
        view = np.lib.stride_tricks.sliding_window_view(size, window)
        alive = view.min(axis=1) > 0
        found = []
        for r in np.unique((view.argmin(axis=1) + np.arange(len(view)))[alive]).tolist():
            own = self.of(words[r]) - r
            if window == 1:
                found.append(own)
                continue
            for near in (r - 1, r + 1):
                if 0 <= near < len(words) and size[near]:
                    other = self.of(words[near]) - near
                    found.append(own[_among(other, own)])
                    if slop:
                        found.append(own[_among(other, own + (1 if near > r else -1))])
        at = np.concatenate([*found, np.zeros(0, np.int64)])
        return np.unique(np.concatenate([at, at - 1, at + 1]) if slop else at)

    def item(self, words: list[bytes], window: int, near: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """First places of the windows that occur, and a place in each text that has a window with one other word, at most,
        between its words."""
        none = np.zeros(0, np.int64)
        at = self.alignments(words, window, near and window > 1)
        if not len(at):
            return none, none
        ok = np.stack([_among(self.of(w), at + j) if self.size(w) else np.zeros(len(at), bool) for j, w in enumerate(words)], axis=1)
        whole = np.lib.stride_tricks.sliding_window_view(ok, window, axis=1).all(axis=2)
        a, i = np.nonzero(whole)
        exact = at[a] + i
        if not near:
            return exact, none
        left, right = np.zeros(ok.shape, np.int64), np.zeros(ok.shape, np.int64)  # matched words up to here, and from here on
        for j in range(ok.shape[1]):
            left[:, j] = np.where(ok[:, j], (left[:, j - 1] if j else 0) + 1, 0)
            k = ok.shape[1] - 1 - j
            right[:, k] = np.where(ok[:, k], (right[:, k + 1] if j else 0) + 1, 0)
        step = np.flatnonzero(np.diff(at) == 1)  # alignments of which the next is one place on
        head, tail = left[step, :-1], right[step + 1, 1:]
        a, j = np.nonzero((head > 0) & (tail > 0) & (np.minimum(head, window - 1) + np.minimum(tail, window - 1) >= window))
        return exact, np.concatenate([exact, at[step[a]] + j])

    def near(self, words: list[bytes], slop: int) -> np.ndarray:
        """Rows (first, last place) where the words stand in order with at most `slop` words between them in all; for each
        first place the earliest such last one. Both are in the same text."""
        if min(map(self.size, words)) == 0:
            return np.zeros((0, 2), np.int64)
        reach = len(words) + slop
        rare = self.of(min(words, key=self.size))
        first = self.of(words[0])
        i = np.minimum(np.searchsorted(rare, first), len(rare) - 1)
        first = last = first[(rare[i] >= first) & (rare[i] < first + reach)]
        for w in words[1:]:
            own = self.of(w)
            i = np.searchsorted(own, last, "right")
            ok = i < len(own)
            first, last = first[ok], own[i[ok]]
            ok = last - first < reach
            first, last = first[ok], last[ok]
        own = self.text_of(first) == self.text_of(last)
        return np.stack([first[own], last[own]], axis=1)


def _among(ascending: np.ndarray, x: np.ndarray) -> np.ndarray:
    i = np.searchsorted(ascending, x)
    i[i == len(ascending)] = 0
    return ascending[i] == x


def segments(batches):
    """(seg, Segment) of rows of asked_lists; one segment is held at a time."""
    held, n_words, lists = None, None, {}
    for b in batches:
        n = b.column("n_words")
        for i, (seg, term, places) in enumerate(zip(*(b.column(c).to_pylist() for c in ("seg", "term", "places")))):
            if term is None:
                if held is not None:
                    yield held, Segment(n_words, lists)
                held, n_words, lists = seg, n[i].values.to_numpy(), {}
            else:
                lists[term] = places
    if held is not None:
        yield held, Segment(n_words, lists)


def _search(batches, items: list[tuple[str, list[bytes]]], window: int, near: bool):
    windows = Windows(items, window)
    for seg, lists in segments(batches):
        if not lists.packed:
            continue
        spans: dict[int, list[tuple[int, int]]] = {}
        names: tuple[dict[int, set[str]], dict[int, set[str]]] = ({}, {})
        for i in windows.items_in(lists.packed):
            name, words = items[i]
            size = min(window, len(words))
            exact, about = lists.item(words, size, near)
            for at, of in zip((exact, about), names):
                for d in np.unique(lists.text_of(at)).tolist():
                    of.setdefault(d, set()).add(name)
            for d, s in zip(lists.text_of(exact).tolist(), exact.tolist()):
                s -= int(lists.starts[d])
                mine = spans.setdefault(d, [])
                if mine and mine[-1][0] <= s <= mine[-1][1]:
                    mine[-1] = (mine[-1][0], max(mine[-1][1], s + size))
                else:
                    mine.append((s, s + size))
        hit = sorted(names[1].keys() | names[0].keys())
        if hit:
            of = lambda x: pa.array([sorted(x.get(d, ())) for d in hit], pa.list_(pa.string()))  # noqa: E731, B023
            pair = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([seg] * len(hit), pa.int64()), pa.array(hit, pa.int32()), pa.array([[{"s": s, "e": e} for s, e in spans.get(d, ())] for d in hit], pair), of(names[0]), of(names[1])], ["seg", "i", "spans", "items", "near"])


def block_count(bench: DataFrame, block_words: int, text_col: str = "text") -> int:
    """Blocks of about block_words words (of six bytes) that the benchmark makes."""
    return 1 + (bench.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // (6 * block_words)


def test_block(bench: DataFrame, k: int, n: int, id_col: str = "item_id", text_col: str = "text") -> list[tuple[str, list[bytes]]]:
    """Distinct (id, words) of the k-th of n blocks of the benchmark's items with words; rows go to blocks by a hash."""
    rows = bench.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
    held = ((str(r.id), words_of(None if r.text is None else r.text.encode())) for r in part.toLocalIterator())
    return [(name, words) for name, words in held if words]


def find_hits(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int, near: bool = True) -> DataFrame:
    """HITS: for texts (segment and number in it) with hits the spans of words in windows of the items, the items with such
    windows, and those of which a window has one other word, at most, between its words."""
    sent = index.sparkSession.sparkContext.broadcast(items)
    return asked_lists(index, {w for _, ws in items for w in ws}).mapInArrow(lambda it: _search(it, sent.value, window, near), HITS)


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 13, share: int = 20, block_words: int = 1_000_000, segment_bytes: int = SEGMENT_BYTES, near: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit (words in an occurrence of a window of any item), items (their ids as sorted strings), contaminated (at
    least one word in `share` is hit) and n_near (items of which a window stands there with at most one other word
    between its words) of every row, repeated rows each for itself.

    An item of fewer words than a window is one window. Null or wordless texts are clean and have no hits; null item texts have
    no window; an empty benchmark leaves all clean; items that repeat an id are one item; other columns are ignored."""
    index = build_index(docs, segment_bytes, id_col, text_col)
    n = block_count(bench, block_words)
    hits = find_hits(index, test_block(bench, 0, n), window, near)
    for k in range(1, n):  # written block by block: what is sent for one is free before the next
        hits = materialize(hits, "decontaminate-hits").unionByName(find_hits(index, test_block(bench, k, n), window, near))
    merge = lambda c: F.flatten(F.collect_list(c))
    met = hits.groupBy("seg", "i").agg(F.array_sort(merge("spans")).alias("spans"), F.array_sort(F.array_distinct(merge("items"))).alias("items"), F.size(F.array_distinct(merge("near"))).cast("long").alias("n_near"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    add = lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["upto"], x["s"]))).alias("n"))
    met = met.select("seg", "i", F.aggregate("spans", start, add)["n"].alias("n_hit"), "items", "n_near")
    texts = index.where("term is null").select("seg", F.posexplode(F.arrays_zip("ids", "n_words")).alias("i", "x")).select("seg", "i", F.col("x.ids").alias("id"), F.col("x.n_words").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = texts.join(met, ["seg", "i"], "left").select("id", "n_words", zero("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), zero("n_near"))
    return out.select("id", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near")


def find_near(docs: DataFrame, phrases: dict[str, str], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proximity matches: id, phrase, first and last (word numbers in the text) of each place where a phrase's words stand in order
    with at most `slop` other words between them in all. Slop 0 gives exact phrases.

    Phrases without a word and null texts have no match; an empty table gives an empty result; repeated rows each have
    their matches; other columns are ignored."""
    asked = {name: words for name, p in phrases.items() if (words := words_of(p.encode()))}

    def search(batches):
        for seg, lists in segments(batches):
            out = []
            for name, words in asked.items():
                hits = lists.near(words, slop)
                out += [(seg, d, name, int(f - lists.starts[d]), int(e - lists.starts[d])) for (f, e), d in zip(hits.tolist(), lists.text_of(hits[:, 0]).tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["seg", "i", "phrase", "first", "last"])

    index = build_index(docs, id_col=id_col, text_col=text_col)
    found = asked_lists(index, {w for ws in asked.values() for w in ws}).mapInArrow(search, "seg bigint, i int, phrase string, first bigint, last bigint")
    texts = index.where("term is null").select("seg", F.posexplode("ids").alias("i", "id"))
    return texts.join(found, ["seg", "i"]).select("id", "phrase", "first", "last")


def digests(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near of every row."""
    found = find_contamination(docs, bench)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near")


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows. A row is known by the hashes of its id and text, as ids can be null or repeated; rows
    alike in both are judged alike. Null texts stay; an empty benchmark removes nothing. Only the keys of contaminated
    rows are joined, from a written table whose size decides whether they are sent."""
    key = F.struct(*document_key(id_col, text_col))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    bad = materialize(find_contamination(rows, bench, near=False, id_col="id").where("contaminated").select("id").distinct(), "decontaminate-bad")
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return keyed.join(send_if_small(bad), F.col("key") == F.col("id"), "left_anti").select("row.*")
