"""Edit-aware token counts: a segment tree over each text's pre-tokens.

Leaves are runs of LEAF pre-tokens; nodes hold the characters and tokens below them. An edit finds its
leaves by descending the sums of characters. Only pre-tokens that could see the edit (the white space before it and two characters more) are made anew,
until one ends where an old one ended behind the edit; from there on the text is as before, so are its
pre-tokens. The touched leaves are dealt anew, so none grows beyond twice LEAF, and the sums above them are
updated. Trees are columns of numbers beside the text's key; edits return the updated ones, which can be
stored between rounds."""

from __future__ import annotations

import base64
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer_path

LEAF = 64

class Counter:
    """Pre-tokens of a text, and the number of tokens in a pre-token; the memo is emptied at `limit`."""

    _made: dict[str, Counter] = {}

    @classmethod
    def get(cls, ranks: str) -> Counter:
        if ranks not in cls._made:
            cls._made[ranks] = cls(ranks)
        return cls._made[ranks]

    def __init__(self, ranks: str, limit: int = 300_000):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("count", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.limit, self.memo = limit, {}

    def count(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        try:
            return [memo[p] for p in pieces]
        except KeyError:
            if len(memo) > self.limit:
                memo.clear()
            for p in set(pieces).difference(memo):
                memo[p] = len(self.encoding.encode_ordinary(p))
            return [memo[p] for p in pieces]


class Sums:
    """A complete binary tree of (characters, tokens) over a fixed number of leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(chars), 0] = chars
        self.sums[self.width : self.width + len(chars), 1] = tokens
        half = self.width // 2
        while half:
            self.sums[half : 2 * half] = self.sums[2 * half : 4 * half : 2] + self.sums[2 * half + 1 : 4 * half : 2]
            half //= 2

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf; the last leaf for any beyond."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if char - before >= self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.width, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> Sums:
        """This tree with other leaves in place of first to last: in their places where they fit, else laid out anew."""
        if len(chars) <= last + 1 - first:
            for k in range(first, last + 1):
                i = k - first
                self.put(k, *((chars[i], tokens[i]) if i < len(chars) else (0, 0)))
            return self
        before, after = self.leaves(0, first), self.leaves(last + 1, self.width)
        return Sums([*before[0], *chars, *after[0]], [*before[1], *tokens, *after[1]])

    def leaves(self, first: int = 0, stop: int | None = None) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves from first to stop that are not empty."""
        own = self.sums[self.width + first : self.width + (self.width if stop is None else stop)]
        own = own[own[:, 0] > 0]
        return own[:, 0].tolist(), own[:, 1].tolist()


class Edited(NamedTuple):
    text: str
    tokens: int
    remade: int  # pre-tokens that edits made anew
    more: int  # pre-tokens after the edits less those before
    leaf_chars: list[int]
    leaf_tokens: list[int]


def build(to: Counter, text: str) -> tuple[list[int], list[int], int]:
    """Characters and tokens of each leaf, and the number of pre-tokens."""
    pieces = to.pattern.findall(text)
    return *deal(to, pieces, LEAF), len(pieces)


def deal(to: Counter, pieces: list[str], leaf: int) -> tuple[list[int], list[int]]:
    """Characters and tokens of leaves of `leaf` pre-tokens each."""
    at = np.arange(0, len(pieces), leaf)
    if not len(at):
        return [], []
    size, count = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(to.count(pieces), np.int64)
    return np.add.reduceat(size, at).tolist(), np.add.reduceat(count, at).tolist()


def apply_edits(to: Counter, text: str, chars: list[int], tokens: list[int], edits: list[dict]) -> Edited:
    """Edits one after the other, each in characters of the text that the ones before it left; what lies beyond the
    end counts as at the end."""
    tree, remade, more = Sums(chars or [0], tokens or [0]), 0, 0
    for e in edits:
        start = max(0, min(int(e["start"] or 0), len(text)))
        stop = max(start, min(start + int(e["length"] or 0), len(text)))
        added = e["text"] or ""
        after, shift = text[:start] + added + text[stop:], len(added) - (stop - start)
        # a pre-token sees to the end of the white space behind it, and two characters on where it is a contraction
        unseen = max(0, len(text[:start].rstrip()) - 2)
        leaf, first = tree.find(unseen)
        front, begin = [], first
        old = to.pattern.finditer(text, first)
        old_end, gone = first, 0
        for m in old:
            old_end = m.end()
            if old_end > unseen:
                gone += 1
                break
            front.append(m.group())
            begin = old_end
        made, met = [], len(text)
        for m in to.pattern.finditer(after, begin):
            made.append(m.group())
            there = m.end() - shift  # in the old text, if behind the edit
            while old_end < max(there, stop) and (o := next(old, None)):
                old_end = o.end()
                gone += 1
            if old_end == there >= stop:
                met = there
                break
        else:
            gone += sum(1 for _ in old)
        last, last_at = tree.find(met)
        edge = last_at + int(tree.sums[tree.width + last, 0])
        back = []
        if met <= last_at and last > leaf:  # the two meet where a leaf begins: it is untouched
            edge = last_at
            last -= 1
        elif met < edge:
            for m in to.pattern.finditer(text, met):
                back.append(m.group())
                if m.end() >= edge:
                    break
        dealt = [*front, *made, *back]
        tree = tree.replace(leaf, last, *deal(to, dealt, LEAF if len(dealt) > 2 * LEAF else 2 * LEAF))
        text = after
        remade += len(made)
        more += len(made) - gone
    return Edited(text, int(tree.sums[1, 1]), remade, more, *tree.leaves())


TREE = "n_chars bigint, n_tokens bigint, n_pieces bigint, leaf_chars array<bigint>, leaf_tokens array<bigint>"


def build_trees(docs: DataFrame, ranks: str | None = None, text_col: str = "text") -> DataFrame:
    """docs' columns (none named like a tree's) with n_chars, n_tokens, n_pieces and the tree's leaves. Null texts are empty."""
    ranks = ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    kept = [c for c in docs.columns if c not in {f.split()[0] for f in TREE.split(", ")}]

    def run(batches):
        to = Counter.get(ranks)
        longs = pa.list_(pa.int64())
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            trees = [build(to, t) for t in texts]
            cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(t[1]) for t in trees], pa.int64()), pa.array([t[2] for t in trees], pa.int64()), pa.array([t[0] for t in trees], longs), pa.array([t[1] for t in trees], longs)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], [*kept, "n_chars", "n_tokens", "n_pieces", "leaf_chars", "leaf_tokens"])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), TREE]))


def recount(trees: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """id, n_edits, n_tokens_before, n_tokens_after, n_pieces (before), n_remade, the edited text and its tree (a struct of TREE's
    columns) of rows with a tree and edits (an array of start, length and text; null: none). The edited text with tree.* can be
    stored and take further edits. Null texts are empty; rows that repeat an id are edited each for itself; other columns are
    ignored; an empty table gives an empty result."""
    ranks = ranks or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches):
        to = Counter.get(ranks)
        longs = lambda x: pa.array(x, pa.int64())
        lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        for b in batches:
            edits = [e or [] for e in b.column("edits").to_pylist()]
            done = [apply_edits(to, t or "", c, k, e) for t, c, k, e in zip(*(b.column(n).to_pylist() for n in ("text", "leaf_chars", "leaf_tokens")), edits)]
            after, n_pieces = longs([d.tokens for d in done]), b.column("n_pieces")
            tree = [longs([len(d.text) for d in done]), after, longs([n + d.more for n, d in zip(n_pieces.to_pylist(), done)]), lists([d.leaf_chars for d in done]), lists([d.leaf_tokens for d in done])]
            cols = [b.column("id"), longs([len(e) for e in edits]), b.column("n_tokens"), after, n_pieces, longs([d.remade for d in done]), pa.array([d.text for d in done], pa.string()), pa.StructArray.from_arrays(tree, [f.split()[0] for f in TREE.split(", ")])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_edits", "n_tokens_before", "n_tokens_after", "n_pieces", "n_remade", "text", "tree"])

    rows = trees.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "n_tokens", "n_pieces", "leaf_chars", "leaf_tokens", F.col(edits_col).alias("edits"))
    tree = ", ".join(f.replace(" ", ": ", 1) for f in TREE.split(", "))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_edits bigint, n_tokens_before bigint, n_tokens_after bigint, n_pieces bigint, n_remade bigint, text string, tree struct<{tree}>")


def gather_edits(edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per id with its edits in order of seq (ties: of start, then length, then text), from rows (id, seq, start, length,
    text), to be joined to trees by id. An empty table gives an empty result."""
    one = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "text")
    listed = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias("x"))
    return listed.select(id_col, F.transform("x", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["text"].alias("text"))).alias("edits"))


def sample_edits(text_col: str = "text"):
    """Three edits for any text: a few characters replaced at a quarter, words inserted at the middle of what is left then, a
    dozen characters deleted at three quarters."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    edit = lambda at, size, text: F.struct(F.floor(at).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), F.lit(text).alias("text"))
    return F.array(edit(n / 4, 5, "edited "), edit(n / 2, 0, " two new words, 42"), edit(n * 3 / 4, 12, ""))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_edits, n_tokens_before, n_tokens_after, n_pieces and n_remade of every row, after sample_edits."""
    trees = build_trees(docs.select("doc_id", "text", sample_edits().alias("edits")))
    return recount(trees).drop("text", "tree").withColumnRenamed("id", "doc_id")
