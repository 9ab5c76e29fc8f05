"""Token ids of a byte-level BPE, fast where texts repeat words.

Pre-tokens never cross from a character that isn't white space to a single space before another such character, so
a text's ids are those of its pieces between single spaces, each with the space before it. A batch's
distinct pieces are encoded once, all together, and texts are put together from them by index.
Texts in which a space touches other white space, or with a special token in them, are encoded whole."""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = rf"{_SPACE} | {_SPACE}|^ | $"


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """vocabulary: a tokenizers file; ranks: the same vocabulary as a tiktoken file, used for pieces (same ids, faster)."""

    _made: dict[tuple[str, str], Encoder] = {}

    @classmethod
    def get(cls, vocabulary: str, ranks: str) -> Encoder:
        """One for each worker process."""
        if (vocabulary, ranks) not in cls._made:
            cls._made[vocabulary, ranks] = cls(vocabulary, ranks)
        return cls._made[vocabulary, ranks]

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for k, i in table.items():
            self.size[i] = len(k)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text (null: none)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNEVEN)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd))
        pool, count = self._even(even)
        if not odd.any():
            return pool, count
        out, n = [], np.zeros(len(texts), np.int64)
        n[~odd] = count
        ends = np.cumsum(count)
        k = 0
        for i, whole in enumerate(odd.tolist()):
            if whole:
                out.append(self.ids(texts[i].as_py()))
                n[i] = len(out[-1])
            else:
                out.append(pool[ends[k] - count[k] : ends[k]])
                k += 1
        return np.concatenate(out), n

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        first = np.concatenate([[0], ends[:-1]])
        coded = cut.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary
        heads = [self.pieces.encode_ordinary(s) for s in cut.flatten().take(pa.array(first)).to_pylist()]

        strings = distinct.to_pylist()
        inner = np.zeros(len(strings), bool)
        rest = np.ones(len(code), bool)
        rest[first] = False
        inner[code[rest]] = True
        joined = [" " + s for s, k in zip(strings, inner.tolist()) if k]
        ids = self.pieces.encode_to_numpy("".join(joined), disallowed_special=()) if joined else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        stops = np.searchsorted(upto, np.cumsum([0, *(len(s.encode()) for s in joined)]))
        begin, size = np.zeros(len(strings) + len(heads), np.int64), np.zeros(len(strings) + len(heads), np.int64)
        own = np.flatnonzero(inner)
        begin[own], size[own] = stops[:-1], np.diff(stops)
        code[first] = len(strings) + np.arange(len(heads))
        head_size = np.fromiter(map(len, heads), np.int64, len(heads))
        begin[len(strings) :], size[len(strings) :] = len(ids) + np.cumsum(head_size) - head_size, head_size
        pool = np.concatenate([ids, np.array([i for h in heads for i in h], np.uint32)]).astype(np.uint32)

        long = size[code]
        total = np.concatenate([[0], np.cumsum(long)])
        out = pool[np.repeat(begin[code] - total[:-1], long) + np.arange(total[-1])]
        return out, total[ends] - total[first]


def slices(texts: pa.Array, most: int = 8 << 20):
    """Parts of an array of texts with about `most` bytes each, or one text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, "right")))
        yield texts.slice(at, n)
        at += n


def pieces(batches, column: str, most: int = 4 << 20):
    """Batches cut into parts with about `most` bytes in a column, or one row, each: what a task holds at once has a bound."""
    for b in batches:
        at = 0
        for part in slices(b.column(column), most):
            yield b.slice(at, len(part))
            at += len(part)
