"""Words as 64-bit hashes in numpy, for operators that work on runs of words inside Arrow batches.

A word is a maximal run of characters other than space and \\x09-\\x0D. UTF-8 never uses those bytes
inside a longer character, so bytes.split(), which splits at exactly those six, is exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_ODD = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits of a polynomial hash depend on all words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD to the power 0..n-1 and the inverses, modulo 2**64."""
    size = max([1 << max(12, int(n).bit_length()), *_powers])
    if size not in _powers:
        up = np.full(size, _ODD, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers.clear()
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return tuple(x[:n] for x in _powers[size])


class Spans:
    """Hashes of any runs of a word sequence from one prefix sum; equal runs have equal hashes."""

    def __init__(self, x: np.ndarray):
        up, self.down = powers(len(x) + 1)
        self.total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=self.total[1:])

    def windows(self, k: int) -> np.ndarray:
        """Of the runs i..i+k-1, for every i."""
        n = max(0, len(self.total) - k)
        return mix((self.total[k : k + n] - self.total[:n]) * self.down[:n])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the runs start..end-1; their lengths are part of the hash."""
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over x[i:i+w] for every i, in about log2(w) passes."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def whole_groups(batches, by: tuple[str, ...], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `by`, each of about `rows` rows or one group: what is held at once
    does not grow with the partition."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in by])
        cut = int(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)).max(initial=-1)) + 1
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n -= cut
    if held:
        yield pa.Table.from_batches(held)
