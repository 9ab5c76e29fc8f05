import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rainframe.llm import packing
from rainframe.llm.tokens import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def whole():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(corpus, whole):
    to = Encoder.get(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    texts = [r[1] for r in corpus] + ["a  b", " a", "a ", " ", "a\n b", "a \nb", "x y z", "it's we'll 's", "é ü 　x", "  a", "tab\t b"]
    ids, n = to.batch(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n):
        assert ids[e - k : e].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def check(rows, corpus, whole, length):
    left = defaultdict(list)
    for r in corpus:
        left[r[0]].append([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.id].append(r)
        assert r.length > 0
    assert set(pieces) == set(left)
    for d, ids in left.items():
        if len(ids) == 1:
            at = 0
            for p in sorted(pieces[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids[0])
                assert p.ids_crc32 == zlib.crc32(np.array(ids[0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids[0])
        else:  # repeated rows: the right number of tokens in all
            assert sum(p.length for p in pieces[d]) == sum(map(len, ids))
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(windows) == set(range(len(windows)))
    for k, w in windows.items():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at == length or k == len(windows) - 1 and at <= length


@pytest.mark.parametrize("length,bucket,weights", [(2048, 1 << 20, None), (64, 3000, None), (256, 5000, {"src0": 1.0, "src1": 3.0})])
def test_every_token_once_and_no_gaps(docs, corpus, whole, length, bucket, weights):
    check(packing.pack(docs, length, weights, bucket).collect(), corpus, whole, length)


def test_every_window_has_the_mixture(docs):
    rows = packing.pack(docs, 256).collect()
    total, by = sum(r.length for r in rows), defaultdict(lambda: defaultdict(int))
    share = defaultdict(int)
    for r in rows:
        share[r.source] += r.length / total
        by[r.sequence_id][r.source] += r.length
    off = [abs(by[k].get(s, 0) / 256 - p) for k in sorted(by)[:-1] for s, p in share.items()]
    assert max(off) < 0.02


@pytest.mark.parametrize("bucket", [700, 5000, 1 << 20])
def test_targets_other_than_the_corpus_hold_until_a_source_ends(spark, bucket):
    """Nine in ten documents are of a: every window is half and half until b runs out, in any number of buckets; c has no target."""
    rows = [(i, "word " * (20 + i % 7), "a" if i % 10 else "b") for i in range(1000)] + [(i, "last " * 10, "c") for i in range(1000, 1010)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(df, 256, {"a": 0.5, "b": 0.5, "none": 1.0}, bucket).collect()
    by, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in got:
        by[r.sequence_id][r.source] += r.length
        total[r.source] += r.length
    until = 2 * total["b"] // 256
    assert until > 10 and all(abs(by[k]["b"] / 256 - 0.5) < 0.02 for k in range(until))
    assert all(by[k]["a"] == 256 for k in range(until + 1, (total["a"] + total["b"]) // 256))
    assert all(sum(by[k].values()) == 256 for k in range(len(by) - 1))
    assert sum(by[k]["c"] for k in range((total["a"] + total["b"]) // 256)) == 0 and total["c"]


def test_pieces_follow_a_plain_round_robin(spark):
    """In each window a source's tokens are those of a plain loop over windows with deficits, one token at most apart."""
    rows = [(i, "x " * (i % 40), f"s{i % 5 % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    weights = {"s0": 1.0, "s1": 2.0, "s2": 5.0}
    got = defaultdict(lambda: defaultdict(int))
    left = defaultdict(int)
    for r in packing.pack(df, 128, weights, 1000).collect():
        got[r.sequence_id][r.source] += r.length
        left[r.source] += r.length
    owed = dict.fromkeys(weights, 0.0)
    for k in range(len(got) - 1):
        if min(left.values()) < 128:
            break
        for s, w in weights.items():
            owed[s] += 128 * w / 8
            assert abs(owed[s] - got[k][s]) < 4
            owed[s] -= got[k][s]
            left[s] -= got[k][s]
    assert k > 10


def test_knots():
    xs, ys, rest = packing.knots({"a": 900, "b": 100}, {"a": 1.0, "b": 1.0}, 50)
    assert xs == [0, 200, 1000, 1050] and ys == {"a": [0, 100, 900, 900], "b": [0, 100, 100, 100]} and rest == [0, 0, 0, 50]
    assert packing.knots({}, {"a": 1.0}, 7) == ([0, 7], {}, [0, 7])
    plan = packing.Plan(xs, ys["a"])
    for size in (7, 64, 999, 5000):
        at = [plan.bucket(t, size) for t in range(900)]
        assert at == sorted(at) and all(plan.upto(k * size) <= t < plan.upto((k + 1) * size) for t, k in enumerate(at))


def test_shares():
    got = packing.shares(np.array([5.5, -2.0, 9.9]), np.array([100, 100, 4]), np.array([0.5, 0.25, 0.25]), 20)
    assert got.sum() == 20 and (got <= [100, 100, 4]).all()
    assert packing.shares(np.array([50.0, 60.0]), np.array([100, 100]), np.array([0.5, 0.5]), 20).sum() == 20
    assert packing.shares(np.array([0.0, 0.0]), np.array([3, 0]), np.array([0.0, 1.0]), 20).tolist() == [3, 0]


def test_empty_table(nothing):
    assert packing.digests(nothing).count() == 0
