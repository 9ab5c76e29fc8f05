import hashlib
from collections import Counter

import pytest

from rainframe.llm import substring


def brute(rows, k):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    times = Counter(tuple(w[i : i + k]) for _, w in texts for i in range(len(w) - k + 1))
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if times[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("k,anchor", [(35, 12), (3, 1), (8, 8)])
def test_matches_brute_force(docs, corpus, k, anchor):
    got = sorted(map(tuple, substring.digests(docs, k, anchor).collect()))
    assert got == sorted(brute(corpus, k))
    assert any(r[2] for r in got)


def test_texts_follow(docs, corpus):
    got = sorted((r.doc_id, r.n_removed, len((r.text or "").split())) for r in substring.remove_repeats(docs).collect())
    assert [(i, g) for i, g, _ in got] == sorted((i, g) for i, _, g, _ in brute(corpus, 35))
    assert set(substring.remove_repeats(docs).columns) == {*docs.columns, "n_removed"}


def test_empty_table(nothing):
    assert substring.digests(nothing).count() == 0


@pytest.mark.parametrize("ids", [[None] * 2000, list(range(2000))])
def test_rows_alike_in_text_are_one_text(spark, ids):
    """2000 rows of one text, with null ids or their own: work and intermediate rows don't grow with their number."""
    text, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(90, 130))
    rows = [(i, text) for i in ids] + [(-1, f"{other} end"), (-2, "w1 w2"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = substring.find_repeats(docs)
    assert found.texts.count() == 2 and found.runs.count() == 2
    assert found.runs.selectExpr("max(size(runs))").first()[0] < 40
    got = sorted(map(tuple, substring.digests(docs).collect()), key=str)
    assert got == sorted(brute(rows, 35), key=str)


def test_long_spans_are_places_of_one_nonbranching_path(spark):
    """A passage of 300 words in three texts, of 120 of them in a fourth, and a text that repeats ten words for long."""
    passage = [f"p{i}" for i in range(300)]
    own = lambda d, n: [f"d{d}w{i}" for i in range(n)]
    texts = [own(d, 50 + d) + passage + own(d + 10, 7) for d in range(3)] + [own(3, 20) + passage[100:220] + own(4, 20), [f"c{i % 10}" for i in range(400)], own(5, 90)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r) for r in substring.repeated_spans(substring.find_repeats(docs)).collect())
    spans = {d: [(f, n, u, p) for i, f, n, u, p in got if i == d] for d in range(6)}
    assert [[x[:2] for x in spans[d]] for d in range(4)] == [[(50, 300)], [(51, 300)], [(52, 300)], [(20, 120)]]
    assert len({spans[d][0][2] for d in range(4)}) == 1 and spans[3][0][3] == 100
    assert spans[4] and not spans[5]


def test_branches_end_a_path(spark):
    """Two passages that share their middle: the graph branches at its ends."""
    mid = [f"m{i}" for i in range(80)]
    side = {c: [f"{c}{i}" for i in range(60)] for c in "abcd"}
    texts = [side["a"] + mid + side["b"], side["c"] + mid + side["d"]] * 2
    docs = spark.createDataFrame([(d, " ".join(t + [f"end{d}"])) for d, t in enumerate(texts)], "doc_id long, text string")
    got = substring.repeated_spans(substring.find_repeats(docs)).collect()
    assert len({r.unit for r in got}) == 5  # the middle, and two ways in and out
    assert sorted(map(tuple, substring.digests(docs).collect())) == sorted(brute([(d, " ".join(t + [f"end{d}"])) for d, t in enumerate(texts)], 35))


@pytest.mark.parametrize("name", ["_kept", "_gone", "row", "key", "cut_key", "kept", "gone", "n_removed", "id"])
def test_clashing_columns(spark, name):
    same = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, same + " x", 7), (2, "y " + same, 8), (None, None, 9)], f"doc_id long, text string, `{name}` long")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in substring.remove_repeats(docs).collect()), key=str)
    assert got == [(1, "x", 40), (2, "y", 40), (None, None, 0)]
