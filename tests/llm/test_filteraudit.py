from itertools import permutations

import numpy as np

from rainframe.llm import filteraudit

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels, letters="ABCDE"):
    """All counts from sets of rows, order by order."""
    texts = [(r[1] or "") for r in rows]
    least = {}
    for r, t in zip(rows, texts):
        if r[0] is not None:
            least[t] = min(r[0], least.get(t, r[0]))
    fails = []
    for r, t in zip(rows, texts):
        w = t.encode().split()
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        f += "D" * any(c in "#$%&*|" for c in t) + "E" * (r[0] is not None and least[t] < r[0])
        fails.append(f)
    ones = lambda k: {x[0] for x in labels if x[k] == 1 and x[0] is not None}
    good, toxic = ones(1), ones(2)
    out, shapley = {}, {}
    for part in {r[3] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[3] or "") == part]
        for order in permutations(letters):
            left = own
            for step, x in enumerate(order, 1):
                gone = [y for y in left if x in y[1]]
                left = [y for y in left if x not in y[1]]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in y[1] for y in own) - len(gone), sum(y[1] == x for y in own), sum(y[0] in good for y in gone), sum(y[0] in toxic for y in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(df):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in df.collect()}


def labels_of(rows):
    return [(i, i % 2 if i % 5 else None, int(i % 7 == 0)) for i in range(0, 170, 3)] + [(9, 1, 1), (None, 1, 1)]


def test_equals_brute_force(spark, docs, corpus):
    some = labels_of(corpus)
    got = table(filteraudit.audit(docs, spark.createDataFrame(some, LABELS)))
    assert got == brute(corpus, some)
    assert len(got) == 600 * len({r[3] or "" for r in corpus})


def test_copies_across_slices_and_partitions_and_null_ids(spark, monkeypatch):
    """A text of a third of all rows, rows alike in all, null and shared ids; slices so small that every text is routed often."""
    text = "word Up #1 " * 30
    rows = [(i, text, None, f"s{i % 3}") for i in range(60, 0, -1)] + [(7, text, None, "s1")] * 5 + [(None, text, None, None)] * 4 + [(None, None, None, "s0"), (2, None, None, "s0"), (2, "", None, "s0"), (3, "", None, "")]
    rows += [(i, f"other text {i % 9}", None, "s2") for i in range(100, 130)] + [(5, f"shared id {k}", None, "s0") for k in range(20)]
    monkeypatch.setattr(filteraudit, "SLICE", 100)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    some = [(5, 1, 0), (5, 0, 1), (7, 0, 1)]
    assert table(filteraudit.audit(df, spark.createDataFrame(some, LABELS), partitions=3)) == brute(rows, some)


def test_collision_chain_tells_texts_apart():
    pairs = [((5, 1, 1), ("a", 0, {"p": 1})), ((5, 1, 2), ("b", 0, {"p": 1})), ((5, 1, 3), ("a", 0, {"p": 2})), ((6, 1, 1), ("c", 1, {"p": 1}))]
    assert list(filteraudit._settled(iter(pairs), 16)) == [(1, "p", 0, 1), (2, "p", 0, 1), (3, "p", 16, 2), (1, "p", 1, 1)]


def test_own_filters_and_empty_table(spark, docs, nothing):
    labels = spark.createDataFrame([], LABELS)
    assert filteraudit.audit(nothing, labels).count() == 0
    two = {"x": lambda t: "a" in t.text, "y": None}
    rows = filteraudit.audit(docs, labels, filters=two).collect()
    assert {r.filter_order for r in rows} == {"xy", "yx"} and all(r.good_lost == 0 for r in rows)


def test_orders_sum_up():
    counts = np.arange(12).reshape(3, 4)
    for r in filteraudit.orders(counts, ["A", "B"]):
        assert r[2] + r[3] <= counts[0].sum() and r[3] + r[4] == (counts[0, [1, 3]] if r[0][r[1] - 1] == "A" else counts[0, [2, 3]]).sum()
