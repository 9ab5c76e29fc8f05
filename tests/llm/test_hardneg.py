import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, id int, x string, d double, near int, anchor boolean"


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100):
    use = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        use.append((i, label, [math.floor(256 * float(np.float32(c))) for c in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in use:
        if not anchor(i):
            continue
        others = sorted((-score(v, w), j, m) for j, m, w in use if j != i)
        for s, j, _ in [x for x in others if x[2] == label][:positives]:
            fits = [x for x in others if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, every, **how):
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % every == 0, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 12))
    out = [(i, int(rng.integers(0, 4)), [float(c) for c in (centers[rng.integers(0, 6)] + 0.4 * rng.normal(size=12)) * rng.choice([0.05, 0.3, 1.0])]) for i in range(700)]
    out += [(i, i % 2, out[20][2]) for i in range(700, 1000)]  # one vector that a third of all rows have
    out += [(1000, 1, [0.0] * 12), (1010, 2, []), (1020, 0, [0.5] * 5), (1030, None, [0.1] * 12), (1040, 1, None), (1050, 1, [None] + [0.1] * 11), (1060, 1, [math.inf] + [0.1] * 11), (1070, 1, [math.nan] * 12), (None, 1, [0.2] * 12)]
    out += [out[30], out[31], (40, 3, [0.1] * 12)]  # repeated rows and a shared id
    return [(*r, 0, "clash", 0.5, 1, False) for r in out]


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mined(df, 10)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert len(got) > 1000


def test_blocks_of_anchors_and_other_bounds(spark, rows, monkeypatch):
    monkeypatch.setattr(hardneg, "ANCHORS", 30)
    monkeypatch.setattr(hardneg, "BUFFER", 50)
    monkeypatch.setattr(hardneg, "ROWS", 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert mined(df, 15, positives=3, negatives=2, low=-50, high=130) == brute(rows, lambda i: i % 15 == 0, 3, 2, -50, 130)


def test_brackets_hold(rows):
    x = np.random.default_rng(1).integers(-300, 300, (50, 8))
    space = hardneg.Space(8, float((x.astype(float) ** 2).sum(axis=1).max()))
    space.choose(x, 6)
    d, q = space.rows(x), space.queries(x)
    true = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + space.most - 2.0 * x @ x.T))
    low, high = np.abs(q[:, None] - d[None]).max(axis=2), (q[:, None] + d[None]).min(axis=2)
    assert (low <= true + space.slack).all() and (true <= high + space.slack).all()


def test_blocks_out_of_reach_are_not_scored(spark, monkeypatch):
    """Rows far from an anchor's best are pruned from the table alone."""
    rng = np.random.default_rng(2)
    centers = 8 * rng.normal(size=(20, 8))
    x = np.floor(256 * (centers[np.repeat(np.arange(20), 100)] + 0.05 * rng.normal(size=(2000, 8)))).astype(np.int64)
    space = hardneg.Space(8, float((x.astype(float) ** 2).sum(axis=1).max()))
    space.choose(x[::50], 16)
    d = space.rows(x)
    import pyarrow as pa

    asked = hardneg.Asked(pa.table({"aid": [0], "id": [5], "label": ["a"], "x": [x[5].tobytes()], "lo": [[-(2**62)]], "hi": [[2**62]]}), space, 5)
    scored = []
    offer = asked.offer
    monkeypatch.setattr(asked, "offer", lambda a, s, i: (scored.append(len(a)), offer(a, s, i)))
    for s in range(0, 2000, 100):
        asked.scan(space, True, "a", np.arange(s, s + 100), x[s : s + 100], d[s : s + 100])
        asked.merge()
    assert sum(scored) < 700
    best = sorted((-int(x[5] @ x[j]), j) for j in range(2000) if j != 5)[:5]
    assert [(int(-s), int(i)) for _, s, i in zip(*asked.best[0])] == best


def test_empty_and_no_anchor(spark, rows):
    assert mined(spark.createDataFrame([], SCHEMA), 10) == []
    assert mined(spark.createDataFrame(rows, SCHEMA).where("vec_id % 10 = 1"), 10) == []
