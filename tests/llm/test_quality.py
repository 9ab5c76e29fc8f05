import random
import re
from collections import Counter

from rainframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def test_base_matches_brute_force(docs, corpus):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.digests(docs).collect())
    assert got == sorted((r[0], *base(r[1])) for r in corpus)


def test_shared_hashes_take_the_slow_path(docs, corpus, monkeypatch):
    monkeypatch.setattr(quality, "POSITION", 60)  # four bits of hash are left
    got = sorted((r.id, r.n_repeat_words) for r in quality.statistics(docs).collect())
    assert got == sorted((r[0], base(r[1])[4]) for r in corpus)


def planted(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "de"]), rng.choice(["a", "b"])
        n = int(rng.lognormvariate(5.5, 0.5)) + 60
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)), lang, source))
    for i in range(900, 930):  # junk: a symbol or three after each word; one enormous word in two
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}###" for _ in range(200)), "en", "a"))
    for i in range(930, 950):
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" + "x" * 60 for _ in range(200)), "de", "b"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_others_stay(spark):
    docs = planted(spark)
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert not any(kept[i] for i in range(900, 950))
    assert sum(not kept[i] for i in range(900)) <= 3


def vectors(rows):
    import numpy as np

    return np.array([[np.log(r.n_words), np.log(r.word_chars / r.n_words), np.sqrt(r.n_symbols / r.n_words), np.sqrt(r.n_repeat_words / r.n_words), np.sqrt(r.n_dup_lines)] for r in rows])


def test_distance_is_mcds(spark):
    """One group of one-line texts, against minimum covariance determinant in numpy from the same starts, run to convergence."""
    import numpy as np
    from pyspark.sql import functions as F

    docs = planted(spark).withColumn("lang", F.lit("en")).withColumn("source", F.lit("a"))
    rows = quality.judge(docs).where("not base_failed").collect()
    x, floor = vectors(rows), np.array(list(quality.FLOORS.values()))
    factor = 0.75 / quality.chi2_cdf(quality.chi2_quantile(0.75, 5), 7)
    dist = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)

    def estimate(part, by=1.0):
        s = np.cov(part.T, bias=True) * by
        return part.mean(axis=0), s + np.diag(np.maximum(0, floor**2 - np.diag(s)))

    m = np.median(x, axis=0)
    start = m, np.diag(np.maximum(1.4826 * np.median(abs(x - m), axis=0), floor) ** 2)
    d = dist(*start)
    ends = []
    for m, s in (start, estimate(x), estimate(x[d <= np.quantile(d, 0.5)])):
        last = np.inf
        while True:
            d = dist(m, s)
            m, s = estimate(x[d <= np.quantile(d, 0.75)], factor)
            if (det := np.linalg.slogdet(s)[1]) >= last - 1e-9:
                break
            last = det
        ends.append((det, m, s))
    d = dist(*min(ends, key=lambda e: e[0])[1:])
    got = np.array([r.d2 for r in rows])
    assert np.median(abs(got / d - 1)) < 0.05
    cut = quality.chi2_quantile(0.9999, 5)
    assert np.mean((got > cut) != (d > cut)) < 0.003 and (d > cut).sum() >= 50


def test_least_determinant_wins_over_a_bad_start(spark):
    """Two thirds tight, one third far and tight too: the estimate of all rows as a start may end elsewhere."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (700, 2)), rng.normal(9, 0.3, (230, 2))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, a double, b double")
    best = quality.minimum_determinant(rows, ["a", "b"], [0.01, 0.01], 0.75, lambda df: df).collect()
    assert len(best) == 1 and abs(best[0].m_0) < 0.3 and abs(best[0].m_1) < 0.3


def test_a_last_step_that_is_worse_does_not_win(spark, monkeypatch):
    """Few rows, so that whole bins are far from exactly h rows and steps may raise the determinant."""
    import numpy as np

    steps, write = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, what: steps.append(write(df, what)) or steps[-1] if what == "quality-estimate" else write(df, what))
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(f"g{g}", *map(float, v)) for g in range(6) for v in rng.normal(0, 1 + g, (40, 2))], "g string, a double, b double")
    best = {r.g: r.log_det for r in quality.minimum_determinant(rows, ["a", "b"], [0.01, 0.01], 0.75, lambda df: df).collect()}
    dets = [(r.g, r.log_det, r.old) for t in steps for r in t.collect()]
    assert any(new > old for _, new, old in dets)
    assert best == {g: min(new for k, new, _ in dets if k == g) for g in best} and len(best) == 6


def test_chi_squared():
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(quality.chi2_quantile(0.99, 5) - 15.086272) < 1e-5
    assert abs(quality.chi2_cdf(3.0, 4) - 0.442175) < 1e-5


def test_empty_table(nothing):
    assert quality.digests(nothing).count() == 0
