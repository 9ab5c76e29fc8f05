import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe.functions import calendar, metrics, missing, special

NAN, INF = float("nan"), float("inf")


def score(spark, obs, sim, names=metrics.CONTINUOUS + metrics.EVENT, threshold=1.0):
    df = spark.createDataFrame(list(zip(obs, sim)), "obs double, sim double")
    return missing.clean(df, "obs", "sim").agg(*metrics.columns(names, threshold)).first().asDict()


def test_continuous_facts(spark):
    got = score(spark, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 5.0])
    assert got["BIAS"] == 0.25 and got["MAE"] == 0.25 and got["RMSE"] == pytest.approx(0.5) and got["NSE"] == pytest.approx(0.8)
    assert got["CORR"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [1, 2, 3, 5])[0, 1])


def test_event_facts(spark):
    got = score(spark, [0.0, 2.0, 0.0, 4.0], [0.0, 3.0, 1.0, 0.0])
    assert (got["POD"], got["FAR"], got["HSS"]) == (0.5, 0.5, 0.0) and got["CSI"] == pytest.approx(1 / 3)


def test_missing_pairs_do_not_count(spark):
    obs, sim = [1.0, 2.0, 3.0, 4.0], [1.5, 2.0, 2.0, 5.0]
    plain = score(spark, obs, sim)
    assert score(spark, [*obs, NAN, INF, None, 7.0, 8.0], [*sim, 1.0, 1.0, 1.0, NAN, -INF]) == pytest.approx(plain)


@pytest.mark.parametrize("obs,sim", [([], []), ([1.0], [2.0]), ([2.0, 2.0, 2.0], [1.0, 2.0, 3.0]), ([0.0, 0.0], [0.0, 0.0])])
def test_undefined_scores_are_null(spark, obs, sim):
    got = score(spark, obs, sim)
    assert all(x is None or math.isfinite(x) for x in got.values())
    assert got["CORR"] is None and got["KGE"] is None and got["NSE"] is None
    assert all(score(spark, obs, sim, metrics.EVENT, None)[k] is None for k in metrics.EVENT)


def test_unknown_metric_is_an_error():
    with pytest.raises(ValueError, match="NOPE"):
        metrics.scores(["bias", "nope"])


def test_nan_is_cleaned_before_comparisons(spark):
    r = spark.createDataFrame([(NAN,), (INF,), (-INF,), (None,), (1.5,)], "v double").agg(F.count_if(missing.finite("v") >= 1).alias("n"), F.count(missing.finite("v")).alias("c")).first()
    assert (r.n, r.c) == (1, 1)
    assert spark.range(1).select(missing.ratio(F.lit(1), F.lit(0)), missing.at_least_zero(F.lit(None).cast("double"))).first() == (None, None)


def test_whole_periods():
    assert calendar.bounds("2001", "2001-03") == (dt.datetime(2001, 1, 1), dt.datetime(2001, 4, 1))
    assert calendar.bounds("2001-12", "2001-12-31")[1] == dt.datetime(2002, 1, 1)
    assert calendar.bounds(None, "20010228")[1] == dt.datetime(2001, 3, 1)


def test_periods_and_seasons(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 12, 31, 5),), (dt.datetime(2000, 2, 29),)], "t timestamp_ntz")
    got = df.select(calendar.period("t", "ME", "end"), calendar.period("t", "A"), calendar.period("t", "quarter", "end"), calendar.season("t")).collect()
    assert [tuple(map(str, r)) for r in got] == [("2001-12-31", "2001-01-01", "2001-12-31", "DJF"), ("2000-02-29", "2000-01-01", "2000-03-31", "DJF")]
    with pytest.raises(ValueError):
        calendar.period("t", "week")


def test_gamma_probabilities():
    x = np.array([0.01, 0.5, 1.0, 3.0, 10.0, 40.0])
    assert np.allclose(special.gamma_cdf(1.0, x), 1 - np.exp(-x), atol=1e-14)
    assert np.allclose(special.gamma_cdf(0.5, x), [math.erf(math.sqrt(v)) for v in x], atol=1e-13)
    assert np.allclose(special.gamma_cdf(2.0, x), 1 - np.exp(-x) * (1 + x), atol=1e-13)


def test_gamma_fit_solves_its_equation():
    x = np.random.default_rng(0).gamma(2.3, 1.7, 4000)
    (a, none), (b, _) = special.gamma_fit([x.mean(), 3.0], [np.log(x).mean(), math.log(3.0)])
    assert abs(np.log(a) - special.digamma(a) - (np.log(x.mean()) - np.log(x).mean())) < 1e-12
    assert a == pytest.approx(2.3, rel=0.1) and a * b == pytest.approx(x.mean())
    assert np.isnan(none)
    many = np.array([0.5, 2.0, 30.0, 2.0])
    at = np.array([0.1, 40.0, 29.0, 1.5])
    assert np.allclose(special.gamma_cdf(many, at), [special.gamma_cdf(m, np.array([v]))[0] for m, v in zip(many, at)], atol=1e-15)
    assert special.normal_quantile(np.array([0.0, 1.0])).tolist() == pytest.approx([-4.753424, 4.753424], abs=1e-6)
