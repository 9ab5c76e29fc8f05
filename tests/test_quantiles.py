import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe.operators.quantiles import quantiles

AT = [0.0, 0.013, 0.25, 0.5, 0.731, 0.99, 1.0]


def plain(df, by, columns):
    at = F.array(*map(F.lit, AT))
    return {(*[r[k] for k in by], c): list(r[c]) for r in df.groupBy(*by).agg(*(F.percentile(c, at).alias(c) for c in columns)).collect() for c in columns if r[c] is not None}


@pytest.mark.parametrize("bins,few", [(8, 5), (4096, 4096), (3, 1)])
def test_equals_the_percentile_function(spark, bins, few):
    """A hot group, ties, values far apart, null and NaN values, a null key, a column without a value."""
    rng = np.random.default_rng(1)
    rows = [(1, "a", float(x), float(round(x))) for x in rng.lognormal(0, 3, 3000)]
    rows += [(2, "a", 5.0, None), (2, "a", 5.0, float("nan")), (None, "b", -1e300, 3.0), (None, "b", 1e300, 3.0), (None, "b", 1e-300, 3.0), (3, None, 7.5, -0.5)]
    df = spark.createDataFrame(rows, "zone int, kind string, p double, q double").repartition(4)
    if few == 1:
        df = df.where("zone is null or zone <> 1 or p < 0.3")
    got = {(r.zone, r.kind, r.column): list(r["values"]) for r in quantiles(df, ["zone", "kind"], ["p", "q"], AT, bins, few).collect()}
    want = plain(df.withColumn("q", F.when(~F.isnan("q"), F.col("q"))), ["zone", "kind"], ["p", "q"])
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12), k


def test_no_keys_and_empty_table(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    assert list(quantiles(df, [], ["x"], [0.5], 10, 10).first()["values"]) == [df.agg(F.percentile("x", 0.5)).first()[0]]
    assert quantiles(df.where("x < 0"), [], ["x"], [0.5]).count() == 0
