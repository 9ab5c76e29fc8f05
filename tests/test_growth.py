"""What keeps the work of fits and blends in proportion to their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe.operators import fusion, regrid, trees


def plan(df):
    return df._jdf.queryExecution().toString()


def test_distances_are_worked_out_once_for_many_keys(spark):
    """Fifty keys at ten places, side by side in the deals that SIDE_BY_SIDE makes."""
    rng = np.random.default_rng(4)
    rows = [(k, float(p), float(p % 3), float(rng.uniform(0, 9))) for k in range(50) for p in range(10) if (k + p) % 4]
    assert len({r[0] for r in rows}) > regrid.SIDE_BY_SIDE
    cells = spark.createDataFrame([(1, 2.5, 0.5), (2, 7.0, 1.0)], "cell_id long, lat double, lon double")
    got = regrid.idw(spark.createDataFrame(rows, "day int, lat double, lon double, value double"), cells, keys=("day",), block=4)
    got = {(r.day, r.cell_id): r.value for r in got.collect()}
    assert len(got) == 100
    for k in range(50):
        p = np.array([r[1:] for r in rows if r[0] == k])
        for i, lat, lon in ((1, 2.5, 0.5), (2, 7.0, 1.0)):
            w = 1 / ((p[:, 0] - lat) ** 2 + (p[:, 1] - lon) ** 2 + 1e-12)
            assert got[k, i] == pytest.approx((w @ p[:, 2]) / w.sum())


def small(spark):
    rows = spark.createDataFrame([(f"2000-01-{d:02d}", c, float(d + c), float(2 * d)) for d in range(1, 9) for c in range(4)], "time string, cell_id long, ref double, a double").withColumn("time", F.to_timestamp("time"))
    zones = spark.createDataFrame([(c, 1 + c % 2) for c in range(3)], "cell_id long, zone_id int")
    return rows, zones


def test_residuals_are_written_before_they_are_looked_at(spark):
    rows, zones = small(spark)
    cells = spark.createDataFrame([(c, float(c), 0.0) for c in range(4)], "cell_id long, lat double, lon double")
    params = spark.createDataFrame([("evw_ref", z, 1, [1.0]) for z in (1, 2)], "method string, zone_id int, month int, weights array<double>")
    assert fusion.geo_residual(rows, ["a"], zones, params, cells).inputFiles()


def test_no_row_carries_its_quantile_table(spark, monkeypatch):
    rows, zones = small(spark)
    monkeypatch.setattr(fusion, "SENT", 1)  # a table at a time
    tables = spark.createDataFrame([(1, 1, [[2.0, 9.0, 16.0]], [0.0, 7.0, 14.0]), (2, 1, [[2.0, 16.0]], [5.0, 5.0])], "zone_id int, month int, xq array<array<double>>, yq array<double>")
    made = fusion.quantile_map(rows, ["a"], zones, tables)
    assert "xq" not in plan(made)
    assert {(r.time.day, r.cell_id): r.value for r in made.collect()} == {(d, c): pytest.approx(5.0 if c == 1 else 2 * d - 2.0) for d in range(1, 9) for c in range(3)}


def test_trees_take_their_rows_as_arrow(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("g"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))
    models = trees.fit(rows, ["g"], ["x"], "y", trees.Forest(trees=3, depth=4))
    assert "FlatMapGroupsInArrow" in plan(models) and models.count() == 6


def test_leaves_of_deep_and_lone_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = (x[:, 0] > 0) * 2.0 + x[:, 1]
    binned, edges = trees._binned(x)
    feature, cut, child, _ = trees.grow(binned, y, np.ones(3000), 6, 1, 2, rng)

    def slow(r):
        k = 0
        while feature[k] >= 0:
            k = child[k] + (r[feature[k]] > cut[k])
        return k

    assert trees.levels(feature, child) == 6
    assert trees.follow(binned, feature, cut, child, chunk=700).tolist() == [slow(r) for r in binned]
    assert trees.follow(binned, np.array([-1]), np.array([0.0]), np.array([-1])).tolist() == [0] * 3000
