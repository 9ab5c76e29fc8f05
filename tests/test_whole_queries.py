"""Registered queries take in all zones, days and cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe import queries
from rainframe.operators import fusion, regrid
from rainframe.plans import views as v

SMALL = "/root/testdata/sf0.001"


def test_two_stages_fit_all_zones_with_the_default_forest(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(queries.learn, "fuse_two_stage", lambda rows, products, zones, cfg: seen.update(zones=zones, cfg=cfg) or rows)
    queries.QUERIES["fused_in_two_stages"](spark, SMALL)
    default = queries.learn.TwoStageConfig()
    assert (seen["cfg"].trees, seen["cfg"].depth) == (default.trees, default.depth)
    assert seen["zones"].count() == v.zones(spark, SMALL).count()


def test_mask_keeps_all_days(spark):
    assert queries.QUERIES["masked_outside_zones"](spark, SMALL).count() == v.obs(spark, SMALL).count()
    assert queries.QUERIES["masked_outside_zones_all_days"](spark, SMALL).count() == v.products(spark, SMALL).count()


def test_inverse_distance_takes_all_cells_in_blocks(spark):
    """Against numpy, with blocks far smaller than the samples of a key."""
    rng = np.random.default_rng(1)
    rows = [(k, *map(float, rng.uniform(0, 9, 3))) for k in (1, 2, None) for _ in range(70)]
    at = [(i, float(rng.uniform(0, 9)), float(rng.uniform(0, 9))) for i in range(40)]
    got = regrid.idw(spark.createDataFrame(rows, "month int, lat double, lon double, value double"), spark.createDataFrame(at, "cell_id long, lat double, lon double"), keys=("month",), block=16)
    got = {(r.month, r.cell_id): r.value for r in got.collect()}
    assert len(got) == 120
    for k in (1, 2, None):
        p = np.array([r[1:] for r in rows if r[0] == k])
        for i, lat, lon in at:
            w = 1 / ((p[:, 0] - lat) ** 2 + (p[:, 1] - lon) ** 2 + 1e-12)
            assert got[k, i] == pytest.approx((w @ p[:, 2]) / w.sum())


def test_idw_of_samples_at_one_place(spark):
    """Half of the samples are one row repeated, others share its place: each counts."""
    rows = [(0.0, 0.0, 1.0)] * 500 + [(0.0, 0.0, 3.0)] * 300 + [(0.0, 2.0, 10.0)] * 200
    got = regrid.idw(spark.createDataFrame(rows, "lat double, lon double, value double"), spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0)], "cell_id long, lat double, lon double"), block=16)
    assert {r.cell_id: r.value for r in got.collect()} == {1: pytest.approx((500 + 900 + 2000) / 1000), 2: None}


def test_idw_has_no_row_limit(spark):
    many = spark.range(100_001).select((F.col("id") % 300 / 30).alias("lat"), (F.col("id") / 10_000).alias("lon"), F.lit(2.0).alias("value"))
    assert [r.value for r in regrid.idw(many, spark.createDataFrame([(1, 5.0, 5.0)], "cell_id long, lat double, lon double")).collect()] == [pytest.approx(2.0)]


def test_residuals_are_at_all_cells(spark, monkeypatch):
    """7000 cells of one month, over the sample that was taken before."""
    n = 7000
    rows = spark.range(n).select(F.to_timestamp(F.lit("2000-01-01")).alias("time"), F.col("id").alias("cell_id"), F.lit(2.0).alias("ref"), F.lit(1.0).alias("a"))
    cells = spark.range(n).select(F.col("id").alias("cell_id"), (F.col("id") / 100).alias("lat"), (F.col("id") % 100 * 1.0).alias("lon"))
    zones = spark.range(n).select(F.col("id").alias("cell_id"), F.lit(1).alias("zone_id"))
    params = spark.createDataFrame([("evw_ref", 1, 1, [1.0])], "method string, zone_id int, month int, weights array<double>")
    seen = []
    whole = regrid.idw
    monkeypatch.setattr(regrid, "idw", lambda samples, *a, **k: seen.append(samples.count()) or whole(samples, *a, **k))
    got = fusion.geo_residual(rows, ["a"], zones, params, cells)
    assert seen == [n] and got.count() == n


def test_no_query_cuts_its_tables_by_id():
    assert not any("% 7" in sql for sql in queries.ORACLE_SQL.values())
