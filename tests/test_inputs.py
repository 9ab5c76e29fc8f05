import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainframe.operators import charts, inputs

CUBE = "time timestamp_ntz, cell_id long, value double"
CELLS = "cell_id long, lat_idx int, lon_idx int, lat double, lon double"


def at(day, hour=0):
    return dt.datetime(2020, 1, day, hour)


def grid(spark, lats, lons, first=0):
    return spark.createDataFrame([(first + i * len(lons) + j, i, j, y, x) for i, y in enumerate(lats) for j, x in enumerate(lons)], CELLS)


def test_products_come_to_the_references_cells_and_common_days(spark):
    cells, coarse = grid(spark, [0.0, 1.0, 2.0], [10.0, 11.0, 12.0], 100), grid(spark, [0.0, 2.0], [10.0, 12.0])
    ref = spark.createDataFrame([(at(t), 100 + c, float(c)) for t in (1, 2, 3) for c in range(9)], CUBE)
    wide = spark.createDataFrame([(at(t, h), c, float(10 * c + t + h)) for t in (2, 3, 4) for h in (0, 2) for c in range(4)], CUBE)
    gappy = spark.createDataFrame([(at(3), 104, float("nan")), (at(3), 105, 7.0), (at(2), 105, None)], CUBE)
    dem = spark.createDataFrame([(at(1), 104, 50.0), (at(2), 104, 60.0)], CUBE)
    zones = spark.createDataFrame([(104, 2, "z")], "cell_id long, zone_id int, zone_name string")
    got = inputs.together(ref, cells, {"p": (wide, coarse), "q": (gappy, None)}, {"dem": (dem, None)}, None, zones)
    assert got.columns == ["time", "cell_id", "ref", "p", "q", "dem", "zone_id"]
    rows = {(r.time.day, r.cell_id): r for r in got.collect()}
    assert set(rows) == {(t, 100 + c) for t in (2, 3) for c in range(9)}
    mid = rows[3, 104]  # the mean of four corners and of two times of the day
    assert (mid.ref, mid.p, mid.q, mid.dem, mid.zone_id) == (4.0, 15 + 3 + 1, None, 50.0, 2)
    assert rows[3, 105].q == 7.0 and rows[2, 105].q is None and rows[2, 108].p == 30 + 2 + 1 and rows[2, 100].dem is None


def test_tasks_have_so_many_rows_however_many_there_are(spark, monkeypatch):
    """Rows are dealt by day and cell to more tasks as they grow; and no task takes rows of several inputs before that."""
    ref = spark.createDataFrame([(at(t), c, float(c)) for t in (1, 2) for c in range(50)], CUBE)
    monkeypatch.setattr(inputs, "ROWS_A_TASK", 4, raising=False)
    got = inputs.together(ref.groupBy("time", "cell_id").agg(F.sum("value").alias("value")), grid(spark, [0.0], [1.0]), {"p": (ref.groupBy("time", "cell_id").agg(F.max("value").alias("value")), None)})
    assert got.rdd.getNumPartitions() == 50
    assert sorted((r.time.day, r.cell_id, r.ref, r.p) for r in got.collect()) == [(t, c, float(c), float(c)) for t in (1, 2) for c in range(50)]


def test_inputs_that_cannot_be_brought_together(spark):
    cells = grid(spark, [0.0, 1.0], [10.0, 11.0])
    ref = spark.createDataFrame([(at(1), 0, 1.0)], CUBE)
    other = spark.createDataFrame([(at(2), 0, 1.0)], CUBE)
    with pytest.raises(ValueError, match="no day in common"):
        inputs.together(ref, cells, {"p": (other, None)})
    with pytest.raises(ValueError, match="a name of its own"):
        inputs.together(ref, cells, {"Ref": (ref, None)})


def test_maps(spark):
    cells = grid(spark, [0.0, 1.0], [10.0, 11.0])
    cube = spark.createDataFrame([("a", at(2), 0, 1.0), ("a", at(1), 0, 5.0), ("a", at(1), 1, float("nan")), (None, at(3), 2, 8.0), (None, at(3), 3, 2.0), (None, at(3), 99, 2.0)], "product string, " + CUBE)
    key = lambda df: sorted(((r["product"], r.cell_id, r.lon, r.lat, r.value, r.vmin, r.vmax) for r in df.collect()), key=str)
    both = [("a", 0, 10.0, 0.0, 5.0, 5.0, 5.0), ("a", 1, 11.0, 0.0, None, 5.0, 5.0), (None, 2, 10.0, 1.0, 8.0, 2.0, 8.0), (None, 3, 11.0, 1.0, 2.0, 2.0, 8.0)]
    assert key(charts.field(cube, cells, ("product",))) == sorted(both, key=str)
    some = charts.field(cube.drop("product"), cells, at="2020-01-03", within=cells.where("cell_id < 3").select("cell_id"))
    assert [tuple(r) for r in some.collect()] == [(2, 10.0, 1.0, 8.0, 8.0, 8.0)]
    assert charts.field(cube.drop("product", "time"), cells).count() == 5
    assert [r.value for r in charts.field(cube.drop("product"), cells).orderBy("cell_id").collect()] == [5.0, None]
    places = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 2.0, 3.0)], "lat double, lon double, v double")
    assert [tuple(r) for r in charts.points(places, "v").collect()] == [(2.0, 1.0, 3.0)]


def test_frames_by_kind(spark):
    one = spark.createDataFrame([(at(2), 0, 1.0), (at(1), 0, float("nan"))], CUBE)
    assert [tuple(r) for r in charts.frame("timeseries", inputs={"y": one, "x": one.withColumn("value", F.lit(4.0))}).collect()] == [("x", at(1), 4.0), ("x", at(2), 4.0), ("y", at(2), 1.0)]
    ranks = spark.createDataFrame([("p", "m", 0.5), ("q", "m", 0.9)], "product string, method string, score double")
    assert [r["product"] for r in charts.frame("ranking_bar", df=ranks, n=1).collect()] == ["q"]
    assert {tuple(r) for r in charts.frame("heatmap", df=ranks, index="product", columns="method", value="score").collect()} == {("p", 0.5), ("q", 0.9)}
    assert charts.frame("suggest", result="Ranking") == ["ranking_bar", "ranking_heatmap"] and charts.frame("suggest", result="none") == []
    with pytest.raises(ValueError, match="unknown kind"):
        charts.frame("pie")
