import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe.plans import tasks
from rainframe.sources import catalog, readers, writers
from rainframe.streaming.daily import daily_totals, write_days


def test_formats():
    assert readers.detect("a/b.nc") == "netcdf" and readers.detect("x.nc.gz") == "netcdf_gz" and readers.detect("x.GRB2") == "grib" and readers.detect("x.dat") == "raw"
    assert readers.detect("d", ["a.nc", "b.tif"]) == "geotiff" and readers.detect("d", ["a.txt"]) == "unknown_dir"


def test_registry_keeps_copies():
    spec = {"format": "raw", "meta": {"shape": [2, 2]}}
    readers.register("r", spec)
    spec["meta"]["shape"].append(9)
    assert readers.registered("r")["meta"]["shape"] == [2, 2] and "r" in readers.reader_names()
    with pytest.raises(KeyError):
        readers.registered("nope")


def test_metadata(spark, tmp_path):
    assert readers.parse_meta("# c\nvar=pr\n\nunits: mm/day\nnx = 2\nurl=a:b=c") == {"var": "pr", "units": "mm/day", "nx": "2", "url": "a:b=c"}
    (tmp_path / "m.txt").write_text("var=pr\nny=3\n")
    assert readers.read_meta(spark, str(tmp_path / "m.txt")) == {"var": "pr", "ny": "3"}
    with pytest.raises(Exception):
        readers.read_meta(spark, str(tmp_path / "none.txt"))


def test_flat_rasters(spark, tmp_path):
    for d in ("20010102", "20010103"):
        np.array([[1, -99, 3], [np.nan, 5, 6]], "float32").tofile(tmp_path / f"pr_{d}.bin")
    meta = {"shape": [2, 3], "nodata": -99, "lat_start": 10, "lat_step": 0.5, "lon": [1, 2, 3]}
    rows = readers.read_grid(spark, str(tmp_path / "*.bin"), meta=meta).collect()
    assert len(rows) == 12 and {r.time for r in rows} == {dt.datetime(2001, 1, 2), dt.datetime(2001, 1, 3)}
    assert {r.cell_id: r.value for r in rows} == {0: 1, 1: None, 2: 3, 3: None, 4: 5, 5: 6}
    assert {(r.lat, r.lon) for r in rows if r.cell_id == 5} == {(10.5, 3.0)}
    with pytest.raises(Exception, match="asks for"):
        readers.read_binary(spark, str(tmp_path / "*.bin"), meta | {"shape": [3, 3], "lat_start": 0, "lon": [1, 2, 3]}).collect()
    with pytest.raises(ValueError, match="cfgrib"):
        readers.read_grid(spark, "x.grb2")
    with pytest.raises(ValueError):
        readers.read_grid(spark, "x.bin")


def test_dates_in_names(spark):
    df = spark.createDataFrame([("a_20010203.tif",), ("b-2001-02-03.x",), ("c200102",), ("none",)], "n string")
    assert [str(r[0])[:10] for r in df.select(readers.date_in_name(F.col("n"))).collect()] == ["2001-02-03", "2001-02-03", "2001-02-01", "None"]


def test_catalogue(spark):
    assert catalog.sources(spark).count() == 47 and catalog.sources(spark, "precipitation").count() > 30
    assert "gleam_monthly_nc" in {r.key for r in catalog.search(spark, "soil_moisture").collect()}
    assert catalog.source(spark, "CMFD")["method"] == "ftp"
    with pytest.raises(KeyError):
        catalog.source(spark, "nope")
    req = catalog.Request("chirps_daily_tif", ("precipitation",), "2001-01-30", "2002-02-02")
    plan = catalog.plan(spark, [req])
    assert plan.first().request_id == "chirps_daily_tif_precipitation_20010130_20020202" and plan.first().method == "http_direct"
    assert catalog.expand(plan, "date").count() == 369 and catalog.expand(plan, "year").count() == 2
    assert [(r.block_start, r.block_end) for r in catalog.expand(plan, "block").collect()] == [(2001, 2010)]
    with pytest.raises(ValueError):
        catalog.plan(spark, [catalog.Request("x", ("v",), "2002-01-01", "2001-01-01")])
    names = spark.createDataFrame([("a.20010101.nc",), ("a.20010101.nc",), ("a.20020101.nc",), ("b.20010101.tif",)], "name string")
    assert [r.name for r in catalog.in_window(names, "2001-01-01", "2001-12-31", r"(\d{8})", (".nc",)).collect()] == ["a.20010101.nc"]
    records = spark.createDataFrame([("SUCCESS", 2 << 20, 2.0), ("FAILED", None, 1.0), ("SUCCESS", 1 << 20, 0.0)], "status string, size_bytes long, elapsed_seconds double")
    m = catalog.manifest(records).first()
    assert (m.attempts, m.success, m.failed, m.success_rate, m.megabytes, m.mean_seconds, m.mean_megabytes_a_second) == (3, 2, 1, 0.667, 3.0, 1.0, 1.0)


def test_scope():
    s = readers.scope()
    assert "NetCDF" in s["formats"] and "unit normalization" in s["steps"]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(dt.datetime(2001, 1, 1) + dt.timedelta(days=i), c, float(i % 7 + c)) for i in range(400) for c in range(4)]
    cube = spark.createDataFrame(rows, "time timestamp_ntz, cell_id long, value double")
    writers.save_cube(cube, f"{tmp_path}/obs")
    writers.save_cube(cube.withColumn("value", F.col("value") * 1.1), f"{tmp_path}/sim")
    spark.createDataFrame([(c, c // 2, c % 2, float(c // 2), float(c % 2)) for c in range(4)], "cell_id long, lat_idx int, lon_idx int, lat double, lon double").write.parquet(f"{tmp_path}/cells")
    (tmp_path / "st.csv").write_text("station,time,lat,lon,obs\ns1,2001-01-03,0.1,0.9,3\ns1,2001-01-04,0.1,0.9,4.5\ns2,1999-01-01,0,0,1\n")
    (tmp_path / "r.geojson").write_text(json.dumps({"features": [{"properties": {"n": "west"}, "geometry": {"type": "Polygon", "coordinates": [[[-0.5, -0.5], [0.5, -0.5], [0.5, 1.5], [-0.5, 1.5], [-0.5, -0.5]]]}}]}))
    return str(tmp_path)


def test_tasks(spark, folder):
    t = {"obs": f"{folder}/obs", "sim": f"{folder}/sim", "group_by": "month", "out_table": f"{folder}/t", "out_group": f"{folder}/g", "out_spatial": f"{folder}/m", "scale": "month"}
    got = tasks.run_all(tasks.evaluation, spark, [t, {"enabled": False}, {"mode": "nope"}], f"{folder}/reports")
    assert [r["status"] for r in got] == ["SUCCESS", "FAILED"] and "nope" in got[1]["error_message"], got
    assert spark.read.csv(f"{folder}/g", header=True).count() == 12 and spark.read.parquet(f"{folder}/m").count() == 4
    assert "succeeded: 1" in "\n".join(r[0] for r in spark.read.text(f"{folder}/reports/report.md").collect())
    st = tasks.recorded(tasks.evaluation, spark, {"mode": "table_to_grid", "obs_table": f"{folder}/st.csv", "sim": f"{folder}/sim", "cells": f"{folder}/cells", "out_table": f"{folder}/st"})
    assert st["status"] == "SUCCESS" and st["stations"] == 2
    assert tasks.recorded(tasks.indices, spark, {"family": "extreme", "input": f"{folder}/obs", "output": f"{folder}/x"})["status"] == "SUCCESS"
    assert tasks.recorded(tasks.indices, spark, {"family": "hydroclimatic", "inputs": {"pr": f"{folder}/obs"}, "indices": ["spi"], "output": f"{folder}/y"})["status"] == "SUCCESS"
    basin = tasks.recorded(tasks.prepare_basin, spark, {"input": f"{folder}/obs", "cells": f"{folder}/cells", "regions": f"{folder}/r.geojson", "region_field": "n", "region_values": ["west"], "time_range": ["2001-03", "2001-03"], "rename": {"value": "pr"}, "output": f"{folder}/b"})
    assert basin["status"] == "SUCCESS", basin
    assert (basin["rows_before"], basin["rows_after"]) == (1600, 62)


def test_ranking_task(spark, tmp_path):
    table = spark.createDataFrame([("A", 1.2, 0.7), ("B", 0.9, 0.6), ("C", 1.0, 0.8)], "product string, RMSE double, KGE double")
    out = tasks.rank_products(spark, {"table": table, "directions": {"RMSE": "cost", "KGE": "benefit"}, "top_n": 2, "out": f"{tmp_path}/o"})
    assert out["selected"].count() == 2 and "consensus" in out
    assert spark.read.csv(f"{tmp_path}/o/borda", header=True).count() == 3


def test_stream_gives_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    write_days(daily_totals(stream, late="0 days"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = {(r.event_type, r.window_start): (r.n, round(r.total, 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.event_type, r.window_start): (r.n, round(r.total, 6)) for r in daily_totals(events).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 5 * 2
