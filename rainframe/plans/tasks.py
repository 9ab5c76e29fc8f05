"""Tasks as dicts: evaluation, index, basin and ranking runs, each a lazy plan up to its sinks, with a record of how it went."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drought, evaluate, extremes, fusion, ranking, regions, regrid, select
from ..sources.readers import read_cube, read_table
from ..sources.writers import save_book, save_cube, save_reports, save_table

Run = Callable[[SparkSession, dict], dict]


def recorded(run: Run, spark: SparkSession, task: dict) -> dict:
    """run(task), with its outcome; an error is noted, not raised."""
    began, out = time.time(), {"task": task.get("name", run.__name__), "started": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")}
    try:
        out |= {"status": "SUCCESS", **run(spark, task)}
    except Exception as e:  # noqa: BLE001  a record is what callers ask for
        out |= {"status": "FAILED", "error_message": f"{type(e).__name__}: {e}"}
    return out | {"elapsed_seconds": round(time.time() - began, 3)}


def run_all(run: Run, spark: SparkSession, tasks: list[dict], report_dir: str | None = None) -> list[dict]:
    """Every enabled task, and reports on them."""
    records = [recorded(run, spark, t) for t in tasks if t.get("enabled", True)]
    if report_dir is not None:
        save_reports(spark, records, report_dir)
    return records


def evaluation(spark: SparkSession, task: dict) -> dict:
    """mode grid_to_grid: obs, sim (paths); table_to_grid: obs_table, sim, cells. Then time_range, scale, how, metrics, group_by,
    threshold, and outputs out_table, out_group, out_spatial."""
    mode = task.get("mode", "grid_to_grid")
    start, end = task.get("time_range") or (None, None)
    names, threshold = task.get("metrics"), task.get("threshold", 1.0)
    common = {"start": start, "end": end, "scale": task.get("scale", "native"), "how": task.get("how", "sum")}
    if mode == "grid_to_grid":
        pairs = evaluate.evaluate_grid(read_cube(spark, task["obs"]), read_cube(spark, task["sim"]), **common).cache()
        try:
            table = evaluate.overall(pairs, names, threshold)
            if "out_table" in task:
                save_table(table, task["out_table"])
            if task.get("group_by") and "out_group" in task:
                save_table(evaluate.grouped(pairs, task["group_by"], names, threshold), task["out_group"])
            if "out_spatial" in task:
                save_cube(evaluate.by_cell(pairs, task.get("spatial_metrics"), threshold), task["out_spatial"], ())
            return {"n": pairs.count()}
        finally:
            pairs.unpersist()
    if mode == "table_to_grid":
        stations = read_table(spark, task["obs_table"]).withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon", "obs")})
        cube, cells = read_cube(spark, task["sim"]), spark.read.parquet(task["cells"])
        got = evaluate.evaluate_stations(stations, cube, cells, **common, names=names, threshold=threshold)
        save_table(got, task["out_table"])
        if task.get("group_by", "none") != "none" and "out_group" in task:
            save_table(evaluate.evaluate_stations(stations, cube, cells, **common, names=names, threshold=threshold, group=task["group_by"]), task["out_group"])
        return {"stations": got.count()}
    raise ValueError(f"unknown mode {mode!r}: grid_to_grid or table_to_grid")


def indices(spark: SparkSession, task: dict) -> dict:
    """family extreme (input) or hydroclimatic (inputs by name): indices, params, time_range, output."""
    start, end = task.get("time_range") or (None, None)
    cut = lambda p: select.time_range(read_cube(spark, p), start, end)
    family = task["family"]
    if family == "extreme":
        save_cube(extremes.compute(cut(task["input"]), task.get("indices"), task.get("params")), task["output"], ())
        return {"output": task["output"]}
    if family == "hydroclimatic":
        made = drought.compute({k: cut(p) for k, p in task["inputs"].items()}, task.get("indices", ("spi",)), task.get("params"), task.get("names"))
        for name, df in made.items():
            save_cube(df, f"{task['output']}/{name}", ("year",))
        return {"output": task["output"]}
    raise ValueError(f"unknown family {family!r}: extreme or hydroclimatic")


def prepare_basin(spark: SparkSession, task: dict) -> dict:
    """input, cells, output; in this order bbox, regions (GeoJSON, region_field, region_values), time_range, rename, resample."""
    cells = spark.read.parquet(task["cells"])
    cube = spark.read.parquet(task["input"])
    before = cube.count()
    if box := task.get("bbox"):
        cells = select.box(cells, *box)
    if path := task.get("regions"):
        shapes = regions.read_regions(spark, path)
        if task.get("region_values"):
            shapes = regions.with_field(shapes, task["region_field"], task["region_values"])
        cells = cells.join(regions.containment(cells, shapes).select("cell_id").distinct(), "cell_id", "left_semi")
    cube = cube.join(cells.select("cell_id"), "cell_id", "left_semi")
    cube = select.time_range(cube, *(task.get("time_range") or (None, None)))
    cube = select.rename(cube, task.get("rename"))
    if task.get("target_resolution") or task.get("target_grid"):
        cube = regrid.resample(cube, cells, task.get("target_resolution"), task.get("target_grid"), task.get("method", "linear"), task.get("value", "value"))
    save_cube(cube, task["output"], ("year",) if "time" in cube.columns else ())
    return {"rows_before": before, "rows_after": spark.read.parquet(task["output"]).count()}


def rank_products(spark: SparkSession, task: dict) -> dict[str, DataFrame]:
    """table (path or DataFrame), directions, methods, top_n (3), selection_method, and a cube (path) for fusion "mean" or
    "weighted". Results by method, with selected and fused; written as tables under out, if given. Errors are raised."""
    table = task["table"] if isinstance(task["table"], DataFrame) else read_table(spark, task["table"], time=None)
    results = ranking.run_methods(table, task["directions"], task.get("methods"), task.get("product", "product"))
    chosen = ranking.best(results[task.get("selection_method", "consensus" if "consensus" in results else next(iter(results)))], task.get("top_n", 3))
    out = {**results, "selected": chosen}
    if how := task.get("fusion"):
        rows = chosen.collect()  # top_n rows
        cube = read_cube(spark, task["cube"])
        if how == "mean":
            out["fused"] = fusion.mean_of_best(cube, [r["product"] for r in rows])
        elif how == "weighted":
            score = next((c for c in ("score", "consensus_score") if c in chosen.columns), None)
            out["fused"] = fusion.weighted(cube, {r["product"]: (r[score] if score else 1 / r["rank"]) for r in rows})
        else:
            raise ValueError(f"unknown fusion {how!r}: mean or weighted")
    if path := task.get("out"):
        save_book({k: d for k, d in out.items() if k != "fused"}, path)
        if "fused" in out:
            save_cube(out["fused"].withColumn("product", F.lit("fused")), f"{path}/fused")
    return out
