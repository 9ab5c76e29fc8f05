"""Inputs of fits brought together: a reference, products and covariates on the reference's cells and on common days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.missing import finite
from .align import axis_ticks, common_dates
from .regrid import interpolate

MOST_DAYS = 1_000_000  # common days that are sent to the tasks
ROWS_A_TASK = 1_000_000

#: A cube or table by cell_id, and its cells; None: it is on the reference's cells already.
Placed = tuple[DataFrame, DataFrame | None]


def on_cells(cube: DataFrame, cells: DataFrame, target: DataFrame, method: str = "linear") -> DataFrame:
    """cube, interpolated on the cells of target and keyed by their cell_id. The axes of a grid are sent to the tasks; axis_ticks bounds them."""
    lats, lons = axis_ticks(target, "lat"), axis_ticks(target, "lon")
    number = lambda axis, name: F.broadcast(target.sparkSession.createDataFrame(list(enumerate(axis)), f"_{name} long, {name} double"))
    named = target.join(number(lats, "lat"), "lat").join(number(lons, "lon"), "lon").select(F.col("cell_id").alias("_id"), (F.col("_lat") * len(lons) + F.col("_lon")).alias("cell_id"))
    out = interpolate(cube, cells, lats, lons, method)
    return out.join(named, "cell_id").withColumn("cell_id", F.col("_id")).drop("_id")


def together(ref: DataFrame, ref_cells: DataFrame, products: dict[str, Placed], static: dict[str, Placed] | None = None, dynamic: dict[str, Placed] | None = None, zones: DataFrame | None = None, method: str = "linear") -> DataFrame:
    """time, cell_id, ref, a column for each product, each dynamic and each static covariate; zone_id last, where zones are given.

    Times are floored to days; of several rows of a day and cell the mean counts. Days are those that the reference, all products
    and all dynamic covariates have; no such day is an error, and so are two inputs of one name. A row stands for every cell that any
    of them has on such a day; what others lack there is NULL. Of a static covariate with times each cell's first counts.
    Inputs that vary in time are written once each, for the common days and for the rows, so a task holds the groups of one input, not of all.
    Then they take one shuffle by day and cell, to so many partitions that a task has some ROWS_A_TASK rows however many there are."""
    static, moving = static or {}, {"ref": (ref, None), **products, **(dynamic or {})}
    names = ["ref", *products, *(dynamic or {}), *static]
    if len({n.lower() for n in [*names, "time", "cell_id", "zone_id"]}) < len(names) + 3:
        raise ValueError(f"each input needs a name of its own: {names}")
    place = lambda df, cells: df if cells is None else on_cells(df, cells, ref_cells, method)
    moving = {name: (written(cube.select("time", "cell_id", "value"), f"inputs-{i}"), cells) for i, (name, (cube, cells)) in enumerate(moving.items())}
    days = written(common_dates(*(cube for cube, _ in moving.values())), "inputs-days")
    days = F.broadcast(days) if days.count() <= MOST_DAYS else days
    parts, n_rows = [], 0
    for i, (cube, cells) in enumerate(moving.values()):
        met = cube.withColumn("date", F.to_date("time")).join(days, "date", "left_semi").drop("date")
        part = place(met, cells) if cells is None else written(place(met, cells), f"inputs-placed-{i}")
        n_rows += (cube if cells is None else part).count()
        parts.append(part.select(F.to_date("time").alias("time"), "cell_id", finite("value").alias("value"), F.lit(i).alias("_input")))
    n_tasks = max(ref.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_A_TASK))
    out = reduce(DataFrame.unionByName, parts).repartition(n_tasks, "time", "cell_id").groupBy("time", "cell_id").agg(*(F.avg(F.when(F.col("_input") == i, F.col("value"))).alias(name) for i, name in enumerate(moving)))
    for name, (table, cells) in static.items():
        value = finite("value")
        first = table.groupBy("cell_id").agg(F.min_by(value, "time").alias("value")) if "time" in table.columns else table.select("cell_id", value.alias("value"))
        out = out.join(place(first, cells).select("cell_id", F.col("value").alias(name)), "cell_id", "left")
    if zones is not None:
        out = out.join(zones.select("cell_id", "zone_id"), "cell_id", "left")
    return out.select("time", "cell_id", *names, *(["zone_id"] if zones is not None else []))
