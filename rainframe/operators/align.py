"""Joins that bring cubes, stations and covariates together.

Cubes are long tables keyed by time and cell_id, so label alignment is an equi-join. Nearest places are found by
search on an axis, nearest times by windows, never by comparing all with all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import finite

KEY = ("time", "cell_id")


def pair(obs: DataFrame, sim: DataFrame, on: tuple[str, ...] = KEY, value: str = "value") -> DataFrame:
    """Keys, obs and sim where both cubes have a row; sim's other columns (its product) stay."""
    left = obs.select(*on, finite(value).alias("obs"))
    right = sim.withColumn("sim", finite(value)).drop(value)
    return right.join(left, list(on), "inner")


def common(cube: DataFrame, products: int | None = None, on: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of a multi-product cube at keys that all its products have. `products`: how many there are, if known."""
    products = products if products is not None else cube.select("product").distinct().count()
    full = cube.groupBy(*on).agg(F.count_distinct("product").alias("n")).where(F.col("n") == products).select(*on)
    return cube.join(full, list(on), "left_semi")


def common_dates(*cubes: DataFrame, time: str = "time") -> DataFrame:
    """The days that all cubes have; none is an error."""
    days = cubes[0].select(F.to_date(time).alias("date")).distinct()
    for c in cubes[1:]:
        days = days.join(c.select(F.to_date(time).alias("date")).distinct(), "date", "left_semi")
    if days.isEmpty():
        raise ValueError("the cubes have no day in common")
    return days


#: Ticks that an axis may have: it is sent to the tasks whole. At a hundredth of a degree the world has 36,000.
MOST_TICKS = 200_000


def snap(column: Column, ticks: list[float]) -> Column:
    """The nearest tick of an ascending axis; of two as near, the larger."""
    axis = np.array(ticks, float)

    @F.pandas_udf("double")
    def nearest(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float, na_value=np.nan)
        high = np.clip(np.searchsorted(axis, x), 1 if len(axis) > 1 else 0, len(axis) - 1)
        low = np.maximum(high - 1, 0)
        return pd.Series(np.where(np.isnan(x), np.nan, np.where(x - axis[low] < axis[high] - x, axis[low], axis[high]))).replace({np.nan: None})

    return nearest(column.cast("double"))


def axis_ticks(cells: DataFrame, axis: str) -> list[float]:
    ticks = cells.select(axis).distinct()
    if (n := ticks.count()) > MOST_TICKS:
        raise ValueError(f"{n} different values of {axis}; an axis may have {MOST_TICKS}")
    return sorted(r[0] for r in ticks.collect())


def nearest_cells(points: DataFrame, cells: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with the cell_id at the nearest latitude and nearest longitude, each axis for itself; a tie goes to the larger
    coordinate, and no distance is too far."""
    placed = points.withColumns({"_lat": snap(F.col(lat), axis_ticks(cells, "lat")), "_lon": snap(F.col(lon), axis_ticks(cells, "lon"))})
    ids = cells.select(F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"), "cell_id")
    return placed.join(ids, ["_lat", "_lon"], "left").drop("_lat", "_lon")


def station_pairs(stations: DataFrame, cube: DataFrame, cells: DataFrame, station: str = "station", time: str = "time", value: str = "obs", cube_value: str = "value") -> DataFrame:
    """station, time, obs and sim at exact times, both present. A station stands where its first row (by time) says."""
    where = stations.groupBy(station).agg(F.min_by(F.struct("lat", "lon"), time).alias("p")).select(station, "p.lat", "p.lon")
    at = nearest_cells(where, cells).select(station, "cell_id")
    rows = stations.select(station, time, finite(value).alias("obs")).where("obs is not null").join(at, station)
    sim = cube.select(F.col("time").alias(time), "cell_id", finite(cube_value).alias("sim"), *(c for c in ("product",) if c in cube.columns)).where("sim is not null")
    return rows.join(sim, [time, "cell_id"]).drop("cell_id")


def nearest_time(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("cell_id",), value: str = "value", time: str = "time") -> DataFrame:
    """left with right's value at the time nearest to its own within the same key; a tie goes to the earlier time."""
    stamp = F.col(time).cast("timestamp")
    rows = left.withColumn("_r", F.lit(None).cast("struct<t:timestamp,v:double>")).withColumn("_left", F.lit(True))
    more = right.select(*by, time, F.struct(stamp.alias("t"), finite(value).alias("v")).alias("_r"), F.lit(False).alias("_left"))
    both = rows.unionByName(more, allowMissingColumns=True)
    past, next_ = Window.partitionBy(*by).orderBy(F.col(time), F.col("_left")), Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col("_left"))
    both = both.withColumn("_p", F.last("_r", True).over(past)).withColumn("_n", F.last("_r", True).over(next_)).where("_left")
    gap = lambda c: F.abs(F.unix_micros(stamp) - F.unix_micros(F.col(c)))
    near = F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull() | (gap("_p.t") <= gap("_n.t")), F.col("_p.v")).otherwise(F.col("_n.v"))
    return both.withColumn(f"near_{value}", near).select(*left.columns, f"near_{value}")
