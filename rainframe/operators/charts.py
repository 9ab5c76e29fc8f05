"""Frames that charts are drawn from: diagrams of skill, densities, quartiles, pivots. Drawing itself is left to the reader's tools."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import scores
from ..functions.missing import finite

#: What suits which result. Fixed values.
SUGGESTED = {
    "spatial_nc": ["spatial_map", "multi_spatial_map"],
    "metric_table": ["heatmap", "grouped_bar", "boxplot", "violin"],
    "timeseries": ["line"],
    "grid_compare": ["density_scatter", "taylor", "sal"],
    "performance": ["performance_diagram_seasons", "performance_diagram_months", "performance_diagram_regions"],
    "ranking": ["ranking_bar", "ranking_heatmap"],
}


def suggest(result: str) -> list[str]:
    return SUGGESTED.get(result.lower(), [])


def field(cube: DataFrame, cells: DataFrame, by: tuple[str, ...] = (), at: str | None = None, within: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Maps: a panel for each value of `by`, of its rows at the time `at` or else at its first time; cell_id, lon, lat, value, and
    the least and greatest value of the panel (vmin, vmax). Cubes without a time are maps as they are. within: the cells to show,
    by cell_id. Missing values stay as cells without a value; a panel without rows has none."""
    rows = cube if within is None else cube.join(within.select("cell_id"), "cell_id", "left_semi")
    if "time" in cube.columns:
        if at is not None:
            rows = rows.where(F.col("time") == F.lit(at).cast(cube.schema["time"].dataType))
        elif by:
            keys = {c: f"_{c}" for c in by}
            first = cube.groupBy(*by).agg(F.min("time").alias("_first")).withColumnsRenamed(keys)
            rows = rows.join(first, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()] + [F.col("time") == F.col("_first")], "left_semi")
        else:
            rows = rows.join(cube.agg(F.min("time").alias("_first")), F.col("time") == F.col("_first"), "left_semi")
    shown = rows.join(cells.select("cell_id", "lon", "lat"), "cell_id").select(*by, "cell_id", "lon", "lat", finite(value).alias("value"))
    keys = {c: f"_{c}" for c in by}
    span = shown.groupBy(*by).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax")).withColumnsRenamed(keys)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()] or [F.lit(True)]
    return shown.join(F.broadcast(span) if not by else span, same).drop(*keys.values())


def points(stations: DataFrame, value: str | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Stations on a map: lon, lat (and value) of the rows that have a place."""
    out = stations.select(finite(lon).alias("lon"), finite(lat).alias("lat"), *([finite(value).alias("value")] if value else []))
    return out.where("lon is not null and lat is not null")


def frame(kind: str, **how) -> DataFrame | list[str]:
    """The frame of a kind of chart, of the keywords that its function here takes. timeseries: `inputs`, a table for each name. suggest:
    the kinds that suit a `result`. Other kinds are an error."""
    if kind == "timeseries":
        value, time = how.get("value", "value"), how.get("time", "time")
        named = [df.select(F.lit(n).alias("name"), time, finite(value).alias(value)).dropna() for n, df in how["inputs"].items()]
        return reduce(DataFrame.unionByName, named).orderBy("name", time)
    if kind not in FRAMES:
        raise ValueError(f"unknown kind of chart {kind!r}: {', '.join(sorted([*FRAMES, 'timeseries']))}")
    return FRAMES[kind](**how)


def taylor(pairs: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """ref_std, std, corr and the angle whose cosine corr is."""
    own = pairs.where("obs is not null and sim is not null").groupBy(*by).agg(F.stddev_samp("obs").alias("ref_std"), F.stddev_samp("sim").alias("std"), scores(("CORR",))["CORR"].alias("corr"))
    return own.withColumn("theta", F.acos(F.least(F.greatest("corr", F.lit(-1.0)), F.lit(1.0))))


def performance(detection: DataFrame) -> DataFrame:
    """detection with success_ratio, csi and frequency bias; rows without POD or FAR go."""
    d = detection.where("POD is not null and FAR is not null").withColumn("success_ratio", 1 - F.col("FAR"))
    inv = F.try_divide(F.lit(1.0), F.col("success_ratio")) + F.try_divide(F.lit(1.0), F.col("POD")) - 1
    return d.withColumns({"csi": F.coalesce(F.try_divide(F.lit(1.0), inv), F.lit(0.0)), "bias": F.try_divide(F.col("POD"), F.col("success_ratio"))})


def performance_lines(spark, biases: Iterable[float] = (0.5, 0.7, 1.0, 1.5, 2.0), n: int = 101) -> DataFrame:
    """Lines of equal bias: bias, success_ratio, pod."""
    x = spark.range(n).select((F.col("id") / (n - 1)).alias("success_ratio"))
    return x.select(F.explode(F.array(*(F.lit(float(b)) for b in biases))).alias("bias"), "success_ratio").withColumn("pod", F.col("bias") * F.col("success_ratio")).where("pod <= 1")


def density(pairs: DataFrame, width: float, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Counts in squares of the given width, the distributed stand-in for a kernel density at every point."""
    at = lambda c: (F.floor(F.col(c) / width) * width).alias(c)
    return pairs.where("obs is not null and sim is not null").groupBy(*by, at("obs"), at("sim")).agg(F.count("*").alias("n"))


def axis_limit(pairs: DataFrame, step: float = 5.0) -> float:
    """The least multiple of step that no value exceeds."""
    top = pairs.agg(F.max(F.greatest("obs", "sim"))).first()[0]
    return step if top is None else max(step, math.ceil(top / step) * step)


def group_climatology(obs: DataFrame, sim: DataFrame, group: str = "season") -> DataFrame:
    """group, cell_id, obs, sim: means of each side over its own rows."""
    from .resample import climatology

    left = climatology(obs, group).withColumnRenamed("value", "obs")
    return left.join(climatology(sim, group).withColumnRenamed("value", "sim"), [group, "cell_id"])


def quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    v = finite(value)
    return df.groupBy(group).agg(F.count(v).alias("n"), F.min(v).alias("low"), *(F.percentile(v, q).alias(k) for k, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))), F.max(v).alias("high"), F.avg(v).alias("mean"))


def pivoted(df: DataFrame, index: str, columns: str, value: str, names: Iterable[str] | None = None) -> DataFrame:
    """One row per index, one column per value of columns; two rows for one place are an error."""
    if not df.groupBy(index, columns).count().where("count > 1").isEmpty():
        raise ValueError(f"more than one row for a pair of {index} and {columns}")
    return df.groupBy(index).pivot(columns, list(names) if names else None).agg(F.first(value))


def top(df: DataFrame, score: str = "score", n: int | None = None, ascending: bool = False) -> DataFrame:
    out = df.orderBy(F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score))
    return out if n is None else out.limit(n)


def series(df: DataFrame, value: str = "value", time: str = "time") -> DataFrame:
    return df.select(time, finite(value).alias(value)).dropna().orderBy(time)


FRAMES = {
    "spatial_map": field,
    "multi_spatial_map": field,
    "stations": points,
    "heatmap": pivoted,
    "grouped_bar": pivoted,
    "ranking_heatmap": pivoted,
    "boxplot": quartiles,
    "violin": quartiles,
    "ranking_bar": top,
    "density_scatter": density,
    "taylor": taylor,
    "performance": performance,
    "suggest": suggest,
}
