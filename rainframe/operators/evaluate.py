"""Evaluation of products against a reference: overall, by calendar group, by cell, region, elevation and station."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.calendar import NAMED_SEASONS, group_label
from ..functions.missing import finite, require
from .align import pair, station_pairs
from .resample import to_period
from .select import time_range


def overall(pairs: DataFrame, names: Iterable[str] | None = None, threshold: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of scores for each key in `by` (one in all without)."""
    return pairs.groupBy(*by).agg(*metrics.columns(names, threshold))


def grouped(pairs: DataFrame, group: str = "month", names: Iterable[str] | None = None, threshold: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores by month, season or year; the column is named after the group."""
    return pairs.withColumn(group, group_label("time", group)).groupBy(*by, group).agg(*metrics.columns(names, threshold))


def by_cell(pairs: DataFrame, names: Iterable[str] | None = None, threshold: float | None = 1.0) -> DataFrame:
    """Score maps: a row per cell (and product, where there is one)."""
    return overall(pairs, names, threshold, tuple(c for c in ("product", "cell_id") if c in pairs.columns))


def classic_scores(pairs: DataFrame, threshold: float | None = None, group: str | None = None) -> DataFrame:
    """The nine customary scores, in all or by month or season, in the order of the labels."""
    if group is None:
        return overall(pairs, metrics.CLASSIC, threshold)
    return grouped(pairs, group, metrics.CLASSIC, threshold).orderBy(group)


def detection_by_product(cube: DataFrame, reference: str, threshold: float = 1.0) -> DataFrame:
    """POD, FAR, CSI and FBIAS of every product but the reference, in their order."""
    pairs = against_reference(cube, reference)
    return overall(pairs, ("POD", "FAR", "CSI", "FBIAS"), threshold, ("product",)).orderBy("product")


def against_reference(cube: DataFrame, reference: str) -> DataFrame:
    """Pairs of every other product with the reference of the same cube."""
    if cube.where(F.col("product") == reference).isEmpty():
        raise ValueError(f"no product named {reference!r}")
    return pair(cube.where(F.col("product") == reference).drop("product"), cube.where(F.col("product") != reference))


def season_months(seasons: dict[str, Iterable[int]] | None = None) -> list[tuple[str, int]]:
    return [(s, m) for s, months in (seasons or NAMED_SEASONS).items() for m in months]


def temporal_detection(pairs: DataFrame, threshold: float = 1.0, seasons: dict[str, Iterable[int]] | None = None, months: Iterable[int] | None = None) -> DataFrame:
    """product, season, month, POD, FAR: by season where month is NULL, and by month where season is. One scan serves both: counts
    by month are summed into seasons, which may overlap."""
    o, s = F.col("obs"), F.col("sim")
    counts = pairs.groupBy("product", F.month("time").alias("month")).agg(*(c.alias(k) for k, c in metrics.contingency(o, s, threshold).items()))
    named = pairs.sparkSession.createDataFrame(season_months(seasons), "season string, month int")
    seasonal = counts.join(F.broadcast(named), "month").groupBy("product", "season").agg(*(F.sum(k).alias(k) for k in ("hits", "misses", "false_alarms"))).withColumn("month", F.lit(None).cast("int"))
    monthly = counts.where(F.col("month").isin(*(months or range(1, 13)))).withColumn("season", F.lit(None).cast("string"))
    return _detection(seasonal.unionByName(monthly, allowMissingColumns=True), "product", "season", "month")


def _detection(counts: DataFrame, *keys: str) -> DataFrame:
    h, m, f = (F.col(c).cast("double") for c in ("hits", "misses", "false_alarms"))
    return counts.select(*keys, (h / F.nullif(h + m, F.lit(0.0))).alias("POD"), (f / F.nullif(h + f, F.lit(0.0))).alias("FAR"))


def elevation_detection(pairs: DataFrame, elevation: DataFrame, bins: Iterable[tuple[float, float]], threshold: float = 1.0) -> DataFrame:
    """product, elevation ("lo-hi m"), POD, FAR over cells with lo <= dem < hi; bins may overlap or leave gaps. Cells are put
    into bins first, so the many pairs meet an equi-join."""
    made = F.array(*(F.struct(F.lit(f"{lo}-{hi} m").alias("elevation"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in bins))
    cells = elevation.select("cell_id", finite("dem").alias("dem"), F.explode(made).alias("b")).where("dem >= b.lo and dem < b.hi").select("cell_id", "b.elevation")
    return overall(pairs.join(cells, "cell_id"), ("POD", "FAR"), threshold, ("product", "elevation"))


def region_detection(pairs: DataFrame, zones: DataFrame, group: str = "all", threshold: float = 1.0, seasons: dict[str, Iterable[int]] | None = None) -> DataFrame:
    """product, zone_name, (season or month,) POD, FAR. group: all, season (named sets of months) or month."""
    if group not in ("all", "season", "month"):
        raise ValueError(f"unknown group {group!r}: all, season or month")
    rows = pairs.join(zones.select("cell_id", "zone_name"), "cell_id")
    if group == "all":
        return overall(rows, ("POD", "FAR"), threshold, ("product", "zone_name"))
    rows = rows.withColumn("month", F.month("time"))
    if group == "season":
        rows = rows.join(F.broadcast(pairs.sparkSession.createDataFrame(season_months(seasons), "season string, month int")), "month")
    return overall(rows, ("POD", "FAR"), threshold, ("product", "zone_name", group))


def detection_rollup(pairs: DataFrame, zones: DataFrame, threshold: float = 1.0) -> DataFrame:
    """product, zone_name, month, POD, FAR for (product, zone), (product, month) and (product) in one pass by grouping sets."""
    rows = pairs.join(zones.select("cell_id", "zone_name"), "cell_id").withColumn("month", F.month("time"))
    sets = [[F.col("product"), F.col("zone_name")], [F.col("product"), F.col("month")], [F.col("product")]]
    return rows.groupingSets(sets, "product", "zone_name", "month").agg(*metrics.columns(("POD", "FAR"), threshold))


def station_scores(pairs: DataFrame, names: Iterable[str] | None = None, threshold: float = 1.0, station: str = "station", group: str = "none") -> DataFrame:
    """n and scores of every station with pairs, of every product apart where there are products; with a group, by station and group."""
    keys = [c for c in ("product",) if c in pairs.columns] + ([station] if group == "none" else [station, group])
    rows = pairs if group == "none" else pairs.withColumn(group, group_label("time", group))
    return rows.groupBy(*keys).agg(F.count("obs").alias("n"), *metrics.columns(names, threshold))


def evaluate_stations(stations: DataFrame, cube: DataFrame, cells: DataFrame, scale: str = "native", how: str = "sum", start=None, end=None, names: Iterable[str] | None = None, threshold: float = 1.0, station: str = "station", group: str = "none", keep_empty: bool = True) -> DataFrame:
    """Scores of a cube, or of each product of one, at stations (station, time, lat, lon, obs). Both sides are cut to the time range,
    whole end day included, and brought to the time scale. keep_empty: stations without pairs keep a row (for each product), with
    n = 0 and NULL scores."""
    require(stations, station, "time", "lat", "lon", "obs")
    seen = to_period(time_range(stations, start, end), scale, how, (station, "lat", "lon"), value="obs")
    model = to_period(time_range(cube, start, end), scale, how)
    got = station_scores(station_pairs(seen, model, cells, station), names, threshold, station, group)
    if not keep_empty or group != "none":
        return got
    where = stations.groupBy(station).agg(F.min_by(F.struct("lat", "lon"), "time").alias("p")).select(station, "p.lat", "p.lon")
    if "product" in cube.columns:  # products are few: each station asks for all of them
        where = where.crossJoin(F.broadcast(cube.select("product").distinct()))
    return where.join(got, [c for c in ("product", station) if c in where.columns], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def reduce_by_cell(pairs: DataFrame, reduce: Callable, name: str = "score", keys: tuple[str, ...] = ("product", "cell_id")) -> DataFrame:
    """A user's own score of each cell: reduce(obs, sim) -> float is given its present pairs as numpy arrays, in no order, a cell at a time
    (Arrow data of one cell is held). What it cannot answer (an error is passed on) it returns as NaN, which becomes NULL."""
    keys = tuple(c for c in keys if c in pairs.columns)

    @F.pandas_udf("double")
    def made(o: pd.Series, s: pd.Series) -> float:
        return float(reduce(o.to_numpy(float), s.to_numpy(float)))

    rows = pairs.where("obs is not null and sim is not null")
    return rows.groupBy(*keys).agg(finite(made("obs", "sim")).alias(name))


def evaluate_grid(obs: DataFrame, sim: DataFrame, start=None, end=None, scale: str = "native", how: str = "sum") -> DataFrame:
    """Pairs of two cubes cut to a time range and brought to a time scale: what overall, grouped and by_cell share."""
    cut = [to_period(time_range(c, start, end), scale, how) for c in (obs, sim)]
    return pair(*cut)


def scatter_stats(pairs: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """n, bias, rmse, r and the slope through the origin (NULL unless the x side has spread) of sim over obs."""
    o, s = F.col("obs"), F.col("sim")
    made = metrics.scores(("BIAS", "RMSE", "CORR"))
    xx = F.sum(o * o)
    return pairs.where("obs is not null and sim is not null").groupBy(*by).agg(F.count("*").alias("n"), made["BIAS"].alias("bias"), made["RMSE"].alias("rmse"), made["CORR"].alias("r"), (F.sum(o * s) / F.when(xx > 0, xx)).alias("slope"))
