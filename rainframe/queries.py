"""The registered queries of the hydroclimate operators, and the same in DuckDB's SQL.

Both sides round doubles to six decimals: sums of doubles depend on their order in the last bits. Before that both add
OFF_TIES, so that means of decimal numbers, which often end in a 5 at the seventh place, are not rounded by those bits."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import written
from .functions.projections import from_epsg
from .operators import align, charts, drought, evaluate, extremes, fusion, inputs, learn, ranking, regions, regrid, resample, select, windows
from .plans import views as v
from .plans.views import OFF_TIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PAIRS = "pairs AS (SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS obs, sum(l_quantity * (1 - l_discount) * (1 + l_tax)) AS sim FROM lineitem GROUP BY 1, 2)"
PRODUCTS = "prods AS (SELECT l_returnflag AS product, l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity * (1 - l_discount) * (1 + l_tax)) AS value FROM lineitem GROUP BY 1, 2, 3)"
PPAIRS = f"{PAIRS}, {PRODUCTS}, pp AS (SELECT product, cell_id, d, obs, value AS sim FROM prods JOIN pairs USING (cell_id, d))"
ZONES = "zones AS (SELECT s_suppkey AS cell_id, r_regionkey + 1 AS zone_id, r_name AS zone_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
CELLS = "cells AS (SELECT s_suppkey AS cell_id, CAST(floor(s_suppkey / 10) AS INT) AS lat_idx, CAST(s_suppkey % 10 AS INT) AS lon_idx, 30 + 0.5::DOUBLE * floor(s_suppkey / 10) AS lat, 100 + 0.5::DOUBLE * (s_suppkey % 10) AS lon FROM supplier)"
MONTHLY = "monthly AS (SELECT cell_id, date_trunc('month', d)::DATE AS m, sum(obs) AS obs, sum(sim) AS sim FROM pairs GROUP BY 1, 2)"
WIDE = f"{PAIRS}, {PRODUCTS}, {MONTHLY}, pm AS (SELECT product, cell_id, date_trunc('month', d)::DATE AS m, sum(value) AS v FROM prods GROUP BY 1, 2, 3), wide AS (SELECT monthly.cell_id, monthly.m, monthly.obs AS ref, max(v) FILTER (product = 'A') AS a, max(v) FILTER (product = 'N') AS n, max(v) FILTER (product = 'R') AS r FROM monthly LEFT JOIN pm USING (cell_id, m) GROUP BY 1, 2, 3)"

CORR = "CASE WHEN count(*) >= 2 AND var_pop(obs) > 0 AND var_pop(sim) > 0 THEN covar_samp(obs, sim) / (stddev_samp(obs) * stddev_samp(sim)) END"
SCORE = {
    "BIAS": "avg(sim - obs)",
    "MAE": "avg(abs(sim - obs))",
    "MSE": "avg((sim - obs) ** 2)",
    "RMSE": "sqrt(avg((sim - obs) ** 2))",
    "CORR": CORR,
    "KGE": f"1 - sqrt((({CORR}) - 1) ** 2 + (stddev_samp(sim) / nullif(stddev_samp(obs), 0) - 1) ** 2 + (avg(sim) / nullif(avg(obs), 0) - 1) ** 2)",
    "NSE": "CASE WHEN count(*) >= 2 THEN 1 - sum((sim - obs) ** 2) / nullif(var_pop(obs) * count(*), 0) END",
    "POD": "H / nullif(H + M, 0)",
    "FAR": "F / nullif(H + F, 0)",
    "CSI": "H / nullif(H + M + F, 0)",
    "FBIAS": "(H + F) / nullif(H + M, 0)",
    "HSS": "2 * (H * C - M * F) / nullif((H + M) * (M + C) + (H + F) * (F + C), 0)",
}


def sql_scores(names, threshold: float | None = None) -> str:
    count = {"H": "obs >= T AND sim >= T", "M": "obs >= T AND sim < T", "F": "obs < T AND sim >= T", "C": "obs < T AND sim < T"}
    fill = lambda m: f"count(*) FILTER ({count[m[0]].replace('T', str(threshold))})::DOUBLE"
    out = []
    for n in names:
        text = SCORE[n]
        if n in ("POD", "FAR", "CSI", "FBIAS", "HSS"):
            text = re.sub(r"\b[HMFC]\b", fill, text) if threshold is not None else "NULL::DOUBLE"
        out.append(f"round({text}, 6) + 0.0 AS {n}")
    return ", ".join(out)


def six(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, without a minus before zero."""
    return df.withColumns({f.name: F.round(F.col(f.name) + F.lit(OFF_TIES), 6) + F.lit(0.0) for f in df.schema if f.dataType.simpleString() == "double"})


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: six(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"(?<!'), 6\)", f" + {OFF_TIES}, 6)", sql)  # not ('Summer', 6)
        return f

    return add


ALL = ("BIAS", "MAE", "MSE", "RMSE", "CORR", "KGE", "NSE", "POD", "FAR", "CSI", "FBIAS", "HSS")
CLASSIC = ("BIAS", "MAE", "RMSE", "CORR", "KGE", "POD", "FAR", "CSI", "FBIAS")


# ---- scores

@query(f"WITH {PAIRS} SELECT {sql_scores(ALL, 30.0)} FROM pairs")
def scores_overall(spark, d):
    return evaluate.overall(v.pairs(spark, d), ALL, 30.0)


@query(f"WITH {PAIRS} SELECT month(d)::INT AS month, {sql_scores(ALL, 30.0)} FROM pairs GROUP BY 1")
def scores_by_month(spark, d):
    return evaluate.grouped(v.pairs(spark, d), "month", ALL, 30.0)


SEASON = "CASE WHEN month(d) IN (12, 1, 2) THEN 'DJF' WHEN month(d) IN (3, 4, 5) THEN 'MAM' WHEN month(d) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


@query(f"WITH {PAIRS} SELECT {SEASON} AS season, {sql_scores(CLASSIC, 30.0)} FROM pairs GROUP BY 1")
def scores_by_season(spark, d):
    return evaluate.classic_scores(v.pairs(spark, d), 30.0, "season")


@query(f"WITH {PAIRS} SELECT year(d)::INT AS year, {sql_scores(('BIAS', 'MAE', 'RMSE', 'CORR', 'KGE', 'NSE'))} FROM pairs GROUP BY 1")
def scores_by_year(spark, d):
    return evaluate.grouped(v.pairs(spark, d), "year")


@query(f"WITH {PPAIRS} SELECT product, cell_id, {sql_scores(ALL, 30.0)} FROM pp GROUP BY 1, 2")
def score_maps(spark, d):
    return evaluate.by_cell(v.product_pairs(spark, d), ALL, 30.0)


@query(f"WITH {PAIRS} SELECT count(*) FILTER (obs >= 30 AND sim >= 30) AS hits, count(*) FILTER (obs >= 30 AND sim < 30) AS misses, count(*) FILTER (obs < 30 AND sim >= 30) AS false_alarms, count(*) FILTER (obs < 30 AND sim < 30) AS correct_negatives FROM pairs")
def contingency_table(spark, d):
    from .functions.metrics import contingency

    return v.pairs(spark, d).agg(*(c.alias(k) for k, c in contingency(F.col("obs"), F.col("sim"), 30.0).items()))


@query(f"WITH {PPAIRS} SELECT product, {sql_scores(('POD', 'FAR', 'CSI', 'FBIAS'), 30.0)} FROM pp GROUP BY 1")
def detection_by_product(spark, d):
    return evaluate.detection_by_product(v.with_reference(spark, d), "REF", 30.0)


@query(f"WITH {PPAIRS}, s(season, month) AS (VALUES ('Spring', 3), ('Spring', 4), ('Spring', 5), ('Summer', 6), ('Summer', 7), ('Summer', 8), ('Autumn', 9), ('Autumn', 10), ('Autumn', 11), ('Winter', 12), ('Winter', 1), ('Winter', 2)) SELECT product, season, NULL::INT AS month, {sql_scores(('POD', 'FAR'), 30.0)} FROM pp JOIN s ON month(d) = month GROUP BY 1, 2 UNION ALL SELECT product, NULL, month(d)::INT, {sql_scores(('POD', 'FAR'), 30.0)} FROM pp GROUP BY 1, 3")
def detection_by_season_and_month(spark, d):
    return evaluate.temporal_detection(v.product_pairs(spark, d), 30.0)


@query(f"WITH {PPAIRS}, b(elevation, lo, hi) AS (VALUES ('-1000-2000 m', -1000, 2000), ('2000-5000 m', 2000, 5000), ('4000-10000 m', 4000, 10000)) SELECT product, elevation, {sql_scores(('POD', 'FAR'), 30.0)} FROM pp JOIN supplier ON cell_id = s_suppkey JOIN b ON s_acctbal >= lo AND s_acctbal < hi GROUP BY 1, 2")
def detection_by_elevation(spark, d):
    return evaluate.elevation_detection(v.product_pairs(spark, d), v.elevation(spark, d), [(-1000, 2000), (2000, 5000), (4000, 10000)], 30.0)


@query(f"WITH {PPAIRS}, {ZONES}, s(season, month) AS (VALUES ('Spring', 3), ('Spring', 4), ('Spring', 5), ('Summer', 6), ('Summer', 7), ('Summer', 8), ('Autumn', 9), ('Autumn', 10), ('Autumn', 11), ('Winter', 12), ('Winter', 1), ('Winter', 2)) SELECT product, zone_name, season, {sql_scores(('POD', 'FAR'), 30.0)} FROM pp JOIN zones USING (cell_id) JOIN s ON month(d) = month GROUP BY 1, 2, 3")
def detection_by_region_and_season(spark, d):
    return evaluate.region_detection(v.product_pairs(spark, d), v.zones(spark, d), "season", 30.0)


@query(f"WITH {PPAIRS}, {ZONES} SELECT product, zone_name, month, {sql_scores(('POD', 'FAR'), 30.0)} FROM (SELECT *, month(d)::INT AS month FROM pp JOIN zones USING (cell_id)) GROUP BY GROUPING SETS ((product, zone_name), (product, month), (product))")
def detection_rollup(spark, d):
    return evaluate.detection_rollup(v.product_pairs(spark, d), v.zones(spark, d), 30.0)


@query(f"WITH {PPAIRS} SELECT product, count(*) AS n, round(avg(sim - obs), 6) + 0.0 AS bias, round(sqrt(avg((sim - obs) ** 2)), 6) AS rmse, round({CORR}, 6) AS r, round(sum(obs * sim) / nullif(sum(obs * obs), 0), 6) AS slope FROM pp GROUP BY 1")
def scatter_statistics(spark, d):
    return evaluate.scatter_stats(v.product_pairs(spark, d))


@query(f"WITH {PAIRS}, {MONTHLY} SELECT {sql_scores(('BIAS', 'RMSE', 'CORR'))} FROM monthly WHERE m >= DATE '1996-01-01' AND m < DATE '1999-01-01'")
def monthly_grid_evaluation(spark, d):
    return evaluate.overall(evaluate.evaluate_grid(v.obs(spark, d), v.sim(spark, d), "1996", "1998", "month"), ("BIAS", "RMSE", "CORR"))


STATIONS = "day AS (SELECT o_custkey AS station, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) / 1000 AS obs FROM orders GROUP BY 1, 2), st AS (SELECT c_custkey AS station, 30 + (c_custkey % 37) * 0.17::DOUBLE AS lat, 100 + (c_custkey % 29) * 0.19::DOUBLE AS lon FROM customer), at AS (SELECT station, arg_min(a.t, abs(a.t - st.lat) - a.t * 1e-9) AS nlat FROM st, (SELECT DISTINCT lat AS t FROM cells) a GROUP BY 1), on_ AS (SELECT station, arg_min(o.t, abs(o.t - st.lon) - o.t * 1e-9) AS nlon FROM st, (SELECT DISTINCT lon AS t FROM cells) o GROUP BY 1), place AS (SELECT station, cell_id FROM at JOIN on_ USING (station) JOIN cells ON lat = nlat AND lon = nlon)"


@query(f"WITH {CELLS}, {STATIONS.replace('at AS (', 'ats AS (').replace('FROM at JOIN', 'FROM ats JOIN')} SELECT station, cell_id FROM place")
def nearest_pixels(spark, d):
    where = v.stations(spark, d).select("station", "lat", "lon").distinct()
    full = v.table(spark, d, "customer").select(F.col("c_custkey").alias("station"), (30 + (F.col("c_custkey") % 37) * 0.17).cast("double").alias("lat"), (100 + (F.col("c_custkey") % 29) * 0.19).cast("double").alias("lon"))
    return align.nearest_cells(full.join(where.select("station"), "station", "left").select("station", "lat", "lon"), v.cells(spark, d)).select("station", "cell_id")


@query(f"WITH {CELLS}, {PAIRS}, {STATIONS.replace('at AS (', 'ats AS (').replace('FROM at JOIN', 'FROM ats JOIN')}, sp AS (SELECT station, day.obs, pairs.sim FROM day JOIN place USING (station) JOIN pairs USING (cell_id, d)), sc AS (SELECT station, count(*) AS n, {sql_scores(('BIAS', 'MAE', 'RMSE', 'CORR', 'POD', 'FAR'), 100.0)} FROM sp GROUP BY 1) SELECT station, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(n, 0) AS n, BIAS, MAE, RMSE, CORR, POD, FAR FROM (SELECT DISTINCT station FROM day) JOIN st USING (station) LEFT JOIN sc USING (station)")
def station_evaluation(spark, d):
    return evaluate.evaluate_stations(v.stations(spark, d), v.sim(spark, d), v.cells(spark, d), names=("BIAS", "MAE", "RMSE", "CORR", "POD", "FAR"), threshold=100.0)


@query(f"WITH {CELLS}, {PPAIRS}, {STATIONS.replace('at AS (', 'ats AS (').replace('FROM at JOIN', 'FROM ats JOIN')}, sp AS (SELECT product, station, month(day.d)::INT AS month, day.obs, prods.value AS sim FROM day JOIN place USING (station) JOIN prods USING (cell_id, d)) SELECT product, station, month, count(*) AS n, {sql_scores(('BIAS', 'RMSE', 'POD', 'FAR'), 100.0)} FROM sp GROUP BY 1, 2, 3")
def station_evaluation_by_product(spark, d):
    return evaluate.evaluate_stations(v.stations(spark, d), v.products(spark, d), v.cells(spark, d), names=("BIAS", "RMSE", "POD", "FAR"), threshold=100.0, group="month")


@query(f"WITH {PPAIRS} SELECT product, cell_id, round(median(abs(sim - obs)), 6) AS median_error FROM pp GROUP BY 1, 2")
def own_score_by_cell(spark, d):
    import numpy as np

    return evaluate.reduce_by_cell(v.product_pairs(spark, d), lambda o, s: np.median(abs(s - o)), "median_error")


# ---- selection, time, alignment

@query(f"WITH {PAIRS}, {CELLS} SELECT cell_id, d AS time, round(obs, 6) AS value FROM pairs JOIN cells USING (cell_id) WHERE lat BETWEEN 30.5 AND 32 AND lon BETWEEN 101 AND 103 AND d >= DATE '1997-03-01' AND d < DATE '1998-01-01' AND month(d) IN (6, 7, 12)")
def box_time_and_months(spark, d):
    rows = v.obs(spark, d).join(v.cells(spark, d), "cell_id")
    rows = select.months(select.time_range(select.box(rows, 101, 103, 30.5, 32), "1997-03", "1997"), (6, 7, 12))
    return rows.select("cell_id", F.to_date("time").alias("time"), "value")


@query(f"WITH {PAIRS} SELECT cell_id, date_trunc('month', d)::DATE AS time, round(sum(obs), 6) AS value FROM pairs GROUP BY 1, 2")
def monthly_totals(spark, d):
    return resample.to_period(v.obs(spark, d), "month")


@query(f"WITH {PRODUCTS} SELECT product, cell_id, (date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS time, round(max(value), 6) AS value FROM prods GROUP BY 1, 2, 3")
def quarterly_maxima(spark, d):
    return resample.to_period(v.products(spark, d), "quarter", "max", label="end")


@query(f"WITH {PAIRS}, {MONTHLY}, span AS (SELECT cell_id, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM monthly GROUP BY 1) SELECT cell_id, m AS time, round(coalesce(obs, 0), 6) AS value FROM span LEFT JOIN monthly USING (cell_id, m)")
def monthly_totals_without_gaps(spark, d):
    return resample.to_period(v.obs(spark, d), "month", fill_gaps=True, empty_sum="zero")


@query(f"WITH {PAIRS} SELECT {SEASON} AS season, cell_id, round(avg(obs), 6) AS obs, round(avg(sim), 6) AS sim FROM pairs GROUP BY 1, 2")
def seasonal_climatology(spark, d):
    return charts.group_climatology(v.obs(spark, d), v.sim(spark, d), "season")


@query(f"WITH {PAIRS} SELECT ((d - (SELECT min(d) FROM pairs)) // 31)::INT AS block, round(sum(obs), 6) AS total, count(*) AS n FROM pairs GROUP BY 1")
def blocks_of_days(spark, d):
    return resample.with_block(v.obs(spark, d), 31).groupBy("block").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT DISTINCT d AS time, round(sin(dayofyear(d) * 2 * pi() / 365.25), 6) + 0.0 AS doy_sin, round(cos(dayofyear(d) * 2 * pi() / 365.25), 6) + 0.0 AS doy_cos, round(sin(month(d) * 2 * pi() / 12), 6) + 0.0 AS month_sin, round(cos(month(d) * 2 * pi() / 12), 6) + 0.0 AS month_cos FROM pairs")
def calendar_features(spark, d):
    from .functions.calendar import cycle_features

    return v.obs(spark, d).select(F.to_date("time").alias("time")).distinct().withColumns(cycle_features("time"))


@query(f"WITH {PRODUCTS}, y AS (SELECT product, cell_id, date_trunc('year', d)::DATE AS y, sum(value) AS v FROM prods GROUP BY 1, 2, 3) SELECT product, cell_id, y AS time, round(v, 6) AS value FROM y SEMI JOIN (SELECT cell_id, y FROM y GROUP BY 1, 2 HAVING count(DISTINCT product) = (SELECT count(DISTINCT product) FROM y)) USING (cell_id, y)")
def common_to_all_products(spark, d):
    """Yearly totals of cells and years that all products have."""
    return align.common(resample.to_period(v.products(spark, d), "year"))


@query(f"WITH {PRODUCTS}, a AS (SELECT cell_id, d FROM prods WHERE product = 'A'), r AS (SELECT cell_id, d, value FROM prods WHERE product = 'R'), b AS (SELECT a.cell_id, a.d, r.d AS rd, r.value FROM a ASOF LEFT JOIN r ON a.cell_id = r.cell_id AND a.d >= r.d), f AS (SELECT a.cell_id, a.d, r.d AS rd, r.value FROM a ASOF LEFT JOIN r ON a.cell_id = r.cell_id AND a.d <= r.d) SELECT b.cell_id, b.d AS time, round(CASE WHEN b.rd IS NULL THEN f.value WHEN f.rd IS NULL OR b.d - b.rd <= f.rd - b.d THEN b.value ELSE f.value END, 6) AS near_value FROM b JOIN f USING (cell_id, d)")
def nearest_in_time(spark, d):
    p = v.products(spark, d)
    met = align.nearest_time(p.where("product = 'A'").select("cell_id", "time"), p.where("product = 'R'").select("cell_id", "time", "value"))
    return met.select("cell_id", F.to_date("time").alias("time"), "near_value")


@query(f"WITH {PAIRS}, {MONTHLY} SELECT cell_id, m AS time, round(CASE WHEN count(obs) OVER w = 3 THEN sum(obs) OVER w END, 6) AS value FROM monthly WINDOW w AS (PARTITION BY cell_id ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_three_months(spark, d):
    return windows.rolling(resample.to_period(v.obs(spark, d), "month"), 3)


# ---- regions and grids

@query(f"WITH {PAIRS}, {ZONES} SELECT zone_name, d AS time, round(avg(obs), 6) AS value FROM pairs JOIN zones USING (cell_id) GROUP BY 1, 2")
def zone_means(spark, d):
    return regions.zone_mean(v.obs(spark, d), v.zones(spark, d)).withColumn("time", F.to_date("time"))


MASKED = "CASE WHEN cell_id IN (SELECT cell_id FROM zones WHERE zone_name IN ('ASIA', 'EUROPE')) THEN round({}, 6) END AS value"


@query(f"WITH {PAIRS}, {ZONES} SELECT cell_id, d AS time, {MASKED.format('obs')} FROM pairs")
def masked_outside_zones(spark, d):
    some = v.zones(spark, d).where("zone_name in ('ASIA', 'EUROPE')")
    return regions.clip(v.obs(spark, d), some, drop=False).select("cell_id", F.to_date("time").alias("time"), "value")


@query(f"WITH {PRODUCTS}, {ZONES} SELECT product, cell_id, d AS time, {MASKED.format('value')} FROM prods")
def masked_outside_zones_all_days(spark, d):
    """Of every product."""
    some = v.zones(spark, d).where("zone_name in ('ASIA', 'EUROPE')")
    return regions.clip(v.products(spark, d), some, drop=False).select("product", "cell_id", F.to_date("time").alias("time"), "value")


@query(f"WITH {CELLS}, p(name, x1, y1, x2, y2, x3, y3) AS (VALUES (1, 0, 0, 0, 0, 0, 0)) SELECT cell_id, CASE WHEN lat < 31.3 AND lon < 102.3 THEN 1 ELSE 2 END AS zone_id, CASE WHEN lat < 31.3 AND lon < 102.3 THEN 'a' ELSE 'b' END AS zone_name FROM cells WHERE (lat < 31.3 AND lon < 102.3) OR (lat > 31.3 AND lat < 33.7 AND lon > 101.2 AND lon < 103.8)")
def cells_in_polygons(spark, d):
    box = lambda x1, y1, x2, y2: [[(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]]
    shapes = spark.createDataFrame([(0, "b", box(101.2, 31.3, 103.8, 33.7), {}), (1, "a", box(99.0, 29.0, 102.3, 31.3), {})], regions.REGIONS)
    return regions.zone_table(v.cells(spark, d), shapes)


@query(f"WITH {CELLS} SELECT cell_id, CASE WHEN lat < 31.3 AND lon < 102.3 THEN 1 ELSE 2 END AS zone_id, CASE WHEN lat < 31.3 AND lon < 102.3 THEN 'a' ELSE 'b' END AS zone_name FROM cells WHERE (lat < 31.3 AND lon < 102.3) OR (lat > 31.3 AND lat < 33.7 AND lon > 101.2 AND lon < 103.8)")
def cells_in_projected_polygons(spark, d):
    """The same polygons, given in metres of Web Mercator."""
    x, y = (lambda lon: math.radians(lon) * 6378137.0), (lambda lat: math.asinh(math.tan(math.radians(lat))) * 6378137.0)
    box = lambda a, b, c, d: [[(x(a), y(b)), (x(c), y(b)), (x(c), y(d)), (x(a), y(d)), (x(a), y(b))]]
    shapes = spark.createDataFrame([(0, "b", box(101.2, 31.3, 103.8, 33.7), {}), (1, "a", box(99.0, 29.0, 102.3, 31.3), {})], regions.REGIONS)
    return regions.zone_table(v.cells(spark, d), regions.in_degrees(shapes, from_epsg(3857)))


@query(f"WITH {PAIRS}, {CELLS} SELECT d AS time, (lat_idx // 2)::INT AS lat_block, (lon_idx // 2)::INT AS lon_block, round(avg(obs), 6) AS value FROM pairs JOIN cells USING (cell_id) WHERE lat_idx // 2 < (SELECT (max(lat_idx) + 1) // 2 FROM cells) GROUP BY 1, 2, 3")
def coarsened_grid(spark, d):
    return regrid.coarsen(v.obs(spark, d), v.cells(spark, d), 2, 2, "mean").withColumn("time", F.to_date("time"))


GRID_LATS, GRID_LONS = [30.1, 30.75, 31.5, 33.9, 40.0], [99.0, 100.0, 101.3, 102.25, 104.45]
AXIS = "tl(i, t) AS (VALUES " + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(GRID_LATS)) + "), tn(j, t) AS (VALUES " + ", ".join(f"({j}, {t}::DOUBLE)" for j, t in enumerate(GRID_LONS)) + ")"
HAT = "wl AS (SELECT i, lat, 1 - abs(tl.t - lat) / 0.5 AS w FROM tl, (SELECT DISTINCT lat FROM cells) WHERE abs(tl.t - lat) < 0.5 - 1e-9 AND tl.t BETWEEN (SELECT min(lat) FROM cells) AND (SELECT max(lat) FROM cells)), wn AS (SELECT j, lon, 1 - abs(tn.t - lon) / 0.5 AS w FROM tn, (SELECT DISTINCT lon FROM cells) WHERE abs(tn.t - lon) < 0.5 - 1e-9 AND tn.t BETWEEN (SELECT min(lon) FROM cells) AND (SELECT max(lon) FROM cells)), w AS (SELECT i * 5 + j AS target, cell_id, wl.w * wn.w AS w FROM wl JOIN cells USING (lat) JOIN wn USING (lon))"


@query(f"WITH {PAIRS}, {MONTHLY}, {CELLS}, {AXIS}, {HAT}, need AS (SELECT target, count(*) AS need FROM w GROUP BY 1) SELECT m AS time, target::BIGINT AS cell_id, round(CASE WHEN count(obs) = any_value(need) THEN sum(obs * w) END, 6) AS value FROM monthly JOIN w USING (cell_id) JOIN need USING (target) GROUP BY 1, 2")
def bilinear_regrid(spark, d):
    return regrid.interpolate(resample.to_period(v.obs(spark, d), "month"), v.cells(spark, d), GRID_LATS, GRID_LONS)


NEAR = "nl AS (SELECT i, arg_min(lat, abs(tl.t - lat) - lat * 1e-9) AS lat FROM tl, (SELECT DISTINCT lat FROM cells) WHERE tl.t BETWEEN (SELECT min(lat) FROM cells) AND (SELECT max(lat) FROM cells) GROUP BY 1), nn AS (SELECT j, arg_min(lon, abs(tn.t - lon) - lon * 1e-9) AS lon FROM tn, (SELECT DISTINCT lon FROM cells) WHERE tn.t BETWEEN (SELECT min(lon) FROM cells) AND (SELECT max(lon) FROM cells) GROUP BY 1)"


@query(f"WITH {PAIRS}, {MONTHLY}, {CELLS}, {AXIS}, {NEAR} SELECT m AS time, (i * 5 + j)::BIGINT AS cell_id, round(obs, 6) AS value FROM monthly JOIN cells USING (cell_id) JOIN nl USING (lat) JOIN nn USING (lon)")
def nearest_regrid(spark, d):
    return regrid.interpolate(resample.to_period(v.obs(spark, d), "month"), v.cells(spark, d), GRID_LATS, GRID_LONS, "nearest")


WEIGHTED = "sum(s.v / ((c.lat - s.lat) ** 2 + (c.lon - s.lon) ** 2 + 1e-12)) / sum(1 / ((c.lat - s.lat) ** 2 + (c.lon - s.lon) ** 2 + 1e-12))"


@query(f"WITH {PAIRS}, {CELLS}, s AS (SELECT month(d)::INT AS month, lat, lon, avg(sim - obs) AS v FROM pairs JOIN cells USING (cell_id) GROUP BY 1, 2, 3) SELECT s.month, c.cell_id, round({WEIGHTED}, 6) + 0.0 AS value FROM cells c, s GROUP BY 1, 2")
def inverse_distance(spark, d):
    """The mean error of each cell and calendar month, spread to all cells."""
    cells = v.cells(spark, d)
    means = v.pairs(spark, d).groupBy("cell_id", F.month("time").alias("month")).agg(F.avg(F.col("sim") - F.col("obs")).alias("value"))
    return regrid.idw(means.join(cells, "cell_id"), cells, keys=("month",))


@query(f"WITH {PAIRS}, {CELLS}, s AS (SELECT cell_id, lat, lon, avg(obs) AS v FROM pairs JOIN cells USING (cell_id) GROUP BY 1, 2, 3) SELECT c.cell_id, round({WEIGHTED}, 6) AS value FROM cells c, s GROUP BY 1")
def inverse_distance_all_cells(spark, d):
    cells = v.cells(spark, d)
    means = v.obs(spark, d).groupBy("cell_id").agg(F.avg("value").alias("value"))
    return regrid.idw(means.join(cells, "cell_id"), cells)


# ---- extremes

def _extreme(name: str, body: str, f) -> None:
    def run(spark, d):
        return f(v.obs(spark, d))

    run.__name__ = name
    query(f"WITH {PAIRS} {body}")(run)


YEAR = "date_trunc('year', d)::DATE AS period"
_extreme("wettest_day", f"SELECT cell_id, {YEAR}, round(max(obs), 6) AS rx1day FROM pairs GROUP BY 1, 2", extremes.rx1day)
_extreme("wettest_five_days", f", w AS (SELECT cell_id, d, CASE WHEN count(obs) OVER f = 5 THEN sum(obs) OVER f END AS s FROM pairs WINDOW f AS (PARTITION BY cell_id ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT cell_id, {YEAR}, round(max(s), 6) AS rx5day FROM w GROUP BY 1, 2", extremes.rx5day)
_extreme("wet_day_total", f"SELECT cell_id, {YEAR}, round(sum(obs) FILTER (obs >= 20), 6) AS prcptot FROM pairs GROUP BY 1, 2", lambda x: extremes.prcptot(x, wet_threshold=20.0))
_extreme("wet_day_intensity", f"SELECT cell_id, {YEAR}, round(avg(obs) FILTER (obs >= 20), 6) AS sdii FROM pairs GROUP BY 1, 2", lambda x: extremes.sdii(x, wet_threshold=20.0))
_extreme("heavy_days", f"SELECT cell_id, {YEAR}, count(*) FILTER (obs >= 10) AS r10mm FROM pairs GROUP BY 1, 2", extremes.r10mm)
_extreme("very_heavy_days", f"SELECT cell_id, {YEAR}, count(*) FILTER (obs >= 20) AS r20mm FROM pairs GROUP BY 1, 2", extremes.r20mm)
for _q, _f in ((95, extremes.r95p), (99, extremes.r99p)):
    _extreme(f"very_wet_days_p{_q}", f", t AS (SELECT cell_id, quantile_cont(obs, 0.{_q}) AS t FROM pairs WHERE obs >= 1 GROUP BY 1) SELECT cell_id, {YEAR}, round(sum(obs) FILTER (obs > t), 6) AS r{_q}p FROM pairs JOIN t USING (cell_id) GROUP BY 1, 2", _f)
RUNS = ", e AS (SELECT cell_id, year(d)::INT AS year, d, {event} AS e FROM pairs), i AS (SELECT cell_id, year, e, row_number() OVER (PARTITION BY cell_id, year ORDER BY d) - row_number() OVER (PARTITION BY cell_id, year, e ORDER BY d) AS g FROM e), r AS (SELECT cell_id, year, e, g, count(*) AS n FROM i GROUP BY 1, 2, 3, 4) SELECT cell_id, year, coalesce(max(n) FILTER (e), 0) AS {name} FROM r GROUP BY 1, 2"
_extreme("longest_dry_spell", RUNS.format(event="obs < 25", name="cdd"), lambda x: extremes.cdd(x, 25.0))
_extreme("longest_wet_spell", RUNS.format(event="obs >= 25", name="cwd"), lambda x: extremes.cwd(x, 25.0))


@query(f"WITH {PAIRS} SELECT cell_id, year(d)::INT AS year, round(max(obs), 6) AS rx1day, count(*) FILTER (obs >= 10) AS r10mm, round(sum(obs) FILTER (obs >= 20), 6) AS prcptot FROM pairs GROUP BY 1, 2")
def extreme_indices_together(spark, d):
    return extremes.compute(v.obs(spark, d), ("rx1day", "r10mm", "prcptot"), {"prcptot": {"wet_threshold": 20.0}})


SPELLS = ", e AS (SELECT cell_id, year(d)::INT AS year, d, obs < 1 AS e FROM pairs), i AS (SELECT cell_id, year, e, row_number() OVER (PARTITION BY cell_id, year ORDER BY d) - row_number() OVER (PARTITION BY cell_id, year, e ORDER BY d) AS g FROM e), r AS (SELECT cell_id, year, e, g, count(*) AS n FROM i GROUP BY 1, 2, 3, 4), sp AS (SELECT cell_id, year, coalesce(max(n) FILTER (e), 0) AS cdd, coalesce(max(n) FILTER (NOT e), 0) AS cwd FROM r GROUP BY 1, 2)"
LIMITS = ", t AS (SELECT cell_id, quantile_cont(obs, 0.95) AS t95, quantile_cont(obs, 0.99) AS t99 FROM pairs WHERE obs >= 1 GROUP BY 1), w AS (SELECT *, CASE WHEN count(obs) OVER f = 5 THEN sum(obs) OVER f END AS s FROM pairs WINDOW f AS (PARTITION BY cell_id ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"


@query(f"WITH {PAIRS}{SPELLS}{LIMITS} SELECT w.cell_id, year(d)::INT AS year, round(max(obs), 6) AS rx1day, round(max(s), 6) AS rx5day, round(sum(obs) FILTER (obs >= 1), 6) AS prcptot, round(avg(obs) FILTER (obs >= 1), 6) AS sdii, count(*) FILTER (obs >= 10) AS r10mm, count(*) FILTER (obs >= 20) AS r20mm, round(sum(obs) FILTER (obs > t95), 6) AS r95p, round(sum(obs) FILTER (obs > t99), 6) AS r99p, any_value(cdd) AS cdd, any_value(cwd) AS cwd FROM w JOIN t USING (cell_id) JOIN sp ON sp.cell_id = w.cell_id AND sp.year = year(d) GROUP BY 1, 2")
def all_extreme_indices(spark, d):
    return extremes.compute(v.obs(spark, d))


# ---- drought

ZSCORE = "CASE WHEN count(x) OVER c >= 10 THEN (x - avg(x) OVER c) / nullif(stddev_samp(x) OVER c, 0) END"
LAST = "(m + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS time"


@query(f"WITH {PAIRS}, b AS (SELECT cell_id, date_trunc('month', d)::DATE AS m, sum(obs - sim) AS v FROM pairs GROUP BY 1, 2), r AS (SELECT cell_id, m, CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END AS x FROM b WINDOW w AS (PARTITION BY cell_id ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT cell_id, {LAST}, round({ZSCORE}, 6) + 0.0 AS SPEI_3 FROM r WINDOW c AS (PARTITION BY cell_id)")
def spei_3(spark, d):
    return drought.spei(v.obs(spark, d), v.sim(spark, d), 3)


@query(f"WITH {PAIRS}, r AS (SELECT cell_id, date_trunc('month', d)::DATE AS m, avg(obs) AS x FROM pairs GROUP BY 1, 2) SELECT cell_id, {LAST}, round({ZSCORE}, 6) + 0.0 AS STI_1 FROM r WINDOW c AS (PARTITION BY cell_id)")
def sti_1(spark, d):
    return drought.sti(v.obs(spark, d), 1)


@query()
def spi_3(spark, d):
    return drought.spi(v.obs(spark, d), 3)


@query()
def sri_6(spark, d):
    return drought.sri(v.sim(spark, d), 6)


@query()
def spi_zone_means(spark, d):
    return drought.with_zone_means({"pr": v.obs(spark, d)}, v.zones(spark, d), (3,), ())["SPI_3_region"]


# ---- ranking

TABLE = f"{PAIRS}, mt AS (SELECT n_name AS product, {sql_scores(('BIAS', 'RMSE', 'CORR', 'KGE', 'POD', 'FAR'), 30.0)} FROM pairs JOIN supplier ON cell_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), long AS (SELECT product, 'RMSE' AS metric, RMSE AS v, FALSE AS benefit FROM mt UNION ALL SELECT product, 'CORR', CORR, TRUE FROM mt UNION ALL SELECT product, 'KGE', KGE, TRUE FROM mt UNION ALL SELECT product, 'POD', POD, TRUE FROM mt UNION ALL SELECT product, 'FAR', FAR, FALSE FROM mt), z AS (SELECT *, CASE WHEN max(v) OVER m - min(v) OVER m <= 1e-8 + 1e-5 * abs(min(v) OVER m) THEN 1.0 WHEN benefit THEN (v - min(v) OVER m) / (max(v) OVER m - min(v) OVER m) ELSE (max(v) OVER m - v) / (max(v) OVER m - min(v) OVER m) END AS z FROM long WINDOW m AS (PARTITION BY metric)), ranks AS (SELECT *, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY metric, v IS NULL ORDER BY CASE WHEN benefit THEN -v ELSE v END) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 END AS rank FROM long)"
RANKED = "SELECT product, round(score, 6) + 0.0 AS score, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY score IS NULL ORDER BY round({sign}score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0 END AS rank FROM s"
ENTROPY = "p AS (SELECT metric, z / nullif(sum(z) OVER m, 0) AS p, count(*) OVER m AS n FROM z WINDOW m AS (PARTITION BY metric)), ew AS (SELECT metric, 1 + sum(coalesce(p, 1.0 / n) * ln(coalesce(p, 1.0 / n) + 1e-12)) / ln(greatest(max(n), 2)) AS s FROM p GROUP BY 1), wt AS (SELECT metric, s / sum(s) OVER () AS w FROM ew)"
CRITIC = "cw AS (SELECT a.metric, b.metric AS other, 1 - coalesce(CASE WHEN stddev_samp(a.z) * stddev_samp(b.z) > 1e-300 THEN covar_samp(a.z, b.z) / (stddev_samp(a.z) * stddev_samp(b.z)) END, 0) AS f FROM z a JOIN z b USING (product) GROUP BY 1, 2), cs AS (SELECT metric, sum(f) AS f FROM cw GROUP BY 1), cd AS (SELECT metric, coalesce(stddev_samp(z), 0) * any_value(f) AS s FROM z JOIN cs USING (metric) GROUP BY 1), wt AS (SELECT metric, s / sum(s) OVER () AS w FROM cd)"
TOPSIS = "tv AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY metric)) * w AS t FROM long JOIN wt USING (metric)), tq AS (SELECT product, t - CASE WHEN benefit THEN max(t) OVER m ELSE min(t) OVER m END AS p, t - CASE WHEN benefit THEN min(t) OVER m ELSE max(t) OVER m END AS q FROM tv WINDOW m AS (PARTITION BY metric)), td AS (SELECT product, sqrt(sum(p * p)) AS p, sqrt(sum(q * q)) AS q FROM tq GROUP BY 1), s AS (SELECT product, q / nullif(p + q, 0) AS score FROM td)"


def _long(spark, d):
    return ranking.long_table(v.metric_table(spark, d), v.WAYS)


@query(f"WITH {TABLE} SELECT product, metric, benefit, round(v, 6) + 0.0 AS value, rank::DOUBLE AS rank FROM ranks")
def metric_ranks(spark, d):
    return ranking.metric_ranks(_long(spark, d))


@query(f"WITH {TABLE} SELECT product, metric, benefit, round(v, 6) + 0.0 AS value, round(z, 6) + 0.0 AS z FROM z")
def normalised_metrics(spark, d):
    return ranking.normalised(_long(spark, d))


@query(f"WITH {TABLE}, s AS (SELECT product, avg(rank) AS score FROM ranks GROUP BY 1) {RANKED.format(sign='')}")
def rank_by_average(spark, d):
    return ranking.average_rank_method(_long(spark, d))


@query(f"WITH {TABLE}, s AS (SELECT product, sum(coalesce((SELECT count(*) FROM mt) + 1 - rank, 0)) AS score FROM ranks GROUP BY 1) {RANKED.format(sign='-')}")
def rank_by_borda(spark, d):
    return ranking.borda(_long(spark, d))


@query(f"WITH {TABLE}, {ENTROPY} SELECT metric, round(w, 6) AS weight FROM wt")
def entropy_weights(spark, d):
    return ranking.entropy_weights(_long(spark, d))


@query(f"WITH {TABLE}, {CRITIC} SELECT metric, round(w, 6) AS weight FROM wt")
def critic_weights(spark, d):
    return ranking.critic_weights(_long(spark, d))


@query(f"WITH {TABLE}, {CRITIC}, {TOPSIS} {RANKED.format(sign='-')}")
def rank_by_critic_topsis(spark, d):
    long = _long(spark, d)
    return ranking.topsis(long, ranking.critic_weights(long))


@query(f"WITH {TABLE}, {ENTROPY}, s AS (SELECT product, sum(coalesce(z, 0) * w) AS score FROM z JOIN wt USING (metric) GROUP BY 1) {RANKED.format(sign='-')}")
def rank_by_entropy_weighted_sum(spark, d):
    long = _long(spark, d)
    return ranking.weighted_sum(long, ranking.entropy_weights(long))


@query(f"WITH {TABLE}, a0 AS (SELECT product, avg(rank) AS score FROM ranks GROUP BY 1), a AS (SELECT product, score, rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0 AS rank FROM a0), b0 AS (SELECT product, sum(coalesce((SELECT count(*) FROM mt) + 1 - rank, 0)) AS score FROM ranks GROUP BY 1), b AS (SELECT product, score, rank() OVER (ORDER BY round(-score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0 AS rank FROM b0), u AS (SELECT 1 AS m, * FROM a UNION ALL SELECT 2, * FROM b), n AS (SELECT product, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS z FROM u WINDOW w AS (PARTITION BY m)), c AS (SELECT product, avg(rank) AS mean_rank, avg(z) AS consensus_score FROM n GROUP BY 1) SELECT product, round(mean_rank, 6) AS mean_rank, round(consensus_score, 6) + 0.0 AS consensus_score, row_number() OVER (ORDER BY round(mean_rank, 9), round(consensus_score, 9) DESC, product)::DOUBLE AS rank FROM c")
def consensus_ranking(spark, d):
    long = _long(spark, d)
    return ranking.consensus({"average": ranking.average_rank_method(long), "borda": ranking.borda(long)})


@query(f"WITH {TABLE}, s AS (SELECT product, avg(rank) AS score FROM ranks GROUP BY 1) SELECT product, round(score, 6) AS score, rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0 AS rank FROM s ORDER BY 3, 1 LIMIT 3")
def best_three(spark, d):
    return ranking.best(ranking.average_rank_method(_long(spark, d)), 3)


# ---- fusion and correction

LEAST = 40


def _fit(spark, d):
    wide = written(v.monthly_wide(spark, d), "wide")
    return wide, v.zones(spark, d), written(fusion.fit_weights(wide, v.FLAGS, v.zones(spark, d), LEAST), "weights")


ZM = f"{WIDE}, {ZONES}, zm AS (SELECT *, month(m) AS mon FROM wide JOIN zones USING (cell_id)), full_ AS (SELECT * FROM zm WHERE ref IS NOT NULL AND a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL), mse AS (SELECT zone_id, mon, avg((a - ref) ** 2) AS ea, avg((n - ref) ** 2) AS en, avg((r - ref) ** 2) AS er FROM full_ GROUP BY 1, 2 HAVING count(*) >= {LEAST})"
BLENDED = "SELECT m AS time, cell_id, round(greatest(CASE WHEN low > 1e-6 THEN top / (low + 1e-6) END, CASE WHEN low > 1e-6 THEN 0 END), 6) AS value FROM (SELECT m, cell_id, coalesce(wa * a, 0) + coalesce(wn * n, 0) + coalesce(wr * r, 0) AS top, CASE WHEN a IS NULL THEN 0 ELSE wa END + CASE WHEN n IS NULL THEN 0 ELSE wn END + CASE WHEN r IS NULL THEN 0 ELSE wr END AS low FROM zm LEFT JOIN w USING (zone_id, mon))"


@query(f"WITH {PRODUCTS} SELECT d AS time, cell_id, round(avg(value), 6) AS value FROM prods WHERE product IN ('A', 'R') GROUP BY 1, 2 HAVING count(DISTINCT product) = 2")
def fused_mean(spark, d):
    return fusion.mean_of_best(v.products(spark, d), ["A", "R"]).select(F.to_date("time").alias("time"), "cell_id", "value")


@query(f"WITH {PRODUCTS} SELECT d AS time, cell_id, round(sum(value * CASE product WHEN 'A' THEN 0.25 ELSE 0.75 END), 6) AS value FROM prods WHERE product IN ('A', 'R') GROUP BY 1, 2 HAVING count(DISTINCT product) = 2")
def fused_weighted(spark, d):
    return fusion.weighted(v.products(spark, d), {"A": 1.0, "R": 3.0}).select(F.to_date("time").alias("time"), "cell_id", "value")


@query(f"WITH {WIDE} SELECT m AS time, cell_id, round(median(x), 6) AS value FROM (SELECT m, cell_id, unnest([a, n, r]) AS x FROM wide) GROUP BY 1, 2")
def fused_median(spark, d):
    return fusion.across_products(v.monthly_wide(spark, d), v.FLAGS, "median").withColumn("time", F.to_date("time"))


@query(f"WITH {ZM}, i AS (SELECT zone_id, mon, 1 / (sqrt(ea) + 1e-6) ** 2 AS wa, 1 / (sqrt(en) + 1e-6) ** 2 AS wn, 1 / (sqrt(er) + 1e-6) ** 2 AS wr FROM mse), w AS (SELECT zone_id, mon, wa / (wa + wn + wr) AS wa, wn / (wa + wn + wr) AS wn, wr / (wa + wn + wr) AS wr FROM i) {BLENDED}")
def fused_inverse_rmse(spark, d):
    wide, zones, params = _fit(spark, d)
    return fusion.apply_weights(wide, v.FLAGS, zones, params, "inv_rmse").withColumn("time", F.to_date("time"))


@query(f"WITH {ZM}, w AS (SELECT zone_id, mon, CASE WHEN ea <= en AND ea <= er THEN 1.0 ELSE 0.0 END AS wa, CASE WHEN en < ea AND en <= er THEN 1.0 ELSE 0.0 END AS wn, CASE WHEN er < ea AND er < en THEN 1.0 ELSE 0.0 END AS wr FROM mse) {BLENDED}")
def fused_best_single(spark, d):
    wide, zones, params = _fit(spark, d)
    return fusion.apply_weights(wide, v.FLAGS, zones, params, "best_single").withColumn("time", F.to_date("time"))


@query(f"WITH {ZM}, cv AS (SELECT zone_id, mon, var_pop(a) AS aa, var_pop(n) AS bb, var_pop(r) AS cc, covar_pop(a, n) AS ab, covar_pop(a, r) AS ac, covar_pop(n, r) AS bc FROM full_ GROUP BY 1, 2 HAVING count(*) >= {LEAST}), e AS (SELECT zone_id, mon, 1 / greatest(aa - ab * ac / bc, 1e-6) AS wa, 1 / greatest(bb - ab * bc / ac, 1e-6) AS wn, 1 / greatest(cc - ac * bc / ab, 1e-6) AS wr FROM cv WHERE abs(ab) >= 1e-12 AND abs(ac) >= 1e-12 AND abs(bc) >= 1e-12) SELECT zone_id::INT AS zone_id, mon::INT AS month, round(wa / (wa + wn + wr), 6) AS wa, round(wn / (wa + wn + wr), 6) AS wn, round(wr / (wa + wn + wr), 6) AS wr FROM e")
def triple_collocation_weights(spark, d):
    got = fusion.triple_collocation(v.monthly_wide(spark, d), v.FLAGS, v.zones(spark, d), LEAST)
    return got.select("zone_id", "month", *(F.get("weights", F.lit(i)).alias(k) for i, k in enumerate(("wa", "wn", "wr"))))


@query()
def fused_stacking(spark, d):
    wide, zones, params = _fit(spark, d)
    return fusion.apply_weights(wide, v.FLAGS, zones, params, "stacking").withColumn("time", F.to_date("time"))


@query()
def fused_by_every_method(spark, d):
    out = fusion.fuse(v.monthly_wide(spark, d), v.FLAGS, v.zones(spark, d), ["mean", "median", "evw_ref_zone_month", "evw_tc_zone_month", "bma_zone_month", "qm_zone_month"], LEAST)
    return out.withColumn("time", F.to_date("time"))


@query()
def fused_with_residuals(spark, d):
    wide, zones, params = _fit(spark, d)
    res = fusion.geo_residual(wide, v.FLAGS, zones, params, v.cells(spark, d))
    return fusion.apply_residual(wide, v.FLAGS, zones, params, res).withColumn("time", F.to_date("time"))


@query()
def fused_by_ridge(spark, d):
    rows = fusion.complete(fusion.zone_month(v.monthly_wide(spark, d), v.zones(spark, d)), v.FLAGS)
    models = learn.ridge(rows, v.FLAGS, "ref", ["zone_id"])
    return learn.ridge_predict(rows, models, v.FLAGS, ["zone_id"]).select("zone_id", "cell_id", F.to_date("time").alias("time"), "prediction")


@query()
def fused_in_two_stages(spark, d):
    cfg = learn.TwoStageConfig(wet=100.0, least=100)
    return learn.fuse_two_stage(v.monthly_wide(spark, d), v.FLAGS, v.zones(spark, d), cfg=cfg).withColumn("time", F.to_date("time"))


@query()
def fused_by_forest(spark, d):
    wide, zones = written(v.monthly_wide(spark, d), "wide"), v.zones(spark, d)
    models = written(learn.fit_by_zone(wide, v.FLAGS, zones, least=100), "zone-forests")
    return learn.predict_by_zone(wide, v.FLAGS, zones, models).withColumn("time", F.to_date("time"))


@query()
def corrected_product(spark, d):
    return learn.correct_product(v.sim(spark, d), v.obs(spark, d), v.cells(spark, d)).withColumn("time", F.to_date("time"))


@query()
def bayesian_weights(spark, d):
    got = fusion.bayesian_average(v.monthly_wide(spark, d), v.FLAGS, v.zones(spark, d), LEAST)
    return got.select("zone_id", "month", "weights", "sig2")


PLACES = ", ".join(str(i / 20) for i in range(21))
OF_COLUMN = "SELECT zone_id, mon, {i} AS k, unnest(quantile_cont({c}, [{at}])) AS value, unnest(range(21)) AS i FROM full_ GROUP BY 1, 2 HAVING count(*) >= {least}"


@query(f"WITH {ZM}, q AS ({' UNION ALL '.join(OF_COLUMN.format(i=i, c=c, at=PLACES, least=LEAST) for i, c in enumerate(('a', 'n', 'r', 'ref')))}) SELECT zone_id, mon::INT AS month, k, i::INT AS i, round(value, 6) + 0.0 AS value FROM q")
def quantiles_by_zone_and_month(spark, d):
    got = fusion.quantile_tables(v.monthly_wide(spark, d), v.FLAGS, v.zones(spark, d), LEAST, 21)
    flat = got.select("zone_id", "month", F.posexplode(F.concat("xq", F.array("yq"))).alias("k", "q"))
    return flat.select("zone_id", "month", "k", F.posexplode("q").alias("i", "value"))


@query(f"WITH {PAIRS}, s AS (SELECT cell_id, month(d) AS mon, CASE WHEN sum(sim) < 0.1 AND sum(obs) < 0.1 THEN 1 ELSE least(greatest(sum(obs) / (sum(sim) + 1e-6), 0.3), 3) END AS k FROM pairs GROUP BY 1, 2) SELECT d AS time, cell_id, round(sim * k, 6) AS value FROM pairs JOIN s ON pairs.cell_id = s.cell_id AND month(d) = mon".replace("SELECT d AS time, cell_id,", "SELECT d AS time, pairs.cell_id,"))
def monthly_volume_constraint(spark, d):
    return learn.volume_scale(v.sim(spark, d), v.obs(spark, d)).withColumn("time", F.to_date("time"))


@query(f"WITH {PAIRS}, {PRODUCTS}, {ZONES}, days AS (SELECT d FROM prods GROUP BY 1 HAVING count(DISTINCT product) = 3) SELECT d AS time, cell_id, round(max(obs), 6) AS ref, round(max(value) FILTER (product = 'A'), 6) AS a, round(max(value) FILTER (product = 'N'), 6) AS n, round(max(value) FILTER (product = 'R'), 6) AS wet, round(max(s_acctbal), 6) AS dem, max(zone_id)::INT AS zone_id FROM pairs JOIN days USING (d) JOIN prods USING (cell_id, d) LEFT JOIN supplier ON s_suppkey = cell_id LEFT JOIN zones USING (cell_id) GROUP BY 1, 2")
def inputs_together(spark, d):
    cells = v.cells(spark, d)
    cube = lambda flag: v.products(spark, d).where(F.col("product") == flag)
    dem = v.elevation(spark, d).withColumnRenamed("dem", "value")
    return inputs.together(v.obs(spark, d), cells, {"a": (cube("A"), cells), "n": (cube("N"), None)}, {"dem": (dem, None)}, {"wet": (cube("R"), None)}, v.zones(spark, d))


# ---- frames for charts

@query(f"WITH {PPAIRS} SELECT product, round(stddev_samp(obs), 6) AS ref_std, round(stddev_samp(sim), 6) AS std, round({CORR}, 6) AS corr, round(acos(least(greatest({CORR}, -1), 1)), 6) AS theta FROM pp GROUP BY 1")
def taylor_frame(spark, d):
    return charts.taylor(v.product_pairs(spark, d))


@query(f"WITH {PPAIRS} SELECT product, (floor(obs / 25) * 25)::BIGINT AS obs, (floor(sim / 25) * 25)::BIGINT AS sim, count(*) AS n FROM pp GROUP BY 1, 2, 3")
def scatter_density(spark, d):
    return charts.density(v.product_pairs(spark, d), 25)


@query(f"WITH {PRODUCTS} SELECT product, count(value) AS n, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM prods GROUP BY 1")
def quartiles_by_product(spark, d):
    return charts.quartiles(v.products(spark, d), "product", "value")


@query(f"WITH {PRODUCTS}, {CELLS}, f AS (SELECT product, min(d) AS d FROM prods GROUP BY 1), s AS (SELECT product, cell_id, lon, lat, value FROM prods JOIN f USING (product, d) JOIN cells USING (cell_id)) SELECT product, cell_id, lon, lat, round(value, 6) AS value, round(min(value) OVER (PARTITION BY product), 6) AS vmin, round(max(value) OVER (PARTITION BY product), 6) AS vmax FROM s")
def first_maps(spark, d):
    return charts.frame("multi_spatial_map", cube=v.products(spark, d), cells=v.cells(spark, d), by=("product",))


@query("SELECT event_type, window_start, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, date_trunc('day', ts)::DATE AS window_start FROM events) GROUP BY 1, 2")
def daily_event_totals(spark, d):
    from .streaming.daily import daily_totals

    return daily_totals(v.table(spark, d, "events"))


