"""Cubes, grids, zones and stations over the star-schema test tables, for the registered queries.

Suppliers are the cells of a grid ten columns wide; a day's line items of a supplier are an observation (quantity) and
a simulation (discounted, taxed quantity); return flags are products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIM = "l_quantity * (1 - l_discount) * (1 + l_tax)"
FLAGS = ["A", "N", "R"]
OFF_TIES = 3.1e-9  # see queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("time"), F.col("l_returnflag").alias("product"), F.col("l_quantity").alias("q"), F.expr(SIM).alias("s"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, cell_id, obs, sim."""
    return _daily(spark, sf_dir).groupBy("time", "cell_id").agg(F.sum("q").alias("obs"), F.sum("s").alias("sim"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).groupBy("time", "cell_id").agg(F.sum("q").alias("value"))


def sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).groupBy("time", "cell_id").agg(F.sum("s").alias("value"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of the products A, N and R."""
    return _daily(spark, sf_dir).groupBy("product", "time", "cell_id").agg(F.sum("s").alias("value"))


def with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products, and obs as the product REF."""
    return products(spark, sf_dir).unionByName(obs(spark, sf_dir).withColumn("product", F.lit("REF")))


def product_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluate import against_reference

    return against_reference(with_reference(spark, sf_dir), "REF")


def monthly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time (months), cell_id, A, N, R, ref: monthly sums, so that all products meet."""
    from ..operators.fusion import wide
    from ..operators.resample import to_period

    return wide(to_period(with_reference(spark, sf_dir), "month").withColumn("time", F.col("time").cast("timestamp_ntz")), FLAGS, "REF")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    lat, lon = F.floor(key / 10).cast("int"), (key % 10).cast("int")
    return table(spark, sf_dir, "supplier").select(key.alias("cell_id"), lat.alias("lat_idx"), lon.alias("lon_idx"), (30 + lat * 0.5).cast("double").alias("lat"), (100 + lon * 0.5).cast("double").alias("lon"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, zone_id (1.. by name) and zone_name: regions of the suppliers' nations."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("cell_id"), (F.col("r_regionkey") + 1).cast("int").alias("zone_id"), F.col("r_name").alias("zone_name"))


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("dem"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, time, lat, lon, obs: customers, and their orders by day."""
    day = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("station"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("time")).agg((F.sum("o_totalprice") / 1000).alias("obs"))
    where = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"), (30 + (F.col("c_custkey") % 37) * 0.17).cast("double").alias("lat"), (100 + (F.col("c_custkey") % 29) * 0.19).cast("double").alias("lon"))
    return day.join(where, "station")


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product (a nation), and the scores of its suppliers' cells."""
    from ..functions import metrics

    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    named = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("cell_id"), F.col("n_name").alias("product"))
    out = pairs(spark, sf_dir).join(named, "cell_id").groupBy("product").agg(*metrics.columns(("BIAS", "RMSE", "CORR", "KGE", "POD", "FAR"), 30.0))
    return out.withColumns({c: F.round(F.col(c) + OFF_TIES, 6) for c in out.columns if c != "product"})


#: Which way the metrics of metric_table are better.
WAYS = {"RMSE": "cost", "CORR": "benefit", "KGE": "benefit", "POD": "benefit", "FAR": "cost"}
