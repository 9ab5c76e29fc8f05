"""Windows along time within a cell: rolling reductions, longest runs, ranks, standard scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import finite


def rolling(df: DataFrame, n: int, how: str = "sum", by: tuple[str, ...] = ("product", "cell_id"), time: str = "time", value: str = "value") -> DataFrame:
    """value reduced over the last n rows of its key; NULL unless all n are present. Rows count, not calendar steps."""
    w = Window.partitionBy(*(c for c in by if c in df.columns)).orderBy(time).rowsBetween(-(n - 1), 0)
    made = {"sum": F.sum, "mean": F.avg}[how](F.col(value)).over(w)
    return df.withColumn(value, F.when(F.count(value).over(w) == n, made))


def longest_run(df: DataFrame, event: Column, keys: tuple[str, ...], time: str = "time", name: str = "run") -> DataFrame:
    """Longest run of rows in a row, by time, in which event holds, for every key; 0 where it never does.

    The number of events that don't hold so far is the same throughout a run, so one window and one sort do: rows of a
    run share (key, that number)."""
    w = Window.partitionBy(*keys).orderBy(time)
    flagged = df.select(*keys, time, F.coalesce(event, F.lit(False)).alias("_e"))
    island = flagged.withColumn("_i", F.count_if(~F.col("_e")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_i").agg(F.count_if("_e").alias("_n")).groupBy(*keys).agg(F.max("_n").alias(name))


def average_rank(value: Column, by: list[str], ascending: bool = True) -> Column:
    """Rank from 1 in which equal values share the mean of their places; NULL for NULL, which is not counted."""
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    present = [*by, value.isNull()]
    ties = Window.partitionBy(*present, value)
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(*present).orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def zscore(df: DataFrame, by: tuple[str, ...] = ("product", "cell_id"), value: str = "value", least: int = 10) -> DataFrame:
    """value as deviations from its key's mean, in sample standard deviations; NULL under `least` values or without spread."""
    w = Window.partitionBy(*(c for c in by if c in df.columns))
    v = finite(value)
    return df.withColumn(value, F.when(F.count(v).over(w) >= least, (v - F.avg(v).over(w)) / F.nullif(F.stddev_samp(v).over(w), F.lit(0.0))))
