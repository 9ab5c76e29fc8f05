"""Aggregation over time: calendar periods, seasons, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import block, group_label, period, period_unit
from ..functions.missing import finite, require

HOW = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def to_period(df: DataFrame, unit: str, how: str = "sum", by: tuple[str, ...] = ("product", "cell_id"), time: str = "time", value: str = "value", label: str = "start", fill_gaps: bool = False, empty_sum: str = "null") -> DataFrame:
    """value summed, or otherwise reduced, over each period of each key that has a row. Missing values are passed over.

    native and daily return df as it is. A period with no value is NULL, or 0 under empty_sum="zero" where `how` is sum.
    fill_gaps adds a row for each period between a key's first and last. Keys are those of `by` that df has; null keys
    are keys like any other."""
    if unit in ("native", "daily"):
        return df
    if how not in HOW:
        raise ValueError(f"unknown reduction {how!r}: {', '.join(HOW)}")
    require(df, time, value)
    by = tuple(c for c in by if c in df.columns)
    out = df.groupBy(*by, period(time, unit, "start").alias("_p")).agg(HOW[how](finite(value)).alias(value))
    if fill_gaps:
        step = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[period_unit(unit)]
        spine = out.groupBy(*by).agg(F.min("_p").alias("_a"), F.max("_p").alias("_b")).select(*by, F.explode(F.expr(f"sequence(_a, _b, {step})")).alias("_p"))
        same = F.col("s._p") == F.col("o._p")
        for c in by:
            same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}"))
        out = spine.alias("s").join(out.alias("o"), same, "left").select(*(F.col(f"s.{c}").alias(c) for c in by), F.col("s._p").alias("_p"), F.col(f"o.{value}").alias(value))
    if how == "sum" and empty_sum == "zero":
        out = out.withColumn(value, F.coalesce(value, F.lit(0.0)))
    return out.select(*by, period("_p", unit, label).alias(time), value)


def climatology(df: DataFrame, by: str = "month", value: str = "value", time: str = "time", keys: tuple[str, ...] = ("product", "cell_id")) -> DataFrame:
    """Mean of value for each key and calendar group."""
    keys = tuple(c for c in keys if c in df.columns)
    return df.groupBy(*keys, group_label(time, by).alias(by)).agg(F.avg(finite(value)).alias(value))


def with_block(df: DataFrame, days: int, time: str = "time") -> DataFrame:
    """df with block, the number of its run of `days` days since the first day of all."""
    first = df.agg(F.to_date(F.min(time)).alias("d")).first()["d"]
    return df.withColumn("block", block(time, F.lit(first), days))
