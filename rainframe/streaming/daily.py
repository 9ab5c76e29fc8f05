"""Daily totals of timed values, in batch and as a stream; the same function makes both plans.

On a stream, a watermark bounds how late a value may be and with it the state that is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import finite


def daily_totals(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", late: str = "2 days") -> DataFrame:
    """key, window_start (a day), n and total. Rows of a stream that come later than `late` are not counted any more."""
    rows = events.select(F.col(key), F.col(time).cast("timestamp").alias("_t"), finite(value).alias("_v"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", late)
    days = rows.groupBy(key, F.window("_t", "1 day").alias("_w")).agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
    return days.select(key, F.to_date("_w.start").alias("window_start"), "n", "total")


def write_days(totals: DataFrame, path: str, checkpoint: str):
    """Append days that the watermark has closed to Parquet, exactly once."""
    return totals.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
