"""Sinks: cubes as partitioned Parquet, small tables as CSV, run reports as CSV, JSON and Markdown."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import to_period


def save_cube(df: DataFrame, path: str, by: tuple[str, ...] = ("product", "year"), compression: str = "zstd", files: int = 16) -> None:
    """Replace path by df, one folder per value of `by` (year is made from time), values as floats. The cells of one folder are
    dealt to `files` tasks."""
    out = df.withColumn("year", F.year("time")) if "year" in by and "year" not in df.columns else df
    by = tuple(c for c in by if c in out.columns)
    if "value" in out.columns:
        out = out.withColumn("value", F.col("value").cast("float"))
    if by:
        spread = [F.pmod(F.xxhash64("cell_id"), F.lit(files))] if "cell_id" in out.columns else []
        out = out.repartition(*by, *spread)
    out.write.mode("overwrite").option("compression", compression).partitionBy(*by).parquet(path)


def save_blocks(df: DataFrame, path: str) -> None:
    """A fused cube with a block column, one folder per method and block."""
    df.write.mode("overwrite").partitionBy(*(c for c in ("method", "block") if c in df.columns)).parquet(path)


def save_monthly(df: DataFrame, path: str, reducer: str = "sum") -> None:
    """A daily stack as monthly sums or means."""
    if reducer not in ("sum", "mean"):
        raise ValueError("reducer must be sum or mean")
    save_cube(to_period(df, "month", reducer).withColumn("time", F.col("time").cast("timestamp_ntz")), path)


def save_table(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.repartition(1).write.mode("overwrite").csv(path, header=True)


def save_book(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder with one table for each sheet, names cut to 31 characters."""
    for name, df in sheets.items():
        save_table(df, f"{path}/{name[:31]}")


def report_texts(records: list[dict], title: str = "Run report") -> dict[str, str]:
    """csv, json and md of run records, over the union of their fields."""
    fields = sorted({k for r in records for k in r})
    buffer = io.StringIO()
    writer = csv.DictWriter(buffer, fields, lineterminator="\n")
    writer.writeheader()
    writer.writerows(records)
    good = sum(r.get("status") == "SUCCESS" for r in records)
    lines = [f"# {title}", "", f"- tasks: {len(records)}", f"- succeeded: {good}", f"- failed: {len(records) - good}", "", "| " + " | ".join(fields) + " |", "|" + "---|" * len(fields)]
    lines += ["| " + " | ".join(str(r.get(f, "")).replace("|", "\\|") for f in fields) + " |" for r in records]
    return {"csv": buffer.getvalue(), "json": json.dumps(records, indent=2, default=str), "md": "\n".join(lines) + "\n"}


def save_reports(spark: SparkSession, records: list[dict], path: str, title: str = "Run report") -> None:
    """report_texts as files under path, on any file system that Spark reaches."""
    for kind, text in report_texts(records, title).items():
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.{kind}")
