"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_made: list[str] = []  # tables of this process, oldest first


def shared_dir(spark: SparkSession) -> str:
    """The URI in spark.checkpoint.dir; only where that is unset and driver and tasks are one process a folder of our own."""
    where = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="rainframe-")
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, below a folder of this application, so that clear() finds it."""
    _made.append(f"{shared_dir(spark)}/rainframe/{_session(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def _session(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


#: Whether the shuffle files of a query go when it ends, and not only when the driver's garbage is collected.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages start from files that
    outlive any executor, and nothing before them runs twice. The shuffle files that it took are removed."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


MOST_SENT = 32 << 20  # bytes of a table of keys up to which it is sent to all tasks


def send_if_small(written: DataFrame, row_bytes: int = 24) -> DataFrame:
    """A written table, marked for broadcast where its rows are counted and of row_bytes each make MOST_SENT bytes at most; else it
    is joined by a shuffle, so texts move for a join only where the keys are too many to send."""
    return F.broadcast(written) if written.count() * row_bytes <= MOST_SENT else written


def written() -> int:
    """How many tables this process has written so far."""
    return len(_made)


def release(spark: SparkSession, since: int) -> None:
    """Remove the tables written since then, but for the last one, on which what follows rests."""
    for path in _made[since:-1]:
        _remove(spark, path)
    _made[since:-1] = []


def _remove(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this session's operators wrote to the shared folder; their results must be written by then."""
    _remove(spark, f"{shared_dir(spark)}/rainframe/{_session(spark)}")
