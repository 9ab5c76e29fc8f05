"""Tables written to the folder that driver and executors share, so that what comes before them is not worked out again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

SETTING = "spark.checkpoint.dir"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet under spark.checkpoint.dir and read back. Only where that is unset and driver and tasks are one process, a
    folder of our own is taken."""
    spark = df.sparkSession
    where = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="rainframe-")
        spark.conf.set(SETTING, where)
    path = f"{where.rstrip('/')}/rainframe/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
