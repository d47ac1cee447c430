"""The folder that driver and executors share, and tables written there in the middle of a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a single machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: what several branches read is made once, outlives lost executors, and
    takes no executor's memory."""
    path = f"{shared_dir(df.sparkSession)}/gleanery-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, name: str, by: str) -> str:
    """The path of df as a Parquet table in the shared folder, with a folder by=value for each value: for tasks that read some values alone."""
    path = f"{shared_dir(df.sparkSession)}/gleanery-tables/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return path
