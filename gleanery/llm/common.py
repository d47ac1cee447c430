"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: blank, and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; if it is one small file, which would be one task, its rows are dealt out to all cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 8) and len(df.inputFiles()) == 1 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a single machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gleanery/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that Spark hands to a worker at once.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, its session set to cut Arrow batches by bytes: rows of long texts are never built into one batch of ten thousand, neither in
    the executor's process nor in its workers. A session that asks for less keeps that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    if not 0 < conf.arrowMaxBytesPerBatch() <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, and outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clear(spark: SparkSession) -> None:
    """Deletes all tables that operators have written into the shared folder: for when their results have been taken."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(shared_dir(spark))
    if store.get_file_info(f"{path}/gleanery").type == fs.FileType.Directory:
        store.delete_dir(f"{path}/gleanery")


def in_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice's texts have about ``size`` bytes: long texts never add up to a batch's ten thousand rows."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end
