"""Arrow batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of rows that Spark hands to a worker at once, and bytes of text that a helper turns into objects at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 1 << 18


def bounded(df: DataFrame) -> DataFrame:
    """df, its session set to cut Arrow batches by bytes. A session that asks for less keeps that."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    if not 0 < conf.arrowMaxBytesPerBatch() <= BATCH_BYTES:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def in_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice's texts have about SLICE_BYTES: what is made of them is many times as large as they are."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end
