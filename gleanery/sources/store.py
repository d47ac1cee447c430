"""Vectors kept by the hash of what they were made from: buckets of files, uses in a log, and a bound in bytes.

A key's first hex digits name its bucket, a folder of Parquet files whose keys have a Bloom filter each; a look-up reads the folders of its
own buckets alone. Uses are appended to a log, so a look-up never rewrites an entry. Compaction writes the most recently used entries up to
a bound as a new generation and names it last, so a run that fails leaves the old one in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import pruned

ENTRY = "key string, vec array<double>, bytes long, added_at timestamp, bucket string"
#: Hex digits of a bucket.
DIGITS = 2


class VectorStore:
    """One writer at a time; readers see whole generations."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(folder)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def folder(self) -> str:
        newest = self._read(f"{self.path}/generations", "n long, folder string").agg(F.max(F.struct("n", "folder")).alias("g")).first()["g"]
        return newest["folder"] if newest else f"{self.path}/entries-0"

    def entries(self, keys: DataFrame | None = None) -> DataFrame:
        """All entries, or those of the buckets that keys (key) fall in."""
        found = self._read(self.folder(), ENTRY)
        if keys is None:
            return found
        buckets = [r[0] for r in keys.select(F.substring("key", 1, DIGITS)).distinct().collect()]  # 16 ** DIGITS at most
        return found.where(F.col("bucket").isin(buckets)) if buckets else found.limit(0)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """(key, vec), vec null where the store has none; found keys are logged as used."""
        wanted = keys.select("key").where(F.col("key").isNotNull()).distinct()
        found = wanted.join(self.entries(wanted).select("key", "vec").dropDuplicates(["key"]), "key", "left")
        found.where(F.col("vec").isNotNull()).select("key", F.current_timestamp().alias("used_at")).write.mode("append").parquet(f"{self.path}/log")
        return found

    def put(self, vectors: DataFrame) -> None:
        """Adds (key, vec) of keys that aren't there yet; null keys and vectors are left out."""
        new = vectors.where(F.col("key").isNotNull() & F.col("vec").isNotNull()).dropDuplicates(["key"])
        new = new.join(self.entries(new).select("key"), "key", "left_anti")
        rows = new.select(
            "key", F.col("vec").cast("array<double>").alias("vec"), (8 * F.size("vec")).cast("long").alias("bytes"), F.current_timestamp().alias("added_at"),
            F.substring("key", 1, DIGITS).alias("bucket")
        )
        self._write(rows, self.folder())

    def _write(self, rows: DataFrame, folder: str) -> None:
        # a bucket's rows in one task, so in one file
        rows.repartition("bucket").write.mode("append").option("parquet.bloom.filter.enabled#key", "true").partitionBy("bucket").parquet(folder)

    def compact(self, most_bytes: int) -> None:
        """Keeps the most recently used entries whose vectors sum to at most most_bytes; an entry that was never used counts from when it was
        added."""
        uses = self._read(f"{self.path}/log", "key string, used_at timestamp").groupBy("key").agg(F.max("used_at").alias("last"))
        aged = self.entries().join(uses, "key", "left").withColumn("used_at", F.greatest("last", "added_at"))
        kept = pruned(aged.drop("last"), most_bytes).select("key", "vec", "bytes", "added_at", "bucket")
        folder, n = f"{self.path}/entries-{uuid.uuid4().hex}", self._read(f"{self.path}/generations", "n long, folder string").count() + 1
        self._write(kept, folder)
        self.spark.createDataFrame([(n, folder)], "n long, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")
