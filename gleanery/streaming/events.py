"""Event checks as streams: duplicates, rate limits, windows, sessions. Each takes a streaming or a batch DataFrame where Spark allows both.

Times are event time; ``late`` is how long state waits for rows that come out of order.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Events of a key that a task sorts at once, and that it gives back at once.
RUN, GIVEN = 1 << 20, 10_000
#: Groups that the keys of a rate limit are dealt into.
BUCKETS = 2048
#: Stands for a null id where rows are numbers.
NO_ID = (1 << 63) - 1


def event_stream(spark: SparkSession, folder: str, schema: str, ts: str = "ts") -> DataFrame:
    """Parquet files that arrive in a folder, the time column as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, keys: list[str], width: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, keys, n) of each window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), *keys, "n"
    )


def sliding(events: DataFrame, keys: list[str], width: str, step: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(
        F.window(ts, width, step).alias("w"), *keys
    ).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, end, keys, n) of each run of events no further apart than gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n"
    )


def in_order(batches: Iterator, columns: list[str], size: int = RUN) -> Iterator[tuple[int, ...]]:
    """The rows of a key's batches as whole numbers, sorted: runs of about ``size`` rows are sorted and laid into the task's temp folder, then
    merged, so a key of any size takes the memory of one run."""
    import numpy as np

    def sort(parts: list) -> np.ndarray:
        rows = np.concatenate(parts)
        return rows[np.lexsort(rows.T[::-1])]

    def read(path: str, n: int) -> Iterator[tuple[int, ...]]:
        for at in range(0, n, GIVEN):  # a read of its own each time: no run keeps a file open
            yield from map(
                tuple, np.fromfile(path, np.int64, min(GIVEN, n - at) * len(columns), offset=at * 8 * len(columns)).reshape(-1, len(columns)).tolist()
            )

    with tempfile.TemporaryDirectory() as folder:
        runs, parts, held = [], [], 0
        for batch in batches:
            parts.append(batch[columns].to_numpy(np.int64))
            held += len(batch)
            if held >= size:
                path = f"{folder}/{len(runs)}"
                sort(parts).tofile(path)
                runs.append(read(path, held))
                parts, held = [], 0
        last = map(tuple, sort(parts).tolist()) if parts else iter(())
        yield from heapq.merge(*runs, last)


def rate_limited(events: DataFrame, key: str, most: int, seconds: int, event_id: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(event_id, key, allowed): whether the key had fewer than ``most`` allowed events in the ``seconds`` before, as events come.

    Keys are dealt into BUCKETS by their hash, rows without a key into one of their own, and a bucket is one group, so what a group costs isn't
    paid for each key. State: a bucket's keys and the times of their allowed events that still count, at most ``most`` numbers a key; a key's
    are dropped when they have expired. A bucket's events are walked in order of key, time and id, never held at once; one key is one task,
    since each decision needs those before.
    """
    import pandas as pd

    kind = dict(events.select(key).dtypes)[key]

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        codes: dict = {}
        held: dict = {}
        if state.exists:
            keys, counts, times = state.get
            flat = iter(times)
            held = {x: list(islice(flat, n)) for x, n in zip(keys, counts, strict=True)}

        def coded() -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [None] * len(batch) if k[0] < 0 else batch[key].tolist()
                yield batch.assign(code=[codes.setdefault(x, len(codes)) for x in found])

        rows, now, times = in_order(coded(), ["code", "t", event_id]), None, []
        while part := list(islice(rows, GIVEN)):
            names, allowed, whose = list(codes), [], []
            for code, t, _ in part:
                if code != now:
                    now, name = code, names[code]
                    times = held.setdefault(name, [])
                if times:  # events of an earlier batch may be later ones
                    times[:] = [x for x in times if t - x < seconds]
                allowed.append(len(times) < most)
                whose.append(name)
                if allowed[-1]:
                    times.append(t)
            yield pd.DataFrame({event_id: [i for _, _, i in part], key: whose, "allowed": allowed})
        mark = state.getCurrentWatermarkMs()
        held = {x: times for x, times in held.items() if times and (max(times) + seconds) * 1000 > mark}
        if held:
            state.update((list(held), [len(times) for times in held.values()], [t for times in held.values() for t in times]))
            state.setTimeoutTimestamp(max(max((max(times) + seconds) * 1000 for times in held.values()), mark + 1))
        elif state.exists:
            state.remove()

    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("long").alias("rate_bucket")
    marked = events.withWatermark(ts, late).select(
        bucket, key, F.coalesce(F.col(event_id), F.lit(NO_ID)).alias(event_id), ts, F.unix_timestamp(ts).alias("t")
    )
    decided = marked.groupBy("rate_bucket").applyInPandasWithState(
        decide, f"{event_id} long, {key} {kind}, allowed boolean", f"keys array<{kind}>, counts array<int>, times array<long>", "append",
        GroupStateTimeout.EventTimeTimeout
    )
    return decided.withColumn(event_id, F.nullif(F.col(event_id), F.lit(NO_ID)))


def finished(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it has given; the checkpoint makes a second run go on from there.

    Executors write the rows as Parquet beside the checkpoint, so none pass through the driver. In complete mode each batch is written
    with its number over the last but one, and the rows of the greatest number count: a batch that fails leaves the one before.
    """
    spark, path = stream.sparkSession, f"{checkpoint}-rows"
    schema, number = stream.schema, "batch_number"
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)

    def version(batch: DataFrame, n: int) -> None:
        batch.withColumn(number, F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/v{n % 2}")

    done = writer.foreachBatch(version).start() if mode == "complete" else writer.format("parquet").option("path", path).start()
    done.awaitTermination()
    try:
        if mode != "complete":
            return spark.read.schema(schema).parquet(path)
        rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)  # no batch has run
    last = rows.agg(F.max(number)).first()[0]
    return rows.where(F.col(number) == F.lit(last)).drop(number)


def upsert(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> None:
    """Keeps the latest row of each key in a table: each batch is merged with it and written to a version of its own, so a batch that
    runs twice writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        if number:  # the version before must be there: without it rows would be lost unseen
            batch = batch.unionByName(spark.read.parquet(f"{path}/v{number - 1}"))
        best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
        best.select(*keys, "r.*").write.mode("overwrite").parquet(f"{path}/v{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
