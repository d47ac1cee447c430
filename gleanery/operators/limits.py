"""Checks over recent events: rolling counts, the next free moment, stale runs."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

if TYPE_CHECKING:
    import numpy as np


def rolling(events: DataFrame, keys: list[str], seconds: int, ts: str = "t") -> DataFrame:
    """n: events of the key in the ``seconds`` up to and with this one, both ends counted; oldest: the first of them. ts: whole seconds."""
    back = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-seconds, 0)
    return events.withColumn("n", F.count("*").over(back)).withColumn("oldest", F.min(ts).over(back))


def next_available(events: DataFrame, keys: list[str], seconds: int, most: int, ts: str = "t") -> DataFrame:
    """free_at: when the key may go again, null while it has fewer than ``most`` in the window."""
    return rolling(events, keys, seconds, ts).withColumn("free_at", F.when(F.col("n") >= most, F.col("oldest") + seconds))


def shown_status(status, created, now, minutes: int = 15):  # noqa: ANN001, ANN201
    """A check that has run for longer than ``minutes`` is shown as failed."""
    return F.when((status == "running") & (created < now - 60 * minutes), "failed").otherwise(status)


def _walk(t: np.ndarray, before: list[int], most: int, seconds: int) -> tuple[np.ndarray, list[int]]:
    """Which of sorted times are allowed after the allowed times before, and the allowed times that a later one may still meet. Goes from one
    allowed time to the next one that can be: what stands between them is jumped over."""
    import numpy as np

    allowed, last, i = np.zeros(len(t), bool), list(before)[-most:], 0
    while i < len(t):
        if len(last) < most or t[i] - last[-most] >= seconds:
            allowed[i] = True
            last = [*last, int(t[i])][-most:]
            i += 1
        else:
            i = max(i + 1, int(np.searchsorted(t, last[-most] + seconds)))
    return allowed, last


def rate_limited(events: DataFrame, key: str, event_id: str, t: str, most: int, seconds: int) -> DataFrame:
    """(event_id, key, allowed): whether the key had fewer than ``most`` allowed events in the ``seconds`` before each, in order of t (whole
    seconds) and event_id.

    Events are dealt out by ranges of key and time, so a key with a third of all events is several runs. Each run is solved as if nothing
    had been before it; then runs that begin with another's end are solved again from what that end gives, until no end changes. Most
    settle at once, since a gap of ``seconds`` forgets all before it. Only keys that lie in several ranges take part, at most one for each
    range's edge, and what the driver holds of them is ``most`` times a run.
    """
    import pandas as pd

    spark = events.sparkSession
    dealt = events.select(F.col(key).alias("key"), F.col(t).cast("long").alias("t"), F.col(event_id).alias("id"))
    dealt = written(dealt.repartitionByRange("key", "t", "id").withColumn("part", F.spark_partition_id()), "limit-ranges")
    kind = dict(dealt.dtypes)["key"]
    runs = dealt.select("key", "part").distinct()
    many = runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    split = written(dealt.join(F.broadcast(many.withColumnRenamed("key", "k")), F.col("key").eqNullSafe(F.col("k")), "left_semi"), "limit-split")
    order: dict = {}
    for r in split.select("key", "part").distinct().orderBy("part").collect():  # two a range at most
        order.setdefault(r["key"], []).append(r["part"])
    begins = {(k, p): [] for k, parts in order.items() for p in parts}
    shape = f"key {kind}, part int, before array<long>"

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"])
        _, last = _walk(rows["t"].to_numpy(), list(rows["before"].iloc[0]), most, seconds)
        return pd.DataFrame({"key": rows["key"].iloc[:1].to_numpy(), "part": rows["part"].iloc[:1].to_numpy(), "last": [last]})

    changed = list(begins)
    while changed:
        table = spark.createDataFrame([(k, p, begins[k, p]) for k, p in changed], shape)
        met = split.join(F.broadcast(table.withColumnsRenamed({"key": "k", "part": "p"})), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
        found = met.select("key", "part", "t", "id", "before").groupBy("key", "part").applyInPandas(ends, f"key {kind}, part int, last array<long>")
        changed = []
        for r in found.collect():
            parts = order[r["key"]]
            at = parts.index(r["part"]) + 1
            if at < len(parts) and begins[r["key"], parts[at]] != list(r["last"]):
                begins[r["key"], parts[at]] = list(r["last"])
                changed.append((r["key"], parts[at]))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"])
        before = rows["before"].iloc[0]
        allowed, _ = _walk(rows["t"].to_numpy(), [] if before is None else list(before), most, seconds)
        return pd.DataFrame({event_id: rows["id"].to_numpy(), key: rows["key"].to_numpy(), "allowed": allowed})

    table = spark.createDataFrame([(k, p, b) for (k, p), b in begins.items()], shape).withColumnsRenamed({"key": "k", "part": "p"})
    begun = dealt.join(F.broadcast(table), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")), "left")
    return begun.select("key", "part", "t", "id", "before").groupBy("key", "part").applyInPandas(
        decide, f"{event_id} {dict(dealt.dtypes)['id']}, {key} {kind}, allowed boolean"
    )
