"""Windows over events, in batch and as streams that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import limits as L
from ..sources.shared import shared_dir
from ..streaming import events as S
from ..streaming import timers as TM
from .registry import query, table

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))


SECONDS = "e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
ROLLING = "count(*) OVER (PARTITION BY user_id, event_type ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n, min(t) OVER (PARTITION BY user_id, event_type ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS oldest"


@query(f"WITH {SECONDS} SELECT event_id, {ROLLING} FROM e")
def rolling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rolling(_events(spark, sf_dir), ["user_id", "event_type"], 86400).select("event_id", "n", "oldest")


@query(f"WITH {SECONDS}, r AS (SELECT event_id, {ROLLING} FROM e) SELECT event_id, CASE WHEN n >= 3 THEN oldest + 86400 END AS free_at FROM r")
def next_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_available(_events(spark, sf_dir), ["user_id", "event_type"], 86400, 3).select("event_id", "free_at")


@query(
    f"WITH {SECONDS}, s AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'running' ELSE 'done' END AS status FROM e) SELECT event_id, CASE WHEN status = 'running' AND t < 1705000000 - 900 THEN 'failed' ELSE status END AS status FROM s"
)
def stale_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 5 == 0, "running").otherwise("done")
    return _events(spark, sf_dir).select("event_id", L.shown_status(status, F.col("t"), F.lit(1705000000)).alias("status"))


@query(
    "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
)
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(
        F.unix_timestamp(F.window("ts", "1 day").start).alias("day"), "event_type"
    ).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: a stream reads folders, so the table's parent with a filter for its name."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str) -> DataFrame:
    name = f"stream_{uuid.uuid4().hex}"
    return S.finished(stream, name, f"{shared_dir(stream.sparkSession)}/streams/{name}", mode)


@query("SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(
        S.tumbling(_stream(spark, sf_dir), ["event_type"], "6 hours"), "complete"
    ).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new
      FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM o)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 3 HOUR)) AS BIGINT) AS "end",
      count(*) AS n FROM s GROUP BY user_id, nth"""
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(S.sessions(_stream(spark, sf_dir), ["user_id"], "3 hours"), "complete").select(
        "user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n"
    )


@query("SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (user, type) of a stream whose state covers it whole, with how many of its rows have passed: the first alone."""
    first = _run(S.deduplicated(_stream(spark, sf_dir), ["user_id", "event_type"], late="365 days"), "append")
    return first.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


LIMITED = """WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t
      FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e),
    r AS (SELECT event_id, user_id, k, true AS allowed, [t] AS times FROM o WHERE k = 1
      UNION ALL SELECT o.event_id, o.user_id, o.k, len(list_filter(times, lambda x: o.t - x < 86400)) < 3,
        CASE WHEN len(list_filter(times, lambda x: o.t - x < 86400)) < 3 THEN list_append(list_filter(times, lambda x: o.t - x < 86400),
      o.t) ELSE list_filter(times, lambda x: o.t - x < 86400) END
      FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT event_id, user_id, allowed FROM r"""


@query(LIMITED)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three allowed events of a user in a day."""
    return _run(S.rate_limited(_stream(spark, sf_dir), "user_id", 3, 86400), "append")


@query(LIMITED)
def rate_limit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions over a table, where a hot user's events are spread over tasks."""
    return L.rate_limited(_events(spark, sf_dir), "user_id", "event_id", "t", 3, 86400)


TASK_SECONDS, LATE_MS = 21_600, 3_600_000


@query(
    f"""WITH RECURSIVE m AS (SELECT event_id, user_id, event_type = 'signup' AS opens, floor(epoch_us(ts) / 1000)::BIGINT AS t, event_type FROM events),
    w AS (SELECT max(t) - {LATE_MS} AS mark FROM m),
    o AS (SELECT user_id, opens, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM m, w WHERE t <= mark
      AND event_type IN ('signup', 'purchase')),
    r AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS since, NULL::BIGINT AS opened, NULL::BIGINT AS closed, NULL::VARCHAR AS how FROM (SELECT DISTINCT user_id FROM o)
      UNION ALL SELECT o.user_id, o.k,
        CASE WHEN since IS NULL OR since + {1000 * TASK_SECONDS} <= o.t THEN CASE WHEN opens THEN o.t END WHEN opens THEN since END,
        CASE WHEN since + {1000 * TASK_SECONDS} <= o.t OR NOT opens THEN since END,
        CASE WHEN since + {1000 * TASK_SECONDS} <= o.t THEN since + {1000 * TASK_SECONDS} WHEN NOT opens AND since IS NOT NULL THEN o.t END,
        CASE WHEN since + {1000 * TASK_SECONDS} <= o.t THEN 'time_up' WHEN NOT opens AND since IS NOT NULL THEN 'handed_in' END
      FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1),
    l AS (SELECT user_id, since FROM r QUALIFY k = max(k) OVER (PARTITION BY user_id))
    SELECT user_id, opened, closed, how FROM r WHERE how IS NOT NULL
    UNION ALL SELECT user_id, since, since + {1000 * TASK_SECONDS}, 'time_up' FROM l, w WHERE since + {1000 * TASK_SECONDS} <= mark"""
)
def stream_timed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of six hours that a signup opens and a purchase hands in; a timer closes those whose time is up, without a further event."""
    events = _stream(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase")).withColumn("opens", F.col("event_type") == "signup")
    return _timed(TM.closed_tasks(events, "user_id", TASK_SECONDS))


def _timed(stream: DataFrame) -> DataFrame:
    """A stream with timers, run with state in RocksDB."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, TM.ROCKS)
    try:
        return _run(stream, "append")
    finally:
        spark.conf.set(name, before)


HOUR_MS = 3_600_000


@query(
    f"""WITH m AS (SELECT event_id, user_id % 20 AS assignment, event_type = 'error' AS line, floor(epoch_us(ts) / 1000)::BIGINT AS t FROM events),
    d AS (SELECT assignment, t, t + {HOUR_MS} * 2 * (1 + assignment % 3) AS due, t + {HOUR_MS} * (2 * (1 + assignment % 3) + assignment % 4) AS cutoff,
      lead(t) OVER (PARTITION BY assignment ORDER BY t) AS next FROM m WHERE line),
    c AS (SELECT assignment, arg_min(due, t) AS due, arg_min(cutoff, t) AS cutoff FROM d WHERE next IS NULL OR next > cutoff GROUP BY assignment)
    SELECT c.assignment, due, cutoff, count(*) FILTER (WHERE NOT line AND t <= due) AS on_time, count(*) FILTER (WHERE NOT line AND t > due AND t <= cutoff) AS late
    FROM c JOIN m USING (assignment) WHERE cutoff <= (SELECT max(t) - {HOUR_MS} FROM m) GROUP BY ALL"""
)
def stream_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty assignments, each with due times and cutoffs of its own that later events move; each is counted when its own cutoff passes."""
    e = _stream(spark, sf_dir).withColumn("assignment", F.col("user_id") % 20)
    due = F.unix_millis("ts") + HOUR_MS * 2 * (1 + F.col("assignment") % 3)
    line = F.col("event_type") == "error"
    rows = e.withColumn("due", F.when(line, due)).withColumn("cutoff", F.when(line, due + HOUR_MS * (F.col("assignment") % 4)))
    parts = _timed(TM.cut_off(rows, "assignment"))
    return parts.groupBy("assignment", "due", "cutoff").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))
