"""Deadlines, marks and test results over orders and line items, and rubric scores over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions import text as T
from .registry import query, table

DEADLINE_SQL = "date_trunc('month', o_orderdate) + INTERVAL 10 DAY"


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions, due on the eleventh of their month; priority gives grace and penalty."""
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    at = F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", at.alias("at"), rank.alias("rank"))
    return o.withColumn("deadline", F.date_trunc("month", "at") + F.expr("INTERVAL 10 DAYS"))


LATE_SQL = f"""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderdate AS handed, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank,
      {DEADLINE_SQL} AS deadline FROM orders),
    s AS (SELECT *, CAST(epoch(handed) - epoch(deadline) AS BIGINT) AS a,
      CAST(epoch(handed) - epoch(deadline) AS BIGINT) - 60 * 720 * rank AS over FROM o),
    l AS (SELECT *, CASE WHEN over > 0 THEN a END AS late_seconds,
      CASE WHEN over > 0 AND rank % 2 = 0 THEN least(100.0, round(greatest(0.0, least(ceil(over / 86400.0) * 7.5, 60.0)), 2))
      ELSE 0.0 END AS percent,
      CASE WHEN over > 0 AND rank % 2 = 1 THEN round(greatest(0.0, least(ceil(over / 86400.0) * 1000.0, 15000.0)), 2) ELSE 0.0 END AS marks
      FROM s)"""


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _submitted(spark, sf_dir)
    percent = F.col("rank") % 2 == 0
    unit = F.when(percent, "percent").otherwise("marks")
    return o.withColumns(
        M.lateness(
            F.col("at"), F.col("deadline"), 720 * F.col("rank"), unit, F.when(percent, 7.5).otherwise(1000.0),
            F.when(percent, 60.0).otherwise(15000.0)
        )
    )


@query(LATE_SQL + " SELECT o_orderkey, late_seconds, percent::DOUBLE AS percent, marks::DOUBLE AS marks FROM l")
def lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).select("o_orderkey", "late_seconds", "percent", "marks")


@query(
    LATE_SQL + " SELECT o_orderkey, CASE WHEN percent = 0 AND marks = 0 THEN o_totalprice ELSE floor(greatest(o_totalprice * (1 - percent::DOUBLE / 100) - marks::DOUBLE, 0) * 100 + 0.5) / 100 END AS final_mark FROM l"
)
def final_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).select("o_orderkey", M.final_mark(F.col("o_totalprice"), F.col("percent"), F.col("marks")).alias("final_mark"))


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderdate AS handed, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank, {DEADLINE_SQL} AS deadline
      FROM orders),
    u AS (SELECT *, greatest(deadline + to_minutes(720 * rank), CASE WHEN rank > 3 THEN deadline + INTERVAL 5 DAY END) AS until FROM o)
    SELECT o_orderkey, CASE WHEN handed < deadline - INTERVAL 7 DAY THEN 'upcoming' WHEN handed > deadline THEN 'closed'
      ELSE 'open' END AS status,
      handed >= deadline - INTERVAL 7 DAY AND handed <= until AS accepted FROM u"""
)
def accept_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether work was taken when it came: from a week before the deadline to the end of the grace period or the late date."""
    o = _submitted(spark, sf_dir)
    start = F.col("deadline") - F.expr("INTERVAL 7 DAYS")
    late_until = F.when(F.col("rank") > 3, F.col("deadline") + F.expr("INTERVAL 5 DAYS"))
    until = M.accept_until(F.col("deadline"), 720 * F.col("rank"), late_until)
    return o.select(
        "o_orderkey", M.status_at(F.col("at"), start, F.col("deadline")).alias("status"),
        ((F.col("at") >= start) & (F.col("at") <= until)).alias("accepted")
    )


@query("""SELECT l_orderkey, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity
      ELSE 0 END), 2) AS earned, round(sum(l_quantity), 2) AS total, count(*) FILTER (WHERE l_returnflag <> 'R') AS passed, count(*) AS n
      FROM lineitem GROUP BY 1""")
def test_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.col("l_returnflag") != "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(F.when(passed, F.col("l_quantity")).otherwise(0.0)), 2).alias("earned"), F.round(F.sum("l_quantity"), 2).alias("total"),
        F.count_if(passed).alias("passed"), F.count("*").alias("n")
    )


@query("""SELECT l_orderkey, l_linestatus, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity
      ELSE 0 END) / sum(l_quantity) * 10, 2) AS mark_of_ten FROM lineitem GROUP BY 1, 2""")
def task_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's tests scaled to ten marks."""
    earned = F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(
        F.round(earned / F.sum("l_quantity") * 10, 2).alias("mark_of_ten")
    )


@query("""WITH t AS (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey, sum(l_quantity) AS earned
      FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R' GROUP BY 1)
    SELECT o_orderkey, round(coalesce(earned, 0), 2) AS earned, round(coalesce(total, 0), 2) AS total FROM orders LEFT JOIN t
      ON t.l_orderkey = o_orderkey LEFT JOIN e ON e.l_orderkey = o_orderkey""")
def submission_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earned from answers that are marked, total from all tests: one aggregate of line items, one join."""
    marked = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R")
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.when(marked, F.col("l_quantity"))).alias("e"), F.sum("l_quantity").alias("t")
    )
    zero = F.lit(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey").join(t, "o_orderkey", "left").select(
        "o_orderkey", F.round(F.coalesce("e", zero), 2).alias("earned"), F.round(F.coalesce("t", zero), 2).alias("total")
    )


@query("""SELECT l_orderkey, l_linestatus, coalesce(min(l_linenumber) FILTER (WHERE l_returnflag = 'R'), 0) AS first_failed,
      count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax < 0.04) AS visible_failed, count(*) FILTER (WHERE l_returnflag = 'R'
      AND l_tax >= 0.04) AS hidden_failed FROM lineitem GROUP BY 1, 2""")
def failed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("l_returnflag") == "R"
    shown = F.col("l_tax") < 0.04
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(
        F.coalesce(F.min(F.when(failed, F.col("l_linenumber"))), F.lit(0)).alias("first_failed"), F.count_if(failed & shown).alias("visible_failed"),
        F.count_if(failed & ~shown).alias("hidden_failed")
    )


@query("""WITH q AS (SELECT DISTINCT l_linenumber AS test FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag
      FROM lineitem GROUP BY 1, 2)
    SELECT o_orderkey, count(*) FILTER (WHERE flag IS NULL) AS skipped, count(*) FILTER (WHERE flag = 'R') AS failed,
      count(*) FILTER (WHERE flag <> 'R') AS passed
    FROM orders CROSS JOIN q LEFT JOIN r ON l_orderkey = o_orderkey AND l_linenumber = test GROUP BY 1""")
def skipped_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test without an answer counts as skipped: the number of tests less those that have a result."""
    items = table(spark, sf_dir, "lineitem")
    tests = items.select("l_linenumber").distinct().agg(F.count("*").alias("tests"))
    r = items.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    counts = r.groupBy("o_orderkey").agg(F.count_if(F.col("flag") == "R").alias("failed"), F.count_if(F.col("flag") != "R").alias("passed"))
    zero = F.lit(0)
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").crossJoin(F.broadcast(tests))  # one row
    return joined.select(
        "o_orderkey", (F.col("tests") - F.coalesce("failed", zero) - F.coalesce("passed", zero)).alias("skipped"),
        F.coalesce("failed", zero).alias("failed"), F.coalesce("passed", zero).alias("passed")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE CAST(l_discount * 100 AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'timeout'
      WHEN 2 THEN 'infrastructure_error' WHEN 3 THEN 'out_of_memory' ELSE 'error' END AS status FROM lineitem""")
def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.element_at(F.array(*(F.lit(c) for c in (0, 124, 125, 137, 1))), F.least(F.round(F.col("l_discount") * 100).cast("int"), F.lit(4)) + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.exit_status(codes).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.0, least(10.0, 10.0 * (least(l_linenumber,
      4) + l_linenumber / 2.0 / 2) / 7)), 2)::DOUBLE AS score, printf('%d:%02d', CAST(l_quantity * 7 AS BIGINT) // 60,
      CAST(l_quantity * 7 AS BIGINT) % 60) AS clock FROM lineitem""")
def check_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks met and partly met, to marks; and a duration as minutes and seconds."""
    n = F.col("l_linenumber")
    score = M.check_score(F.lit(10.0), F.least(n, F.lit(4)), n / 2, F.lit(7))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"), M.clock((F.col("l_quantity") * 7).cast("long")).alias("clock")
    )


KEYWORDS_SQL = (
    r"list_distinct(list_filter(list_transform(regexp_extract_all(b.text, '[A-Za-z][A-Za-z0-9_]*'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    + ")))"
)


@query(
    f"""WITH k AS (SELECT item_id, unnest({KEYWORDS_SQL}) AS word FROM benchmark b), s AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1),
    d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS word FROM documents),
    m AS (SELECT doc_id, item_id, count(*) AS matched FROM d JOIN k USING (word) GROUP BY 1, 2)
    SELECT doc_id, item_id, matched, round(10.0 * matched / n, 2)::DOUBLE AS score FROM m JOIN s USING (item_id) WHERE 2 * matched >= n"""
)
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria (benchmark items) of which a document names at least half of the keywords, as whole words, and the score out of ten."""
    k = table(spark, sf_dir, "benchmark").select("item_id", T.keywords(F.col("text")).alias("k"))
    sizes = k.select("item_id", F.size("k").cast("long").alias("n"))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word")
    )
    m = d.join(k.select("item_id", F.explode("k").alias("word")), "word").groupBy("doc_id", "item_id").agg(F.count("*").alias("matched"))
    return m.join(sizes, "item_id").where("2 * matched >= n").select(
        "doc_id", "item_id", "matched", F.round(10.0 * F.col("matched") / F.col("n"), 2).alias("score")
    )


@query(
    r"""WITH t AS (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn) FILTER (WHERE role = 'assistant') AS report,
      list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{6,}')) FILTER (WHERE role = 'user'))) AS terms FROM conversations
      GROUP BY 1),
    m AS (SELECT conv_id, len(terms) AS n, len(list_filter(terms, lambda w: contains(report, w))) AS mentioned FROM t WHERE len(terms) > 0
      AND report IS NOT NULL)
    SELECT conv_id, n, mentioned, round(100.0 * mentioned / n)::BIGINT AS score, 10 * mentioned < 3 * n AS flagged FROM m"""
)
def term_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the assistant's turns name the terms of the user's."""
    c = table(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.lower("text").alias("t")))))
    terms = F.array_distinct(
        F.flatten(F.collect_list(F.when(F.col("role") == "user", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))))
    )
    t = c.groupBy("conv_id").agg(said.alias("said"), terms.alias("terms")).where((F.size("said") > 0) & (F.size("terms") > 0))
    t = t.select("conv_id", "terms", F.array_join(F.transform("said", lambda x: x["t"]), " ").alias("report"))
    m = t.select(
        "conv_id", F.size("terms").cast("long").alias("n"),
        F.size(F.filter("terms", lambda w: F.contains(F.col("report"), w))).cast("long").alias("mentioned")
    )
    return m.select(
        "*", F.round(100.0 * F.col("mentioned") / F.col("n")).cast("long").alias("score"), (10 * F.col("mentioned") < 3 * F.col("n")).alias("flagged")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_returnflag, l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1""")
def file_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of a submission: by priority, then age, then number."""
    order = Window.partitionBy("l_orderkey").orderBy("l_returnflag", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
