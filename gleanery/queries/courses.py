"""More listings and scalars of the course domain: deadlines ahead, derived kinds, names, errors, timers, frames, curvature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import course as C
from ..functions.text import STOP_WORDS, keywords
from ..operators import pages as P
from .registry import query, table

NOW = "1998-03-01"


@query(f"""SELECT o_orderkey, o_orderdate AS due FROM orders WHERE o_orderdate > TIMESTAMP '{NOW}'
      AND o_orderdate <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY AND o_orderstatus <> 'F'""".replace("o_orderdate AS due", "CAST(epoch(o_orderdate) AS BIGINT) AS due"))
def due_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open work that falls due within a week."""
    at = F.col("o_orderdate").cast("timestamp")
    now = F.lit(NOW).cast("timestamp")
    rows = table(spark, sf_dir, "orders").where(
        (F.col("o_orderdate") > F.lit(NOW).cast("timestamp_ntz")) & (at <= now + F.expr("INTERVAL 7 DAYS")) & (F.col("o_orderstatus") != "F")
    )
    return rows.select("o_orderkey", F.unix_timestamp(at).alias("due"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'code_questions' WHEN p_size < 25 THEN 'timed' ELSE 'assignment' END AS kind,
    array_to_string(list_filter(['code', CASE WHEN p_size % 2 = 0 THEN 'report' END, CASE
      WHEN p_size % 5 = 0 THEN 'video' END], lambda x: x IS NOT NULL), ',') AS accepted FROM part""")
def derived_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size < 10, "code_questions").when(size < 25, "timed").otherwise("assignment")
    accepted = F.array_compact(F.array(F.lit("code"), F.when(size % 2 == 0, "report"), F.when(size % 5 == 0, "video")))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.array_join(accepted, ",").alias("accepted"))


@query("""SELECT s_suppkey, 'REG/' || s_nationkey || '/' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS number,
      regexp_matches('REG/' || s_nationkey || '/' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0'), '^[A-Z]+/[0-9]{2}/[0-9]{4}$') AS valid,
      lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS last_part FROM supplier""")
def register_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", C.register_number(F.lit("REG"), F.col("s_nationkey"), F.col("s_suppkey")).alias("number")
    )
    return s.select(
        "s_suppkey", "number", F.col("number").rlike("^[A-Z]+/[0-9]{2}/[0-9]{4}$").alias("valid"),
        F.substring_index("number", "/", -1).alias("last_part")
    )


@query(r"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(c_mktsegment) || '!' END AS w FROM customer)
    SELECT c_custkey, array_to_string(list_filter([CASE WHEN length(w) < 10 THEN 'short' END, CASE
      WHEN NOT regexp_matches(w, '[A-Z]') THEN 'no upper case' END, CASE WHEN NOT regexp_matches(w, '[a-z]') THEN 'no lower case' END,
      CASE WHEN NOT regexp_matches(w, '[0-9]') THEN 'no digit' END, CASE
      WHEN NOT regexp_matches(w, '[^A-Za-z0-9]') THEN 'no sign' END], lambda x: x IS NOT NULL), ', ') AS problems FROM c""")
def password_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("!")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(C.password_problems(word), ", ").alias("problems"))


@query(r"""WITH o AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Traceback' || chr(10) || '  File "main.py", line ' || (event_id % 90) || chr(10)
      || 'ValueError: bad' WHEN 1 THEN 'main.c:' || (event_id % 90) || ':5: error: expected'
      WHEN 2 THEN 'Main.java:' || (event_id % 90) || ': error: x' WHEN 3 THEN 'panic: main.go:' || (event_id % 90) ELSE 'fine' END AS e
      FROM events)
    SELECT event_id, CASE WHEN regexp_matches(e, 'line [0-9]+') THEN regexp_extract(e, 'line ([0-9]+)', 1)::INT
      WHEN regexp_matches(e, '\.[a-z]+:[0-9]+') THEN regexp_extract(e, '\.[a-z]+:([0-9]+)', 1)::INT END AS line,
      CASE WHEN regexp_matches(e, 'error:') THEN 'compile' WHEN regexp_matches(e, 'Traceback|panic|Exception') THEN 'runtime' END AS kind
      FROM o""")
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 90).cast("string")
    which = F.col("event_id") % 5
    text = (
        F.when(which == 0, F.concat(F.lit('Traceback\n  File "main.py", line '), n, F.lit("\nValueError: bad"))).when(which == 1, F.concat(F.lit("main.c:"), n, F.lit(":5: error: expected")))
        .when(which == 2, F.concat(F.lit("Main.java:"), n, F.lit(": error: x"))).when(which == 3, F.concat(F.lit("panic: main.go:"), n)).otherwise("fine")
    )
    return table(spark, sf_dir, "events").select("event_id", C.error_line(text).alias("line"), C.error_kind(text).alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rtrim(replace(l_returnflag || '  ', chr(13), '')) = l_linestatus AS exact,
      contains(l_returnflag || l_linestatus, 'NO') AS holds FROM lineitem""")
def output_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.concat("l_returnflag", F.lit("  "))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.matches(printed, F.col("l_linestatus"), "exact").alias("exact"),
        C.matches(F.concat("l_returnflag", "l_linestatus"), F.lit("NO"), "contains").alias("holds")
    )


@query("""WITH f AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
      FROM events), d AS (SELECT user_id, abs(value - before) AS d FROM f)
    SELECT user_id, count(d) AS n_diffs, CAST(sum(CAST(round(d * 100) AS BIGINT)) AS BIGINT) AS total_diff_hundredths,
      count(*) FILTER (WHERE d > 20) AS scene_changes FROM d GROUP BY user_id""")
def frame_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of consecutive frames of a recording: events stand for frames, a user for a recording."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = table(spark, sf_dir, "events").select("user_id", F.abs(F.col("value") - before).alias("d"))
    return d.groupBy("user_id").agg(
        F.count("d").alias("n_diffs"), F.sum(F.round(F.col("d") * 100).cast("long")).alias("total_diff_hundredths"),
        F.count_if(F.col("d") > 20).alias("scene_changes")
    )


@query("""WITH n AS (SELECT page_id, length(html) AS total FROM pages)
      SELECT page_id, i::INT AS i, CAST(floor(total * (i + 0.5) / 8) AS BIGINT) AS place FROM n, range(0, 8) AS r(i)""")
def frame_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight places spread evenly over each recording (here: page)."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(C.even_places(F.length("html"), 8)).alias("i", "place"))


@query("""WITH c AS (SELECT event_id, value / 40.0 - 1 AS c, CAST(value * 7 AS BIGINT) AS tokens FROM events)
    SELECT event_id, CASE WHEN tokens < 120 THEN 'insufficient_text' ELSE 'ok' END AS status, CASE
      WHEN tokens >= 120 THEN CAST(round(100 / (1 + exp(-2 * (c - 2.0)))) AS BIGINT) END AS score,
      CASE WHEN tokens >= 120 THEN CASE WHEN c >= 2 THEN 'high' WHEN c >= 1 THEN 'medium' ELSE 'low' END END AS signal FROM c""")
def curvature_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curvature and its number of tokens to a displayed score and a band; too little text gives neither."""
    c = table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") / 40.0 - 1).alias("c"), (F.col("value") * 7).cast("decimal(18,6)").alias("raw")
    )
    c = c.withColumn("tokens", F.round("raw").cast("long"))
    status, score, signal = C.curvature(F.col("c"), F.col("tokens"))
    return c.select("event_id", status.alias("status"), score.alias("score"), signal.alias("signal"))


@query("""WITH s AS (SELECT o_orderkey, o_orderdate AS start, o_orderdate + to_minutes(30 * (1 + o_custkey % 5)) AS personal,
      o_orderdate + INTERVAL 1 HOUR AS until FROM orders), e AS (SELECT *, least(personal, until) AS fin FROM s)
    SELECT o_orderkey, CAST(epoch(fin) - epoch(start) AS BIGINT) AS allowed_seconds, greatest(0,
      CAST(epoch(fin) - epoch(start) AS BIGINT) - 2000) AS seconds_left, epoch(start) + 2000 > epoch(fin) + 15 AS expired FROM e""")
def timed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of a timed task is its own limit or the assignment's, whichever is first; it has expired 15 seconds after."""
    start = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    end = F.least(start + 60 * 30 * (1 + F.col("o_custkey") % 5), start + 3600)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (end - start).alias("allowed_seconds"), F.greatest(F.lit(0).cast("long"), end - start - 2000).alias("seconds_left"),
        (start + 2000 > end + 15).alias("expired")
    )


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1, 2), g AS (SELECT *, min(CASE
      WHEN NOT done THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING) AS waits_for FROM t)
    SELECT l_orderkey, l_linenumber, waits_for FROM g""")
def order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first earlier task of the same work that isn't handed in."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.every(F.col("l_linestatus") == "F").alias("done"))
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("l_orderkey", "l_linenumber", F.min(F.when(~F.col("done"), F.col("l_linenumber"))).over(before).alias("waits_for"))


@query("""WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS l
      FROM documents),
    e AS (SELECT DISTINCT source, doc_id, regexp_replace(lower(unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2):len(l)]))), '[0-9]+',
      '#', 'g') AS key FROM l),
    n AS (SELECT source, count(*) AS pages FROM l GROUP BY source)
    SELECT source, md5(key) AS line, count(*) AS n FROM e JOIN n USING (source) GROUP BY source, key, pages
      HAVING count(*) >= greatest(2, ceil(pages * 0.05))""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near the top or bottom that a share of a source's pages (documents) have, digits apart."""
    return P.running_lines(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text", 0.05).select("source", F.md5("key").alias("line"), "n")


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name, unnest(range(0, len(regexp_extract_all(text,
      '[A-Za-z]+')))) AS i FROM conversations),
    f AS (SELECT conv_id, turn, name, min(i) AS first FROM w GROUP BY ALL)
      SELECT conv_id, turn, name, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY first) - 1)::INT AS number FROM f""")
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names numbered in the order in which they first appear, without a shuffle: places in the distinct array."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(names).alias("number", "name"))


@query("""WITH e AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice / 6000.0 END AS model, o_totalprice / 9000.0 AS style
      FROM orders)
    SELECT o_orderkey, CASE WHEN model IS NULL THEN 'style' ELSE 'model' END AS method, floor(coalesce(model,
      style) * 10000 + 0.5) / 10000 AS score FROM e""")
def method_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's score where it has one, else the style score, and which of them it is."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice") / 6000.0).alias("model"),
        (F.col("o_totalprice") / 9000.0).alias("style")
    )
    return o.select(
        "o_orderkey", F.when(F.col("model").isNull(), "style").otherwise("model").alias("method"),
        (F.floor(F.coalesce("model", "style") * 10000 + 0.5) / 10000).alias("score")
    )


TERMS_SQL = (
    "SELECT DISTINCT w FROM (SELECT unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'), lambda w: lower(w))) AS w FROM benchmark) WHERE length(w) > 2 AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in STOP_WORDS)
    + ")"
)
BUDGET = 1500


@query(
    f"""WITH RECURSIVE k AS ({TERMS_SQL}),
    s AS (SELECT doc_id, length(text) <= {BUDGET} AS fits, list_filter(string_split(text, chr(10)), lambda x: length(trim(x,
      ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0) AS ls FROM documents),
    l AS (SELECT doc_id, fits, i, ls[i] AS line FROM (SELECT doc_id, fits, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
    h AS (SELECT doc_id, i, unnest(list_distinct(list_transform(regexp_extract_all(line, '[A-Za-z][A-Za-z0-9_]*'),
      lambda w: lower(w)))) AS w FROM l WHERE NOT fits),
    g AS (SELECT doc_id, i, count(*) AS score FROM h SEMI JOIN k USING (w) GROUP BY ALL),
    o AS (SELECT doc_id, l.i, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, l.i) AS k FROM l
      LEFT JOIN g USING (doc_id, i) WHERE NOT fits),
    r AS (SELECT doc_id, i, n, k, n + 2 <= {BUDGET} AS kept, CASE WHEN n + 2 <= {BUDGET} THEN n + 2 ELSE 0 END AS used FROM o WHERE k = 1
      UNION ALL SELECT o.doc_id, o.i, o.n, o.k, r.used + o.n + 2 <= {BUDGET}, CASE WHEN r.used + o.n + 2 <= {BUDGET} THEN r.used + o.n + 2
      ELSE r.used END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1),
    t AS (SELECT doc_id, i, n FROM r WHERE kept UNION ALL SELECT doc_id, i, length(line) FROM l WHERE fits),
    c AS (SELECT doc_id, string_agg((i - 1)::VARCHAR, ',' ORDER BY i) AS chosen, sum(n)::INT AS n_chars FROM t GROUP BY doc_id)
    SELECT doc_id, coalesce(len(ls), 0)::INT AS n_passages, coalesce(chosen, '') AS chosen, coalesce(n_chars, 0) AS n_chars FROM s LEFT
      JOIN c USING (doc_id)"""
)
def greedy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts within the budget whole, else passages by how many benchmark keywords they name."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(keywords(F.col("text"))).alias("w"))
    return P.greedy_passages(table(spark, sf_dir, "documents"), "doc_id", "text", terms, BUDGET)
