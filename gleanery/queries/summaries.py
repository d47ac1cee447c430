"""Exports, tallies, checks of input, and collapsed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cited, code
from .registry import query, table


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_custkey % 10 > 0) AS evaluated, round(avg(CASE
      WHEN o_orderstatus <> 'P' AND o_custkey % 10 > 0 THEN floor(o_totalprice) / (o_custkey % 10) END), 3) AS average FROM orders
      GROUP BY 1""")
def export_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average share over evaluated rows whose maximum isn't zero; others count but don't weigh."""
    counts = (F.col("o_orderstatus") != "P") & (F.col("o_custkey") % 10 > 0)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(counts).alias("evaluated"),
        F.round(F.avg(F.when(counts, F.floor("o_totalprice") / (F.col("o_custkey") % 10))), 3).alias("average")
    )


@query("""WITH p AS (SELECT quality = 0 AS copy, n_chars > 2000 AS old, n_chars > 2500 AS new FROM labels JOIN documents USING (doc_id))
    SELECT copy, count(*) AS n, count(*) FILTER (WHERE old) AS old_caught, count(*) FILTER (WHERE new) AS new_caught,
      count(*) FILTER (WHERE old AND NOT new) AS only_old, count(*) FILTER (WHERE new AND NOT old) AS only_new FROM p GROUP BY copy""")
def rule_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an old and a new rule catch of copies and of honest work."""
    old, new = F.col("n_chars") > 2000, F.col("n_chars") > 2500
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return p.groupBy((F.col("quality") == 0).alias("copy")).agg(
        F.count("*").alias("n"), F.count_if(old).alias("old_caught"), F.count_if(new).alias("new_caught"), F.count_if(old & ~new).alias("only_old"),
        F.count_if(new & ~old).alias("only_new")
    )


@query("""WITH b AS (SELECT o_custkey, CASE WHEN o_totalprice > 450000 THEN 2 WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS rank FROM orders)
      SELECT o_custkey, ['low', 'moderate', 'high'][max(rank) + 1] AS band FROM b GROUP BY 1""")
def worst_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    rank = F.when(price > 450000, 2).when(price > 300000, 1).otherwise(0)
    worst = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("r"))
    return worst.select("o_custkey", F.element_at(F.array(F.lit("low"), F.lit("moderate"), F.lit("high")), F.col("r") + 1).alias("band"))


@query("""WITH p AS (SELECT p_partkey, p_brand, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS number FROM part WHERE p_size <> 13
      OR p_brand <> ''), o AS (SELECT *, row_number() OVER (ORDER BY number, p_brand, p_partkey) AS place FROM p)
    SELECT place, p_partkey, p_brand FROM o WHERE place BETWEEN 101 AND 150""")
def natural_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty in numeric-aware order: a sort with limit and offset, numbered afterwards."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.regexp_extract("p_brand", "([0-9]+)$", 1).try_cast("int").alias("number"))
    order = ["number", "p_brand", "p_partkey"]
    page = p.orderBy(*order).offset(100).limit(50)
    return page.select((F.row_number().over(Window.orderBy(*order)) + 100).cast("long").alias("place"), "p_partkey", "p_brand")


@query("""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS name
      FROM conversations), n AS (SELECT conv_id, name, count(*) AS turns FROM w GROUP BY ALL)
    SELECT conv_id, turn, count(*) FILTER (WHERE turns > 1) AS named_elsewhere, count(*) FILTER (WHERE turns = 1) AS own FROM w
      JOIN n USING (conv_id, name) GROUP BY 1, 2""")
def other_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a file (turn) that its submission's other files use too, from counts, without joining files with each other."""
    w = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))).alias("name")
    )
    n = w.groupBy("conv_id", "name").agg(F.count("*").alias("turns"))
    return w.join(n, ["conv_id", "name"]).groupBy("conv_id", "turn").agg(
        F.count_if(F.col("turns") > 1).alias("named_elsewhere"), F.count_if(F.col("turns") == 1).alias("own")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice >= 0 AND l_extendedprice <= 90000
      AND abs(round(l_extendedprice, 2) - l_extendedprice) < 1e-9 AS valid, CASE WHEN l_linenumber > 5 THEN 'unknown' END AS problem
      FROM lineitem""")
def mark_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in range with at most two decimals, and criteria that the rubric doesn't have."""
    price = F.col("l_extendedprice")
    known = F.array(*map(F.lit, range(1, 6)))
    unknown = F.size(F.array_except(F.array("l_linenumber"), known)) > 0
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ((price >= 0) & (price <= 90000) & (F.abs(F.round(price, 2) - price) < 1e-9)).alias("valid"), F.when(unknown, "unknown").alias("problem")
    )


@query("""WITH n AS (SELECT c_nationkey, list(lower(trim(c_mktsegment))) AS s FROM customer GROUP BY 1)
      SELECT c_nationkey, len(s) <> len(list_distinct(s)) AS repeated FROM n""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.collect_list(F.lower(F.trim("c_mktsegment")))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(names.alias("s")).select(
        "c_nationkey", (F.size("s") != F.size(F.array_distinct("s"))).alias("repeated")
    )


@query("""SELECT event_id, '{"kind":"' || event_type || '","value":' || CAST(value * 100 AS BIGINT) || '}' AS result FROM events""".replace("CAST(value * 100 AS BIGINT)", "CAST(round(value * 100) AS BIGINT)"))
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as students may see it: ids and raw fields dropped from the struct, the rest as JSON."""
    r = F.struct("event_id", "user_id", F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(r.dropFields("event_id", "user_id")).alias("result"))


@query("""WITH t AS (SELECT conv_id, avg(length(text)) FILTER (WHERE role = 'user') AS u, avg(length(text)) FILTER (WHERE role = 'assistant') AS a,
      avg(length(text)) FILTER (WHERE role = 'system') AS s FROM conversations GROUP BY 1),
    p AS (SELECT conv_id, CASE WHEN u > 0 AND a > 0 THEN least(u, a) / greatest(u, a) END AS ua, CASE WHEN u > 0
      AND s > 0 THEN least(u, s) / greatest(u, s) END AS us, CASE WHEN a > 0 AND s > 0 THEN least(a, s) / greatest(a, s) END AS sa FROM t),
    k AS (SELECT conv_id, CASE WHEN ua IS NOT NULL AND us IS NOT NULL AND sa IS NOT NULL THEN (ua + us + sa) / 3
      WHEN ua IS NOT NULL THEN ua END AS m, (CASE WHEN ua < 0.25 THEN 1 ELSE 0 END + CASE WHEN us < 0.25 THEN 1 ELSE 0 END + CASE
      WHEN sa < 0.25 THEN 1 ELSE 0 END) AS low FROM p)
    SELECT conv_id, round(m, 4) AS overall, CASE WHEN m IS NULL THEN 'not_run' WHEN low > 0 THEN 'review' ELSE 'consistent' END AS status,
      CASE low WHEN 0 THEN NULL WHEN 1 THEN 'one pair differs' WHEN 2 THEN 'one part differs from two' ELSE 'all parts differ' END AS reason
      FROM k""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a submission's parts against each other (here of mean lengths): their mean, a status, and which differ. A part that is
    missing gives no score, never a zero."""
    size = lambda role: F.avg(F.when(F.col("role") == role, F.length("text")))
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(size("user").alias("u"), size("assistant").alias("a"), size("system").alias("s"))
    # least and greatest pass over nulls, so both sides are asked for
    pair = lambda x, y: F.when((F.col(x) > 0) & (F.col(y) > 0), F.least(x, y) / F.greatest(x, y))
    p = t.select("conv_id", pair("u", "a").alias("ua"), pair("u", "s").alias("us"), pair("a", "s").alias("sa"))
    mean = F.coalesce((F.col("ua") + F.col("us") + F.col("sa")) / 3, F.col("ua"))
    low = sum((F.coalesce((F.col(c) < 0.25).cast("int"), F.lit(0)) for c in ("ua", "us", "sa")), F.lit(0))
    reason = F.when(low == 1, "one pair differs").when(low == 2, "one part differs from two").when(low == 3, "all parts differ")
    return p.select(
        "conv_id", F.round(mean, 4).alias("overall"),
        F.when(mean.isNull(), "not_run").when(low > 0, "review").otherwise("consistent").alias("status"), reason.alias("reason")
    )


@query("""WITH e AS (SELECT l_orderkey, count(*) AS n, round(coalesce(avg(CASE
      WHEN l_tax > 0.02 THEN l_linenumber * 10 END), 50), 4) AS quality, string_agg(DISTINCT l_linestatus, ','
      ORDER BY l_linestatus) AS kinds, bool_or(l_returnflag = 'R') AS flagged FROM lineitem GROUP BY 1)
    SELECT l_orderkey, n, quality, kinds, flagged OR quality < 20 AS needs_review FROM e""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission's evidence in one row: files, their average quality (50 without any), kinds, and whether it needs review."""
    quality = F.round(F.coalesce(F.avg(F.when(F.col("l_tax") > 0.02, F.col("l_linenumber") * 10)), F.lit(50.0)), 4)
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), quality.alias("quality"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("kinds"),
        F.some(F.col("l_returnflag") == "R").alias("flagged")
    )
    return e.select("l_orderkey", "n", "quality", "kinds", (F.col("flagged") | (F.col("quality") < 20)).alias("needs_review"))


@query("""SELECT page_id, md5(regexp_replace(html, '("(?:\\\\.|[^"\\\\\\n])*"|''(?:\\\\.|[^''\\\\\\n])*'')|//[^\\n]*|#[^\\n]*|/\\*(?s:.*?)\\*/',
      '\\1', 'g')) AS digest FROM pages""")
def comments_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(code.without_comments(F.col("html"))).alias("digest"))


@query(cited.sql("documents", "doc_id", "text"))
def cited_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lists and cited quotations cut out."""
    return cited.removed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(code.paragraphs_sql("documents", "doc_id", "text"))
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed into passages of at most 800 characters."""
    return code.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
