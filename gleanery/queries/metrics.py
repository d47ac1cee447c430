"""Accuracy of text signals against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import query, table

#: A score with exact sums: characters that aren't letters, in thousandths of the text, as a whole number.
SCORED = """s AS (SELECT doc_id, lang, quality = 0 AS bad, CAST(floor(1000.0 * (length(text) - length(regexp_replace(text, '[^\\p{L}]', '',
      'g'))) / greatest(1, length(text))) AS BIGINT) AS score FROM documents JOIN labels USING (doc_id))""".replace("\\\\", "\\")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    other = n - F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", (F.col("quality") == 0).alias("bad"), F.floor(1000.0 * other / F.greatest(F.lit(1), n)).alias("score"))


@query(
    f"""WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (WHERE score >= 230 AND bad) AS tp, count(*) FILTER (WHERE score >= 230
      AND NOT bad) AS fp, count(*) FILTER (WHERE score < 230 AND bad) AS fn, count(*) FILTER (WHERE score < 230 AND NOT bad) AS tn FROM s
      GROUP BY lang)
    SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_scored(spark, sf_dir), F.col("score") >= 230, F.col("bad"), ["lang"])


@query(f"""WITH {SCORED} SELECT a.lang, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM s a
      JOIN s b ON a.lang = b.lang AND a.bad AND NOT b.bad GROUP BY a.lang""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.auc(_scored(spark, sf_dir), "score", F.col("bad"), "lang").where("auc IS NOT NULL").select("lang", F.round("auc", 6).alias("auc"))


@query(
    f"""WITH {SCORED}, h AS (SELECT lang, score / 1000.0 AS v FROM s WHERE NOT bad), c AS (SELECT DISTINCT lang, floor(v * 100 + 1) AS t FROM h),
    r AS (SELECT c.lang, t, avg(CASE WHEN floor(v * 100 + 1) > t THEN 1.0 ELSE 0 END) AS rate FROM c JOIN h USING (lang) GROUP BY ALL)
      SELECT lang, min(t) / 100 AS threshold FROM r WHERE rate <= 0.05 GROUP BY lang"""
)
def threshold_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lowest_threshold(_scored(spark, sf_dir).withColumn("v", F.col("score") / 1000), "v", ~F.col("bad"), 0.05, "lang")


@query(f"""WITH {SCORED}, g AS (SELECT lang, score // 100 AS given, CASE WHEN bad THEN 5 ELSE 2 END AS t FROM s)
    SELECT lang, count(*) AS n, round(avg(abs(given - t)), 4) AS mae, round(avg(CASE WHEN abs(given - t) <= 1 THEN 1.0
      ELSE 0 END), 4) AS within_one, round(avg(given - t), 4) AS bias, count(*) FILTER (WHERE given = 0 AND t > 0) AS false_zeros FROM g
      GROUP BY lang""")
def mae_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _scored(spark, sf_dir).select("lang", F.floor(F.col("score") / 100).alias("given"), F.when(F.col("bad"), 5).otherwise(2).alias("t"))
    return E.errors(g, "given", "t", ["lang"])


@query("""WITH m AS (SELECT o_orderpriority, regr_slope(o_totalprice / 1000, o_custkey % 100) AS s, avg(o_custkey % 100) AS mx,
      avg(o_totalprice / 1000) AS my FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(coalesce(s, 1.0), 6) AS slope, round(my - coalesce(s, 1.0) * mx, 6) AS intercept FROM m""")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 100).alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return E.line(o, "x", "y", ["o_orderpriority"])


@query(
    f"""WITH {SCORED}, b AS (SELECT CASE WHEN bad THEN 'bad' ELSE 'good' END AS label, CASE WHEN score >= 400 THEN 'high'
      WHEN score >= 230 THEN 'medium' ELSE 'low' END AS signal FROM s)
    SELECT coalesce(label, 'ALL') AS label, signal, count(*) AS n FROM b GROUP BY GROUPING SETS ((label, signal), (signal))"""
)
def band_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal bands by label, and over all of them."""
    b = _scored(spark, sf_dir).select(
        F.when(F.col("bad"), "bad").otherwise("good").alias("label"),
        F.when(F.col("score") >= 400, "high").when(F.col("score") >= 230, "medium").otherwise("low").alias("signal")
    )
    return b.groupingSets([["label", "signal"], ["signal"]], "label", "signal").agg(F.count("*").alias("n")).select(
        F.coalesce("label", F.lit("ALL")).alias("label"), "signal", "n"
    )


@query(
    f"""WITH {SCORED}, r AS (SELECT lang, count(*) FILTER (WHERE score >= 230) AS h, count(*) AS n FROM s WHERE NOT bad
      GROUP BY lang), p AS (SELECT *, h / n AS p FROM r)
    SELECT lang, h AS hits, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n),
      6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM p"""
)
def flag_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of good texts that the score flags, with its interval."""
    r = _scored(spark, sf_dir).where(~F.col("bad")).groupBy("lang").agg(F.count_if(F.col("score") >= 230).alias("hits"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("hits"), F.col("n"))
    return r.select("lang", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    """WITH t AS (SELECT label, vec_id FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM t a JOIN t b ON a.vec_id + 1 = b.vec_id),
    q AS (SELECT coalesce(x.a, y.a) AS a, x.a IS NOT NULL AS predicted, y.a IS NOT NULL AS actual FROM (SELECT * FROM p
      WHERE a % 3 = 0) x FULL OUTER JOIN (SELECT p.a, p.b FROM p JOIN t l ON l.vec_id = p.a JOIN t r ON r.vec_id = p.b
      WHERE l.label % 2 = r.label % 2) y USING (a, b))
    SELECT count(*) FILTER (WHERE predicted AND actual) AS tp, count(*) FILTER (WHERE predicted
      AND NOT actual) AS fp, count(*) FILTER (WHERE NOT predicted AND actual) AS fn FROM q"""
)
def predicted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against true pairs, by a full outer join."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    p = t.select(F.col("vec_id").alias("a"), F.col("label").alias("la")).join(
        t.select((F.col("vec_id") - 1).alias("a"), F.col("label").alias("lb")), "a"
    )
    predicted = p.where("a % 3 = 0").select("a", F.lit(True).alias("predicted"))
    actual = p.where("la % 2 = lb % 2").select("a", F.lit(True).alias("actual"))
    q = predicted.join(actual, "a", "full_outer").na.fill(False)
    return q.agg(
        F.count_if(F.col("predicted") & F.col("actual")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("actual")).alias("fp"),
        F.count_if(~F.col("predicted") & F.col("actual")).alias("fn")
    )
