"""Chunk vectors over the embeddings table; a submission is a run of five vectors, its cohort the label of the first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import chunks as C
from ..operators import cohort
from ..sources.shared import shared_dir, written
from ..sources.store import VectorStore
from .registry import query, table

#: Sums of 64 products, rounded so that the order of summation doesn't show.
DIGITS = 6
SQL_CHUNKS = """e AS (SELECT vec_id, label, vec_id // 5 AS owner, vec_id % 3 + 1 AS w, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    u AS (SELECT vec_id, label, owner, w, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)"""
SQL_PAIRS = (
    SQL_CHUNKS
    + """, k AS (SELECT owner, arg_min(label, vec_id)::BIGINT AS class FROM u GROUP BY owner), q AS (SELECT x.owner AS a, y.owner AS b, x.class
      FROM k x JOIN k y ON x.class = y.class AND x.owner < y.owner),
    d AS (SELECT q.a, q.b, q.class, x.vec_id AS i, y.vec_id AS j, x.w AS wi, y.w AS wj, list_sum(list_transform(list_zip(x.v, y.v),
      lambda z: z[1] * z[2])) AS s FROM q JOIN u x ON x.owner = q.a JOIN u y ON y.owner = q.b),
    l AS (SELECT a, b, sum(w * m) / sum(w) AS s FROM (SELECT a, b, i, any_value(wi) AS w, max(s) AS m FROM d GROUP BY a, b, i)
      GROUP BY a, b),
    r AS (SELECT a, b, sum(w * m) / sum(w) AS s FROM (SELECT a, b, j, any_value(wj) AS w, max(s) AS m FROM d GROUP BY a, b, j)
      GROUP BY a, b),
    p AS (SELECT a, b, class, round(least(1.0, greatest(0.0, (l.s + r.s) / 2)), 4) AS score FROM l JOIN r USING (a, b) JOIN k
      ON k.owner = a)"""
)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 5).alias("owner"), (F.col("vec_id") % 3 + 1).alias("w"), "embedding", "label"
    )


WHO = ("owner", "class", "embedding", "w")


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the class of their submission, which is the label of its first vector."""
    c = _chunks(spark, sf_dir)
    classes = c.groupBy("owner").agg(F.min_by("label", "vec_id").alias("class"))
    return c.drop("label").join(classes, "owner")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of submissions of a class."""
    return C.class_scores(_classed(spark, sf_dir), *WHO).withColumn("score", F.round("score", 4))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(C.score_counts(_classed(spark, sf_dir), *WHO), "scores")


@query(f"WITH {SQL_PAIRS} SELECT a, b, class, score FROM p")
def best_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(
    f"""WITH {SQL_PAIRS}, m AS (SELECT class, count(*) AS n, median(score) AS median FROM p
      GROUP BY class), s AS (SELECT class, median(abs(score - median)) AS mad FROM p JOIN m USING (class) GROUP BY class)
    SELECT class, n, round(median, 6) AS median, round(mad, 6) AS mad, round(CASE
      WHEN n >= 10 THEN greatest(0.8, median + 2 * greatest(1.4826 * mad, 0.02)) ELSE 0.8 END, 6) AS bar FROM m JOIN s USING (class)"""
)
def cohort_bar_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = cohort.robust_bar(_counts(spark, sf_dir), "class")
    return bars.select("class", "n", *(F.round(c, DIGITS).alias(c) for c in ("median", "mad", "bar")))


@query(
    f"""WITH {SQL_PAIRS}, m AS (SELECT class, count(*) AS n, median(score) AS median FROM p
      GROUP BY class), s AS (SELECT class, median(abs(score - median)) AS mad FROM p JOIN m USING (class) GROUP BY class)
    SELECT class, round(CASE WHEN n >= 10 THEN greatest(0.85, median + 2 * 1.4826 * mad) ELSE 0.85 END, 6) AS bar FROM m
      JOIN s USING (class)"""
)
def cohort_bar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = cohort.robust_bar(_counts(spark, sf_dir), "class", cohort.SEMANTIC_REPORT_REVIEW, 0.0)
    return bars.select("class", F.round("bar", DIGITS).alias("bar"))


@query(
    f"""WITH {SQL_PAIRS}, m AS (SELECT class, count(*) AS n, median(score) AS median FROM p
      GROUP BY class), s AS (SELECT class, median(abs(score - median)) AS mad FROM p JOIN m USING (class) GROUP BY class),
    c AS (SELECT class, CASE WHEN n >= 10 THEN greatest(0.2, median + 2 * greatest(1.4826 * mad, 0.02)) ELSE 0.2 END AS bar FROM m
      JOIN s USING (class))
    SELECT a, b, CASE WHEN (a + b) % 17 = 0 THEN 'high' WHEN score >= bar THEN 'review' END AS level FROM p JOIN c USING (class)"""
)
def semantic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against their cohort's bar; every 17th pair stands for one that the tokens flag."""
    bars = cohort.robust_bar(_counts(spark, sf_dir), "class", 0.2).select("class", "bar")
    scored = C.class_scores(_classed(spark, sf_dir), *WHO, bars=bars)
    level, _ = cohort.combined_flag((F.col("a") + F.col("b")) % 17 == 0, F.round("score", 4), F.col("bar"))
    return scored.select("a", "b", level.alias("level"))


@query(
    f"""WITH {SQL_PAIRS}, m AS (SELECT class, count(*) AS n, median(score) AS median FROM p
      GROUP BY class), s AS (SELECT class, median(abs(score - median)) AS mad FROM p JOIN m USING (class) GROUP BY class),
    c AS (SELECT class, CASE WHEN n >= 10 THEN greatest(0.2, median + 2 * greatest(1.4826 * mad, 0.02)) ELSE 0.2 END AS bar FROM m
      JOIN s USING (class))
    SELECT class, a, b, score FROM p JOIN c USING (class) WHERE score >= bar"""
)
def semantic_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs at their class's bar or over it, with no list of the others: the bar comes from counts, and pairs of blocks that can't
    reach it are never compared."""
    bars = written(cohort.robust_bar(_counts(spark, sf_dir), "class", 0.2), "bars")
    return C.scores_over(_classed(spark, sf_dir), bars, *WHO)


@query(f"""WITH {SQL_CHUNKS}, x AS (SELECT owner, w, unnest(range(0, 64)) AS dim, unnest(embedding) AS x FROM e JOIN embeddings USING (vec_id))
      SELECT owner, dim::INT AS dim, round(sum(w * x::DOUBLE) / sum(w), 6) + 0.0 AS mean FROM x GROUP BY owner, dim""")
def doc_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_vector(_chunks(spark, sf_dir), "owner", "embedding", "w").withColumn("mean", F.round("mean", DIGITS) + 0.0)


@query("""SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
      AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 AS valid FROM embeddings""")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.valid(F.col("embedding"), 64).alias("valid"))


@query(
    f"WITH {SQL_CHUNKS} SELECT x.vec_id AS a, y.vec_id AS b, round(list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * z[2])), 6) + 0.0 AS cosine FROM u x JOIN u y ON x.owner = y.owner AND x.vec_id < y.vec_id"
)
def chunk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _chunks(spark, sf_dir).select("owner", "vec_id", V.unit(F.col("embedding")).alias("v"))
    left, right = u.select(
        "owner", F.col("vec_id").alias("a"), F.col("v").alias("va")
    ), u.select("owner", F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return left.join(right, "owner").where("a < b").select("a", "b", (F.round(V.dot(F.col("va"), F.col("vb")), DIGITS) + 0.0).alias("cosine"))


@query(
    """WITH e AS (SELECT vec_id, md5('v1|' || vec_id) AS key, label FROM embeddings)
    SELECT vec_id, label % 2 = 0 AS hit FROM e"""
)
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that was given the vectors of every other label, and which of all vectors it holds."""
    e = table(spark, sf_dir, "embeddings").withColumn("key", F.md5(F.concat(F.lit("v1|"), F.col("vec_id").cast("string"))))
    store = VectorStore(spark, f"{shared_dir(spark)}/vector-stores/{uuid.uuid4().hex}")
    store.put(e.where("label % 2 = 0").select("key", F.col("embedding").alias("vec")))
    return e.select("vec_id", "key").join(store.look_up(e), "key").select("vec_id", F.col("vec").isNotNull().alias("hit"))
