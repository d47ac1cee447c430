"""Text that a template holds too: runs of covered words, and what is left without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_RUN = 8


def runs(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", k: int = T.GRAM_WORDS, least: int = LEAST_RUN) -> DataFrame:
    """(id, start_word, end_word) of every run of at least ``least`` words covered by k-word grams of the templates.

    Grams are exploded with their place and meet the templates' distinct grams in a semi-join, so what moves is places that match.
    Words from 0, ends exclusive.
    """
    known = templates.select(F.explode(T.gram_hashes(T.words(F.col("text")), k)).alias("h")).distinct()
    placed = docs.select(id_col, F.posexplode(T.gram_hashes(T.words(F.col("text")), k)).alias("at", "h")).join(known, "h", "left_semi")
    by_place = Window.partitionBy(id_col).orderBy("at")
    gap = F.col("at") - F.lag("at").over(by_place)
    numbered = placed.withColumn("new", F.when(gap <= k, 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    )
    found = numbered.groupBy(id_col, "run").agg(F.min("at").alias("start_word"), (F.max("at") + k).alias("end_word"))
    return found.where(F.col("end_word") - F.col("start_word") >= least).select(id_col, "start_word", "end_word")


def without_runs(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, words_removed, rest): the document's words outside the runs, in order."""
    by_doc = found.groupBy(id_col).agg(F.collect_list(F.struct("start_word", "end_word")).alias("cut"))
    joined = docs.select(id_col, T.words(F.col("text")).alias("w")).join(by_doc, id_col, "left")
    rest = F.when(F.col("cut").isNull(), F.col("w")).otherwise(
        F.filter("w", lambda _, i: ~F.exists("cut", lambda r: (i >= r["start_word"]) & (i < r["end_word"])))
    )
    return joined.select(id_col, "w", rest.alias("r")).select(
        id_col, (F.size("w") - F.size("r")).alias("words_removed"), F.array_join("r", " ").alias("rest")
    )
