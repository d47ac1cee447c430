"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a table; run writes it as Parquet into the shared folder and reads it again as the
next one's docs. All stages but the last return the columns of documents.

Defined results: a null or empty text fails the quality rules and goes there; very long texts pass through every stage whole; of equal
rows, and of near copies, the one with the least doc_id stays, different texts under one id both do, and rows without an id do as they
are; a row that the mixing stage repeats is packed each time; an empty table gives no row; extra columns, whatever their names, are
carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import packing, quality, raking, secret_scan, simhash, tokens
from gleanery.llm.common import read, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.passing(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the least doc_id; different texts under one id are different documents.
    Rows without an id stay as they are."""
    return simhash.unique_rows(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    marked = F.contains("text", F.lit(secret_scan.MARK))
    return secret_scan.redact(docs).withColumn("n_chars", F.when(marked, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their cell needs them to meet the target margins: some not at all, those of sparse cells several times."""
    return raking.sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, tokens.vocabulary_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SimHash components and tokenizers are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None
