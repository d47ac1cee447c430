"""Programs: Python files written from orders, one function a line item, and pages as files of other languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import python_code as P
from .registry import query, table


def _function(x: Column) -> Column:
    """A function of a line item: its flags say whether it has a docstring, an odd name, a reminder, a long line and many paths."""
    number = x["l_linenumber"].cast("string")
    return F.concat(
        F.when(x["l_discount"] > 0.08, "def Line_").otherwise("def line_"), number, F.lit("(a):\n"),
        F.when(x["l_returnflag"] == "R", F.concat(F.lit('    """Returns line '), number, F.lit('."""\n'))).otherwise(""),
        F.when(x["l_linestatus"] == "O", "    # TODO look again\n").otherwise("    # counts up here\n"),
        F.when(x["l_quantity"] > 45, F.concat(F.lit("    b = '"), F.repeat(F.lit("x"), F.lit(100)), F.lit("'\n"))).otherwise(""),
        F.array_join(F.transform(F.sequence(F.lit(1), 2 * x["l_linenumber"].cast("int")), lambda k: F.concat(F.lit("    if a > "), k.cast("string"), F.lit(" and b:\n        a += 1\n"))), ""),
        F.lit("    return a\n\n\n"),
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_discount", "l_returnflag", "l_linestatus", "l_quantity").alias("x")
    )
    # parsing takes long and the rows are small: as many parts as there are cores, whatever their bytes
    lines = lines.repartition(spark.sparkContext.defaultParallelism, "l_orderkey")
    files = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return files.select("l_orderkey", F.array_join(F.transform("x", _function), "").alias("source"), F.lit("order.py").alias("name"))


@query(
    """WITH f AS (SELECT l_orderkey, count(*)::INT AS functions, count(*) FILTER (WHERE l_returnflag = 'R') AS told,
      count(*) FILTER (WHERE 1 + 4 * l_linenumber > 10)::INT AS complex, count(*) FILTER (WHERE l_discount > 0.08)::INT AS names,
      count(*) FILTER (WHERE l_linestatus = 'O')::INT AS reminders, count(*) FILTER (WHERE l_quantity > 45)::INT AS long_lines,
      string_agg('Returns line ' || l_linenumber || '.', chr(10) ORDER BY l_linenumber, l_discount, l_returnflag, l_linestatus, l_quantity)
        FILTER (WHERE l_returnflag = 'R') AS docs,
      string_agg('counts up here', chr(10)) FILTER (WHERE l_linestatus <> 'O') AS said FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, functions, round(told / functions, 6) AS docstring_coverage, complex, names, reminders, long_lines,
      (100 - least(40, 10 * complex) - least(20, 5 * names) - least(15, 5 * reminders) - least(10, long_lines)
        - least(15, floor((1 - told / functions) * 15)))::INT AS quality,
      md5(concat_ws(chr(10), docs, said)) AS documentation FROM f"""
)
def python_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smells, quality and documentation of the files, from their syntax nodes; SQL counts what the files were written from."""
    found = P.file_quality(_files(spark, sf_dir), "l_orderkey", "source", "name")
    return found.select(
        "l_orderkey", "functions", F.round("docstring_coverage", 6).alias("docstring_coverage"), *P.COSTS, "quality", F.md5("documentation").alias("documentation")
    )


@query(C.numbered_sql("pages", "page_id", "html"))
def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as code whose own names are numbered as they first appear, so that a renamed copy reads the same."""
    t = table(spark, sf_dir, "pages").select("page_id", C.numbered_tokens(F.col("html")).alias("t"))
    return t.select("page_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "\x1f")).alias("digest"))


@query()
def python_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as if they were source files, by the generic tokenizer; tested against plain Python."""
    return C.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(C.sql("pages", "page_id", "html"))
def generic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded code tokens of pages, as counts and a digest of their order."""
    t = table(spark, sf_dir, "pages").select("page_id", C.generic_tokens(F.col("html")).alias("t"))
    return t.select("page_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "\x1f")).alias("digest"))


@query(C.sentences_sql("documents", "doc_id", "text"))
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed greedily into chunks of at most 120 words."""
    return C.sentence_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
