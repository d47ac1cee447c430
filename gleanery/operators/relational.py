"""Shapes that most listings share: the latest row of a key, counts with defaults, scoped rows, masks, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The row of each key with the greatest order, then tie: a partial aggregate over structs, no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("row"))
    return best.select(*keys, *(F.col("row")[c].alias(c) for c in rest))


def with_counts(df: DataFrame, counts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Left outer merge of counts, 0 where a key has none."""
    return df.join(counts, keys, "left").select(*df.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def scoped(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows of keys that the caller may see."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_semi")


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done yet: resume is idempotent."""
    return rows.join(done.select(*keys), keys, "left_anti")


def masked(column: Column, released: Column) -> Column:
    """The value once released, null before."""
    return F.when(released, column)


def first_row_of(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """name: the first row (by order) with the same value, null in that first row itself."""
    first = F.min(order).over(Window.partitionBy(value))
    return df.withColumn(name, F.when(F.col(order) > first, first))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def endpoints(pairs: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """Each pair twice: (id, other)."""
    both = F.array(F.struct(F.col(a).alias("id"), F.col(b).alias("other")), F.struct(F.col(b).alias("id"), F.col(a).alias("other")))
    return pairs.select(F.explode(both).alias("e"), *keep).select("e.id", "e.other", *keep)


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place (from 1) in an order of all rows.

    Rows are dealt out by ranges and numbered inside each; a range's first place comes from the numbers of rows in the ranges before it,
    one row a range. So no task sees all rows, as one window over everything would.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "places")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("__part", before.alias("__before"))
    return dealt.withColumn("__nth", inside).join(first, "__part").withColumn(
        name, (F.col("__before") + F.col("__nth")).cast("long")
    ).select(*df.columns, name)
