"""Connected components of a graph given as a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's greater neighbours move to the least of its neighbourhood; small star: the others do.

    links has each link once as (v, u) with v > u. Only a minimum per node is aggregated, so a node with a third of all links
    costs one partial aggregate per task, and the join back is an inner join whose large partitions Spark can split.
    """
    if large:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), F.least("v", "m").alias("m"))
        moved = links.withColumnRenamed("u", "c").join(least, "c").select("v", F.col("m").alias("u"))
    else:
        least = links.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), "m")
        joined = links.withColumnRenamed("v", "c").join(least, "c")
        moved = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select(F.col("c").alias("v"), F.col("m").alias("u")))
    return moved.where("v > u").distinct()


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """links: (v, u) of any orderable type, in any direction, repeats and v = u allowed. Returns (node, root) for each node that
    has a link to another one; root is the least node that can be reached. Each round is written to the shared folder."""
    now = written(links.where("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
                now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        seen = mark
        now = written(_star(_star(now, True), False), name)
