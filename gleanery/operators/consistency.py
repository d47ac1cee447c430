"""Whether a submission's code, report and transcript are about the same: cosines of their vectors, an overall mean and a verdict."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

PARTS = ("code", "report", "transcript")
PAIRS = tuple(combinations(PARTS, 2))


def part_scores(rows: DataFrame, keys: list[str], part: str, vector: str, threshold: float) -> DataFrame:
    """keys, a score for each pair of parts, overall and status. rows: one per part that has enough text.

    A score is the cosine within 0 and 1; a part that is missing gives no score, never a zero. overall is their mean. Fewer than two parts:
    limited_data without scores; below threshold: review_recommended; all three parts: consistent; two: limited_data with the score.
    """
    packed = rows.groupBy(*keys).agg(*(F.max(F.when(F.col(part) == p, V.unit(F.col(vector)))).alias(p) for p in PARTS))

    def both(a: str, b: str) -> Column:  # least and greatest pass over nulls, so both sides are asked for
        close = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.dot(F.col(a), F.col(b)))), 4)
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), close).alias(f"{a}_{b}")

    scored = packed.select(*keys, *(both(a, b) for a, b in PAIRS), sum((F.col(p).isNotNull().cast("int") for p in PARTS), F.lit(0)).alias("parts"))
    found = F.array_compact(F.array(*(F.col(f"{a}_{b}") for a, b in PAIRS)))
    overall = F.when(F.size(found) > 0, F.round(F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found), 4))
    told = scored.withColumn("overall", overall)
    status = F.when(F.col("overall").isNull(), "limited_data").when(
        F.col("overall") < threshold, "review_recommended"
    ).when(F.col("parts") == 3, "consistent").otherwise("limited_data")
    return told.select(*keys, *(f"{a}_{b}" for a, b in PAIRS), "overall", status.alias("status"))
