"""How good a signal is against labels: confusion, AUC, thresholds, errors, a line through two columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, predicted: Column, actual: Column, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision and recall (null where nothing is predicted or true)."""
    counts = {"tp": predicted & actual, "fp": predicted & ~actual, "fn": ~predicted & actual, "tn": ~predicted & ~actual}
    c = rows.groupBy(*keys).agg(*(F.count_if(x).alias(k) for k, x in counts.items()))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return c.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def auc(rows: DataFrame, score: str, positive: Column, key: str) -> DataFrame:
    """(key, auc): the chance that a positive scores above a negative, ties half. Scores are folded to counts per value first, so the
    running sum passes distinct scores, not rows."""
    folded = rows.groupBy(key, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = folded.withColumn("wins", F.col("p") * (below + F.col("n") / 2))
    return wins.groupBy(key).agg((F.sum("wins") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def lowest_threshold(rows: DataFrame, score: str, negative: Column, most: float, key: str) -> DataFrame:
    """(key, threshold): the least of a 0.01 grid at which at most ``most`` of the negatives score. Candidates lie just above scores."""
    grid = F.floor(F.col(score) * 100 + 1)
    bins = rows.where(negative).groupBy(key, grid.alias("t")).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(key).orderBy(F.desc("t"))
    above = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bins.withColumn("above", above).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    return placed.where(F.col("above") <= most * F.col("all")).groupBy(key).agg((F.min("t") / 100).alias("threshold"))


def errors(rows: DataFrame, given: str, true: str, keys: list[str]) -> DataFrame:
    """n, mae, within_one, bias and false_zeros of given against true."""
    gap = F.col(given) - F.col(true)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(gap)), 4).alias("mae"), F.round(F.avg((F.abs(gap) <= 1).cast("double")), 4).alias("within_one"),
        F.round(F.avg(gap), 4).alias("bias"), F.count_if((F.col(given) == 0) & (F.col(true) > 0)).alias("false_zeros"),
    )


def line(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """slope and intercept of y by x; slope 1 where x doesn't vary."""
    fitted = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("s"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.coalesce("s", F.lit(1.0))
    return fitted.select(*keys, F.round(slope, 6).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), 6).alias("intercept"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share."""
    p, zz = hits / n, z * z
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (middle - half) / (1 + zz / n), (middle + half) / (1 + zz / n)


def held_out_errors(rows: DataFrame, x: str, y: str, key: str, order: str) -> DataFrame:
    """key, n, mae_raw and mae_fitted: a line of y by x is fitted on the first half of each key's rows by order, and the other half tells how
    far x and the line (at least 0) lie off."""
    nth, n = F.row_number().over(Window.partitionBy(key).orderBy(order)), F.count("*").over(Window.partitionBy(key))
    halves = rows.withColumn("__train", nth * 2 <= n)
    train = halves.where("__train")
    fitted = train.groupBy(key).agg(F.coalesce(F.regr_slope(y, x), F.lit(1.0)).alias("__a"), F.avg(y).alias("__my"), F.avg(x).alias("__mx"))
    line_at = F.greatest(F.lit(0.0), F.col("__a") * F.col(x) + F.col("__my") - F.col("__a") * F.col("__mx"))
    off = lambda c: F.round(F.avg(F.abs(c - F.col(y))), 4)
    return halves.where(~F.col("__train")).join(fitted, key).groupBy(key).agg(
        F.count("*").alias("n"), off(F.col(x)).alias("mae_raw"), off(line_at).alias("mae_fitted")
    )


def chunk_budgets(chunks: DataFrame, report: str, place: str, value: str, budgets: tuple[int, ...], tolerance: float) -> DataFrame:
    """max_chunks, mean_delta, max_delta, changes and suggested: scores (whole means of evenly spread chunks) of each budget against the
    largest; changes: reports whose sign changes; suggested: the least budget without changes and within the tolerance, else the largest."""
    packed = chunks.groupBy(report).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias("v"))

    def score(budget: int) -> Column:
        n = F.size("v")
        places = F.transform(
            F.sequence(F.lit(0), F.least(n, F.lit(budget)) - 1), lambda j: F.when(n <= budget, j).otherwise(F.floor(j * n / budget).cast("int"))
        )
        picked = F.transform(places, lambda i: F.get("v", i))
        return F.floor(F.aggregate(picked, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(picked))

    last = max(budgets)
    rows = packed.select(
        score(last).alias("ref"), F.explode(F.array(*(F.struct(F.lit(b).alias("max_chunks"), score(b).alias("s")) for b in budgets))).alias("b")
    )
    gap = F.abs(F.col("b.s") - F.col("ref"))
    told = rows.groupBy(F.col("b.max_chunks").alias("max_chunks")).agg(
        F.avg(gap).alias("d"), F.max(gap).alias("max_delta"), F.count_if((F.col("b.s") >= 0) != (F.col("ref") >= 0)).alias("changes")
    )
    good = F.min(
        F.when((F.col("changes") == 0) & (F.col("d") <= tolerance), F.col("max_chunks"))
    ).over(Window.partitionBy(F.lit(0)))  # one row a budget
    return told.select(
        "max_chunks", F.round("d", 2).alias("mean_delta"), "max_delta", "changes",
        (F.col("max_chunks") == F.coalesce(good, F.lit(last))).alias("suggested")
    )


def progress(items: DataFrame, job: str, outcome: str, stop: Column) -> DataFrame:
    """job, total, evaluated, skipped, failed, stopped and state: queued, running, stopped, failed (all of it) or done."""
    count = lambda name: F.count_if(F.col(outcome) == name).alias(name)
    c = items.groupBy(job).agg(F.count("*").alias("total"), count("evaluated"), count("skipped"), count("failed"), F.some(stop).alias("stopped"))
    over = F.col("evaluated") + F.col("skipped") + F.col("failed")
    state = F.when(over == 0, "queued").when(
        over < F.col("total"), F.when(F.col("stopped"), "stopped").otherwise("running")
    ).when(F.col("failed") == F.col("total"), "failed").otherwise("done")
    return c.withColumn("state", state)


def calibration(rows: DataFrame, score: str, positive: Column, current: float, high: float = 0.01, medium: float = 0.05) -> DataFrame:
    """One row: human and ai counts, auc, suggested high and medium thresholds by the share of humans that they may flag (medium is at most
    high), and the shares flagged at the current threshold."""
    keyed = rows.select(F.lit(0).alias("k"), F.col(score).alias("c"), positive.alias("p"))
    at = lambda p: F.round(F.avg(F.when(p, (F.col("c") >= current).cast("double"))), 6)
    counts = keyed.groupBy("k").agg(
        F.count_if(~F.col("p")).alias("human"), F.count_if(F.col("p")).alias("ai"), at(~F.col("p")).alias("human_flagged"),
        at(F.col("p")).alias("ai_flagged")
    )
    scored = auc(keyed, "c", F.col("p"), "k").select("k", F.round("auc", 6).alias("auc"))
    lines = [
        lowest_threshold(keyed, "c", ~F.col("p"), share, "k").withColumnRenamed("threshold", name) for name,
        share in (("high", high), ("medium", medium))
    ]
    for part in (scored, *lines):
        counts = counts.join(part, "k", "left")
    return counts.select("human", "ai", "auc", "high", F.least("medium", "high").alias("medium"), "human_flagged", "ai_flagged")
