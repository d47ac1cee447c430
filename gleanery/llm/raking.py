"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Their tokens (ids of the byte-level vocabulary) are counted in the pass that finds
the cell and summed per cell in one partial aggregate. Targets name the values they give a share to, and all others of a margin fall
under ``REST``; or they come from what is found (``Tempered``): each value's share of tokens to a power under 1, which lifts small sources
and holds large ones back. Fitting scales the cells to each margin in turn until all margins hold; ``mix_gap`` tells by which share of all
tokens the worst margin is missed where no weights meet all of them. Up to CELLS cells that the targets span are scaled in one array;
beyond that the cells stay a table, and each step is one aggregate of it with the factors found so far, of which there are as many as the
targets name values. A cell's weight is its fitted tokens over its found ones. Where that is below 1 it is the chance of the cell's
documents to stay; where it is above, all stay and carry the weight on. So kept tokens times their weights have the target margins in
expectation. A document's fate is a hash of its id: a lost task draws the same sample again. ``sampled`` has no weight to carry: there a
row comes as often as its cell needs it, but MOST_TIMES at most, so that a cell of few documents isn't repeated without end; ``margins``
tells what that leaves unmet.

Defined results: a null source or language counts under ``REST``; a null or empty text has no token and its cell's chance; very long
texts count whole; repeated rows share one fate; ties can't arise, as a draw is compared with one chance; targets of values that no
document has are spread over the others in proportion; an empty table gives an empty result. Other columns of the input are carried in
a struct and clash with nothing, whatever their names. Topics are told by cue words, three of them and prose: a fixed list, not learned.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from math import prod
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, in_slices, let, read, written
from .tokens import encoder, vocabulary_path

REST = "*"
CELLS = 100_000

#: Topic by the first rule of which a cue is in the lower-cased text; a text without any is prose. ADDRESS must hold beside an "@".
TOPICS = (
    ("legal", ("license", "licence", "copyright", "warrant")),
    ("technical", ("http://", "https://", "password", "secret", "token =", "token=", "api_key", "apikey")),
    ("contact", ("@",)),
)
ADDRESS = r"[a-z0-9]@[a-z0-9]"

#: How often ``sampled`` takes a row at most.
MOST_TIMES = 8


@dataclass(frozen=True)
class Tempered:
    """Targets from the corpus: a value's share of all tokens to ``power``. Values of less than ``least`` of all tokens fall under REST, so at
    most 1 / least have a target of their own."""

    power: float = 0.7
    least: float = 0.001


Target = Mapping[str, float] | Tempered
#: Production targets, as weights: sources as they are found, drawn together; languages and topics near what a web crawl holds.
SOURCES = Tempered()
LANGUAGES = {"en": 0.58, "de": 0.15, "fr": 0.15, "es": 0.11, REST: 0.01}
TOPIC_TARGETS = {"prose": 0.90, "legal": 0.035, "contact": 0.045, "technical": 0.02}
TARGETS: dict[str, Target] = {"source": SOURCES, "lang": LANGUAGES, "topic": TOPIC_TARGETS}
#: Tokens to draw, as a share of those there are, before cells that would need more than they have are held to what they have.
FRACTION = 1.0
SEED = 9


def topic(text: Column) -> Column:
    def by_cue(low: Column) -> Column:
        out = F.lit("prose")
        for name, cues in reversed(TOPICS):
            found = reduce(or_, (F.contains(low, F.lit(c)) for c in cues))
            out = F.when(found & low.rlike(ADDRESS) if "@" in cues else found, name).otherwise(out)
        return out

    return let(F.lower(text), by_cue)


def fit(found: np.ndarray, targets: list[np.ndarray], rounds: int = 2000, close: float = 1e-9) -> tuple[np.ndarray, float]:
    """Fitted tokens with found's zeros and interactions, and the margins of targets (each summing to found's total); and by which share of
    the total the worst margin is missed. A target of a slice with no tokens is shared out over the other slices."""
    fitted = found.astype(float)
    total = fitted.sum()
    if not total:
        return fitted, 0.0
    goals = []
    for axis, goal in enumerate(targets):
        has = fitted.sum(tuple(i for i in range(fitted.ndim) if i != axis)) > 0
        goal = np.where(has, goal, 0.0)
        goals.append(goal / goal.sum() * total if goal.sum() else np.where(has, total / has.sum(), 0.0))
    def margin(axis: int) -> np.ndarray:
        return fitted.sum(tuple(i for i in range(fitted.ndim) if i != axis))

    worst = 1.0
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            now = margin(axis)
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            fitted = fitted * factor.reshape([-1 if i == axis else 1 for i in range(fitted.ndim)])
        worst = max(float(np.abs(margin(axis) - goal).max()) / total for axis, goal in enumerate(goals))
        if worst < close:
            break
    return fitted, worst


def fit_spread(cells: DataFrame, keys: list[str], targets: list[Mapping[str, float]], rounds: int = 200, close: float = 1e-6) -> tuple[list[dict[str, float]], float]:
    """The same fit over a table of cells (keys, found), as factors by value for each key. A step is one aggregate by one key; what comes
    back is a number for each value of a target."""
    spark = cells.sparkSession
    factors = [dict.fromkeys([*t, REST], 1.0) for t in targets]

    def margin(axis: int) -> dict[str, float]:
        scaled = cells
        for k, f in zip(keys, factors, strict=True):
            scaled = scaled.join(spark.createDataFrame(list(f.items()), f"{k} string, f_{k} double"), k)
        product = reduce(lambda x, k: x * F.col(f"f_{k}"), keys, F.col("found"))
        return {r[0]: r[1] for r in scaled.groupBy(keys[axis]).agg(F.sum(product)).collect() if r[1]}

    goals, worst = [], 1.0
    total = cells.agg(F.sum("found")).first()[0] or 0
    if not total:
        return factors, 0.0
    for axis, t in enumerate(targets):
        there = margin(axis)
        whole = sum(t.get(x, 0.0) for x in there)
        goals.append({x: t.get(x, 0.0) / whole * total if whole else total / len(there) for x in there})
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            now = margin(axis)
            factors[axis] |= {x: factors[axis][x] * goal[x] / now[x] if x in now else 0.0 for x in goal}
        found = [margin(axis) for axis in range(len(goals))]
        worst = max(abs(found[axis].get(x, 0.0) - g) / total for axis, goal in enumerate(goals) for x, g in goal.items())
        if worst < close:
            break
    return factors, worst


def _cells(targets: Mapping[str, Target], text: str) -> list[Column]:
    """mix_source, mix_lang, mix_topic, as far as targets have them."""
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.coalesce(F.col(text), F.lit("")))}
    return [(F.coalesce(values[k], F.lit(REST)) if isinstance(t, Tempered) else _named(values[k], t)).alias(f"mix_{k}") for k, t in targets.items()]


def _named(value: Column, target: Mapping[str, float]) -> Column:
    """The value if the target names it, else REST."""
    return F.when(value.isin([x for x in target if x != REST]), value).otherwise(F.lit(REST))


def _resolved(marked: DataFrame, targets: Mapping[str, Target]) -> tuple[DataFrame, dict[str, Mapping[str, float]]]:
    """marked with its values under named targets alone, and these targets as weights."""
    out: dict[str, Mapping[str, float]] = {}
    for k, t in targets.items():
        if not isinstance(t, Tempered):
            out[k] = t
            continue
        key = f"mix_{k}"
        counts = marked.groupBy(key).agg(F.sum("mix_tokens").alias("n"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        large = counts.where((F.col("n") >= t.least * total) & (F.col(key) != REST) & (F.col("n") > 0))
        named = {r[0]: r[1] for r in large.orderBy(key).collect()}  # at most 1 / least
        rest = total - sum(named.values())
        out[k] = {x: (n / total) ** t.power for x, n in named.items()} | ({REST: (rest / total) ** t.power} if rest else {})
        marked = marked.withColumn(key, _named(F.col(key), out[k]))
    return marked, out


def _counted(rows: DataFrame, path: str) -> DataFrame:
    """rows with mix_tokens in place of their last column, a text."""
    last = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in in_slices(batches, last):
            count = pa.array((len(encode(t)) for t in batch.columns[-1].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], count], [*batch.schema.names[:-1], "mix_tokens"])

    kept = rows.drop(rows.columns[-1])
    return rows.transform(bounded).mapInArrow(run, kept.withColumn("mix_tokens", F.lit(0).cast("long")).schema)


def _drawn(
    docs: DataFrame, targets: Mapping[str, Target], text: str, fraction: float, tokens: Column | None, id_col: str, seed: int, keep: tuple[str, ...],
) -> DataFrame:
    """row (the columns in keep, as one struct), the cell, mix_tokens, mix_weight, mix_probability, mix_draw, mix_kept and mix_gap.
    tokens: a count to use in place of the vocabulary's ids."""
    keys = [f"mix_{k}" for k in targets]
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = docs.select(
        F.struct(*keep).alias("row"), *_cells(targets, text), draw.alias("mix_draw"), (F.col(text) if tokens is None else tokens).alias("mix_tokens")
    )
    marked, known = _resolved(written(rows if tokens is not None else _counted(rows, vocabulary_path()), "cells"), targets)
    weighted, gap = _weighted(marked, keys, list(known.values()), fraction)
    kept = (F.col("mix_draw") < F.col("mix_probability")).alias("mix_kept")
    return weighted.select("row", *keys, "mix_tokens", "mix_weight", "mix_probability", "mix_draw", kept, F.lit(gap).alias("mix_gap"))


def _weighted(marked: DataFrame, keys: list[str], targets: list[Mapping[str, float]], fraction: float) -> tuple[DataFrame, float]:
    """marked with mix_weight and mix_probability, and by which share the worst margin is missed."""
    axes = [list(dict.fromkeys([*t, REST])) for t in targets]
    cells = marked.groupBy(*keys).agg(F.sum("mix_tokens").alias("found"))
    spark = marked.sparkSession
    if prod(map(len, axes)) > CELLS:
        factors, gap = fit_spread(written(cells.where("found > 0"), "mix-cells"), keys, targets)
        for k, f in zip(keys, factors, strict=True):
            marked = marked.join(spark.createDataFrame(list(f.items()), f"{k} string, f_{k} double"), k)
        need = reduce(lambda x, k: x * F.col(f"f_{k}"), keys, F.lit(fraction))
        return marked.withColumns({"mix_weight": F.greatest(F.lit(1.0), need), "mix_probability": F.least(F.lit(1.0), need)}), gap
    found = np.zeros([len(a) for a in axes])
    for *cell, n in cells.collect():  # at most CELLS rows
        found[tuple(a.index(x) for a, x in zip(axes, cell, strict=True))] = n or 0
    fitted, gap = fit(found, [np.array([t.get(x, 0.0) for x in a]) for a, t in zip(axes, targets, strict=True)])
    need = fraction * np.divide(fitted, found, out=np.ones_like(found), where=found > 0)
    rows = [
        (
            *(a[i] for a, i in zip(axes, at, strict=True)), max(1.0, float(need[at])), min(1.0, float(need[at]))
        ) for at in np.ndindex(found.shape) if found[at]
    ]
    table = spark.createDataFrame(rows, ", ".join([f"{k} string" for k in keys] + ["mix_weight double", "mix_probability double"]))
    joined = marked.join(F.broadcast(table), keys, "left").fillna({"mix_weight": max(1.0, fraction), "mix_probability": min(1.0, fraction)})
    return joined, gap


def calibrated(
    docs: DataFrame, targets: Mapping[str, Target] = TARGETS, text: str = "text", fraction: float = FRACTION,
    tokens: Column | None = None, id_col: str = "doc_id", seed: int = SEED, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns in keep with mix_source, mix_lang, mix_topic, mix_tokens, mix_probability, mix_kept, mix_gap and mix_weight, the weight
    that a kept document carries: what its cell needs over the chance to stay.

    Each row's cell is found once and written with the columns to keep; sums and draws read that table.
    """
    drawn = _drawn(docs, targets, text, fraction, tokens, id_col, seed, keep)
    return drawn.drop("mix_draw").select("row.*", *[c for c in drawn.columns[1:] if c != "mix_draw"])


def _times(most: int) -> Column:
    """How often a row is taken: the whole part of its cell's need, and once more by the row's draw on the rest."""
    need = F.least(F.col("mix_weight") * F.col("mix_probability"), F.lit(float(most)))
    return (F.floor(need) + (F.col("mix_draw") < need - F.floor(need)).cast("int")).cast("int")


def sampled(
    docs: DataFrame, targets: Mapping[str, Target] = TARGETS, text: str = "text", fraction: float = FRACTION, id_col: str = "doc_id",
    seed: int = SEED, most: int = MOST_TIMES,
) -> DataFrame:
    """The rows of docs as often as their cell needs them, ``most`` times at most, with docs' own columns, whatever their names. So the rows'
    own tokens meet the margins, without a weight, as far as ``margins`` tells."""
    drawn = _drawn(docs, targets, text, fraction, None, id_col, seed, tuple(docs.columns))
    return drawn.select("row", F.explode(F.array_repeat(F.lit(0), _times(most)))).select("row.*")


def margins(
    docs: DataFrame, targets: Mapping[str, Target] = TARGETS, text: str = "text", fraction: float = FRACTION, id_col: str = "doc_id",
    seed: int = SEED, most: int = MOST_TIMES,
) -> DataFrame:
    """(margin, value, found, weighted, repeated): each value's share of the tokens there are, of those that weights make, and of those in the
    rows of ``sampled``. Where the last two differ, cells of few documents need more than ``most`` times what they have."""
    drawn = _drawn(docs, targets, text, fraction, None, id_col, seed, (id_col,))
    need = F.col("mix_weight") * F.col("mix_probability")
    facts = drawn.select(
        F.explode(F.array(*(F.struct(F.lit(k).alias("margin"), F.col(f"mix_{k}").alias("value")) for k in targets))).alias("m"),
        F.col("mix_tokens").alias("n"), (F.col("mix_tokens") * need).alias("w"), (F.col("mix_tokens") * _times(most)).alias("r"),
    )
    sums = facts.groupBy("m.margin", "m.value").agg(*(F.sum(c).alias(c) for c in "nwr"))
    whole = facts.groupBy("m.margin").agg(*(F.sum(c).alias(f"all_{c}") for c in "nwr"))
    share = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(c) / F.col(f"all_{c}")).otherwise(0.0)
    return sums.join(whole, "margin").select("margin", "value", share("n").alias("found"), share("w").alias("weighted"), share("r").alias("repeated"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = calibrated(read(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 9) for c in ("mix_weight", "mix_probability", "mix_gap")})
