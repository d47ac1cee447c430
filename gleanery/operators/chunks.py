"""Submissions as weighted chunk vectors: best-match similarity, document vectors, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vectors as V
from ..sources.shared import partitioned, written


def best_match(chunks: DataFrame, pairs: DataFrame, owner: str, vector: str, weight: str) -> DataFrame:
    """(a, b, score): each chunk's best cosine with the other side's chunks, weighted, both ways, averaged, within 0 and 1.

    A side's chunks ride along in one array per submission (a submission is class-work sized), so a pair is one row and no chunk pair
    becomes a row; the double loop runs inside the expression.
    """
    packed = chunks.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(F.col(weight).alias("w"), V.unit(F.col(vector)).alias("v")))).alias("c"))
    joined = pairs.join(
        packed.select(F.col(owner).alias("a"), F.col("c").alias("ca")), "a"
    ).join(packed.select(F.col(owner).alias("b"), F.col("c").alias("cb")), "b")

    def one_way(x: Column, y: Column) -> Column:
        best = F.transform(x, lambda p: F.struct(p["w"].alias("w"), F.array_max(F.transform(y, lambda q: V.dot(p["v"], q["v"]))).alias("s")))
        weighted = F.aggregate(best, F.lit(0.0), lambda s, z: s + z["w"] * z["s"])
        return weighted / F.aggregate(x, F.lit(0.0), lambda s, z: s + z["w"])

    both = (one_way(F.col("ca"), F.col("cb")) + one_way(F.col("cb"), F.col("ca"))) / 2
    return joined.select("a", "b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), both)).alias("score"))


#: Submissions of a block, and cosines that a task holds at once.
BLOCK, CLOSE = 256, 1 << 21
#: Scores are counted in this many steps; submissions of a class are gathered around so many of their own. The most tasks that pairs of
#: blocks are dealt to.
STEPS, PIVOTS, TASKS = 10_000, 16, 4096


def packed(chunks: DataFrame, owner: str, klass: str, vector: str, weight: str) -> DataFrame:
    """(class, id, v, w): each submission's unit vectors and weights. Vectors that aren't valid directions are left out."""
    unit = chunks.select(
        F.col(klass).cast("long").alias("class"), F.col(owner).alias("id"),
        F.struct(V.unit(F.col(vector)).alias("v"), F.col(weight).cast("double").alias("w")).alias("c")
    ).where("c.v IS NOT NULL")
    return unit.groupBy("class", "id").agg(F.collect_list("c").alias("c")).select("class", "id", F.col("c.v").alias("v"), F.col("c.w").alias("w"))


def _side(part) -> tuple:  # noqa: ANN001
    """Vectors, weights, where each submission's begin, and the submissions, from (id, v, w)."""
    import numpy as np

    v, w = (part[c].combine_chunks() for c in "vw")
    weights = w.flatten().to_numpy(zero_copy_only=False)
    x = v.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(weights), -1)
    return x, weights, np.cumsum([0, *np.diff(w.offsets.to_numpy())])[:-1], part["id"].to_numpy()


def _scored(lo_side: tuple, hi_side: tuple, same: bool):  # noqa: ANN202
    """(a, b, score) of the pairs a < b of two blocks, once each, as products of matrices of at most about CLOSE cosines."""
    import numpy as np

    def one_way(s: np.ndarray, w: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        best = np.maximum.reduceat(s, other, axis=1)
        return np.add.reduceat(best * w[:, None], at, axis=0) / np.add.reduceat(w, at)[:, None]

    (x, wx, at_x, a), (y, wy, at_y, b) = lo_side, hi_side
    upto, start = np.append(at_x, len(wx)), 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + CLOSE // len(wy), "right")) - 1)
        mine, at = slice(upto[start], upto[stop]), at_x[start:stop] - upto[start]
        close = x[mine] @ y.T
        both = np.clip((one_way(close, wx[mine], at, at_y) + one_way(close.T, wy, at_y, at).T) / 2, 0, 1)
        own = a[start:stop]
        i, j = np.nonzero(own[:, None] < b[None, :] if same else own[:, None] != b[None, :])
        yield np.minimum(own[i], b[j]), np.maximum(own[i], b[j]), both[i, j]
        start = stop


def _blocked(rows: DataFrame, emit: Callable, schema: str, block: int, bars: DataFrame | None = None, near: bool = False) -> DataFrame:
    """emit(class, bar, a, b, scores): columns of the pairs of each class, some pairs at a time. rows: of ``packed``; bars: (class, bar).

    A class of at most ``block`` submissions is one group. Larger ones are dealt into blocks of about that, stored once in the shared folder,
    and a task reads the two blocks of each of its pairs: no vector is shuffled or stored more than once however many blocks a class has.
    near gathers near submissions into blocks, and leaves out pairs of blocks that can't hold a score at the bar.
    """
    import pyarrow as pa

    names, kinds = zip(*((f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.float64()) for f in StructType.fromDDL(schema)), strict=True)

    def made(klass: int, bar: float | None, lo_side: tuple, hi_side: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        for a, b, score in _scored(lo_side, hi_side, same):
            columns = emit(klass, bar, a, b, score)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=list(names))

    def alone(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = _side(group)
        return pa.Table.from_batches(made(group["class"][0].as_py(), group["bar"][0].as_py(), side, side, True))

    rows = written(rows, "packed")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("w")) / (8 * block))).cast("int").alias("blocks")
    sizes = rows.groupBy("class").agg(parts)
    known = F.lit(None).cast("double").alias("bar")
    sizes = written(sizes.select("*", known) if bars is None else sizes.join(bars.select("class", "bar"), "class", "left" if not near else "inner"), "sizes")
    few, large = sizes.where("blocks <= 1").select("class", "bar"), sizes.where("blocks > 1")
    small = rows.join(few, "class").select("class", "bar", "id", "v", "w").groupBy("class").applyInArrow(alone, schema)
    if not large.limit(1).count():
        return small
    if near:
        dealt = written(gathered(rows.join(large.select("class"), "class", "left_semi"), block), "gathered")
        met = block_pairs(dealt, large.select("class", "bar"))
    else:
        dealt = rows.join(large, "class").select("class", "id", "v", "w", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long").alias("mine"))
        full = written(dealt.select("class", "mine").distinct(), "full-blocks")
        met = full.select("class", F.col("mine").alias("lo")).join(full.select("class", F.col("mine").alias("hi")), "class").where("lo <= hi")
    met = written(met.join(large.select("class", "bar"), "class"), "block-pairs")
    key = lambda at: F.xxhash64("class", at)
    # some pairs a task, since a task's own cost is that of several small ones
    tasks = met.count()
    tasks = max(1, min(tasks, TASKS, max(4 * rows.sparkSession.sparkContext.defaultParallelism, tasks // 32)))
    dealt = dealt.select("class", "id", "v", "w", "mine", key("mine").alias("block"))
    folder = partitioned(dealt.repartition(tasks, "block"), "vector-blocks", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)

        def side(klass: int, at: int, block: int) -> tuple:
            held = pq.read_table(f"{path}/block={block}", filesystem=store, partitioning=None, use_threads=False)
            return _side(held.filter(pc.and_(pc.equal(held["class"], klass), pc.equal(held["mine"], at))))

        last = (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                if last[0] != (r["class"], r["lo"]):
                    last = ((r["class"], r["lo"]), side(r["class"], r["lo"], r["key_lo"]))
                same = r["lo"] == r["hi"]
                yield from made(r["class"], r["bar"], last[1], last[1] if same else side(r["class"], r["hi"], r["key_hi"]), same)

    pairs = met.select("class", "bar", "lo", "hi", key("lo").alias("key_lo"), key("hi").alias("key_hi"))
    dealt_out = pairs.repartition(tasks).sortWithinPartitions("class", "lo")
    return small.unionByName(dealt_out.mapInArrow(run, schema))


def class_scores(
    chunks: DataFrame, owner: str, klass: str, vector: str, weight: str, block: int = BLOCK, bars: DataFrame | None = None
) -> DataFrame:
    """(class, a, b, score) of all pairs a < b of a class, as ``best_match`` scores them, from pairs of blocks of bounded size; with bars
    (class, bar) also its class's bar, so that the pairs needn't be joined with it."""

    told = bars is not None

    def emit(klass, bar, a, b, score):  # noqa: ANN001, ANN202
        return [[klass] * len(a), a, b, score] + ([[bar] * len(a)] if told else [])

    return _blocked(
        packed(chunks, owner, klass, vector, weight), emit, "class long, a long, b long, score double" + (", bar double" if told else ""), block, bars
    )


def score_counts(chunks: DataFrame, owner: str, klass: str, vector: str, weight: str, block: int = BLOCK) -> DataFrame:
    """(class, v, w): how many pairs of a class have each score, rounded to a STEPSth: counted inside each pair of blocks, so that no pair
    leaves it and a class is at most STEPS + 1 rows."""
    import numpy as np

    def emit(klass, bar, a, b, score):  # noqa: ANN001, ANN202
        step, count = np.unique(np.floor(score * STEPS + 0.5).astype(np.int64), return_counts=True)
        return [[klass] * len(step), step, count]

    counted = _blocked(packed(chunks, owner, klass, vector, weight), emit, "class long, step long, w long", block)
    return counted.groupBy("class", (F.col("step") / F.lit(float(STEPS))).alias("v")).agg(F.sum("w").alias("w"))


def gathered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows of ``packed`` with mine, a block of about ``block`` submissions that are near to one of PIVOTS of their class, and mean, the
    submission's mean vector."""
    dims = F.size(F.get("v", F.lit(0)))
    mean = F.transform(F.sequence(F.lit(0), dims - 1), lambda k: F.aggregate("v", F.lit(0.0), lambda s, x: s + F.get(x, k)) / F.size("v"))
    centred = rows.withColumn("mean", mean)
    order = F.xxhash64("id")
    # the least of a class by hash: Spark cuts each task's rows to so many before it shuffles them
    nth = F.row_number().over(Window.partitionBy("class").orderBy(order, "id"))
    first = centred.select("class", "mean", nth.alias("nth")).where(F.col("nth") <= PIVOTS)
    pivots = first.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("nth", "mean"))).alias("p"))
    near = F.transform(F.col("p.mean"), lambda m: V.dot(F.col("mean"), m))
    celled = centred.join(pivots, "class").withColumn("near", near)
    celled = celled.select("class", "id", "v", "w", "mean", F.array_position("near", F.array_max("near")).cast("long").alias("cell"))
    sizes = celled.groupBy("class", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    return celled.join(sizes, ["class", "cell"]).select("class", "id", "v", "w", "mean", (F.col("cell") * (1 << 40) + part).alias("mine"))


def block_pairs(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """(class, lo, hi) of the pairs of blocks that may hold a score at their class's bar (class, bar). rows: of ``gathered``.

    All vectors of a block lie within its radius, an angle, of its centre. So no cosine of two blocks' vectors, and no mean of best ones,
    is over the cosine of the angle between their centres less both radii.
    """
    dims = rows.select("class", "mine", F.posexplode("mean").alias("dim", "x"))
    mean = dims.groupBy("class", "mine", "dim").agg(F.avg("x").alias("x"))
    centres = mean.groupBy("class", "mine").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("c")).select("class", "mine", V.unit(F.col("c.x")).alias("centre"))
    angle = lambda x, y: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(x, y))))
    far = F.array_max(F.transform("v", lambda x: angle(x, F.col("centre"))))
    # a block whose vectors cancel out has no direction: it may be near to anything
    away = rows.join(centres, ["class", "mine"]).select("class", "mine", "centre", far.alias("far"))
    known = away.groupBy("class", "mine").agg(F.first("centre").alias("centre"), F.coalesce(F.max("far"), F.lit(4.0)).alias("radius"))
    x, y = (known.select("class", *(F.col(c).alias(f"{c}_{side}") for c in ("mine", "centre", "radius"))) for side in "xy")
    between = F.coalesce(angle(F.col("centre_x"), F.col("centre_y")), F.lit(0.0)) - F.col("radius_x") - F.col("radius_y")
    bound = F.when(F.col("mine_x") == F.col("mine_y"), 1.0).otherwise(F.cos(F.greatest(F.lit(0.0), between)))
    met = x.join(y, "class").where("mine_x <= mine_y").join(bars.select("class", "bar"), "class")
    return met.where(bound >= F.col("bar") - 1e-4).select("class", F.col("mine_x").alias("lo"), F.col("mine_y").alias("hi"))


def scores_over(chunks: DataFrame, bars: DataFrame, owner: str, klass: str, vector: str, weight: str, block: int = BLOCK) -> DataFrame:
    """(class, a, b, score) of the pairs of ``class_scores`` whose score, rounded to a STEPSth, is at their class's bar or over it. Pairs of
    blocks that can't hold one are never read."""
    import numpy as np

    def emit(klass, bar, a, b, score):  # noqa: ANN001, ANN202
        score = np.floor(score * STEPS + 0.5) / STEPS
        over = score >= bar
        return [[klass] * int(over.sum()), a[over], b[over], score[over]]

    return _blocked(packed(chunks, owner, klass, vector, weight), emit, "class long, a long, b long, score double", block, bars, near=True)


def document_vector(chunks: DataFrame, owner: str, vector: str, weight: str) -> DataFrame:
    """(owner, dim, mean): the weighted mean of each dimension, folded map-side."""
    dims = chunks.select(owner, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("dim", "x"))
    return dims.groupBy(owner, "dim").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("mean"))


def hashed_words(docs: DataFrame, id_col: str, text: str, dims: int = 256, unit: bool = True) -> DataFrame:
    """(id, vec): word counts hashed into dims places, of length 1 if unit: the encoder used where no model is there."""
    import numpy as np
    import pandas as pd

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zlib

        for batch in batches:
            vectors = []
            for value in batch["text"]:
                v = np.zeros(dims)
                for w in re.findall(r"\w+", (value or "").lower()):
                    v[zlib.crc32(w.encode()) % dims] += 1
                vectors.append((v / (np.linalg.norm(v) or 1.0)).tolist() if unit else v.astype(np.int32).tolist())
            yield pd.DataFrame({"id": batch["id"], "vec": vectors})

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(encode, f"id long, vec array<{'double' if unit else 'int'}>")
