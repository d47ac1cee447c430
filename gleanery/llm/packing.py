"""Best-fit packing of token pieces into sequences by minimum bin slack, planned on a length histogram.

Pieces of one length are alike to the packer, so it works on how many pieces there are of each length: at most CONTEXT numbers,
whatever the corpus. Per bin, a bitset subset-sum over the lengths still there finds the fullest combination that holds the longest
of them; that combination is then taken as often as the counts allow, and its pieces are removed. The plan (a few thousand rows, a
bound set by CONTEXT alone) goes to the executors, where each piece finds its place by its rank among those of its length. Ranks come
from counts per input task, never from a sort of all pieces.

Defined results: a null text is empty, and an empty text is the one closing id; ties of equal lengths go by input task and row;
repeated rows are packed each; an empty table gives no sequence. Only the id and the text column are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, in_slices, read, written
from .tokens import encoder, vocabulary_path

CONTEXT, CLOSING = 1024, 2


def cut_points(n: int, context: int = CONTEXT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones with the shorter one in front."""
    if n <= context:
        return [(0, n)]
    head = n % context
    return ([(0, head)] if head else []) + [(at, context) for at in range(head, n, context)]


def pieces(docs: DataFrame, path: str, context: int = CONTEXT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece; run and nth: the task that made it, and how many of this length the task had made before."""
    closing = np.array([CLOSING], "<u4").tobytes()
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [0] * (context + 1)
        run, encode = TaskContext.get().partitionId(), encoder(path)
        for batch in in_slices(batches, 1):
            out: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text).tobytes() + closing
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, context)):
                    out.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), made[length]))
                    made[length] += 1
            at, *rest = np.array(out, np.int64).reshape(-1, 6).T
            columns = [batch.column(0).take(pa.array(at)), *(pa.array(x) for x in rest), pa.array(np.full(len(at), run, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "run"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(bounded).mapInArrow(
        rows, "doc_id long, piece long, start long, length long, ids_crc32 long, nth long, run long"
    )


def fullest(counts: np.ndarray, context: int) -> dict[int, int]:
    """The fullest combination {length: times} of at most ``context`` that holds the longest piece left; of equally full ones that
    with the longest pieces."""
    longest = int(np.flatnonzero(counts)[-1])
    room = context - longest
    items: list[tuple[int, int]] = []  # (length, times), times in powers of two up to what there is and what fits
    for length in np.flatnonzero(counts[: room + 1]).tolist():
        left = min(int(counts[length]) - (length == longest), room // length)
        times = 1
        while left > 0:
            items.append((length, min(times, left)))
            left -= times
            times *= 2
    reach, before, mask = 1, [], (1 << (room + 1)) - 1
    for length, times in items:
        before.append(reach)
        reach |= (reach << (length * times)) & mask
        if reach >> room & 1 and length > room // 2:
            break
    total = reach.bit_length() - 1
    taken = {longest: 1}
    for (length, times), reach in zip(reversed(items[: len(before)]), reversed(before), strict=True):
        size = length * times
        if total >= size and reach >> (total - size) & 1:
            taken[length] = taken.get(length, 0) + times
            total -= size
    return taken


def plan(histogram: dict[int, int], context: int = CONTEXT) -> np.ndarray:
    """Rows (length, first rank, end rank, times in a bin, first bin, offset of its first place in a bin), sorted by the first two."""
    counts = np.zeros(context + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(context + 1, np.int64)
    rows, bins = [], 0
    while counts.any():
        taken = fullest(counts, context)
        often = min(int(counts[length]) // k for length, k in taken.items())
        at = 0
        for length, k in sorted(taken.items(), reverse=True):
            rows.append((length, used[length], used[length] + k * often, k, bins, at))
            used[length] += k * often
            counts[length] -= k * often
            at += length * k
        bins += often
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str, context: int = CONTEXT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row."""
    made = written(pieces(docs, path, context, id_col, text), "pieces")
    by_run = made.groupBy("length", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    by_run = by_run.select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``context`` rows
    places = plan(histogram, context)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = {int(x): slice(*np.searchsorted(places[:, 0], [x, x + 1])) for x in np.unique(places[:, 0])}
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                mine = length == x
                row[mine] = by_length[x].start + np.searchsorted(places[by_length[x], 1], rank[mine], "right") - 1
            _, first, _, times, bin_, at = places[row].T
            nth = rank - first
            columns = [*batch.columns[:5], pa.array(bin_ + nth // times), pa.array(at + nth % times * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(by_run, ["length", "run"]).select(
        "doc_id", F.col("piece"), "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )
    return ranked.transform(bounded).mapInArrow(
        place, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumn("piece", F.col("piece").cast("int"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary_path())
