"""SimHash near-duplicates, linked through pivot distance tables.

Work in four steps, each of them a distributed job:

1. Each text gets a 64-bit fingerprint of its word shingles; the result is written once.
2. Equal fingerprints fold into one (a partial aggregate, so thousands of copies cost nothing).
3. Pairs of fingerprints at MAX_BITS or fewer differing bits. Distances to random references alone cannot deal fingerprints out: a
   coordinate differs by at most MAX_BITS for more than half of all pairs. So fingerprints first go to cells. The bits are cut into six
   blocks; four flipped bits leave two blocks untouched, so each linked pair agrees in one of the 15 pairs of blocks. A cell with over
   CELL fingerprints is cut again: its other bits are cut into five parts, of which a linked pair agrees in one, so cells stay small as
   the corpus grows; what is still too large (a crowd of near copies) is dealt into chunks, each pair of chunks a group of its own.
   Inside a group every fingerprint has its row of Hamming distances to the reference fingerprints PIVOTS, and the group is sorted by
   the first. By the triangle inequality two fingerprints differ in no coordinate by more than in bits, so a row's candidates are those
   that follow it within MAX_BITS of the first distance; a candidate whose greatest coordinate difference exceeds MAX_BITS is discarded,
   and the survivors are compared bit by bit. A group returns a spanning forest of its links, never all its pairs.
4. Components of these links, again as a distributed job; the least doc_id of each is joined back to every row.

Defined results: a null, empty or wordless text has fingerprint zero and is linked like any other; texts of one to three words have
one shingle; very long texts are hashed whole; repeated rows fall into one component and each is returned; an empty table gives an empty
result. Only the two named columns are read, so others may have any name. A null id is left out of the minimum and its row returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, in_slices, read, written
from .components import connected_components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Bit blocks (first bit, bits): with two more blocks than a link has differing bits, two of them are untouched.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints that one group compares at most is about twice this.
CELL = 2048


def pivots(n: int = 24, seed: int = 7) -> np.ndarray:
    """n reference fingerprints, by a fixed random sequence."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # for bytes: A-Z and the six white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None) -> int:
    """The bits that are set in over half of the shingle hashes; 0 for a text with no word."""
    hashes = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, fp): a 64-bit hash of the text, null for a null one, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2):
            texts = batch.column(2).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "digest", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text).alias("digest"), F.col(text).alias("text"))
    return rows.transform(bounded).mapInArrow(run, "doc_id long, digest long, fp long")


def _digest(text: str) -> Column:
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def _bits(fp: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))


def _joined(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    """The bits of several ranges (first bit, bits) side by side."""
    out = F.lit(0).cast("long")
    for at, bits in ranges:
        out = F.shiftleft(out, bits).bitwiseOR(_bits(fp, at, bits))
    return out


BLOCK_PAIRS = list(combinations(range(len(BLOCKS)), MAX_BITS // 2))


def _cells(fp: Column) -> Column:
    """A fingerprint's 15 cell keys: the number of the pair of blocks, and what the two blocks hold."""
    return F.array(*(F.shiftleft(F.lit(k).cast("long"), 22).bitwiseOR(_joined(fp, [BLOCKS[i] for i in pair])) for k, pair in enumerate(BLOCK_PAIRS)))


def rest_parts(pair: tuple[int, ...]) -> list[list[tuple[int, int]]]:
    """The bits outside a pair of blocks in MAX_BITS + 1 parts of about equal size, each as ranges."""
    places = [x for i, (at, bits) in enumerate(BLOCKS) if i not in pair for x in range(at, at + bits)]
    edges = [round(i * len(places) / (MAX_BITS + 1)) for i in range(MAX_BITS + 2)]
    parts = []
    for a, b in zip(edges, edges[1:], strict=False):
        ranges: list[tuple[int, int]] = []
        for x in places[a:b]:
            if ranges and sum(ranges[-1]) == x:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + 1)
            else:
                ranges.append((x, 1))
        parts.append(ranges)
    return parts


def _finer(key: Column, fp: Column) -> Column:
    """The five keys that a fingerprint of a crowded cell has there: the part's number and what it holds."""
    by_pair = [
        F.array(*(F.shiftleft(F.lit(i).cast("long"), 10).bitwiseOR(_joined(fp, r)) for i, r in enumerate(rest_parts(pair)))) for pair in BLOCK_PAIRS
    ]
    return F.get(F.array(*by_pair), F.shiftrightunsigned(key, 22).cast("int"))


def forest(
    group: np.ndarray, fps: np.ndarray, refs: np.ndarray, max_bits: int = MAX_BITS, cross: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is within max_bits inside each group. group: sorted group numbers; fps: unsigned; returns index pairs.

    Rows are sorted by group and first distance. All groups advance together: step s looks at the row s places on, as long as it is in the
    group and its first distance within max_bits; then no row after it can be a candidate. cross: chunk numbers; where given, rows of the
    same chunk aren't compared unless the group has only one chunk (-1).
    """
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, fps, table = group[order], fps[order], table[order]
    cross = None if cross is None else cross[order]
    root = np.arange(n)
    left: list[int] = []
    right: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    live, step = np.arange(n), 0
    while len(live):
        step += 1
        live = live[live + step < n]
        live = live[(group[live] == group[live + step]) & (table[live + step, 0] - table[live, 0] <= max_bits)]
        pair = live
        if cross is not None and len(pair):
            pair = pair[(cross[pair] != cross[pair + step]) | (cross[pair] < 0)]
        pair = pair[root[pair] != root[pair + step]]  # already joined ones need no second link
        for k in range(1, table.shape[1]):
            if not len(pair):
                break
            pair = pair[np.abs(table[pair, k] - table[pair + step, k]) <= max_bits]
        pair = pair[np.bitwise_count(fps[pair] ^ fps[pair + step]) <= max_bits]
        joined = False
        for i in pair.tolist():
            a, b = find(i), find(i + step)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
                joined = True
        while joined and not np.array_equal(up := root[root], root):
            root[:] = up
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def links(nodes: DataFrame, refs: np.ndarray | None = None, cell: int = CELL) -> DataFrame:
    """Links (v, u) between the distinct fingerprints of nodes (fp) whose components are those of all pairs within MAX_BITS."""
    refs = pivots() if refs is None else refs
    keyed = nodes.select(F.explode(_cells(F.col("fp"))).alias("key"), "fp")
    met = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    crowded = met.where(F.col("n") > cell).select("key", F.explode(_finer(F.col("key"), F.col("fp"))).alias("part"), "fp")
    finer = crowded.join(crowded.groupBy("key", "part").agg(F.count("*").alias("n")).where("n > 1"), ["key", "part"])
    placed = met.where(F.col("n") <= cell).select("key", F.lit(-1).cast("long").alias("part"), "fp", "n").unionByName(finer)
    placed = placed.withColumn("chunks", F.ceil(F.col("n") / cell).cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = placed.select("key", "part", "fp", "chunk", other.alias("other"))
    keys = ["key", "part", "lo", "hi"]
    dealt = pairs.select("key", "part", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; a group may span batches, so the last group of a batch waits for the next."""

        def solve(part: np.ndarray) -> pa.RecordBatch:
            new = np.any(part[1:, :4] != part[:-1, :4], axis=1)
            group = np.concatenate(([0], np.cumsum(new)))
            cross = np.where(part[:, 2] == part[:, 3], -1, part[:, 4])
            fps = np.ascontiguousarray(part[:, 5])
            a, b = forest(group, fps.view(np.uint64), refs, cross=cross)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(fps[a], fps[b])), pa.array(np.minimum(fps[a], fps[b]))], ["v", "u"])

        held = np.zeros((0, 6), np.int64)
        for batch in batches:
            part = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)])
            cut = int(np.argmax(np.all(part[:, :4] == part[-1:, :4], axis=1))) if len(part) else 0
            if cut:
                yield solve(part[:cut])
            held = part[cut:]
        if len(held):
            yield solve(held)

    found = dealt.repartition(*keys).sortWithinPartitions(*keys).transform(bounded).mapInArrow(run, "v long, u long")
    return found.distinct()


def _linked(docs: DataFrame, id_col: str, text: str, refs: np.ndarray | None, cell: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprinted rows, and (fp, first): the least (doc_id, digest) of all rows whose fingerprint can be reached from fp."""
    marked = written(fingerprints(docs, id_col, text), "fingerprints")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest")))
    nodes = marked.groupBy("fp").agg(least.alias("first"))
    found = connected_components(links(nodes.select("fp"), refs, cell), "simhash")
    named = nodes.join(found, nodes["fp"] == found["node"]).select("fp", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    # written, as all rows of a root come from one task: from a table they are dealt out evenly again
    linked = written(named.join(least, "root").select("fp", "least"), "simhash-linked")
    # written, so that a join with all rows deals both sides anew and Spark can split a fingerprint that a third of all rows share
    return marked, written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")), "simhash-ids")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", refs: np.ndarray | None = None, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    marked, ids = _linked(docs, id_col, text, refs, cell)
    return marked.join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each group of near copies, with docs' own columns: that with the least id, and of several texts under that
    id the one with the least digest. Rows without an id can't be named and all stay; repeated rows are one."""
    _, ids = _linked(docs, id_col, text, None, CELL)
    first = ids.where("first IS NOT NULL").select("first.doc_id", "first.digest").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), _digest(text).alias("digest"))
    same = F.col("k.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("k.digest").eqNullSafe(F.col("f.digest"))
    kept = keyed.alias("k").join(first.alias("f"), same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return kept.unionByName(keyed.where("doc_id IS NULL")).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
