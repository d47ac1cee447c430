from __future__ import annotations

import random

import numpy as np
import xxhash

from gleanery.llm import simhash
from gleanery.llm.components import connected_components

from .conftest import edge_rows


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps):
    """Smallest id reachable through links of four bits or fewer, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(fps))]


def check(spark, rows, **more):
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    fps = [plain(t) for _, t in rows]
    want = sorted((str(i), f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, classes([i for i, _ in rows], fps), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_near_copies_and_hot_copies(spark):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(200)]
    rows, n = [], 0
    for _ in range(60):  # near copies of one text
        words = base[:]
        words[rng.randrange(200)] = "changed"
        rows.append((n := n + 1, " ".join(words)))
    rows += [(n := n + 1, " ".join(base)) for _ in range(40)]  # exact copies
    rows += [(n := n + 1, " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))) for _ in range(60)]
    rng.shuffle(rows)
    check(spark, rows)
    for cell in (4, 16, 40):  # cells cut again and dealt into chunks give the same
        check(spark, rows, cell=cell)


def test_parts_cover_the_rest_of_the_bits():
    for pair in simhash.BLOCK_PAIRS:
        parts = simhash.rest_parts(pair)
        bits = [x for ranges in parts for at, n in ranges for x in range(at, at + n)]
        agreed = [x for i in pair for x in range(simhash.BLOCKS[i][0], sum(simhash.BLOCKS[i]))]
        assert sorted(bits + agreed) == list(range(64)) and len(parts) == 5
        assert all(8 <= sum(n for _, n in ranges) <= 9 for ranges in parts)


def test_edges(spark, edges, nothing):
    rows = [(r[0], r[1]) for r in edge_rows()]
    check(spark, rows)
    assert simhash.near_duplicates(edges).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_row_of_each_group(spark, edges, nothing):
    """Different texts under one id are different documents; equal rows are one; rows without an id stay."""
    other, third = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [
        (1, other, "a"), (1, third, "b"), (1, third, "c"), (2, other, "d"), (3, other, "e"), (4, None, "f"), (5, "", "g"), (None, other, "h"),
        (0, third, "i")
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = simhash.unique_rows(docs.repartition(4))
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("0", third), ("1", other), ("4", None), ("None", other)], key=str)
    assert simhash.unique_rows(nothing).count() == 0
    assert simhash.unique_rows(edges).columns == edges.columns


def test_forest_spans_what_all_pairs_span():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = np.array(
        [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for c in centre for _ in range(20)], np.uint64
    )
    a, b = simhash.forest(np.zeros(len(fps), np.int64), fps, simhash.pivots())
    assert all(int(fps[i] ^ fps[j]).bit_count() <= 4 for i, j in zip(a, b, strict=True))
    want = classes(list(range(len(fps))), [int(x) for x in fps])
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert find(i) != find(j)  # a forest
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert [find(i) for i in range(len(fps))] == want


def test_pivots_discard_no_link():
    rng = np.random.default_rng(2)
    refs = simhash.pivots()
    x = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    y = x ^ np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in x], np.uint64)
    gap = np.abs(np.bitwise_count(x[:, None] ^ refs).astype(int) - np.bitwise_count(y[:, None] ^ refs))
    assert gap.max() <= 4
    z = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    far = np.abs(np.bitwise_count(x[:, None] ^ refs).astype(int) - np.bitwise_count(z[:, None] ^ refs)).max(1)
    assert (far > 4).mean() > 0.99


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 99), (99, 100)], "v long, u long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {99: 99, 100: 99}
