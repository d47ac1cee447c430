"""Pairs where they are made: what blocks count, and what leaves a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleanery.functions.columns import count_share, share
from gleanery.operators import fingerprints as P

SETS = "cohort string, rep long, copies long, n long, hs array<long>"


def made_sets(spark, n=60, seed=1, vocabulary=40, most=9):
    rng = np.random.default_rng(seed)
    rows = [(k % 2, k, 1 + k % 3, rng.choice(vocabulary, rng.integers(1, most), replace=False).tolist()) for k in range(n)]
    return spark.createDataFrame([("xy"[c], k, m, len(h), h) for c, k, m, h in rows], SETS)


def by_hand(sets):
    rows = [(r.cohort, r.rep, r.copies, set(r.hs)) for r in sets.collect()]
    return {(a[1], b[1]): (a, b, len(a[3] & b[3])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] & b[3]}


def test_count_share_is_share(spark):
    counts = spark.range(0, 400).select(F.col("id").alias("w")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("w"))))
    assert counts.where(~count_share(F.col("p"), F.col("w")).eqNullSafe(share(F.col("p"), F.col("w")))).count() == 0


def test_strips_sort_or_count(spark):
    """Few meetings are sorted, many counted in a matrix; fingerprints that one class alone has meet nothing."""
    for vocabulary, most in ((5000, 6), (12, 9)):
        rows = made_sets(spark, 300, 3, vocabulary, most).where("cohort = 'x'")
        sets = rows.toArrow()
        side, lone = P._side(sets), P._side(sets)
        own, _, count, _ = P._meetings(side, side)
        assert len(own) < len(side[0]) or vocabulary == 12
        want = {(a, b) + (n,) for (a, b), (_, _, n) in by_hand(rows).items()}
        for other, same in ((side, True), (lone, False)):
            got = {(i, j, n) for x in P._strips(side, other, same) for i, j, n in zip(side[2]["rep"][x[0]].tolist(), side[2]["rep"][x[1]].tolist(), x[2].tolist(), strict=True)}
            assert {x for x in got if x[0] < x[1]} == want


def test_endpoints_come_together(spark, monkeypatch):
    """Both sides of each pair; inside a task a class's rows of one block follow one another."""
    for classes in (1024, 8):
        monkeypatch.setattr(P, "BLOCK_CLASSES", classes)
        sets = made_sets(spark)
        rows = P.endpoints(sets).withColumn("task", F.spark_partition_id()).collect()
        want = {(x, y, round(n / len(a[3] | b[3]) + 1e-9, 4)) for (a, b, n) in by_hand(sets).values() for x, y in ((a[1], b[1]), (b[1], a[1]))}
        assert {(r.id, r.other, r.jaccard) for r in rows} == want and len(rows) == len(want)
        if classes == 1024:
            assert sum(x.id != y.id for x, y in zip(rows, rows[1:], strict=False)) <= 2 * sets.count()


def test_best_pairs_stop_at_a_line(spark, monkeypatch):
    """The first n of all pairs, whether they are found at a line or among all; where a line has n, no pair below it is made."""
    sets = P.written(made_sets(spark, 80, 5, 60, 12), "sets")
    want = P.flagged(P.pairs(sets)).orderBy(F.desc("flagged"), F.greatest("jaccard", "containment").desc(), "a", "b").collect()
    at_line = sum(r.containment >= 0.5 for r in want)
    assert 0 < at_line < sum(r.flagged for r in want) < len(want)
    for n, lines in ((at_line, (0.9, 0.5)), (at_line + 1, (0.5, 0.4)), (len(want) - 1, (0.8, 0.4)), (len(want) + 5, ())):
        assert sorted(P.best_pairs(sets, n, lines).collect()) == sorted(want[:n])
    monkeypatch.setattr(P, "products", None)
    monkeypatch.setattr(P, "CROWD", 1000)
    assert sorted(P.best_pairs(sets, at_line, (0.5,)).collect()) == sorted(want[:at_line])


def test_links_are_counted_without_pairs(spark, monkeypatch):
    """Links of classes and copies, whatever few or many share, in one group or in blocks; no pair is made."""
    monkeypatch.setattr(P, "_strips", None)
    for vocabulary, most, classes in ((300, 9, 1024), (15, 9, 1024), (15, 9, 8), (60, 20, 8)):
        monkeypatch.setattr(P, "BLOCK_CLASSES", classes)
        sets, want = made_sets(spark, 150, 2, vocabulary, most), {}
        for a, b, _ in by_hand(sets).values():
            for x, y in ((a, b), (b, a)):
                old = want.get(x[:2], (0, 0))
                want[x[:2]] = (old[0] + 1, old[1] + y[2])
        assert {(r.cohort, r.rep): (r.links, r.linked) for r in P.links(sets).collect()} == want


def test_passages_are_chosen_in_the_task(spark):
    """The same as of a table of runs: overlaps on either side, ties, and ids that several rows have."""
    rng = np.random.default_rng(4)
    rows = [(k % 30, 2 + k % 2, int(x), int(y), int(w)) for k, (x, y, w) in enumerate(zip(rng.integers(0, 90, 400), rng.integers(0, 90, 400), rng.integers(10, 30, 400), strict=True))]
    want = {tuple(r) for r in P.passages(spark.createDataFrame(rows, "a long, b long, start_a long, start_b long, n_words long")).collect()}
    a, b, x, y, w = map(np.array, zip(*rows, strict=True))
    kept, *rest = P._chosen(a * 10 + b, x, y, w)
    assert {(p // 10, p % 10, *r) for p, *r in zip(kept.tolist(), *(c.tolist() for c in rest), strict=True)} == want

    words = [f"w{n}" for n in range(160)]
    turned = words[80:] + ["x"] * 9 + words[:80]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(turned)), (3, " ".join(words[:70] + words[40:])), (3, " ".join(turned[50:]))], "doc_id long, text string")
    sets = P.written(P.own_sets(P.numbered(P.fingerprints(docs.withColumn("lang", F.lit("en")), ["lang"]))), "sets")
    runs = P.near_runs(docs, sets, 0.01, 0.01)
    got = P.near_runs(docs, sets, 0.01, 0.01, chosen=True)
    assert got.schema.names == P.passages(runs).schema.names
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.passages(runs).collect())) and got.count() > 2


def test_stream_rows_are_folded_before_state(spark):
    """every line went to every part as a row of its own, and every submission was a row."""
    from gleanery.streaming import timers

    rows = [(k % 2, k % 3, 1_000 * k, *((None, None) if k % 5 else (1_000 * k + 5, 1_000 * k + 9))) for k in range(3_000)] + [(1, 0, None, None, None)]
    df = spark.createDataFrame(rows, "key long, part int, t long, due long, cutoff long").withColumn("ts", F.timestamp_millis("t"))
    folded = timers._packed(df.select("key", "part", "ts", "t", "due", "cutoff").coalesce(1), 3, "long").collect()
    assert len(folded) == 2 * 3 * 2
    for r in folded:
        times = [t for key, part, t, _, cutoff in rows if t is not None and cutoff is None and (key, part) == (r.key, r.part)]
        lines = [[t, due, cutoff] for key, _, t, due, cutoff in rows if cutoff is not None and key == r.key]
        got = np.frombuffer(r.times if r.lines is None else r.lines, np.int64)
        assert (got.tolist() if r.lines is None else got.reshape(-1, 3).tolist()) == (times if r.lines is None else lines)
        assert r.ts.timestamp() * 1000 == (max(times) if r.lines is None else max(t for t, _, _ in lines))


def test_code_matches_shuffle_no_place(spark, monkeypatch):
    """each fingerprint of a pair, and each place of it, was a row that was shuffled and sorted. In one block and in many, the same."""
    from gleanery.plans import checks

    bodies = [f"int v{k} = a + b * {k} ;\n" for k in range(12)] + [f"while ( x < {k} ) y [ {k} ] = z ( {k} ) ;\n" for k in range(12)] + ["if ( p ) { q ( ) ; } else r -- ;\n"]
    rng = np.random.default_rng(6)
    rows = [(k, "c", f"f{n}.c", "".join(rng.choice(bodies, 9))) for k in range(8) for n in range(2)]
    files = spark.createDataFrame(rows, "id long, cohort string, file string, source string")
    prints = P.written(checks.file_prints(files), "prints")
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)] + [(2, 1), (3, 3)], "a long, b long")
    found = checks.code_matches(files, prints, pairs)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, found.collect()))
    sets = {}
    for r in prints.collect():
        sets.setdefault(r.id, {})[r.file] = set(r.fps)
    assert {(i, o) for i, o, *_ in whole} == {(a, b) for a in sets for b in sets if (a != b or a == 3) and set().union(*sets[a].values()) & set().union(*sets[b].values())}
    monkeypatch.setattr(checks, "BLOCK_PLACES", 300)
    monkeypatch.setattr(checks, "PLACES_AT_ONCE", 100)
    assert sorted(map(tuple, checks.code_matches(files, prints, pairs).collect())) == whole
