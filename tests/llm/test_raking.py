from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import raking, tokens


def plain_fit(table, goals, rounds=500):
    """Scaling to each margin in turn, cell by cell."""
    out = {k: float(v) for k, v in table.items() if v}
    total = sum(out.values())
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            now = {}
            for k, v in out.items():
                now[k[axis]] = now.get(k[axis], 0) + v
            there = sum(goal[x] for x in now)
            out = {k: v * goal[k[axis]] / there * total / now[k[axis]] for k, v in out.items()}
    return out


def test_fit_meets_margins():
    rng = np.random.default_rng(1)
    found = rng.integers(1, 100, (3, 4, 2)).astype(float)
    goals = [np.array([1, 2, 1.0]), np.array([1, 1, 1, 3.0]), np.array([0.3, 0.7])]
    fitted, gap = raking.fit(found, goals)
    assert gap < 1e-9
    for axis, g in enumerate(goals):
        got = fitted.sum(tuple(i for i in range(3) if i != axis))
        assert np.allclose(got, g / g.sum() * found.sum(), rtol=1e-6)
    want = plain_fit({k: found[k] for k in np.ndindex(found.shape)}, [dict(enumerate(g)) for g in goals])
    assert all(abs(fitted[k] - v) < 1e-5 * found.sum() for k, v in want.items())


def test_fit_without_data():
    assert raking.fit(np.zeros((2, 2)), [np.ones(2), np.ones(2)])[0].sum() == 0
    found = np.array([[5.0, 5], [0, 0]])  # a target for a slice that has nothing
    assert np.allclose(raking.fit(found, [np.array([1.0, 1]), np.array([1.0, 3])])[0], [[2.5, 7.5], [0, 0]])


def test_fit_tells_of_margins_that_no_weights_meet():
    _, gap = raking.fit(np.array([[5.0, 0], [0, 5]]), [np.array([1.0, 3]), np.array([1.0, 1])])
    assert gap > 0.1


def test_spread_fit_is_the_same(spark, monkeypatch):
    """Cells that stay a table give the weights of cells in one array."""
    rng = np.random.default_rng(7)
    cells = [(f"s{a}", f"l{b}", "t" if c else "*", float(rng.integers(1, 90))) for a in range(4) for b in range(3) for c in range(2) if rng.random() < 0.9]
    targets = [{"s0": 1.0, "s1": 2.0, "s2": 1.0, "s3": 1.0, "none": 5.0}, {"l0": 1.0, "l1": 1.0, "l2": 3.0}, {"t": 0.3, "*": 0.7}]
    table = spark.createDataFrame(cells, "a string, b string, c string, found double")
    factors, gap = raking.fit_spread(table, ["a", "b", "c"], targets)
    want = plain_fit({c[:3]: c[3] for c in cells}, [{**t, **{x: t.get(x, 0.0) for x in ("none",)}} for t in targets])
    assert gap < 1e-6
    for a, b, c, n in cells:
        assert abs(n * factors[0][a] * factors[1][b] * factors[2][c] - want[a, b, c]) < 1e-3
    docs = spark.createDataFrame([(i, "word " * (i % 9), "en" if i % 3 else "de", f"s{i % 5 % 3}") for i in range(500)], "doc_id long, text string, lang string, source string")
    dense = {r.doc_id: r.mix_weight * r.mix_probability for r in raking.calibrated(docs).collect()}
    monkeypatch.setattr(raking, "CELLS", 1)
    spread = {r.doc_id: r.mix_weight * r.mix_probability for r in raking.calibrated(docs).collect()}
    assert dense.keys() == spread.keys() and all(abs(dense[k] - spread[k]) < 1e-4 for k in dense)


def test_one_sparse_cell(spark):
    """A cell of a single document is taken MOST_TIMES at most, and the margins tell what is missed."""
    rows = [(i, "some words here", "en", "big") for i in range(400)] + [(1_000, "some words here", "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"big": 0.5, "tiny": 0.5}}
    got = [r.doc_id for r in raking.sampled(docs, targets).collect()]
    assert got.count(1_000) == raking.MOST_TIMES and len(got) > 150
    told = {r.value: (r.found, r.weighted, r.repeated) for r in raking.margins(docs, targets).collect()}
    assert abs(told["tiny"][1] - 0.5) < 1e-6 and told["tiny"][2] == raking.MOST_TIMES / len(got) and abs(told["tiny"][0] - 1 / 401) < 1e-9


def test_tempered_targets(spark):
    rows = [(i, "a b c d", "en", "hot" if i < 800 else f"s{i % 4}" if i < 999 else "rare" if i < 1_000 else None) for i in range(1_004)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = raking.calibrated(docs, {"source": raking.Tempered(0.5, 0.01)}, tokens=F.lit(4)).collect()
    assert {r.mix_source for r in got} == {"hot", "s0", "s1", "s2", "s3", "*"}
    shares = {"hot": 800 / 1004, "*": 5 / 1004} | {f"s{k}": sum(f"s{k}" == r[3] for r in rows) / 1004 for k in range(4)}
    whole = sum(v**0.5 for v in shares.values())
    for r in got:
        assert abs(r.mix_weight * r.mix_probability - shares[r.mix_source] ** 0.5 / whole / shares[r.mix_source]) < 1e-6


def test_sampled_margins(spark):
    rows = [
        (
            i, "word " * (i % 7 + 1) + ("license" if i % 5 == 0 else ""), ["en", "de", None][i % 3], "hot" if i // 3 % 4 else "cold"
        ) for i in range(6000)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"hot": 0.4, "cold": 0.6}, "lang": {"en": 0.5, "de": 0.3, "*": 0.2}, "topic": {"prose": 0.7, "legal": 0.3}}
    got = [r.asDict() for r in raking.calibrated(docs, targets).collect()]
    assert len(got) == len(rows)
    for name, goal in targets.items():
        weighted = {}
        for r in got:
            if r["mix_kept"]:
                weighted[r[f"mix_{name}"]] = weighted.get(r[f"mix_{name}"], 0) + r["mix_tokens"] * r["mix_weight"]
        total = sum(weighted.values())
        assert all(abs(weighted[k] / total - v) < 0.05 for k, v in goal.items())
    assert all(r["mix_kept"] for r in got if r["mix_probability"] == 1)
    cells = {tuple(r[f"mix_{k}"] for k in targets): (r["mix_weight"], r["mix_probability"]) for r in got}
    spent = {}
    for r in got:
        key = tuple(r[f"mix_{k}"] for k in targets)
        spent[key] = spent.get(key, 0) + r["mix_tokens"]
    want = plain_fit(spent, list(targets.values()))
    assert all(abs(max(w, 1) - cells[k][0]) < 1e-4 and abs(min(w, 1) - cells[k][1]) < 1e-4 for k, v in want.items() for w in [v / spent[k]])
    assert all(r["mix_gap"] < 1e-9 for r in got)
    encode = tokens.encoder(tokens.vocabulary_path())
    texts = {r[0]: r[1] for r in rows}
    assert all(r["mix_tokens"] == len(encode(texts[r["doc_id"]])) for r in got[:200])
    again = {r.doc_id: r.mix_kept for r in raking.calibrated(docs.repartition(7), targets).collect()}
    assert again == {r["doc_id"]: r["mix_kept"] for r in got}  # a lost task draws the same


def test_sampled_rows_meet_margins_unweighted(spark):
    """A hot source with two thirds of the rows, and a topic that needs more than it has."""
    rows = [
        (i, "word " * (i % 7 + 1) + ("license" if i % 11 == 0 else ""), ["en", "de"][i % 2], "hot" if i // 2 % 3 else "cold") for i in range(12000)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"hot": 0.2, "cold": 0.8}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 0.7, "legal": 0.3}}
    got, encode, spent = raking.sampled(docs, targets).collect(), tokens.encoder(tokens.vocabulary_path()), {"source": {}, "lang": {}, "topic": {}}
    for r in got:
        n = len(encode(r.text))
        for name, x in (("source", r.source), ("lang", r.lang), ("topic", "legal" if "license" in r.text else "prose")):
            spent[name][x] = spent[name].get(x, 0) + n
    all_in, all_out = sum(len(encode(r[1])) for r in rows), sum(spent["source"].values())
    assert abs(all_out / all_in - 1) < 0.05
    assert all(abs(spent[name][x] / all_out - share) < 0.02 for name, goal in targets.items() for x, share in goal.items())
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in raking.sampled(docs.repartition(7), targets).collect())


def test_edges(edges, nothing):
    got = raking.calibrated(edges).collect()
    assert len(got) == edges.count()
    need = {(r.doc_id, r.mix_source, r.mix_lang, r.mix_topic): r.mix_weight * r.mix_probability for r in got}
    kept = raking.sampled(edges)
    assert kept.columns == edges.columns
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in edges.collect()]
    times = [(r.doc_id, r.text, r.source, r.lang) for r in kept.collect()]
    assert times and set(times) <= set(rows)
    for r in set(rows):  # each row as often as its cell needs it, and once more or not by the draw
        cell = [n for k, n in need.items() if k[0] == r[0]]
        cell = [min(n, raking.MOST_TIMES) for n in cell]
        assert any(int(n) * rows.count(r) <= times.count(r) <= (int(n) + 1) * rows.count(r) for n in cell)
    assert raking.sampled(nothing).count() == 0 and raking.calibrated(nothing).count() == 0


def test_topics(spark):
    rows = [("Copyright 2020",), ("see https://x.org",), ("a@b.c",), ("plain @ home",), (None,)]
    docs = spark.createDataFrame(rows, "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    got = [r[0] for r in docs.select(raking.topic(F.col("text"))).collect()]
    assert got == ["legal", "technical", "contact", "prose", "prose"]
