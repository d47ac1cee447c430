from __future__ import annotations

import re

import duckdb

from gleanery.llm import quality

from .conftest import edge_rows


def figures(text):
    """Plain Python of the base contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {}
    for g in grams:
        many[g] = many.get(g, 0) + 1
    inside = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), failed


def test_equals_sql(spark, sf):
    got = quality.op1_quality_rules(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(quality.ORACLE_SQL)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_edges(edges):
    got = quality.quality_rules(edges).collect()
    want = sorted((str(r[0]), *figures(r[1])) for r in edge_rows())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_passing_keeps_columns_and_clean_rows(edges, nothing):
    kept = quality.passing(edges)
    assert kept.columns == edges.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "6", "None"]
    assert quality.passing(nothing).count() == 0
    assert quality.quality_rules(nothing).count() == 0


def test_overlapping_repeats(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d e f g h i j k l", "x " * 5, "p q r s t u p q r s t u p q r s t u"]
    rows = quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_repeat_words for r in sorted(rows)] == [figures(t)[4] for t in texts]


def test_no_python_in_plan(edges):
    plan = quality.quality_rules(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan
