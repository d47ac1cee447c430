from __future__ import annotations

import re

import corpus_pipeline
from gleanery.llm import packing, quality, raking, secret_scan, simhash, tokens

from .conftest import PROSE, SCHEMA, edge_rows, row
from .test_quality import figures
from .test_raking import plain_fit
from .test_simhash import classes, plain


def run(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        got.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        out.append(docs.collect())
    return out


def test_stages_on_edges(spark, tmp_path):
    copies = [row(20 + i, PROSE) for i in range(5)] + [row(50, PROSE)]
    other = row(5, "A second text of that id stays too, for it is not a copy of the first and was written by hand in the town.")
    secret = row(40, PROSE + ' and then a token = "18945874088f67dc02ebee7da32856e8cab6c30f" was lost near the old house of the town')
    rows = edge_rows() + copies + [secret, other]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    kept, unique, clean, mixed, packed = run(spark, str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in rows if r[1] and ("cat sat" in r[1] or r is other))
    assert sorted(str(r.doc_id) for r in unique) == ["40", "5", "5", "None"]
    by_id = {r.doc_id: r for r in clean}
    assert "[secret]" in by_id[40].text and by_id[40].n_chars == len(by_id[40].text) and "1894" not in by_id[40].text
    assert {r.text for r in clean if r.doc_id == 5} == {PROSE, other[1]}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert sorted({str(r.doc_id) for r in packed}) == sorted({str(r.doc_id) for r in mixed})


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert all(x == [] for x in run(spark, str(tmp_path)))


def test_run_equals_plain_python(spark, sf):
    """All stages but the draw, done again by comparing everything with everything; a row comes as often as its cell needs it."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    judged = {r.doc_id: r.kept for r in quality.op1_quality_rules(spark, sf).collect()}
    ids = sorted(i for i, r in rows.items() if not figures(r.text)[-1] and judged[i])
    least = classes(ids, [plain(rows[i].text) for i in ids])
    unique = [i for i, c in zip(ids, least, strict=True) if i == c]
    clean = {i: redacted(rows[i].text) for i in unique}
    encode = tokens.encoder(tokens.vocabulary_path())
    size = {i: len(encode(clean[i])) for i in unique}
    sources = tempered([(rows[i].source, size[i]) for i in unique])
    cell = {i: (where(rows[i].source, sources), where(rows[i].lang, raking.LANGUAGES), about(clean[i])) for i in unique}
    spent = {}
    for i in unique:
        spent[cell[i]] = spent.get(cell[i], 0) + size[i]
    fitted = plain_fit(spent, [sources, raking.LANGUAGES, raking.TOPIC_TARGETS])
    need = {k: v / spent[k] for k, v in fitted.items()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= set(unique)
    tokens_of = {}
    for i in unique:
        n = len(encode(clean[i])) + 1
        mine = [(r.piece, r.start, r.length) for r in got if r.doc_id == i]
        times = sum(k == 0 for k, _, _ in mine)
        assert sorted(mine) == sorted((k, s, x) for _ in range(times) for k, (s, x) in enumerate(packing.cut_points(n)))
        assert int(min(need[cell[i]], raking.MOST_TIMES) - 1e-6) <= times <= int(need[cell[i]] + 1e-6) + 1 and times <= raking.MOST_TIMES
        for margin, x in zip(("source", "lang", "topic"), cell[i], strict=True):
            tokens_of[margin, x] = tokens_of.get((margin, x), 0) + times * (n - 1)
    total = sum(v for (margin, _), v in tokens_of.items() if margin == "lang")
    there = {x for m, x in tokens_of if m == "lang"}
    for x in there:  # the rows themselves have the target margins, up to the draw
        assert abs(tokens_of["lang", x] / total - raking.LANGUAGES[x] / sum(raking.LANGUAGES[y] for y in there)) < 0.06
    assert simhash.MAX_BITS == 4


def redacted(text):
    """Overlapping spans together become one mark."""
    out, done = "", 0
    for start, _, end in secret_scan.find_spans(text):
        if start >= done:
            out += text[done:start] + secret_scan.MARK
        done = max(done, end)
    return out + text[done:]


def tempered(counts, power=0.7, least=0.001):
    total, found = sum(n for _, n in counts), {}
    for value, n in counts:
        found[value] = found.get(value, 0) + n
    named = {v: n for v, n in found.items() if v not in (None, raking.REST) and n >= least * total}
    rest = total - sum(named.values())
    return {v: (n / total) ** power for v, n in named.items()} | ({raking.REST: (rest / total) ** power} if rest else {})


def where(value, targets):
    return value if value in targets else raking.REST


def about(text):
    low = text.lower()
    for name, cues in raking.TOPICS:
        if any(c in low for c in cues) and (name != "contact" or re.search("[a-z0-9]@[a-z0-9]", low)):
            return name
    return "prose"
