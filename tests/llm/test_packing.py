from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import packing, tokens

from .conftest import edge_rows

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def whole():
    untouched = Tokenizer.from_file(PATH)
    return lambda text: untouched.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(whole):
    rng = random.Random(5)
    parts = [
        "foo", "Bar", ".", ",", "é", "日本", "x1", "_", '"q"', "it's", "a.\nThe", "b,\nc.", "²", "end.\n", "\n", "--", "Ⅷ", "\t", "\x85", "　", "w..",
        "<|endoftext|>", "<|endof", "'s", "\r\n", "\x1c", "\u200b", "e\u0301"
    ]
    encoder = tokens.Encoder(PATH)
    assert encoder.fast is not None
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "", "  "]) for _ in range(rng.randint(0, 14)))
        assert encoder(text).tolist() == whole(text)
    assert encoder(None).tolist() == [] and encoder("").dtype == np.dtype("<u4")
    every = "".join(f"a{chr(c)}b {chr(c)}1 " for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    assert encoder(every).tolist() == whole(every)


def test_added_token_has_its_id(whole):
    for text in ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b  c", "plain words here", "x <|endoftext|>"]:
        assert tokens.encoder(PATH)(text).tolist() == whole(text)
    assert whole("one <|endoftext|> two") == [505, 220, 50256, 734]


@pytest.mark.parametrize("part", [" ", "\n", "a", "^", "1", "ab ", "\u3000", "é", " \t"])
def test_long_runs(whole, part):
    for n in (1500, 1999, 2000, 20_000, 300_000):
        text = "x" + part * (n // len(part)) + "y"
        assert tokens.encoder(PATH)(text).tolist() == whole(text)


def test_other_vocabularies_go_to_the_library():
    path = tokens.vocabulary_path("word_bpe_49k.json")
    encoder = tokens.Encoder(path)
    assert encoder.fast is None
    assert encoder("Two words").tolist() == Tokenizer.from_file(path).encode("Two words", add_special_tokens=False).ids


def test_cut_points():
    assert packing.cut_points(1) == [(0, 1)]
    assert packing.cut_points(1024) == [(0, 1024)]
    assert packing.cut_points(1025) == [(0, 1), (1, 1024)]
    assert packing.cut_points(2048) == [(0, 1024), (1024, 1024)]


def test_plan_places_each_rank_once():
    rng = np.random.default_rng(0)
    for _ in range(60):
        context = int(rng.integers(5, 40))
        histogram = {int(x): int(rng.integers(1, 30)) for x in rng.integers(1, context + 1, size=8)}
        plan, bins = packing.plan(histogram, context), {}
        for length, n in histogram.items():
            mine = [r for r in plan if r[0] == length]
            for rank in range(n):
                (_, first, _, times, bin_, at), = (r for r in mine if r[1] <= rank < r[2])
                nth = rank - first
                bins.setdefault(int(bin_ + nth // times), []).append((int(at + nth % times * length), length))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= context


def test_fullest_is_the_fullest():
    rng = random.Random(2)
    for _ in range(100):
        context = rng.randint(4, 24)
        counts = np.zeros(context + 1, int)
        for _ in range(5):
            counts[rng.randint(1, context)] += 1
        taken = packing.fullest(counts, context)
        longest = int(np.flatnonzero(counts)[-1])
        sums = {0}
        rest = [x for x in range(1, context + 1) for _ in range(counts[x] - (x == longest))]
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(k * v for k, v in taken.items()) == longest + max(s for s in sums if s <= context - longest)
        assert taken[longest] >= 1 and all(v <= counts[k] for k, v in taken.items())


def check(got, rows, whole, context):
    by_row = {}
    for r in got:
        by_row.setdefault((str(r.doc_id)), []).append(r)
    for doc, found in by_row.items():
        copies = [t for i, t in rows if str(i) == doc]
        ids = [*whole(copies[0]), packing.CLOSING]
        want = sorted(
            (k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for _ in copies for k,
            (s, n) in enumerate(packing.cut_points(len(ids), context))
        )
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    assert by_row.keys() == {str(i) for i, _ in rows}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= context
    total = sum(r.length for r in got)
    assert -(-total // context) <= len(bins) <= 1.05 * total / context + 3


def test_pack_edges(edges, nothing, whole):
    rows = [(r[0], r[1]) for r in edge_rows()]
    for context in (1024, 64):
        check(packing.pack(edges.repartition(3), PATH, context).collect(), rows, whole, context)
    assert packing.pack(nothing, PATH).count() == 0


def test_pack_query(spark, sf, whole):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(packing.op3_packing(spark, sf).collect(), rows, whole, 1024)


def test_histogram(spark, sf, edges, nothing, whole):
    for docs in (edges, spark.read.parquet(f"{sf}/documents.parquet")):
        n = np.array([len(whole(r.text)) for r in docs.select("text").collect()])
        rows = tokens.length_histogram(docs, PATH, block=100).collect()
        assert sorted(r.context_limit for r in rows) == sorted(set(n.tolist()))
        for r in rows:
            at = r.context_limit
            assert (r.n_docs, r.n_up_to, r.n_longer, r.tokens_up_to, r.truncated_tokens, r.total_tokens) == (
                (n == at).sum(), (n <= at).sum(), (n > at).sum(), n[n <= at].sum(), np.minimum(n, at).sum(), n.sum()
            )
            assert r.quantile == (n <= at).sum() / len(n)
    assert tokens.length_histogram(nothing, PATH).count() == 0
