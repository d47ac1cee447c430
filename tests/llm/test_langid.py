from __future__ import annotations

import math
import zlib

import numpy as np

from gleanery.llm import langid


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], 4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, there = langid.laid_out([rng.integers(97, 100, n).astype(np.uint8) for n in (4, 2, 3)])
    y = np.array([0, 1, 2])
    _, grads = net.gradients(x, there, y)
    for k, w in net.weights.items():
        for _ in range(6):
            at = (int(rng.integers(97, 100)), int(rng.integers(w.shape[1]))) if k in ("fx", "bx") else tuple(rng.integers(n) for n in w.shape)
            was, step = w[at], 1e-2
            w[at] = was + step
            more = net.gradients(x, there, y)[0]
            w[at] = was - step
            less = net.gradients(x, there, y)[0]
            w[at] = was
            assert abs((more - less) / (2 * step) - grads[k][at]) < 1e-3


def test_windows_count_each_byte_once_and_keep_characters():
    text = "aé日\U0001f600 b" * 300
    raw = langid.bytes_of(text)
    for core, margin in ((7, 3), (10, 4), (256, 32), (10_000, 5)):
        cut = langid.windows(raw, core, margin)
        assert cut[0, 1] == 0 and cut[-1, 2] == len(raw) and all(a[2] == b[1] for a, b in zip(cut, cut[1:], strict=False))
        for a, first, last, b in cut.tolist():
            assert a <= first <= last <= b
            bytes(raw[a:b]).decode()
            bytes(raw[first:last]).decode()
            assert (a == 0 or first - a >= margin) and (b == len(raw) or b - last >= margin - 3)
    assert len(langid.windows(langid.bytes_of(""))) == 0


def plain_shares(net, text):
    """Position by position, one number at a time, over the windows of one text."""
    def sigmoid(a):
        return 1 / (1 + math.exp(-a))

    raw, w = text.lower().encode(), {k: v.astype(float) for k, v in net.weights.items()}
    n = len(w["fh"])
    total = np.zeros(len(net.languages))
    for a, first, last, b in langid.windows(langid.bytes_of(text)).tolist():
        seen = {}
        for side, order in (("f", range(a, b)), ("b", range(b - 1, a - 1, -1))):
            h = [0.0] * n
            for t in order:
                given = w[f"{side}x"][raw[t]]
                held = [sum(h[i] * w[f"{side}h"][i, j] for i in range(n)) for j in range(3 * n)]
                new = []
                for i in range(n):
                    z, r = sigmoid(given[i] + held[i]), sigmoid(given[n + i] + held[n + i])
                    new.append((1 - z) * math.tanh(given[2 * n + i] + r * held[2 * n + i]) + z * h[i])
                h = new
                seen[side, t] = h
        for t in range(first, last):
            scores = [
                sum(x * y for x, y in zip(seen["f", t] + seen["b", t], w["out"][:, k], strict=True)) + w["bias"][k] for k in range(len(net.languages))
            ]
            e = [math.exp(x - max(scores)) for x in scores]
            total += np.array(e) / sum(e)
    return total / total.sum()


def test_predictions_are_those_of_the_plain_network():
    net = langid.Network.fresh(["x", "y", "z"], 5, seed=3)
    texts = ["One short text", "é", "1 2 3 Wort", "über die Straße und noch viel weiter " * 20, "abc " * 75]
    for text, sums in zip(texts, langid.Predictor(net).sums(texts), strict=True):
        assert np.allclose(sums / sums.sum(), plain_shares(net, text), atol=1e-5)
    assert abs(langid.Predictor(net).sums(texts).sum() - sum(len(t.lower().encode()) for t in texts)) < 1e-2


def test_a_state_goes_on_over_blanks():
    p = langid.Predictor(langid.Network.fresh(["x", "y"], 5, seed=3))
    assert abs(p.sums(["one two"])[0] - p.sums(["two one"])[0]).max() > 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs)
    rows = langid.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    again = langid.fit(docs)  # the same sample, the same weights
    assert all(np.array_equal(net.weights[k], again.weights[k]) for k in net.weights)


def test_predictions_read_only_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.fit(docs)
    other = docs.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang", "'s' AS source")
    a = {r.text: (r.lang_pred, r.score) for r in langid.predict(docs, net).join(docs, "doc_id").collect()}
    b = {r.text: (r.lang_pred, r.score) for r in langid.predict(other, net).join(other, "doc_id").collect()}
    assert a == b


def test_edges(edges, nothing):
    net = langid.Network.fresh(["en", "fr"])
    rows = langid.predict(edges, net).collect()
    assert len(rows) == edges.count()
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1, 2, 3, 10))
    assert all(by_id[i].lang_pred in ("en", "fr") for i in (4, 5, 7, None))
    assert langid.predict(nothing, net).count() == 0


def test_nothing_to_learn(edges, nothing):
    net = langid.fit(nothing)
    assert net.languages == []
    assert {r.lang_pred for r in langid.predict(edges, net).collect()} == {"und"}


def test_many_labels_and_one_repeated_document(spark, monkeypatch):
    """1,500 labels are all learned; an id that is there a thousand times is one document of the sample."""
    seen = []
    monkeypatch.setattr(langid.Network, "train", lambda self, texts, labels: seen.append((texts, labels)) or self)
    docs = spark.range(6_000).selectExpr("id AS doc_id", "concat('text ', id % 1500) AS text", "concat('l', id % 1500) AS lang")
    net = langid.fit(docs, docs_per_language=2)
    assert len(net.languages) == 1_500 and 1_500 <= len(seen[0][0]) <= 3_000
    rows = langid.predict(docs.where("doc_id < 20"), net).collect()
    assert len(rows) == 20 and all(r.lang_pred in net.languages for r in rows)
    same = spark.range(1_000).selectExpr("4L AS doc_id", "'again and again' AS text", "'x' AS lang")
    other = spark.range(30).selectExpr("id + 100 AS doc_id", "concat('new ', id) AS text", "'x' AS lang")
    langid.fit(same.unionByName(other), docs_per_language=50)
    texts = seen[1][0]
    assert texts.count("again and again") == 1 and len(texts) == len(set(texts)) > 15


def test_states_take_no_tanh_and_large_scores_stay_whole(monkeypatch):
    """tanh is most of a position's time: the gates are made of exponentials. Where scores are large, exp doesn't run over."""
    net = langid.Network.fresh(["x", "y"], 5, seed=3)
    net.weights["out"] *= 300
    net.weights["fx"] *= 200
    text = "Straße und noch viel weiter " * 30
    want = plain_shares_of_large(net, text)
    monkeypatch.setattr(np, "tanh", None)
    sums = langid.Predictor(net).sums([text])[0]
    assert np.isfinite(sums).all() and np.allclose(sums / sums.sum(), want, atol=1e-4)


def plain_shares_of_large(net, text):
    """Shares by the written formula, tanh and all, in 64 bits."""
    raw, w = langid.bytes_of(text), {k: v.astype(np.float64) for k, v in net.weights.items()}
    n, total = len(w["fh"]), 0.0
    for a, first, last, b in langid.windows(raw).tolist():
        states = {}
        for side, order in (("f", range(a, b)), ("b", range(b - 1, a - 1, -1))):
            h = np.zeros(n)
            for t in order:
                x, y = w[f"{side}x"][raw[t]], h @ w[f"{side}h"]
                z, r = ((1 + np.tanh((x + y)[k * n : (k + 1) * n] / 2)) / 2 for k in (0, 1))
                h = (1 - z) * np.tanh(x[2 * n :] + r * y[2 * n :]) + z * h
                states[side, t] = h
        for t in range(first, last):
            s = np.concatenate([states["f", t], states["b", t]]) @ w["out"] + w["bias"]
            total = total + np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    return total / total.sum()
