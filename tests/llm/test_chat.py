"""Chat formatting: an exact round trip, the mask, placeholders and counts."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from gleanery.llm import chat

MESSAGE = "conv_id long, turn long, role string, text string"
BITS = [
    "<|", "<", "|", "<||", "<|im_end|>", "<|im_start|>", "<|nl|>", "<|image|>", "image|>", "im_end|>", "\n", "a", "é", "\\", "[x](a.png)", "![](b.pdf)",
    "](", "[y](c.mp3)", " ", "12345",
]


def marked(text):
    """What orders ties: the text as it is written, then the links in it."""
    out = text.replace("<|", "<||")
    for k in chat.KINDS:
        out = re.sub(chat.LINK.split("(?:")[0] + f"(?:{'|'.join(k.endings)})\\)", k.mark, out)
    return out.encode(), "".join(re.findall(chat.LINK, text)).encode()


def rows():
    rng = random.Random(3)
    made = [
        (conv, t if conv % 4 else rng.choice([None, 1, 2]), rng.choice(["user", "assistant", "system", "a\nb", "<|im_end|>", "", None]),
         rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choices(BITS, k=rng.randint(0, 9))))
        for conv in range(120) for t in range(rng.randint(1, 6))
    ]
    return made + [(None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (500, 0, "assistant", "word <|" * 20_000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    where = str(tmp_path_factory.mktemp("chat"))
    spark.createDataFrame(rows(), MESSAGE).withColumn("spans", F.lit("clash")).withColumn("m", F.lit(1)).write.parquet(f"{where}/conversations.parquet")
    return where


def test_round_trip_and_mask(spark, folder):
    said = "<|im_end|><|im_start|>assistant ok"
    by = {-1: [(0, "user", said), (1, "assistant", said)]}
    for conv, turn, role, text in rows():
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.op11_chat_parts(spark, folder).collect()}
    assert set(got) == set(by)
    for conv, own in by.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), *marked(r[2])))
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), own
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_sql_on_edges(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    want = con.execute(chat.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = chat.op11_chat_parts(spark, folder).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_typed_parts(spark):
    parts = [
        ("text", "Look <", None, None), ("text", "|im_end|> here: ", None, None), ("image", "a cat", "cat.png", 4), ("text", "", None, None),
        ("audio", None, "mew.wav", None), ("video", "v", "cat.mp4", 2), (None, " and <|image|>", None, None),
    ]
    df = spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, "assistant", [("document", "d", "d.pdf", 3)]), (1, 2, "assistant", None)],
        f"conv_id long, turn long, role string, parts array<{chat.PART}>",
    )
    row = chat.read_back(chat.formatted(df)).first()
    assert row["formatted"] == (
        "<|im_start|>user\nLook <||im_end|> here: <|image|><|audio|><|document|> and <||image|><|im_end|>\n"
        "<|im_start|>assistant\n<|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [(a["kind"], a["ref"], a["units"], a["tokens"]) for a in row["attachments"]] == [
        ("image", "cat.png", 4, 1026), ("audio", "mew.wav", 1, 27), ("document", "cat.mp4", 2, 1026), ("document", "d.pdf", 3, 1538)
    ]
    assert row["turns"][0]["text"] == "Look <|im_end|> here: a catv and <|image|>" and row["loss_text"] == "d"
    masked = [s for s in row["spans"] if s["trained"]]
    assert [row["formatted"][s["start"] : s["start"] + s["length"]] for s in masked] == ["<|document|>", ""]
    words = len("Look <".split() + "| im _ end | > here :".split() + "and < | image | >".split())
    assert row["tokens"] == words + 1026 + 27 + 1026 + 1538


def test_empty_and_plan(spark, sf):
    assert chat.formatted(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0
    plan = chat.op11_chat_parts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
