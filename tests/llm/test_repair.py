"""Conversation repair against every sequence of edits, and the query's other columns against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleanery.llm import repair

MESSAGE = "conv_id long, turn long, role string, text string"


def faulty(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_repair(rows, most=2):
    """(cost, audit, repaired) of the cheapest, among all edits of the rows with up to `most` inserts before each and at the end."""
    best, marks = None, faulty(rows)
    for edits in itertools.product("KRD", repeat=len(rows)):
        for inserts in itertools.product(range(most + 1), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(inserts, [*edits, ""], strict=True))
            cost, out, at = 0, [], 0
            for c in audit:
                if c == "I":
                    cost, out = cost + 2, [*out, (None, "")]
                    continue
                (role, text), fault = rows[at], marks[at]
                at += 1
                if c == "D":
                    cost += 3
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += (fault == "truncated") + (2 if c == "R" else 0)
                out = [*out, (None if c == "R" else role, text)]
            else:
                first = int(bool(out) and out[0][0] is not None and out[0][0][:1] == "s")
                filled = [(("user", "assistant")[(k - first) % 2] if r is None else r, t) for k, (r, t) in enumerate(out)]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in filled)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, filled)
    return best


def plain(rows):
    """The query's row of one conversation: (turn, role, text) with nulls, before damage."""
    left = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text, role = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text, "user" if d == 4 else role
        left += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    said = [r[1:] for r in left]
    marks, turns = faulty(said), {t for t, _, _ in left if t is not None}
    cost, audit, out = every_repair(said)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{k: marks.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(), "n_repaired": len(out),
    }


@pytest.fixture(scope="module")
def damaged_table(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [
        (conv, rng.choice([None, 0, 1, 2, 3, 7]) if conv % 3 == 0 else t, rng.choice(["user", "assistant", "system", "tool", "", None, "s"]),
         rng.choice(["Yes.", "No", "", " \n", None, "What?", "é!", "a\nb. "]))
        for conv in range(160) for t in range(rng.randint(1, 4))
    ]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", None), (1_000, None, "system", "Only."), (1_001, 3, "user", "x" * 70_000)]
    folder = str(tmp_path_factory.mktemp("repair"))
    spark.createDataFrame(rows, MESSAGE).withColumn("audit", F.lit("clash")).withColumn("r", F.lit(1)).write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def test_query_equals_every_edit(spark, damaged_table):
    folder, rows = damaged_table
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    got = {r["conv_id"]: r.asDict() for r in repair.op12_turn_repair(spark, folder).collect()}
    assert set(got) == set(by)
    for conv, own in by.items():
        assert {k: got[conv][k] for k in plain(own)} == plain(own), own


def test_sql_on_edges(spark, damaged_table):
    import duckdb

    folder, _ = damaged_table
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    want = con.execute(repair.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = repair.op12_turn_repair(spark, folder).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_general_interface(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "So it"), (2, 0, "user", "Why?"), (2, 1, "assistant", "So.")]
    got = {r["conv_id"]: r for r in repair.repaired(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (5, "KIKD") and (got[2]["cost"], got[2]["audit"]) == (0, "KK")
    assert [tuple(x) for x in got[1]["repaired"]] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")]
    assert repair.repaired(spark.createDataFrame([], MESSAGE)).count() == 0


def test_no_python_on_executors(spark, sf):
    plan = repair.op12_turn_repair(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3_000)]
    got = repair.repaired(spark.createDataFrame(rows, MESSAGE)).first()
    assert got["audit"] == "K" * 3_000 and got["cost"] == 0
