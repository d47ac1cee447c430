"""Small sources and scalars without SQL."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import code, python_code
from gleanery.sources import settings, tables


def test_settings(spark):
    spark.conf.set("spark.gleanery.most", "7")
    spark.conf.set("spark.gleanery.share", "much")
    assert settings.setting(spark, "most", 3) == 7
    assert settings.setting(spark, "share", 0.5) == 0.5 and settings.setting(spark, "unset", "x") == "x"


def test_seeded(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps({"users": [{"id": 1, "name": "a"}, {"id": 2, "name": None}], "other": 3}))
    assert sorted(
        map(tuple, settings.seeded(spark, str(tmp_path / "seed.json"), "id: long, name: string", "users").collect())
    ) == [(1, "a"), (2, None)]


def test_class_list_encodings_and_bounds(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name;Email\nJosé €;j@x.org\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("\ufeffName,Email\nJosé €,j@x.org\n".encode())
    (tmp_path / "c.csv").write_text("Name,Email\n" + "".join(f"n{i},e{i}@x.org\n" for i in range(301)))
    for name in "ab":
        assert [(r.full_name, r.email) for r in tables.class_list(spark, str(tmp_path / f"{name}.csv")).collect()] == [("José €", "j@x.org")]
    with pytest.raises(ValueError, match="rows"):
        tables.class_list(spark, str(tmp_path / "c.csv"))


def judged(spark, sources):
    files = spark.createDataFrame([(k, f"{k}.py", s) for k, s in enumerate(sources)], "k long, n string, s string")
    return [r for _, r in sorted((r.k, r) for r in python_code.file_quality(files, "k", "s", "n").collect())]


def test_quality(spark):
    good = '"""A module."""\n\n\ndef area(w, h):\n    """The area."""\n    size = w * h\n    return size\n'
    bad = "class thing_: pass\nclass _X: pass\ndef Bad():\n    x = 1  # TODO later\n    return x\n" + "y = 1  " + "#" * 120 + "\n"
    busy = "def f(x):\n" + "".join(f"    if x == {i}:\n        x += 1\n" for i in range(11)) + "    return x\n"
    paths = "def f(x):\n" + "    return [i for i in x if i] if x and x > 1 or 0 else None\n" + "async def g():\n    def h(y):\n        while y: y -= 1\n"
    idle = 'import os\n"text"\ndef f():\n    return None\nif __name__ == "__main__":\n    f()\n'
    a, b, c, d, e, f, g = judged(spark, [good, bad, busy, paths, idle, "(", None])
    assert (a.quality, a.docstring_coverage, a.functions, a.classes) == (100, 1.0, 1, 0)
    assert (b.names, b.reminders, b.long_lines, b.functions, b.classes, b.quality) == (2, 1, 1, 1, 2, 100 - 10 - 5 - 1 - 15)
    assert c.complex == 1 and d.complex == 0 and d.functions == 3
    assert (e.real_logic, e.quality) == (False, 10) and f.quality is None and f.functions == 0 and (g.quality, g.documentation) == (10, "")
    nodes = python_code.parsed(spark.createDataFrame([(1, paths)], "k long, s string"), "k", "s")
    assert [tuple(x)[:2] for x in nodes.select(python_code.functions(F.col("nodes"))).first()[0]] == [("f", 5), ("g", 2), ("h", 2)]


def test_documentation(spark):
    source = '#!/usr/bin/env python\n"""Counts words."""\n# TODO no\n# says something here\nx = "# not this one"\n'
    assert [r.documentation for r in judged(spark, [source, "("])] == ["Counts words.\nsays something here", ""]


def test_file_quality(spark):
    rows = [(1, "a.py", "x = 1\ny = 2\n"), (2, "b.js", "// TODO\n" + "z" * 130), (3, "c.py", "("), (4, "d.c", None), (5, None, "x")]
    got = {r.k: r.quality for r in python_code.file_quality(spark.createDataFrame(rows, "k long, n string, s string"), "k", "s", "n").collect()}
    assert got == {1: 100, 2: 94, 3: None, 4: 100, 5: 100}


RENAMED = {
    "c": "int add(int a, int b) {{ return a + {0} * 2; /* {0} */ }}", "java": "class T {{ int {0}; void run() {{ this.{0}.go({0}); }} }}",
    "js": "let {0} = 'x'; const f = ({0}) => {0}.length;", "go": "func g({0} int) int {{ return {0} + 1 }}", "rb": "def m({0}); {0}.each {{ |q| q }} end",
    "php": "$ {0} = \"s\"; echo $ {0}; // {0}",
}


def test_renamed_copies_read_the_same(spark):
    rows = [(lang, name, text.format(name)) for lang, text in RENAMED.items() for name in ("count", "n", "_tmp9")]
    df = spark.createDataFrame(rows, "lang string, name string, s string").select("lang", "name", code.numbered_tokens(F.col("s")).alias("t"))
    seen = {}
    for r in df.where("lang <> 'java'").collect():
        seen.setdefault(r.lang, set()).add(tuple(r.t))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == 5
    (java,) = {tuple(r.t) for r in df.where("lang = 'java' AND name = 'n'").collect()}
    assert "n" in java and "v1" in java  # the member keeps its name, the variable doesn't
    assert spark.createDataFrame([(None,)], "s string").select(code.numbered_tokens(F.col("s"))).first()[0] == []


def test_stems(spark):
    words = ["tests", "tested", "testing", "test", "codes", "bus", "sing", "larger", "these"]
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()}
    assert {
        got[w] for w in ("tests", "tested", "testing", "test")
    } == {"test"} and got["bus"] == "bus" and got["sing"] == "sing" and got["codes"] == "code"


def test_markdown(spark):
    text = "# Title\n\n> quoted *bold* and `code`\n\n- one [link](http://a.b)\n1. two ![pic](x.png)\n\n| a | b |\n|---|:-:|\n```py\nx = 1\n```"
    assert spark.createDataFrame([(text,)], "t string").select(T.markdown_text(F.col("t"))).first()[0] == "Title quoted bold and code one link two pic a b x = 1"
