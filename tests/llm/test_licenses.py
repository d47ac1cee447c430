from __future__ import annotations

import random
import re

import pytest

from gleanery.llm import licenses

from .conftest import SCHEMA, edge_rows, row

MIT = """Copyright (c) 2020 Some One
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software"""


def labels(text):
    words = text.encode().translate(licenses.FOLD).split()
    return sorted({x[0] for x in licenses.outermost(licenses.Scanner().accepted(words))})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, ["mit-text"]),
        (MIT.replace("free of charge", "for free"), []),  # mandatory wording
        (MIT.replace("software and associated", "one two three four five six and associated"), ["mit-text"]),
        (MIT.replace("software and associated", "one two three four five six seven and associated"), []),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("the GNU General Public License as published by the Free Software Foundation, either version 3", ["gpl-3.0"]),
        ("the GNU General Public License as published by the Foundation, either version 3", []),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        ("Licensed under CC BY 4.0.", ["cc-by"]),
        ("Released under the MIT License.", ["mit-notice"]),
        ("Copyright (c) 2020 by A B. All rights reserved.", ["all-rights-reserved"]),
        ("nothing of the kind", []),
        ("please send it to me, cc by friday", []),
        ("the clause bsd of it", []),
        ("creative commons zero day exploit", []),
        ("GNU General Public License version 2, 1 June 1991", ["gpl-2.0"]),
        ("GNU Lesser General Public License version 2.1", ["lgpl"]),
        ("CC0 1.0", ["cc0-1.0"]),
        ("Mozilla Public License 2.0", ["mpl-2.0"]),
        ("Mozilla Public License, version 2.0", ["mpl-2.0"]),
        ("the Mozilla Public License, v. 2.0", ["mpl-2.0"]),
        ("under the GNU GPL v3 or later", ["gpl-3.0"]),
        ("GPLv2", ["gpl-2.0"]),
        ("Creative Commons Zero v1.0 Universal", ["cc0-1.0"]),
    ],
)
def test_templates(text, want):
    assert labels(text) == want


def plain_text(form):
    """A template as a text: without optional regions, a name in each place."""
    while "<<optional>>" in form:
        form = re.sub(r"<<optional>>(?:(?!<<optional>>).)*?<</optional>>", "", form)
    return re.sub(r"<<var:\d+>>", "Thing", form)


MIT_WHOLE = MIT + """, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def expansions(markup, room=1):
    """Every text of a short template, with up to ``room`` words in a replaceable place."""

    def read(parts):
        """([texts of what stands before the region's end], the rest)."""
        texts = [""]
        while parts:
            part, *parts = parts
            if part == "<</optional>>":
                return texts, parts
            if part == "<<optional>>":
                inner, parts = read(parts)
                options = ["", *inner]
            elif m := re.fullmatch(r"<<var:(\d+)>>", part):
                options = [" ".join(["filler"] * k) for k in range(min(room, int(m[1])) + 1)]
            else:
                options = [part]
            texts = [f"{t} {o}".strip() for t in texts for o in options]
        return texts, parts

    return set(read(re.findall(r"<<[^>]*>>|[^<\s]+", markup))[0])


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_every_label_has_texts(label):
    """Each form's texts are accepted from their first word to their last; for names, every expansion is, and none without a word of it."""
    for form in licenses.TEMPLATES[label]:
        whole = re.sub(r"<<var:\d+>>", "filler", re.sub(r"<</?optional>>", " ", form))
        bare = form
        while (less := re.sub(r"<<optional>>(?:(?!<</?optional>>).)*<</optional>>", " ", bare)) != bare:
            bare = less
        texts = {" ".join(whole.split()), " ".join(re.sub(r"<<var:\d+>>", " ", bare).split())}
        texts |= expansions(form) if label in licenses.NAMES else set()
        automaton = licenses.compile_template(form)
        for text in texts:
            words = text.encode().split()
            assert automaton.run(words, 0) == len(words), text
            assert words[0] in automaton.starts()
            assert (label, 0, len(words)) in licenses.Scanner({label: [form]}).accepted(words)
            if len(words) < 12:
                for k in range(len(words)):
                    cut = words[:k] + words[k + 1 :]
                    inside = any(" ".join(x.decode() for x in cut[:n]) in texts for n in range(len(cut) + 1))
                    assert inside == (automaton.run(cut, 0) is not None) or "var" in form, (text, k)


@pytest.mark.parametrize(
    "markup", ["a <<optional>> b", "a <</optional>> b", "a <<optional> b <</optional>>", "a <</optional><<optional>> b", "a <<var:x>> b", "", "<<var:3>>", "<<optional>>a<</optional>>", "a,b"]
)
def test_malformed_markup(markup):
    with pytest.raises(ValueError):
        licenses.compile_template(markup)


def test_whole_wording(spark, tmp_path):
    head, tail = MIT_WHOLE.split(", subject to")
    warranty = tail[tail.index("THE SOFTWARE IS") :]
    cases = {
        MIT_WHOLE: "mit",
        head + ". " + warranty: "mit-0",
        MIT_WHOLE.replace("THE SOFTWARE IS", "The Software shall be used for Good, not Evil. THE SOFTWARE IS"): "json",
        MIT_WHOLE.replace("LIABLE FOR", "GLAD OF"): "mit-text",
    }
    for text, want in cases.items():
        assert labels(text) == [want]
    for name, forms in licenses.WHOLE.items():
        for form in forms:
            words = plain_text(form).split()
            assert labels(" ".join(words)) == [name]
            assert name not in labels(" ".join(words[:-2]))
            for at in range(3, len(words), 11):  # a word more or another word inside: not this license
                if words[at] != "Thing" and "Thing" not in words[at - 1 : at + 2]:
                    assert name not in labels(" ".join([*words[:at], "changed", *words[at + 1 :]]))
    assert labels("Copyright (c) 2015 Acme, BSD 3-Clause License. All rights reserved.") == ["all-rights-reserved", "bsd"]
    spark.createDataFrame([row(i, t) for i, t in enumerate(cases)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.score for r in licenses.op7_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()] == [1, 1, 1, 0.5]


GPL_3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""


def test_notices():
    assert labels(GPL_3) == ["gpl-3.0-notice"]
    assert labels(
        GPL_3.replace("either version 3 of the License, or (at your option) any later version", "version 2 of the License")
    ) == ["gpl-2.0-notice"]
    assert labels(GPL_3.replace("WITHOUT ANY WARRANTY", "WITH A WARRANTY")) == ["gpl-3.0"]


def test_outermost_is_what_no_longer_place_holds():
    rng = random.Random(3)
    for _ in range(200):
        found = list({(rng.choice(["cc-by", "cc-by-nc", "bsd", "mit"]), a, a + rng.randint(1, 6)) for a in (rng.randrange(9) for _ in range(8))})
        kin = lambda x: licenses.FAMILY.get(x[0], x[0])
        want = [x for x in found if not any(kin(x) == kin(y) and y[1] <= x[1] and x[2] <= y[2] and y[1:] != x[1:] for y in found)]
        assert sorted(licenses.outermost(found)) == sorted(want)


def test_folder_of_whole_texts(tmp_path):
    long = " ".join(f"word{i % 991}" for i in range(6000))
    (tmp_path / "Long-1.0.txt").write_text(f"{long}; by <<var:2>>.\nEnd of terms")
    (tmp_path / "empty").write_text("")
    templates = licenses.from_folder(str(tmp_path))
    assert list(templates) == ["long-1.0"]
    scanner = licenses.Scanner(templates)
    words = f"before {long} by some one end of terms after".split()
    assert scanner.accepted([w.encode() for w in words]) == [("long-1.0", 1, 6007)]
    words[3000] = "other"
    assert scanner.accepted([w.encode() for w in words]) == []


def test_automaton():
    a = licenses.compile_template("a <<optional>>b c<</optional>> d <<var:2>> e")
    run = lambda t: a.run(t.encode().split(), 0)
    assert [run(x) for x in ("a d e", "a b c d e", "a d x e", "a d x y e", "a d e x e")] == [3, 5, 4, 5, 5]
    assert [run(x) for x in ("a b d e", "a d x y z e", "a d", "d e", "")] == [None] * 5
    assert licenses.compile_template("<<optional>>x<</optional>> y").starts() == {b"x", b"y"}


def base(text):
    """Plain Python of the base contract."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_columns(spark, edges, nothing, tmp_path):
    texts = [
        "MIT License, mit  license; Apache\nLicense", "general public license general public license", "mitlicense É-license MIT-LICENSE",
        "the apache license mit"
    ]
    rows = edge_rows() + [row(100 + i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = licenses.op7_license_scan(spark, str(tmp_path)).collect()
    want = sorted(((str(r[0]), *base(r[1])) for r in rows), key=str)
    assert sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.license_scan(nothing).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.op7_license_scan(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
