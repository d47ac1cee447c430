"""License scans: marked-up license templates compiled into token automata.

A template is mandatory wording with ``<<optional>>...<</optional>>`` regions, which may be absent, and ``<<var:N>>`` places, which
take up to N words of any kind (a name, a year, a title). Compiled, it is an automaton over words: one state per mandatory or optional
word, empty moves around optional regions, and counted loops for replaceable ones. A text is accepted from a word on if the automaton
reaches its end, so each mandatory word must be there, exactly and in order; punctuation, case and line breaks don't count.

TEMPLATES holds short licenses and the standard notices of long ones in full, and names of licenses with their versions, which are labels
of their own worth. The whole texts of long licenses (Apache-2.0, the GNU licenses, MPL) aren't in the table: a document that has one is
found by its name, notice or base phrases, with a lower score. ``from_folder`` compiles texts of any length that lie in a folder.

Defined results: a null or empty text has no words and no label; very long texts are scanned whole, a few MB of texts at a time;
first_word and last_word are null without a base place; of accepted places inside a longer one of their family only the longer counts,
and equal ones count each; repeated rows are scanned each; an empty table gives no row. Only the id and the text column are read, so
other columns may have any name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, in_slices, read

#: A-Z become lower case; all but letters, digits and what isn't ASCII becomes a blank. Works on UTF-8 bytes.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording that licenses share.
MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this <<var:6>> and associated documentation files "
    "<<optional>>the <<var:3>><</optional>> to deal in <<var:4>> without restriction including without limitation the rights to use "
    "copy modify merge publish distribute sublicense and or sell copies of"
)
MIT_PERSONS = "the <<var:3>> and to permit persons to whom the <<var:3>> is furnished to do so"
MIT_NOTICE = (
    "subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next "
    "paragraph<</optional>> shall be included in all copies or substantial portions of the <<var:3>>"
)
AS_IS = (
    "the <<var:3>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall <<var:12>> be liable for any claim damages or "
    "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the <<var:3>> or the use "
    "or other dealings in the <<var:3>>"
)
ISC_GRANT = "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted"
ISC_AS_IS = (
    "the software is provided as is and <<var:8>> disclaims all warranties with regard "
    " to this software including all implied warranties of merchantability and fitness in no event shall <<var:8>> be liable for any "
    "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
    "action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
ISC_AS_IS_FORMS = (ISC_AS_IS, ISC_AS_IS.replace("disclaims", "disclaim"))
BSD_CONDITIONS = (
    "redistribution and use <<var:3>> in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met <<var:1>> redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer <<var:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_NAMES = (
    "neither the name of <<var:12>> nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission"
)
BSD_AS_IS = (
    "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties "
    "of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:12>> be liable for any direct indirect "
    "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of "
    "use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort "
    "including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Texts begin where a word stands that isn't in every sentence.
GNU_NOTICE = (
    "free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation "
    "<<var:1>> version {version} of the license <<optional>>or at your option any later version<</optional>> <<var:6>> is distributed in the "
    "hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular "
    "purpose see the gnu {name} for more details <<optional>>you should have received a copy of the gnu {name} along with <<var:6>><<optional>>if "
    "not see <<var:8>><</optional>><<optional>>if not write to the free software foundation inc <<var:14>><</optional>><</optional>>"
)

#: Whole wording of public licenses, by label.
WHOLE = {
    "mit": [f"{MIT_GRANT} {MIT_PERSONS} {MIT_NOTICE} {AS_IS}"],
    "mit-0": [f"{MIT_GRANT} {MIT_PERSONS} {AS_IS}"],
    "json": [f"{MIT_GRANT} {MIT_PERSONS} {MIT_NOTICE} the software shall be used for good not evil {AS_IS}"],
    "isc": [f"{ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {x}" for x in ISC_AS_IS_FORMS],
    "0bsd": [f"{ISC_GRANT} {x}" for x in ISC_AS_IS_FORMS],
    "bsd-2-clause": [f"{BSD_CONDITIONS} {BSD_AS_IS}"],
    "bsd-3-clause": [f"{BSD_CONDITIONS} <<var:1>> {BSD_NAMES} {BSD_AS_IS}"],
    "bsd-4-clause": [
        f"{BSD_CONDITIONS} <<var:1>> all advertising materials mentioning features or use of this software must display the following "
        f"acknowledgement this product includes software developed by <<var:20>> {BSD_NAMES} {BSD_AS_IS}"
    ],
    "unlicense": [
        "free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any "
        "means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        f"software under copyright law {AS_IS}"
    ],
    "zlib": [
        "software is provided as is without any express or implied warranty in no event will <<var:6>> be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions <<var:1>> the origin of this software "
        "must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
        f"{x} in the product documentation would be appreciated but "
        "is not required <<var:1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original "
        "software <<var:1>> this notice may not be removed or altered from any source distribution"
        for x in ("acknowledgment", "acknowledgement")
    ],
    "wtfpl": [
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long "
        "as the name is changed <<optional>>do what the fuck you want to public license<</optional>> terms and conditions for copying "
        "distribution and modification <<var:1>> you just do what the fuck you want to"
    ],
    "apache-2.0-notice": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at <<var:8>> unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for "
        "the specific language governing permissions and limitations under the license"
    ],
    "gpl-2.0-notice": [GNU_NOTICE.format(name="general public license", version="2")],
    "gpl-3.0-notice": [GNU_NOTICE.format(name="general public license", version="3")],
    "lgpl-2.1-notice": [GNU_NOTICE.format(name="lesser general public license", version="2 1")],
    "lgpl-3.0-notice": [GNU_NOTICE.format(name="lesser general public license", version="3")],
    "agpl-3.0-notice": [GNU_NOTICE.format(name="affero general public license", version="3")],
    "mpl-2.0-notice": [
        "source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
        "file you can obtain one at <<var:8>>"
    ],
}
FSF = "<<optional>>as published by the free software foundation either<</optional>>"
GNU_SHORT = ("gpl <<optional>>version<</optional>> {}", "gpl v{}", "gplv{}")
#: Names of licenses with what tells their version, by label: they mention a license and aren't one.
NAMES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "apache license <<optional>>version<</optional>> 2 0"],
    "gpl-2.0": [f"gnu general public license {FSF} version 2", *(x.format(2) for x in GNU_SHORT)],
    "gpl-3.0": [f"gnu general public license {FSF} version 3", *(x.format(3) for x in GNU_SHORT)],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl-3.0": [f"gnu affero general public license {FSF} version 3"],
    "mit-notice": ["<<optional>>released<</optional>><<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> mit license"],
    "bsd": [f"{n} clause bsd license" for n in "234"] + [f"bsd {n} clause license" for n in "234"] + ["bsd license"],
    "mpl-2.0": ["mozilla public license <<optional>>version<</optional>> <<optional>>v<</optional>> 2 0", "mpl <<optional>>version<</optional>> <<optional>>v<</optional>> 2 0"],
    "cc0-1.0": ["cc0 1 0", "creative commons <<optional>>cc0<</optional>><<optional>>zero<</optional>> <<optional>>v1 0<</optional>><<optional>>1 0<</optional>> universal"],
    "cc-by": [f"cc by {v} 0" for v in "234"] + ["creative commons attribution <<optional>>4 0<</optional>> <<optional>>international<</optional>> license"],
    "cc-by-nc": [f"cc by nc {v} 0" for v in "234"] + ["creative commons attribution noncommercial <<optional>>4 0<</optional>> <<optional>>international<</optional>> license"],
    "cc-by-sa": [f"cc by sa {v} 0" for v in "234"] + ["creative commons attribution sharealike <<optional>>4 0<</optional>> <<optional>>international<</optional>> license"],
    "cc-by-nd": [f"cc by nd {v} 0" for v in "234"] + ["creative commons attribution noderivatives <<optional>>4 0<</optional>> <<optional>>international<</optional>> license"],
    "all-rights-reserved": ["copyright <<optional>>c<</optional>> <<var:8>> all rights reserved"],
}
#: Openings that several licenses share: alone they are no accepted license.
OPENINGS = {"mit-text": [MIT_GRANT]}
TEMPLATES = WHOLE | NAMES | OPENINGS
#: Labels of which a longer place hides a shorter one inside it, as a label does its own.
FAMILIES = (
    ("mit-text", "mit", "mit-0", "json"), ("cc-by", "cc-by-nc", "cc-by-sa", "cc-by-nd"), ("apache-2.0", "apache-2.0-notice"),
    ("gpl-2.0", "gpl-2.0-notice"), ("gpl-3.0", "gpl-3.0-notice"), ("lgpl", "lgpl-2.1-notice", "lgpl-3.0-notice"),
    ("agpl-3.0", "agpl-3.0-notice"), ("mpl-2.0", "mpl-2.0-notice"),
)
FAMILY = {label: family[0] for family in FAMILIES for label in family}


def from_folder(folder: str) -> dict[str, list[str]]:
    """Templates of the plain texts in a folder, each of them mandatory wording from its first word to its last; the label is the lower-case
    file name without ``.txt``. Marked-up regions in a text are kept."""
    found = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), "rb") as f:
            parts = re.split(rb"(<</?(?:optional|var:\d+)>>)", f.read())
        words = b" ".join(p if i % 2 else p.translate(FOLD) for i, p in enumerate(parts))
        if words.strip():
            found[name.lower().removesuffix(".txt")] = [words.decode("utf-8", "replace")]
    return found


@dataclass
class Automaton:
    """States 0..size: ``words[s]`` is the word that leads from s to s + 1, None a replaceable place; ``skips[s]`` where s may move
    without a word; ``room[s]`` how many words of any kind may pass while in s."""

    words: list[bytes | None] = field(default_factory=list)
    skips: dict[int, list[int]] = field(default_factory=dict)
    room: dict[int, int] = field(default_factory=dict)

    def closed(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, seen = list(states), set(states)
        while todo:
            s, _ = todo.pop()
            for to in self.skips.get(s, ()):
                new = (to, self.room.get(to, 0))
                if new not in seen:
                    seen.add(new)
                    todo.append(new)
        return seen

    def starts(self) -> set[bytes]:
        return {w for s, _ in self.closed({(0, 0)}) if s < len(self.words) and (w := self.words[s])}

    def run(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted stretch that starts at word ``at``, or None."""
        states, end = self.closed({(0, self.room.get(0, 0))}), None
        while True:
            if any(s == len(self.words) for s, _ in states):
                end = at
            if at >= len(words):
                return end
            moved = set()
            for s, left in states:
                if s == len(self.words):
                    continue
                if self.words[s] is None:
                    if left:
                        moved.add((s, left - 1))
                elif self.words[s] == words[at]:
                    moved.add((s + 1, self.room.get(s + 1, 0)))
            if not moved:
                return end
            states, at = self.closed(moved), at + 1


def compile_template(markup: str) -> Automaton:
    """The automaton of a template. Regions that aren't closed, or closed twice, unknown marks and templates that need no word are errors."""
    out, open_ = Automaton(), []
    for part in re.findall(r"<<(?:/?optional|var:\d+)>>|[^<\s]+|<", markup):
        if part == "<<optional>>":
            open_.append(len(out.words))
        elif part == "<</optional>>":
            if not open_:
                raise ValueError(f"a region is closed that wasn't open: {markup}")
            out.skips.setdefault(open_.pop(), []).append(len(out.words))
        elif m := re.fullmatch(r"<<var:(\d+)>>", part):
            here = len(out.words)
            out.words.append(None)
            out.room[here] = int(m[1])
            out.skips.setdefault(here, []).append(here + 1)
        elif part.encode().translate(FOLD) != part.encode().lower() or not part.strip():
            raise ValueError(f"no word and no mark: {part} in {markup}")
        else:
            out.words.append(part.encode().lower())
    if open_:
        raise ValueError(f"a region isn't closed: {markup}")
    if any(s == len(out.words) for s, _ in out.closed({(0, 0)})):
        raise ValueError(f"no word is mandatory: {markup}")
    return out


class Scanner:
    """All templates by the words that they may start with."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.by_start: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, forms in templates.items():
            for form in forms:
                automaton = compile_template(form)
                for word in automaton.starts():
                    self.by_start.setdefault(word, []).append((label, automaton))

    def accepted(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, end) of all accepted stretches."""
        found = []
        for start in self.by_start.keys() & set(words):
            at = -1
            while True:
                try:
                    at = words.index(start, at + 1)
                except ValueError:
                    break
                for label, automaton in self.by_start[start]:
                    if (end := automaton.run(words, at)) is not None:
                        found.append((label, at, end))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def base_places(words: list[bytes], folded: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    if b"license" not in folded:
        return []
    out = []
    for phrase, label in BASE.items():
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                out.append((at, label))
    return out


def outermost(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without places inside a longer one of their family: a longer license name is not also one of its beginnings. One pass over the
    places from left to right, longer ones first."""
    reach: dict[str, int] = {}  # by family: the furthest end so far
    out = []
    for (start, end), equal in groupby(sorted(found, key=lambda x: (x[1], -x[2], x[0])), key=lambda x: x[1:]):
        here = [(label, FAMILY.get(label, label)) for label, _, _ in equal]
        out += [(label, start, end) for label, kin in here if reach.get(kin, -1) < end]
        for _, kin in here:
            reach[kin] = max(reach.get(kin, -1), end)
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, matches): places of base phrases (word, label), and accepted templates (label, start, end)."""
    places = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    matches = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in in_slices(batches, 1):
            texts = batch.column(1).to_pylist()
            n, base, found = [], [], []
            for value in texts:
                folded = (value or "").encode("utf-8", "surrogatepass").translate(FOLD)
                words = folded.split()
                n.append(len(words))
                base.append([{"word": w, "label": label} for w, label in base_places(words, folded)])
                found.append([{"label": label, "start": a, "end": b} for label, a, b in outermost(scanner.accepted(words))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(base, places), pa.array(found, matches)],
                ["doc_id", "n_words", "places", "matches"]
            )

    schema = "doc_id long, n_words long, places array<struct<word:long,label:string>>, matches array<struct<label:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(bounded).mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 1 for the whole wording of a license or its notice, 3/4 for a name with its version, half for base phrases or a shared
    opening alone, 0 for none of these."""
    base, own = F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["label"])
    where = F.transform("places", lambda p: p["word"])
    return license_scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(where).alias("first_word"),
        F.array_max(where).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.exists(own, lambda x: x.isin(*WHOLE)), 1.0)
        .when(F.exists(own, lambda x: x.isin(*NAMES)), 0.75)
        .when((F.size("matches") > 0) | (F.size("places") > 0), 0.5)
        .otherwise(0.0)
        .alias("score"),
    )


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_license_scan that don't depend on templates."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _sql() -> str:
    def places(phrase: str) -> str:
        words = phrase.split()
        here = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
        return f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {here})"

    found = ", ".join(f"{places(phrase)} AS {label}" for phrase, label in BASE.items())
    label_list = ", ".join(f"CASE WHEN len({x}) > 0 THEN '{x}' END" for x in sorted(BASE.values()))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    p AS (SELECT doc_id, w, {found} FROM d),
    q AS (SELECT *, list_concat(list_concat({", ".join(list(BASE.values())[:2])}), {list(BASE.values())[2]}) AS places FROM p)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
      array_to_string(list_filter([{label_list}], lambda x: x IS NOT NULL), ',') AS base_labels FROM q
    """


PLACES_SQL = _sql()
