"""Secret scans: three fixed shapes, and credential values that would take many guesses.

A credential value stands after a name such as ``password`` or ``pwd`` and a colon or equals sign. Its cost is the cheapest way to
cut it into common words, dates, repeats, keyboard walks and brute-force characters, as bits of guesses, found by dynamic programming
over its end positions, in time linear in its length. Values of GUESS_BITS or more become spans of kind ``guess``; placeholders such as
``password=changeme`` don't. Common words are a short list of placeholders, then the whole words of a public vocabulary file, which
stands in the order of their frequency.

Spans are counted in code points, ends exclusive. Defined results: a null or empty text has no span; very long texts and values are
read whole; repeated rows each get their own result; ties at one start go by kind, in the order of KINDS; an empty table gives no row.
``secret_spans`` reads only the id and the text; all columns pass through ``redact`` unchanged but the text, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, in_slices, read
from .tokens import vocabulary_path

KINDS = ("assign", "access", "hex", "guess")
GUESS_BITS = 36.0
#: What stands in a redacted text for each secret.
MARK = "[secret]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A name that may end in one of these words, then the value up to a blank, quote or separator.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|(?:api|access|private|secret)[_-]?key|auth(?:orization)?)["']?[\x20\t]*[:=]+[\x20\t]*["'`]?([^\s"'`,;<>(){}]{4,})""", re.ASCII | re.IGNORECASE)
#: A text without any of these, in lower case, has no match of ASSIGN or CONTEXT.
CUES = ("pass", "pwd", "secret", "token", "credential", "api", "access", "private", "auth")

#: Frequent parts of passwords and placeholders, most frequent first.
PLACEHOLDERS = (
    "password pass admin user root test example changeme secret token key letmein welcome login guest default demo sample my your the "
    "love master monkey dragon football baseball sunshine princess shadow super hello world iloveyou qwerty abc null none true false "
    "redacted placeholder insert here value string"
).split()
LEET = str.maketrans("013457@$", "oleastas")
#: Rows of a keyboard, and the alphabet.
KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
ROWS = (*KEYS, "abcdefghijklmnopqrstuvwxyz")
#: A key touches the one right of it, the one below it, and the one below and to the left; neighbours in any direction make a walk.
LINES = [*ROWS, *(a + b for up, down in zip(KEYS, KEYS[1:], strict=False) for k in range(len(up)) for a, b in zip(up[k] * 2, down[max(0, k - 1) : k + 1], strict=False))]
NEXT = {(a, b) for line in LINES for x in (line, line[::-1]) for a, b in zip(x, x[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
DATE_BITS, YEAR_BITS, WALK_BITS, LEAST = 1 + log2(365 * 130), 1 + log2(130), 1 + log2(47), 3
#: The longest block of which repeats are known.
PERIOD = 16


@lru_cache(4)
def word_ranks(path: str) -> dict[str, int]:
    """Rank of each common word: PLACEHOLDERS, then the words of three letters or more that a byte-level vocabulary has as tokens that
    begin with a blank, in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    listed = (
        t[1:].lower() for t in sorted(vocab, key=vocab.__getitem__) if t[0] == "\u0120" and len(t) > LEAST and t[1:].isalpha() and t[1:].isascii()
    )
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*PLACEHOLDERS, *listed]))}


def _char_bits(c: str) -> float:
    return log2(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of the longest stretches that hold a block of 2 to PERIOD characters twice or more, the block being no repeat
    itself. For each period one pass over what agrees with itself so far on."""
    n, out = len(value), []
    same: dict[int, list[int]] = {}  # by period: how many characters from each on agree with those a period later
    for p in range(1, min(PERIOD, n // 2) + 1):
        upto = same[p] = [0] * (n + 1)
        for i in range(n - p - 1, -1, -1):
            upto[i] = upto[i + 1] + 1 if value[i] == value[i + p] else 0
        if p > 1:
            out += [
                (i, i + p + upto[i], p) for i in range(n - 2 * p + 1)
                if upto[i] >= p and not (i and value[i - 1] == value[i - 1 + p]) and all(p % d or same[d][i] < p - d for d in range(1, p))
            ]
    return sorted(out)


class GuessCost:
    """Bits of guesses of a value: the sum over the cheapest segmentation's parts. A part is a brute-force character, or for one bit more
    a common word (also with capitals or digits for letters, a bit each), a date or year, three or more equal characters (as a whole
    run's character and length), a block of up to PERIOD characters twice or more in a row (as the block and how often the whole stretch
    holds it), or a walk of three or more neighbouring keys (half a bit a key)."""

    def __init__(self, path: str):
        self.ranks = word_ranks(path)
        self.longest = max(map(len, self.ranks))

    def word(self, low: str, plain: str, value: str, i: int, j: int) -> float:
        bits = min((log2(rank + 1) + extra for form, extra in ((low, 0), (plain, 1)) if (rank := self.ranks.get(form[i:j]))), default=float("inf"))
        return 1 + bits + (value[i:j] != low[i:j])

    def __call__(self, value: str, enough: float = float("inf"), blocks: bool = True) -> float:
        """The bits, or some number of ``enough`` or more as soon as it is sure that they are that many. blocks: whether blocks may repeat."""
        n, low = len(value), "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(LEET)
        best = [0.0]
        dates: dict[int, list[tuple[int, float]]] = {}  # by end: (start, bits)
        stretches = repeats(value) if blocks else []
        ahead, known = [(a, b, p, [float("inf")] * p) for a, b, p in reversed(stretches)], {}  # known: bits of a block
        open_: list[tuple[int, int, int, list[float]]] = []  # stretches that have begun, with the cheapest start for each rotation of the block
        runs, run = [0] * n, 0  # where the run that a character belongs to ends
        for i in range(n - 1, -1, -1):
            runs[i] = run = run if i + 1 < n and value[i] == value[i + 1] else i + 1
        in_run = in_walk = float("inf")  # cheapest start of a part that is open, without what it costs by its length
        run_from = walk_from = 0
        for j in range(1, n + 1):
            i = j - 1
            for shape, bits in ((DATE, DATE_BITS), (YEAR, YEAR_BITS)):
                if m := shape.match(value, i):
                    dates.setdefault(m.end(), []).append((i, bits))
            if i and value[i] != value[i - 1]:
                run_from, in_run = i, float("inf")
            if i and (low[i - 1], low[i]) not in NEXT:
                walk_from, in_walk = i, float("inf")
            cost = best[i] + _char_bits(value[i])
            for k in range(max(0, j - self.longest), j - 1):
                cost = min(cost, best[k] + self.word(low, plain, value, k, j))
            for k, bits in dates.pop(j, ()):
                cost = min(cost, best[k] + bits)
            if j - LEAST >= run_from:
                in_run = min(in_run, best[j - LEAST])
                cost = min(cost, in_run + 1 + _char_bits(value[i]) + log2(runs[i] - run_from))
            if j - LEAST >= walk_from:
                in_walk = min(in_walk, best[j - LEAST] - 0.5 * (j - LEAST))
                cost = min(cost, in_walk + WALK_BITS + 0.5 * j)
            while ahead and ahead[-1][0] < j:
                open_.append(ahead.pop())
            open_ = [x for x in open_ if x[1] >= j]
            for a, b, p, starts in open_:
                if (k := j - 2 * p) >= a:
                    if (block := value[k : k + p]) not in known:
                        known[block] = self(block, blocks=False)
                    starts[k % p] = min(starts[k % p], best[k] + known[block])
                    cost = min(cost, starts[k % p] + 1 + log2((b - a) // p))
            best.append(cost)
            later = (min(starts) + 1 + log2((b - a) // p) for a, b, p, starts in open_)
            if min(in_run, in_walk + 0.5 * j, *best[-max(self.longest, 2 * PERIOD) :], *later) >= enough:
                return enough  # all that a later part can start from costs as much
        return best[n]


@lru_cache(4)
def guess_cost(path: str) -> GuessCost:
    """One for each worker process and vocabulary."""
    return GuessCost(path)


def guess_bits(value: str) -> float:
    return guess_cost(vocabulary_path())(value)


def find_spans(text: str | None, least_bits: float = GUESS_BITS, path: str | None = None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted. path: the vocabulary of common words."""
    if not text:
        return []
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(cue in low for cue in CUES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
        bits = guess_cost(path or vocabulary_path())
        spans += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if bits(m[1], least_bits) >= least_bits]
    return sorted(spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_bits: float = GUESS_BITS, path: str | None = None) -> DataFrame:
    """(doc_id, spans): each row's spans as structs (kind, start, end), sorted by start, then kind."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in in_slices(batches, 1):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t, least_bits, path)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(bounded).mapInArrow(run, schema)


def redacted(value: str | None, mark: str = MARK, least_bits: float = GUESS_BITS, path: str | None = None) -> str | None:
    """The text with mark in place of its spans; overlapping ones are replaced together."""
    spans = find_spans(value, least_bits, path)
    if not spans:
        return value
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [value[done:start], mark]
        done = max(done, end)
    return "".join([*out, value[done:]])


def redact(docs: DataFrame, text: str = "text", mark: str = MARK, least_bits: float = GUESS_BITS, path: str | None = None) -> DataFrame:
    """docs with every span of its text replaced by mark; all columns stay."""
    place, path = docs.columns.index(text), path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, place):
            clean = pa.array((redacted(t, mark, least_bits, path) for t in batch.column(place).to_pylist()), batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([clean if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.transform(bounded).mapInArrow(run, docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents"))

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("guess"),
    )


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of (kind, start, end) in order; for tests and callers outside Spark."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8_secret_scan that don't depend on guesses."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def _sql() -> str:
    def either(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" for c in word)

    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])
    assign = rf"(?:{names})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    counted = {"assign": (assign, 1, 6), "access": ("(AKIA[A-Z0-9]+)", 1, 20), "hex": ("([0-9a-f]+)", 1, 24)}
    columns = ", ".join(
        f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{p}', {g}), lambda x: length(x) >= {n}))::BIGINT AS n_{k}" for k,
        (p, g, n) in counted.items()
    )
    return f"SELECT doc_id, {columns} FROM documents"


COUNTS_SQL = _sql()
