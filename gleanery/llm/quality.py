"""Quality rules: a threshold table compiled into one Spark projection.

Every figure is a DataFrame expression over the row's own text, so the job is one scan with no shuffle and no Python on the
executors. A rule is a row (name, part, whole, least, most): the document passes if ``least <= part / whole <= most``, tested in
whole numbers as ``1000 * part`` against ``least * whole``, so that any engine gives the same verdict.

Defined results: a null or wordless text has zero counts and fails the base rule (fewer than 10 words); very long texts are judged
whole; a figure on a bound passes; repeated rows are judged alike, one result each; an empty table gives an empty result. Other columns
of the input are carried in a struct and clash with nothing, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, read

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this have from or had not but at which they an you "
    "der die das und ist nicht ein eine zu von mit auf für im dem den des es sich auch "
    "le la les et de des un une est dans que qui pour pas sur avec au du en "
    "el los las y del una por con para se su al lo como más"
).split()

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Bounds in thousandths of ``whole``; None leaves that side open. A row of fewer than ``since`` words passes."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None
    since: int = 0


#: The production table. Bounds are loose: they mark text that hardly any prose reaches.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2_000, 16_000),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 400),
    Rule("stop_words", "n_stop_words", "n_words", 20, None, 40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("shouted_lines", "n_shouted_lines", "n_lines", None, 500),
)


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the text.

    Windows are compared by the 64-bit hash of their words' 64-bit hashes. Most texts repeat none; a hash set tells, and only the
    others are sorted. In those, equal neighbours give the starts of repeated windows, and the gaps between starts the union.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def union(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b
            )

        return let(let(placed, starts), union)

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(let(hashes, grams), counted)).cast("long")


def measures(text: Column, words: Column, stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> dict[str, Column]:
    """The figures that rules may name. words: the words of the text, computed once."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(list(stop_words)))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "lines": let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(x, lambda y: (F.upper(y) == y) & y.rlike(r"\p{Lu}.*!"))).cast("long").alias("n_shouted_lines"),
            ),
        ),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean: no rule of the table is broken."""
    passed = F.lit(True)
    for r in rules:
        part, whole = 1000 * F.col(r.part), F.col(r.whole)
        for bound, ok in ((r.least, lambda b: part >= b * whole), (r.most, lambda b: part <= b * whole)):
            if bound is not None:
                passed = passed & (ok(bound) | (F.col("n_words") < r.since))
    return passed


def _judged(docs: DataFrame, rules: tuple[Rule, ...], text: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns in keep as one struct (so that none clashes with a figure), the figures, base_failed and kept."""
    words = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    with_words = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"), words.alias("words"))
    figures = measures(F.col("text"), F.col("words"))
    rows = with_words.select("row", *(c.alias(k) for k, c in figures.items()))
    rows = rows.select("row", *(k for k in figures if k != "lines"), "lines.*")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns in keep, the figures, base_failed and kept."""
    judged = _judged(docs, rules, text, keep)
    return judged.select("row.*", *judged.columns[1:])


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns, whatever their names."""
    return _judged(docs, rules, text, tuple(docs.columns)).where("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def _sql() -> str:
    bounds = [(r, sign, bound) for r in RULES for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None]
    tests = " AND ".join(f"(1000 * {r.part} {sign} {bound} * {r.whole} OR n_words < {r.since})" for r, sign, bound in bounds)
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
          list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    g AS (SELECT r, i, words[i:i+{WINDOW - 1}] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
    d AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
    n AS (SELECT r, count(DISTINCT i + k) AS n FROM d, range(0, {WINDOW}) AS s(k) GROUP BY r),
    f AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
          (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
          len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
          coalesce(n, 0)::BIGINT AS n_repeat_words,
          len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
          len(list_filter(lines, lambda x: upper(x) = x AND regexp_matches(x, '\p{{Lu}}.*!')))::BIGINT AS n_shouted_lines
          FROM w LEFT JOIN n USING (r)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
    SELECT *, NOT base_failed AND {tests} AS kept FROM b
    """


ORACLE_SQL = _sql()
