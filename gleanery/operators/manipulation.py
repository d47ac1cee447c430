"""Passages that try to influence an automatic grader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, total

#: A few words on one line, whom such a passage addresses, and what it asks for.
GAP = r"[^.\n]{0,40}?"
WHO = (
    r"(?:ai|a\.i\.|grader|grading (?:model|system|tool)|marker|evaluator|examiner|assessor|model|llm|chatgpt|gpt|"
    r"assistant|language model|automated (?:grader|marker|system)|reviewer)"
)
MARKS = r"(?:full|maximum|max|perfect|top|highest|all(?: the)?|100\s*%|10\s*/\s*10)\s+(?:marks?|points?|scores?|grades?|credit)"
#: What a passage is told to do, and its pattern.
PATTERNS = {
    "tells the grader to ignore its instructions": rf"\b(?:ignore|disregard|forget|override|bypass)\b{GAP}\b(?:previous|prior|above|earlier|all|any|the|your|these|grading|marking)\s+(?:instructions?|rubric|criteria|guidelines|prompts?|rules)\b",
    "asks for full marks": rf"\b(?:give|award|assign|grant)\b{GAP}\b{MARKS}\b",
    "asks for a top score": r"\b(?:score|grade|rate|mark)\s+(?:this|it|me|my\s+\w+)\s+(?:as\s+|with\s+|at\s+)?(?:a\s+)?(?:10\b|100\b|full\b|perfect\b|maximum\b|max\b|the highest\b|top marks)",
    "claims the work deserves full marks": rf"\b(?:this|my)\s+(?:submission|work|code|report|project|assignment|solution)\s+(?:deserves|should (?:get|receive|be given)|must (?:get|receive|be given))\b{GAP}\b(?:full|maximum|max|perfect|top|100|highest)\b",
    "writes a message to the AI grader": rf"\b(?:note|message|instructions?|reminder|request)\s+(?:to|for)\s+(?:the\s+|any\s+|an?\s+)?{WHO}\b",
    "addresses the AI grader directly": rf"\b(?:dear|hey|hello|hi|attention)[,:]?\s+(?:the\s+)?{WHO}\b",
    "tells the model what it is": rf"\byou\s+are\s+(?:now\s+)?(?:an?\s+|the\s+)?(?:helpful\s+|friendly\s+|lenient\s+)?{WHO}\b",
    "names the grader's own tool or fields": r"\b(?:submit_grades|checks_met|checks_partly|system\s+prompt)\b",
}
#: Characters of a snippet.
SNIPPET = 90


def places(text: Column, pattern: str, reason: str) -> Column:
    """Every match as (start, end, reason), from 0: what splits at the matches leaves, and the matches, give where each begins."""
    found = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0))
    rest = F.split(text, f"(?i){pattern}", -1)

    def where(pair: Column) -> Column:
        lengths = F.transform(pair["m"], F.length)
        gaps = F.transform(pair["r"], F.length)
        start = lambda i: total(F.slice(gaps, 1, i + 1), "int") + F.when(i > 0, total(F.slice(lengths, 1, i), "int")).otherwise(0)
        return F.transform(lengths, lambda n, i: F.struct(start(i).alias("start"), (start(i) + n).alias("end"), F.lit(reason).alias("reason")))

    none = F.array().cast("array<struct<start:int,end:int,reason:string>>")
    return F.when(text.rlike(f"(?i){pattern}"), let(F.struct(found.alias("m"), rest.alias("r")), where)).otherwise(none)


def snippet(text: Column, start: Column, end: Column) -> Column:
    """What a reader sees of a match: it and as much on either side as SNIPPET characters leave room for, on one line, with an ellipsis
    wherever something was left out."""
    room = F.floor(F.greatest(F.lit(0), SNIPPET - end + start) / 2).cast("int")
    before, behind = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    shown = F.concat(F.right(before, room), F.substring(text, start + 1, end - start), F.left(behind, room))
    line = F.trim(F.regexp_replace(shown, r"\s+", " "))
    fitted = F.when(F.length(line) <= SNIPPET, line).otherwise(F.concat(F.rtrim(F.left(line, F.lit(SNIPPET - 1))), F.lit("…")))
    left_out = lambda side: F.when(F.length(side) > room, "…").otherwise("")
    return F.concat(left_out(before), fitted, left_out(behind))


def hits(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_places (distinct starts over all patterns), and of the first match (least start, then end, then reason) reason, start and
    snippet; null where nothing matches."""
    found = df.select(
        *keys, F.col(text).alias("__text"), F.array_sort(F.concat(*(places(F.col(text), p, reason) for reason, p in PATTERNS.items()))).alias("p")
    )
    first = F.get("p", F.lit(0))
    return found.select(
        *keys,
        F.coalesce(F.size(F.array_distinct(F.transform("p", lambda x: x["start"]))), F.lit(0)).alias("n_places"),
        first["reason"].alias("reason"),
        first["start"].alias("start"),
        F.when(first.isNotNull(), snippet(F.col("__text"), first["start"], first["end"])).alias("snippet"),
    )


def sql(table: str, keys: str, text: str) -> str:
    def one(reason: str, pattern: str) -> str:
        pattern, reason = pattern.replace("'", "''"), reason.replace("'", "''")
        m, r = f"regexp_extract_all({text}, '(?i){pattern}')", f"string_split_regex({text}, '(?i){pattern}')"
        start = "list_sum(list_transform(r[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        made = f"list_transform(range(1, len(m) + 1), lambda i: {{'s': ({start})::INT, 'e': ({start} + length(m[i]))::INT, 'reason': '{reason}'}})"
        return f"SELECT {keys}, {text} AS t, unnest({made}) AS p FROM (SELECT {keys}, {text}, {m} AS m, {r} AS r FROM {table}) WHERE len(m) > 0"

    matches = " UNION ALL ".join(one(reason, p) for reason, p in PATTERNS.items())
    line = "trim(regexp_replace(substr(t, a + 1, b - a), '\\s+', ' ', 'g'))"
    return f"""WITH f AS ({matches}),
    g AS (SELECT {keys}, any_value(t) AS t, count(DISTINCT p.s) AS n, min(p) AS p FROM f GROUP BY {keys}),
    w AS (SELECT *, greatest(0, floor(({SNIPPET} - (p.e - p.s)) / 2))::INT AS pad FROM g),
    x AS (SELECT *, greatest(0, p.s - pad) AS a, least(length(t), p.e + pad) AS b FROM w), l AS (SELECT *, {line} AS line FROM x),
    s AS (SELECT {keys}, n, p, CASE WHEN a > 0 THEN '…' ELSE '' END || CASE WHEN length(line) > {SNIPPET} THEN rtrim(substr(line, 1, {SNIPPET - 1})) || '…' ELSE line END || CASE WHEN b < length(t) THEN '…' ELSE '' END AS snippet FROM l)
    SELECT {keys}, coalesce(n, 0)::INT AS n_places, p.reason AS reason, p.s AS start, snippet FROM {table} LEFT JOIN s USING ({keys})"""
