"""Marks by a rubric without a model, and claims of a grader that what was handed in wasn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a criterion's label that ask for the quality of the code.
QUALITY_TERMS = ("quality", "style", "structure", "clean", "readab")
#: Coverage of a criterion that has no keyword.
NEUTRAL = 0.5
#: By kind of evidence, the nouns by which a grader speaks of it.
NOUNS = {
    "report text (words)": r"answer|report|text|submission|response|evidence|work",
    "source code (files)": r"code|program|solution|answer|submission|response|evidence|work",
    "video transcript (words)": r"transcript|video|answer|submission|response|evidence",
    "video frame descriptions": r"frames?|video|answer|submission|response|evidence",
}


def words_of(name: str, description: str) -> list[str]:
    """A criterion's keywords, as ``functions.text.keywords`` finds them."""
    import re

    from ..functions.text import STOP_WORDS

    found = (w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_]*", f"{name} {description}"))
    return list(dict.fromkeys(w for w in found if w not in STOP_WORDS and len(w) > 2))


def heuristic(docs: DataFrame, keys: list[str], text: str, quality: Column, criteria: list[tuple[str, str, float]]) -> DataFrame:
    """keys, criterion, score and justification: one row for each criterion (name, description, points) of the rubric.

    The score is the share of the criterion's keywords that stand anywhere in the text, averaged with the code quality (of 100) where the
    label asks for that, times the points. A rubric is short: it is compiled into the projection.
    """
    rows = []
    low = F.lower(F.coalesce(text, F.lit("")))
    for name, description, points in criteria:
        words = words_of(name, description)
        matched = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        share = matched / len(words) if words else F.lit(NEUTRAL)
        told = F.concat(
            F.lit("keyword coverage "), matched.cast("string"), F.lit(f"/{len(words)}")
        ) if words else F.lit("criterion has no distinguishing keywords; used a neutral baseline")
        if any(term in f"{name} {description}".lower() for term in QUALITY_TERMS):
            share = (share + quality / 100) / 2
            told = F.concat(told, F.lit("; blended with code quality score "), F.round(quality).cast("int").cast("string"), F.lit("/100"))
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * points, 2)
        rows.append(F.struct(F.lit(name).alias("criterion"), score.alias("score"), told.alias("justification")))
    return docs.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def heuristic_sql(table: str, keys: str, text: str, quality: str, criteria: list[tuple[str, str, float]]) -> str:
    parts = []
    for name, description, points in criteria:
        words = words_of(name, description)
        n = " + ".join(f"contains(low, '{w}')::INT" for w in words) or "0"
        share = f"({n}) / {len(words)}.0" if words else str(NEUTRAL)
        told = f"'keyword coverage ' || ({n}) || '/{len(words)}'" if words else "'criterion has no distinguishing keywords; used a neutral baseline'"
        if any(term in f"{name} {description}".lower() for term in QUALITY_TERMS):
            share, told = f"(({share}) + q / 100.0) / 2", f"{told} || '; blended with code quality score ' || round(q)::INT || '/100'"
        parts.append(
            f"SELECT {keys}, '{name}' AS criterion, round(greatest(0.0, least(1.0, ({share})::DOUBLE)) * {points}, 2)::DOUBLE AS score, {told} AS justification FROM t"
        )
    return f"WITH t AS (SELECT {keys}, lower(coalesce({text}, '')) AS low, {quality} AS q FROM {table}) " + " UNION ALL ".join(parts)


def claim_patterns(nouns: str) -> list[str]:
    """How a grader says that something of these nouns wasn't handed in."""
    return [
        rf"\b(?:no|any)\s+(?:\w+\s+){{0,2}}(?:{nouns})\s+(?:was\s+|is\s+|were\s+)?(?:provided|submitted|given|included|available|present|supplied)\b",
        rf"\b(?:{nouns})\b(?:\s+\w+){{0,3}}\s+(?:was|is|were|has been|have been)?\s*(?:not|never)\s+(?:been\s+)?(?:provided|submitted|given|included)\b",
        r"\b(?:did not|didn't|does not|doesn't|has not|hasn't|failed to)\s+(?:submit|provide|include|supply|contain)\s+(?:(?:an?|any|the|student|code analysis|source code|code|"
        r"report text|report|video transcript|transcript|frame descriptions|video frames|frames|text|answer|response|submission|evidence|or|and|,)\s*)+"
        r"(?:$|[.;:]|(?:that|which|so|to|for|in|as|with)\b)",
        r"\bno\s+evidence\s+for\s+(?:the\s+)?[\w ]{0,40}\bcriterion\b[^.]{0,20}\b(?:was|is)\s+(?:provided|submitted|available)\b",
    ]


def claims_missing(text: Column, kinds: dict[str, Column]) -> Column:
    """Whether a justification says that evidence is missing which is there. kinds: by kind of NOUNS, whether it was handed in."""
    said = F.lit(False)
    for kind, there in kinds.items():
        any_of = F.lit(False)
        for p in claim_patterns(NOUNS[kind]):
            any_of = any_of | text.rlike(f"(?i){p}")
        said = said | (there & any_of)
    return F.coalesce(said, F.lit(False))


def claims_sql(text: str, kinds: dict[str, str]) -> str:
    quoted = lambda p: p.replace("'", "''")
    return "coalesce(" + " OR ".join(
        f"(({there}) AND ({' OR '.join(f"regexp_matches({text}, '(?i){quoted(p)}')" for p in claim_patterns(NOUNS[kind]))}))" for kind,
        there in kinds.items()
    ) + ", false)"
