"""Mentions of programming languages in a text, and texts that name other languages than the code they come with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns over lower-cased text, each counted by itself; the second of a pair is subtracted. Free of look-around, so that
#: any engine can count them: a guard before a match is written as the start or another character.
PATTERNS: dict[str, tuple[tuple[str, str | None], ...]] = {
    "python": ((r"\bpython\b", None), (r"\bdjango\b", None), (r"\bjupyter\b", None)),
    "java": ((r"\bjava\b", r"\bjava\b[\s-]*script"), (r"\bjdk\b", None), (r"\bspring boot\b", None)),
    "javascript": ((r"\bjava[\s-]?script\b", None), (r"\btypescript\b", None), (r"\bnode\.?js\b", None), (r"\breact(?:\.js|js)\b", None)),
    "c": ((r"\bc (?:programming )?language\b", None), (r"\bansi c\b", None), (r"\bc programming\b", None)),
    "cpp": ((r"\bc\s*\+\+", None), (r"\bc[\s-]?plus[\s-]?plus\b", None), (r"\bcpp\b", None)),
    "csharp": ((r"(?:^|[^\w+#])c\s?#", None), (r"\bc[\s-]?sharp\b", None), (r"\bcsharp\b", None), (r"(?:^|[^\w.])\.net\b", None), (r"\bdotnet\b", None)),
    "go": ((r"\bgolang\b", None), (r"\bgo (?:programming )?language\b", None), (r"\bgo lang\b", None), (r"\bgoroutines?\b", None)),
    "ruby": ((r"\bruby\b", None),),
    "php": ((r"\bphp\b", None), (r"\blaravel\b", None)),
    "kotlin": ((r"\bkotlin\b", None),),
    "rust": ((r"\brust (?:programming )?language\b", None), (r"\brustlang\b", None)),
}
#: How a language is shown.
SHOWN = {
    "python": "Python", "java": "Java", "javascript": "JavaScript/TypeScript", "c": "C", "cpp": "C++", "csharp": "C#", "go": "Go",
    "ruby": "Ruby", "php": "PHP", "kotlin": "Kotlin", "rust": "Rust",
}
#: Languages that may name each other.
ALIKE = {"c": ("c", "cpp"), "cpp": ("c", "cpp")}
LEAST_MENTIONS = 2


def mentions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One count per language."""
    low = F.lower(text)

    def count(name: str) -> Column:
        n = sum((F.regexp_count(low, F.lit(p)) - (F.regexp_count(low, F.lit(less)) if less else 0) for p, less in PATTERNS[name]), F.lit(0))
        return F.coalesce(n, F.lit(0)).alias(name)

    return df.select(*keys, *map(count, PATTERNS))


def mismatch(df: DataFrame, keys: list[str], text: str, code_language: str, source: str = "report") -> DataFrame:
    """keys, flagged, named and flag: the text names other languages at least LEAST_MENTIONS times, and its own code's never. named: those
    languages, most mentioned first (equal ones in the order of PATTERNS); flag: the sentence for a reviewer, null where not flagged."""
    counted = mentions(df, [*keys, code_language], text)
    own = [F.when(F.col(code_language) == c, sum((F.col(x) for x in ALIKE.get(c, (c,))), F.lit(0))) for c in PATTERNS]
    every = sum((F.col(c) for c in PATTERNS), F.lit(0))
    flagged = F.coalesce((F.coalesce(*own) == 0) & (every >= LEAST_MENTIONS), F.lit(False))
    all_counts = F.array(*(F.struct((-F.col(c)).alias("less"), F.lit(i).alias("i"), F.lit(SHOWN[c]).alias("name")) for i, c in enumerate(PATTERNS)))
    found = F.filter(F.array_sort(all_counts), lambda x: x["less"] < 0)
    times = lambda x: F.concat(
        x["name"], F.lit(" ("), (-x["less"]).cast("string"), F.when(x["less"] == -1, " mention)").otherwise(" mentions)")
    )
    shown = F.coalesce(*(F.when(F.col(code_language) == c, SHOWN[c]) for c in PATTERNS))
    sentence = F.concat(
        F.lit(f"language mismatch: the {source} talks about "), F.array_join(F.transform(found, times), ", "), F.lit(" but the submitted code is "), shown,
        F.lit(f" -- check that the {source} belongs to this submission"),
    )
    named = F.array_join(F.transform(found, lambda x: x["name"]), ", ")
    return counted.select(*keys, flagged.alias("flagged"), F.when(flagged, named).alias("named"), F.when(flagged, sentence).alias("flag"))


def downgraded(status: Column, overall: Column, named: Column, code: Column, source: str = "report") -> tuple[Column, Column]:
    """(status, reason): a verdict of matching topics doesn't stand where the text names another language; scores stay. reason is null
    where the status stays."""
    falls = overall.isNotNull() & named.isNotNull() & status.isin("consistent", "limited_data")
    reason = F.concat(
        F.lit("The topic matches ("), F.round(overall * 100).cast("int").cast("string"), F.lit(f"% overall), but the {source} names "), named,
        F.lit(" while the submitted code is "), code, F.lit(". This part may belong to a different submission. Review recommended."),
    )
    return F.when(falls, "review_recommended").otherwise(status), F.when(falls, reason)


def _count_sql(name: str, text: str) -> str:
    one = lambda p: f"len(regexp_extract_all(lower({text}), '{p}'))"
    return "coalesce(" + " + ".join(one(p) + (f" - {one(less)}" if less else "") for p, less in PATTERNS[name]) + ", 0)::INT"


def sql(table: str, keys: str, text: str) -> str:
    return f"SELECT {keys}, {', '.join(f'{_count_sql(c, text)} AS {c}' for c in PATTERNS)} FROM {table}"


def mismatch_sql(table: str, keys: str, text: str, code_language: str, source: str = "report") -> str:
    own = " ".join(f"WHEN '{c}' THEN {' + '.join(ALIKE.get(c, (c,)))}" for c in PATTERNS)
    shown = " ".join(f"WHEN '{c}' THEN '{SHOWN[c]}'" for c in PATTERNS)
    entries = ", ".join(f"{{'less': -{c}, 'i': {i}, 'name': '{SHOWN[c]}'}}" for i, c in enumerate(PATTERNS))
    return f"""WITH m AS (SELECT {keys}, {code_language} AS code, {', '.join(f'{_count_sql(c, text)} AS {c}' for c in PATTERNS)} FROM {table}),
    f AS (SELECT {keys}, coalesce((CASE code {own} END) = 0 AND {' + '.join(PATTERNS)} >= {LEAST_MENTIONS}, false) AS flagged, CASE code {shown} END AS shown,
      list_filter(list_sort([{entries}]), lambda x: x.less < 0) AS found FROM m)
    SELECT {keys}, flagged, CASE WHEN flagged THEN array_to_string(list_transform(found, lambda x: x.name), ', ') END AS named,
      CASE WHEN flagged THEN 'language mismatch: the {source} talks about ' || array_to_string(list_transform(found, lambda x: x.name || ' (' || -x.less || CASE WHEN x.less = -1 THEN ' mention)' ELSE ' mentions)' END), ', ')
        || ' but the submitted code is ' || shown || ' -- check that the {source} belongs to this submission' END AS flag FROM f"""
