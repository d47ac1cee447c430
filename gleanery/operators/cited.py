"""Cited material: a reference list at the end, and quotations with their citation. Both are meant to match other texts.

All of it is column expressions. The last heading is where a greedy prefix ends, so the text falls into what stands before it, the list,
and what follows from an appendix on; a list goes if it stands in the text's second half, is a small share of it, and is short or full of
what references hold. Quotations with a citation split the rest; those of enough words become a blank, and the parts are joined again.

Words are runs of letters, digits and underscores of any script. A null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import total
from ..functions.text import WORD

#: A list is cut if it is at most this share of the words (in hundredths), and short or with a marker at least every so many words.
MOST_HUNDREDTHS, SHORT_WORDS, WORDS_PER_MARKER, QUOTE_WORDS = 30, 60, 30, 6
#: Headings of reference lists with their number, headings of appendices, what references hold, and what stands in and
#: behind a cited quotation.
HEADING = r"\b(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY|Reference [Ll]ist|REFERENCE LIST|Works [Cc]ited|WORKS CITED)\b\s*:?"
NUMBER = r"\b\d{1,2}(?:\.\d{1,2})*\.?\s+\z"
APPENDIX = r"\b(?:Appendix|Appendices|APPENDIX|APPENDICES)\b"
MARKER = (
    r"https?://\S+|\bwww\.\S+|\b[\w-]+\.(?:org|com|net|edu|gov|io|ac\.[a-z]{2})\b|\bdoi\b|\bDOI\b|\b(?:19|20)\d{2}[a-z]?\b|\bet al\b"
    r"|\b(?:Retrieved|Accessed|Available)\b|\[\d{1,3}\]"
)
QUOTED = r"[^\"”]{1,1500}+"
CITATION = r"\s*(?:\((?:[^()]{0,80}?\b(?:19|20)\d{2}[a-z]?|[^()]{0,80}?n\.d\.)[^()]{0,30}\)|\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\])"
QUOTE = rf"[\"“]({QUOTED})[\"”]{CITATION}"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def without_list(docs: DataFrame, text: str) -> DataFrame:
    """docs with rest, the text without its reference list, and list_words, the words that went."""
    t = F.coalesce(F.col(text), F.lit(""))
    before = F.regexp_replace(F.regexp_extract(t, rf"(?s)\A(.*){HEADING}", 1), NUMBER, "")
    after = F.regexp_extract(t, rf"(?s)\A.*{HEADING}(.*)\z", 1)
    cut = docs.select("*", t.alias("__t"), t.rlike(HEADING).alias("__has"), before.alias("__before"), after.alias("__after"))
    cut = cut.withColumn("__list", F.regexp_extract("__after", rf"(?s)\A(.*?)(?:{APPENDIX}|\z)", 1))
    cut = cut.withColumn("__tail", F.expr("substring(__after, length(__list) + 1)"))
    every, ahead, held = n_words(F.col("__t")), n_words(F.col("__before")), n_words(F.col("__list"))
    dense = (held <= SHORT_WORDS) | (WORDS_PER_MARKER * F.regexp_count("__list", F.lit(MARKER)) >= held)
    goes = F.col("__has") & (2 * ahead >= every) & (held > 0) & (100 * held <= MOST_HUNDREDTHS * every) & dense
    rest = F.when(goes, F.concat_ws(" ", "__before", "__tail")).otherwise(F.col("__t"))
    gone = F.when(goes, every - ahead - n_words(F.col("__tail"))).otherwise(0)
    return cut.select(*docs.columns, rest.alias("rest"), gone.cast("int").alias("list_words"))


def without_quotes(rest: Column) -> tuple[Column, Column]:
    """rest without cited quotations of QUOTE_WORDS or more, and how many words those had."""
    whole, inner = (F.regexp_extract_all(rest, F.lit(QUOTE), F.lit(g)) for g in (0, 1))
    long = F.transform(inner, lambda q: n_words(q) >= QUOTE_WORDS)
    kept = F.zip_with(whole, long, lambda q, is_long: F.when(is_long, " ").otherwise(q))
    joined = F.array_join(F.zip_with(F.split(rest, QUOTE, -1), kept, lambda part, q: F.concat(part, F.coalesce(q, F.lit("")))), "")
    return joined, total(F.transform(inner, lambda q: F.when(n_words(q) >= QUOTE_WORDS, n_words(q)).otherwise(0)), "int")


def removed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words_removed, rest): white space of the rest is collapsed."""
    listed = without_list(docs.select(key, F.col(text).alias("__text")), "__text")
    joined, gone = without_quotes(F.col("rest"))
    return listed.select(key, (F.col("list_words") + gone).alias("words_removed"), F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("rest"))


def sql(table: str, key: str, text: str) -> str:
    """The same for an engine whose patterns repeat at most a thousand times and don't possess."""
    heading, marker, word = HEADING, MARKER, WORD
    quote = QUOTE.replace(QUOTED, r"[^\"”]{1,750}[^\"”]{0,750}").replace("'", "''")
    n = lambda x: f"len(regexp_extract_all({x}, '{word}'))"
    return rf"""WITH t AS (SELECT {key}, coalesce({text}, '') AS t FROM {table}),
    b AS (SELECT *, regexp_matches(t, '{heading}') AS has, regexp_replace(regexp_extract(t, '(?s)\A(.*){heading}', 1), '{NUMBER}', '') AS before,
      regexp_extract(t, '(?s)\A.*{heading}(.*)\z', 1) AS after FROM t),
    l AS (SELECT *, regexp_extract(after, '(?s)\A(.*?)(?:{APPENDIX}|\z)', 1) AS list FROM b),
    n AS (SELECT *, substr(after, length(list) + 1) AS tail, {n("t")} AS every, {n("before")} AS ahead, {n("list")} AS held, len(regexp_extract_all(list, '{marker}')) AS markers FROM l),
    g AS (SELECT *, has AND 2 * ahead >= every AND held > 0 AND 100 * held <= {MOST_HUNDREDTHS} * every AND (held <= {SHORT_WORDS} OR {WORDS_PER_MARKER} * markers >= held) AS goes FROM n),
    r AS (SELECT {key}, CASE WHEN goes THEN before || ' ' || tail ELSE t END AS rest, CASE WHEN goes THEN every - ahead - {n("tail")} ELSE 0 END AS gone FROM g),
    q AS (SELECT *, string_split_regex(rest, '{quote}') AS parts, regexp_extract_all(rest, '{quote}') AS whole, regexp_extract_all(rest, '{quote}', 1) AS inner_ FROM r),
    k AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(CASE WHEN {n("inner_[i]")} >= {QUOTE_WORDS} THEN ' ' ELSE whole[i] END, '')) AS kept,
      list_transform(inner_, lambda x: CASE WHEN {n("x")} >= {QUOTE_WORDS} THEN {n("x")} ELSE 0 END) AS counts FROM q)
    SELECT {key}, (gone + coalesce(list_sum(counts), 0))::INT AS words_removed, trim(regexp_replace(array_to_string(kept, ''), '\s+', ' ', 'g')) AS rest FROM k"""
