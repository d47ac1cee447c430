"""Pages of a report: lines that run through them, and the passages most worth reading."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords

EDGE = 3


def running_lines(pages: DataFrame, report: list[str], page: str, text: str, least_share: float = 0.5) -> DataFrame:
    """(report, key, n): lines within EDGE of a page's top or bottom, digits folded, on at least two and a share of the pages."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    cut = pages.select(*report, page, lines.alias("l"))
    edges = F.array_distinct(
        F.transform(F.concat(F.slice("l", 1, EDGE), F.slice(F.reverse("l"), 1, EDGE)), lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#"))
    )
    counted = cut.select(*report, F.explode(edges).alias("key")).groupBy(*report, "key").agg(F.count("*").alias("n"))
    sizes = pages.groupBy(*report).agg(F.count("*").alias("pages"))
    return counted.join(sizes, report).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * least_share))).select(*report, "key", "n")


#: What a passage costs beside its length: the blank line that parts it from the next.
BETWEEN = 2


def choose(passages: list[str], scores: list[int], budget: int) -> list[int]:
    """Passages by score, most first and earlier ones before later ones, taken while they fit (a longer one is passed over), back in text
    order. Those of score 0 come last."""
    taken, used = [], 0
    for i in sorted(range(len(passages)), key=lambda i: (-scores[i], i)):
        cost = len(passages[i]) + BETWEEN
        if used + cost <= budget:
            taken.append(i)
            used += cost
    return sorted(taken)


def greedy_passages(docs: DataFrame, key: str, text: str, terms: DataFrame, budget: int) -> DataFrame:
    """(key, n_passages, chosen, n_chars) for each document; a passage is a line, and its score the distinct terms (column w) among its
    words. A text that fits the budget is kept whole. Terms meet the distinct words of the longer texts in a join, so they may be many."""
    import re

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, hits in zip(batch["k"], batch["t"], batch["hits"], strict=True):
                lines = [x for x in (t or "").split("\n") if x.strip()]
                if len(t or "") <= budget:
                    taken = list(range(len(lines)))
                else:
                    named = set() if hits is None else set(hits)
                    taken = choose(lines, [len(named & {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_]*", x)}) for x in lines], budget)
                rows.append((k, len(lines), ",".join(map(str, taken)), sum(len(lines[i]) for i in taken)))
            yield pd.DataFrame(rows, columns=[key, "n_passages", "chosen", "n_chars"])

    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.when(F.length(text) > budget, F.md5(text)).alias("m"))
    words = marked.where("m IS NOT NULL").select("m", F.explode(keywords(F.col("t"))).alias("w")).distinct()
    hits = words.join(terms.select("w").distinct(), "w", "left_semi").groupBy("m").agg(F.collect_list("w").alias("hits"))
    return marked.join(hits, "m", "left").select("k", "t", "hits").mapInPandas(run, f"{key} long, n_passages int, chosen string, n_chars int")
