"""Text queries over documents, pages, conversations and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import let, total
from ..operators import languages, manipulation, template
from .registry import query, table

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(rf"SELECT doc_id, len({WORDS_SQL})::INT AS n_words, len(list_distinct({WORDS_SQL}))::INT AS n_distinct FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(
    r"""WITH w AS (SELECT text, regexp_extract_all(lower(text), '[a-z'']+') AS w,
      list_transform(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda s: length(trim(s)) > 0), lambda s: len(regexp_extract_all(s, '[A-Za-z'']+'))) AS n, doc_id FROM documents),
    p AS (SELECT doc_id,
      CASE WHEN len(n) >= 5 AND list_sum(n) > 0 AND 10000 * (len(n) * list_sum(list_transform(n,
      lambda x: x * x)) - list_sum(n) * list_sum(n)) < 1225 * list_sum(n) * list_sum(n) THEN 30 ELSE 0 END
      + CASE WHEN len(w) >= 50 AND 10 * len(list_distinct(w)) < 4 * len(w) THEN 25 ELSE 0 END
      + least(30, 10 * len(list_filter(["""
    + _list(T.STOCK_PHRASES)
    + """], lambda s: contains(lower(text), s))))
      + CASE WHEN len(w) > 0 AND 10 * length(array_to_string(w, '')) > 52 * len(w) THEN 15 ELSE 0 END AS points FROM w)
    SELECT doc_id, least(100, points)::INT AS points, CASE WHEN points < 34 THEN 'low' WHEN points < 67 THEN 'medium'
      ELSE 'high' END AS signal FROM p"""
)
def style_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("doc_id", T.prose_points(F.col("text")).alias("points"))
    return scored.select("doc_id", "points", T.signal(F.col("points")).alias("signal"))


@query(
    r"""WITH w AS (SELECT page_id, html, string_split(html, chr(10)) AS l, list_transform(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*'),
      lambda x: lower(x)) AS w FROM pages),
    f AS (SELECT *, list_transform(list_filter(l, lambda x: regexp_matches(x, '\S')), lambda x: length(x)) AS n FROM w),
    p AS (SELECT page_id, CASE WHEN 4 * len(list_filter(l, lambda x: regexp_matches(x, '^\s*(#|//)'))) > len(l) THEN 25 ELSE 0 END
      + CASE WHEN len(l) > 15 AND len(n) > 1 AND list_sum(n) > 0
      AND 10000 * (len(n) * list_sum(list_transform(n, lambda x: x * x)) - list_sum(n) * list_sum(n)) < 625 * list_sum(n) * list_sum(n) THEN
      25 ELSE 0 END
      + CASE WHEN 100 * len(list_filter(w, lambda x: x IN ("""
    + _list(T.GENERIC_NAMES)
    + r"""))) > 8 * len(w) THEN 25 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(html, '\b(def|function)\s+\w+')) > 0 AND 10 * len(regexp_extract_all(html, '(def |function )[^\n]*\n\s*("""
    + '"""'
    + r"""|''''''|/\*\*)')) > 7 * len(regexp_extract_all(html, '\b(def|function)\s+\w+')) THEN 25 ELSE 0 END AS points FROM f)
    SELECT page_id, points::INT AS points, CASE WHEN points < 34 THEN 'low' WHEN points < 67 THEN 'medium' ELSE 'high' END AS signal FROM p"""
)
def style_score_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "pages").select("page_id", T.code_points(F.col("html")).alias("points"))
    return scored.select("page_id", "points", T.signal(F.col("points")).alias("signal"))


@query(
    r"""WITH m AS (SELECT page_id, len(regexp_extract_all(html, '(?i)\b(figure|fig\.?|screenshot|see below|shown below)\b'))::INT AS mentions, len(regexp_extract_all(html, '(?i)<img\b'))::INT AS images FROM pages)
    SELECT *, (mentions >= 2 AND images = 0) OR (images >= 3 AND mentions = 0) AS flagged FROM m"""
)
def figure_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "pages").select(
        "page_id", T.figure_mentions(F.col("html")).alias("mentions"), F.regexp_count("html", F.lit(r"(?i)<img\b")).alias("images")
    )
    return m.withColumn("flagged", ((F.col("mentions") >= 2) & (F.col("images") == 0)) | ((F.col("images") >= 3) & (F.col("mentions") == 0)))


@query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("plain"))


@query(
    r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
    SELECT doc_id, line, count(*) AS times FROM l WHERE length(line) BETWEEN 1 AND 80 GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading-like lines that a document repeats; short lines only, so rows stay small."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    ).select("doc_id", F.trim("line").alias("line"))
    return lines.where(F.length("line").between(1, 80)).groupBy("doc_id", "line").agg(F.count("*").alias("times")).where("times >= 3")


@query(
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS l FROM documents),
    k AS (SELECT doc_id, list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^((page\s*)?[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?|[-–—]\s*[0-9]{1,4}\s*[-–—]|[ivxlcdm]{1,6})$')) AS k, len(l) AS n FROM l)
    SELECT doc_id, (n - len(k))::INT AS n_removed, regexp_replace(regexp_replace(array_to_string(k, chr(10)), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g') AS cleaned FROM k"""
)
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-number lines go, words hyphenated across lines are rejoined, white space collapses."""
    number = r"(?i)^((page\s*)?[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?|[-–—]\s*[0-9]{1,4}\s*[-–—]|[ivxlcdm]{1,6})$"
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    kept = table(spark, sf_dir, "documents").select(
        "doc_id", let(lines, lambda x: F.struct(F.size(x).alias("n"), F.filter(x, lambda y: ~y.rlike(number)).alias("k"))).alias("l")
    )
    joined = F.regexp_replace(F.array_join("l.k", "\n"), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    return kept.select("doc_id", (F.col("l.n") - F.size("l.k")).alias("n_removed"), F.regexp_replace(joined, r"\s+", " ").alias("cleaned"))


@query(languages.sql("conversations", "conv_id, turn", "text"))
def language_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mentions(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@query(manipulation.sql("documents", "doc_id", "text"))
def manipulation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manipulation.hits(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(
    rf"""WITH w AS (SELECT doc_id, len({WORDS_SQL}) AS n FROM documents),
    c AS (SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil((n - 32) / 96.0) AS BIGINT)))) AS chunk_no FROM w WHERE n > 0)
    SELECT doc_id, chunk_no::INT AS chunk_no, (chunk_no * 96)::INT AS first_word, least(n, chunk_no * 96 + 128)::INT AS end_word,
      (least(n, chunk_no * 96 + 128) - CASE WHEN chunk_no = 0 THEN 0 ELSE chunk_no * 96 + 32 END)::INT AS weight FROM c"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 words that overlap by 32; weight: the words that no window before has."""
    size, overlap = 128, 32
    step = size - overlap
    w = table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n")).where("n > 0")
    last = F.greatest(F.lit(1), F.ceil((F.col("n") - overlap) / step)).cast("int")
    c = w.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last - 1)).alias("chunk_no"))
    start = F.col("chunk_no") * step
    end = F.least(F.col("n"), start + size)
    return c.select(
        "doc_id", "chunk_no", start.alias("first_word"), end.alias("end_word"),
        (end - F.when(F.col("chunk_no") == 0, 0).otherwise(start + overlap)).alias("weight")
    )


@query(
    rf"""WITH l AS (SELECT doc_id, len({WORDS_SQL}) AS m FROM documents), w AS (SELECT doc_id, CAST(ceil(m / 128.0) - CASE WHEN m > 128 AND m % 128 BETWEEN 1 AND 63 THEN 1 ELSE 0 END AS BIGINT) AS n FROM l)
    SELECT doc_id, n::INT AS n_chunks, array_to_string(list_transform(range(0, least(n, 8)), lambda i: CAST(CASE WHEN n <= 8 THEN i ELSE (i * n) // 8 END AS VARCHAR)), ',') AS sampled FROM w WHERE n > 0"""
)
def sampled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eight chunks of 128 words spread evenly over each document; a tail of under half a chunk is none, unless it is all there is."""
    m = F.size(T.words(F.col("text")))
    short = F.when((F.col("m") > 128) & (F.col("m") % 128).between(1, 63), 1).otherwise(0)
    w = table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select(
        "doc_id", (F.ceil(F.col("m") / 128) - short).cast("int").alias("n_chunks")
    ).where("n_chunks > 0")
    picked = F.transform(
        F.sequence(F.lit(0), F.least("n_chunks", F.lit(8)) - 1),
        lambda i: F.when(F.col("n_chunks") <= 8, i).otherwise(F.floor(i * F.col("n_chunks") / 8).cast("int")).cast("string")
    )
    return w.select("doc_id", "n_chunks", F.array_join(picked, ",").alias("sampled"))


@query(
    r"""WITH k AS (SELECT item_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ("""
    + _list(T.STOP_WORDS)
    + r""")))) AS k FROM benchmark) SELECT item_id, len(k)::INT AS n_keywords, array_to_string(k, ' ') AS keywords FROM k"""
)
def keyword_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(T.keywords(F.col("text"))).alias("k"))
    return k.select("item_id", F.size("k").alias("n_keywords"), F.array_join("k", " ").alias("keywords"))


@query(
    rf"""WITH b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
    t AS (SELECT DISTINCT substr(md5(array_to_string(w[i:i+5], chr(31))), 1, 16) AS h FROM (SELECT w, unnest(range(1, len(w) - 4)) AS i FROM b)),
    d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    g AS (SELECT doc_id, i, substr(md5(array_to_string(w[i:i+5], chr(31))), 1, 16) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d)),
    c AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 6 THEN 0 ELSE 1 END AS new FROM g SEMI JOIN t USING (h)),
    r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c)
    SELECT doc_id, (min(i) - 1)::INT AS start_word, (max(i) + 5)::INT AS end_word FROM r GROUP BY doc_id, run HAVING max(i) - min(i) + 6 >= 8"""
)
def template_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight or more words of a document that the benchmark's texts contain too."""
    return template.runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""WITH c AS (SELECT p_partkey, lower(p_name) AS name, list_distinct(list_filter(string_split_regex(lower(regexp_replace(p_name || 'Type' || p_type, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[ _\-0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ("""
    + _list(T.COMMON_PARTS)
    + r"""))) AS parts FROM part)
    SELECT p_partkey, len(parts)::INT AS n_parts, array_to_string(list_sort(parts), ',') AS parts FROM c"""
)
def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace(F.concat("p_name", F.lit("Type"), "p_type"), " ", "_")
    p = table(spark, sf_dir, "part").select("p_partkey", F.array_sort(T.identifier_parts(name)).alias("parts"))
    return p.select("p_partkey", F.size("parts").alias("n_parts"), F.array_join("parts", ",").alias("parts"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(range(1, 1 + len(s))) AS i, s FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS s FROM documents)),
    m AS (SELECT doc_id, i, len(regexp_extract_all(s[i], '[\p{L}\p{N}_]+')) AS n FROM l)
    SELECT doc_id, count(*) AS n_lines, sum(n)::BIGINT AS n_words, max(n)::BIGINT AS longest_line, count(*) FILTER (WHERE n = 1) AS single_word_lines FROM m GROUP BY doc_id"""
)
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    n = F.transform(lines, lambda x: F.regexp_count(x, F.lit(T.WORD)).cast("long"))
    p = table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where(F.size("n") > 0)
    return p.select(
        "doc_id", F.size("n").cast("long").alias("n_lines"), total(F.col("n")).alias("n_words"), F.array_max("n").alias("longest_line"),
        F.size(F.filter("n", lambda x: x == 1)).cast("long").alias("single_word_lines")
    )


@query(
    r"""WITH d AS (SELECT md5(text) AS key, doc_id FROM documents) SELECT key, min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY key"""
)
def dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query(
    r"""WITH k AS (SELECT doc_id, md5('v1|' || text) AS key FROM documents), c AS (SELECT DISTINCT md5('v1|' || text) AS key FROM documents JOIN labels USING (doc_id))
    SELECT key, min(doc_id) AS doc_id FROM k ANTI JOIN c USING (key) GROUP BY key"""
)
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that still need an embedding: distinct content keys that the labelled documents don't have yet."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws("|", F.lit("v1"), "text")).alias("key"))
    cached = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key")
    return d.join(cached, "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@query(
    r"""WITH s AS (SELECT doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents)
    SELECT doc_id, greatest(0, least(n, 2000, 20000 - (total - n)))::BIGINT AS taken FROM s"""
)
def bounded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each text a reader takes with 2,000 characters a file and 20,000 a source, in id order."""
    n = F.length("text").cast("long")
    before = F.sum(n).over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - n
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(0), F.least(n, F.lit(2000),
      20000 - before)).cast("long").alias("taken"))


@query(f"SELECT doc_id, md5({T.markdown_sql("'# ' || text || ' **bold** [a link](http://x.y) | cell'")}) AS digest FROM documents")
def markdown_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown with a heading, marks, a link and a table cell, as plain text."""
    text = F.concat(F.lit("# "), "text", F.lit(" **bold** [a link](http://x.y) | cell"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.markdown_text(text)).alias("digest"))


STEM_SQL = (
    "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) >= {4 + len(e)} THEN substr(w, 1, length(w) - {len(e)})" for e in T.ENDINGS) + " ELSE w END"
)


@query(
    f"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark), s AS (SELECT w, {STEM_SQL} AS s FROM k WHERE length(w) > 2)
    SELECT w, CASE WHEN ends_with(s, 'e') AND length(s) > 4 THEN substr(s, 1, length(s) - 1) ELSE s END AS stem FROM s"""
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark with the form in which they are matched."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("w")
    ).distinct()
    return words.where(F.length("w") > 2).select("w", T.stem(F.col("w")).alias("stem"))
