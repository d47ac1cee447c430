"""Rules of a reviewer: languages that don't fit, marks by a rubric, claims of missing work, errors, files, times, locks, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import course as C
from ..operators import consistency as K
from ..operators import evaluation as E
from ..operators import languages, rubric
from ..operators import relational as R
from .registry import query, table

NAMES = list(languages.PATTERNS)
NAMES_SQL = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"


def _named(index: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (index % len(NAMES) + 1).cast("int"))


@query(
    languages.mismatch_sql(
        f"(SELECT conv_id, turn, text || ' java, Java and c++' AS text, {NAMES_SQL}[(conv_id % {len(NAMES)} + 1)::INT] AS lang FROM conversations)",
        "conv_id, turn", "text", "lang"
    )
)
def language_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as reports on code of some language; each ends with a mention of three."""
    text = F.concat("text", F.lit(" java, Java and c++"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), _named(F.col("conv_id")).alias("lang"))
    return languages.mismatch(rows, ["conv_id", "turn"], "text", "lang")


CRITERIA = [
    ("Code quality", "clean structure and readable style of the program", 10.0),
    ("Report", "describes method, results and limits", 20.0),
    ("Data", "works with the given data", 5.0),
    ("It", "is", 3.0),
]


@query(rubric.heuristic_sql("documents", "doc_id", "text", "n_chars % 101", CRITERIA))
def rubric_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short rubric over all documents, each with a code quality of its own."""
    return rubric.heuristic(table(spark, sf_dir, "documents"), ["doc_id"], "text", F.col("n_chars") % 101, CRITERIA)


CLAIMS = [
    "No answer was provided.", "the report was never submitted", "does not include the key idea", "did not submit a report or transcript.",
    "No evidence for the style criterion was provided", "good work"
]


@query(f"""WITH j AS (SELECT conv_id, turn, text || ' ' ||
      [{", ".join("'" + c.replace("'", "''") + "'" for c in CLAIMS)}][(conv_id % {len(CLAIMS)} + 1)::INT] AS said, turn % 2 = 0 AS report, turn % 3 = 0 AS code FROM conversations)
    SELECT conv_id, turn, {rubric.claims_sql("said", {"report text (words)": "report", "source code (files)": "code"})} AS wrong FROM j""")
def missing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Justifications that say work is missing which was handed in."""
    claim = F.element_at(F.array(*map(F.lit, CLAIMS)), (F.col("conv_id") % len(CLAIMS) + 1).cast("int"))
    given = {"report text (words)": F.col("turn") % 2 == 0, "source code (files)": F.col("turn") % 3 == 0}
    wrong = rubric.claims_missing(F.concat("text", F.lit(" "), claim), given)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", wrong.alias("wrong"))


PARTS_SQL = """e AS (SELECT vec_id // 3 AS doc, ['code', 'report', 'transcript'][(vec_id % 3 + 1)::INT] AS part, list_transform(embedding,
      lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 7 <> 3),
    u AS (SELECT doc, part, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
    p AS (SELECT doc, count(*) AS parts, any_value(v) FILTER (WHERE part = 'code') AS c, any_value(v) FILTER (WHERE part = 'report') AS r,
      any_value(v) FILTER (WHERE part = 'transcript') AS t FROM u GROUP BY doc)"""


def _cosine_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])))), 4) END"


@query(
    f"""WITH {PARTS_SQL}, s AS (SELECT doc, parts, {_cosine_sql("c", "r")} AS code_report, {_cosine_sql("c", "t")} AS code_transcript,
      {_cosine_sql("r", "t")} AS report_transcript FROM p),
    o AS (SELECT *, round(list_avg(list_filter([code_report, code_transcript, report_transcript], lambda x: x IS NOT NULL)), 4) AS overall
      FROM s),
    w AS (SELECT *, CASE WHEN overall IS NULL THEN 'limited_data' WHEN overall < 0.02 THEN 'review_recommended'
      WHEN parts = 3 THEN 'consistent' ELSE 'limited_data' END AS status FROM o)
    SELECT doc, code_report, code_transcript, report_transcript, overall, CASE WHEN doc % 5 = 0 AND overall IS NOT NULL
      AND status <> 'review_recommended' THEN 'review_recommended' ELSE status END AS status,
      CASE WHEN doc % 5 = 0 AND overall IS NOT NULL AND status <> 'review_recommended' THEN 'The topic matches (' || round(overall *
      100)::INT || '% overall), but the report names Java while the submitted code is Go. This part may belong to a different submission. Review recommended.'
      END AS reason FROM w"""
)
def semantic_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in threes as a submission's parts, some of them missing; every fifth report names another language than its code."""
    part = F.element_at(F.array(*map(F.lit, K.PARTS)), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 7 <> 3").select(
        F.floor(F.col("vec_id") / 3).alias("doc"), part.alias("part"), "embedding"
    )
    scored = K.part_scores(rows, ["doc"], "part", "embedding", 0.02)
    status, reason = languages.downgraded(F.col("status"), F.col("overall"), F.when(F.col("doc") % 5 == 0, "Java"), F.lit("Go"))
    return scored.select("doc", "code_report", "code_transcript", "report_transcript", "overall", status.alias("status"), reason.alias("reason"))


STDERR = {
    "python": 'Traceback\\n  File "/run/main.py", line {n}, in f\\n  File "/usr/lib/python3/x.py", line 7\\nValueError: bad', "ruby": "main.rb:{n}:in `f': bad (RuntimeError)",
    "java": "Exception in thread main\\n  at java.base/x.Y(Y.java:3)\\n  at Main.main(main.java:{n})", "javascript": "/run/main.js:{n}\\nSyntaxError: bad", "c": "main.c:{n}:5: error: expected ;",
    "cpp": "Segmentation fault", "php": "PHP Parse error: bad in /run/main.php on line {n}", "go": "panic: x\\n\\t/run/main.go:{n} +0x1d",
}
_LANGS = list(STDERR)
_STDERR_SQL = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN replace(replace('{v.replace(chr(39), chr(39) * 2)}', '\\n', chr(10)), '{{n}}', n)" for k, v in STDERR.items()
) + " END"


@query(
    f"""WITH e AS (SELECT event_id, [{", ".join(f"'{x}'" for x in _LANGS)}][(event_id % {len(_LANGS)} + 1)::INT] AS lang,
      (event_id % 90 + 1)::VARCHAR AS n, event_id FROM events),
    s AS (SELECT event_id, lang, CASE WHEN event_id % 97 = 0 THEN 'Killed: out of memory'
      ELSE replace({_STDERR_SQL}, '\\t', chr(9)) END AS err FROM e) SELECT event_id, {C.error_message_sql("err", "lang")} AS message FROM s"""
)
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a student is told of each failed run, by the language of their program."""
    which = (F.col("event_id") % len(_LANGS) + 1).cast("int")
    n = (F.col("event_id") % 90 + 1).cast("string")
    forms = F.array(*(F.lit(v.replace("\\n", "\n").replace("\\t", "\t")) for v in STDERR.values()))
    err = F.when(F.col("event_id") % 97 == 0, "Killed: out of memory").otherwise(F.replace(F.element_at(forms, which), F.lit("{n}"), n))
    lang = F.element_at(F.array(*map(F.lit, _LANGS)), which)
    runs = table(spark, sf_dir, "events").select("event_id", err.alias("err"), lang.alias("lang"))
    return runs.select("event_id", C.error_message(F.col("err"), F.col("lang")).alias("message"))


@query(
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, (l_partkey % {len(C.ENDINGS)})::INT AS i,
      l_partkey, l_suppkey FROM lineitem),
    f AS (SELECT l_orderkey, l_linenumber, i, CASE WHEN n = 1 THEN 'main'
      ELSE 'q' || l_linenumber END || [{", ".join(f"'{x}'" for x in C.ENDINGS.values())}][i + 1] AS file FROM a)
    SELECT l_orderkey, l_linenumber, arg_min(file, i) AS file, count(*) AS copies FROM f GROUP BY 1, 2"""
)
def answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each answer; where several languages have one, the first in the languages' order is the one that counts."""
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    i = (F.col("l_partkey") % len(C.ENDINGS)).cast("int")
    lang = F.element_at(F.array(*map(F.lit, C.ENDINGS)), i + 1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), i.alias("i"), lang.alias("lang"))
    named = rows.withColumn("file", C.answer_file(F.col("n"), F.col("l_linenumber"), F.col("lang")))
    return named.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("file", "i").alias("file"), F.count("*").alias("copies"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN '[{"question":2,"file":"q2.py"},{"question":1,"file":"q1.rb"}]' END AS stored
      FROM events)
    SELECT event_id, CASE WHEN stored IS NOT NULL THEN '1:q1.rb,2:q2.py'
      ELSE array_to_string(list_transform(range(1, event_id % 3 + 1), lambda q: q || ':q' || q || '.py'), ',') END AS answers,
      CASE WHEN stored IS NOT NULL THEN 2 ELSE event_id % 3 END::INT AS n FROM e""")
def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as stored, in question order, or from the files that are there where nothing was stored; and how many."""
    kind = "array<struct<question:long,file:string>>"
    stored = F.when(F.col("event_id") % 4 > 0, F.lit('[{"question":2,"file":"q2.py"},{"question":1,"file":"q1.rb"}]'))
    files = F.transform(
        F.filter(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")), lambda q: q <= F.col("event_id") % 3),
        lambda q: F.struct(q.alias("question"), F.concat(F.lit("q"), q.cast("string"), F.lit(".py")).alias("file"))
    )
    answers = F.array_sort(F.coalesce(F.from_json(stored, kind), files))
    rows = table(spark, sf_dir, "events").select("event_id", answers.alias("a"))
    return rows.select(
        "event_id", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["question"].cast("string"), x["file"])), ",").alias("answers"),
        F.size("a").alias("n")
    )


@query(
    """WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ['src/main.py', 'src/util.py'] WHEN 'O' THEN ['a.go']
      ELSE ['app.py', 'main.py'] END AS files, CASE o_orderkey % 4 WHEN 1 THEN 'MAIN.py' WHEN 2 THEN 'src/util.py' WHEN 3 THEN 'none.c'
      ELSE '' END AS wanted FROM orders),
    m AS (SELECT *, CASE WHEN wanted <> '' THEN coalesce(list_filter(files, lambda p: ends_with(lower(p), lower(wanted))
      AND split_part(lower(p), '/', -1) = split_part(lower(wanted), '/', -1))[1], list_filter(files, lambda p: split_part(lower(p), '/',
      -1) = split_part(lower(wanted), '/', -1))[1])
      WHEN len(files) = 1 THEN files[1] WHEN files[1] = 'src/main.py' THEN files[1] END AS file FROM o)
    SELECT o_orderkey, file, CASE WHEN file IS NULL THEN CASE WHEN wanted <> '' THEN 'main file not found: ' || lower(wanted)
      ELSE 'several code files' END END AS error FROM m"""
)
def main_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file to run of each submission, by the wanted name or by the usual ones."""
    lists = {"F": ("src/main.py", "src/util.py"), "O": ("a.go",), "P": ("app.py", "main.py")}
    files = F.coalesce(*(F.when(F.col("o_orderstatus") == k, F.array(*map(F.lit, v))) for k, v in lists.items()))
    wanted = F.element_at(F.array(*map(F.lit, ("", "MAIN.py", "src/util.py", "none.c"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    file, error = C.main_file(F.col("files"), F.col("wanted"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", files.alias("files"), wanted.alias("wanted")
    ).select("o_orderkey", file.alias("file"), error.alias("error"))


@query(
    """WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ran without errors' WHEN 'O' THEN 'did not finish within the time limit'
      ELSE 'crashed (exit code 7)' END AS told, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE repeat(o_orderpriority || ' ', 90) END AS out
      FROM orders)
    SELECT o_orderkey, md5('--- main.py: ' || told || ' ---' || CASE WHEN length(trim(out)) > 0 THEN chr(10) || 'stdout:' || chr(10) || CASE
      WHEN length(trim(out)) > 1000 THEN substr(trim(out), 1, 1000) || chr(10) || '... [truncated]' ELSE trim(out) END ELSE '' END) AS block
      FROM r"""
)
def run_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as blocks of text for a reader, long output clipped."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "timeout").otherwise("error")
    out = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(90)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.md5(C.run_output(F.lit("main.py"), status, F.lit(7), out, F.lit(""))).alias("block"))


@query("""SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CASE event_id % 3 WHEN 1 THEN 19800 WHEN 2 THEN -28800
      ELSE 0 END AS utc_seconds FROM events""")
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text, some with an offset, as UTC."""
    offset = F.element_at(F.array(*map(F.lit, ("", "+05:30", "-08:00"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", C.utc(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset)).alias("utc_seconds")
    )


@query("""SELECT o_orderkey, o_orderstatus = 'O' AND o_orderkey % 5 > 0 AND (o_orderkey % 7 = 0
      OR TIMESTAMP '1997-01-01' < o_orderdate) AS open, o_orderdate >= TIMESTAMP '1996-06-01' AS session_valid FROM orders""")
def open_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether students may still register, and whether a session is still good; an end of null is never."""
    at, day = F.col("o_orderdate").cast("timestamp"), lambda d: F.lit(d).cast("timestamp")
    ends = F.when(F.col("o_orderkey") % 7 != 0, at)
    still = C.registration_open(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 5 > 0, ends, day("1997-01-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", still.alias("open"), C.session_valid(at, day("1996-06-01")).alias("session_valid"))


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'error'),
    w AS (SELECT event_id, t, count(*) OVER r - 1 AS misses, min(t) OVER r AS oldest FROM e WINDOW r AS (PARTITION BY user_id
      ORDER BY t RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW))
    SELECT event_id, misses, misses >= 2 AS locked, CASE WHEN misses >= 2 THEN greatest(1,
      ceil((172800 - (t - oldest)) / 60.0))::BIGINT END AS wait_minutes FROM w"""
)
def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong tries: the misses of the two days before each, whether that locks, and the minutes until the oldest is forgotten."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        "event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")
    )
    seconds, most = 172800, 2
    back = Window.partitionBy("user_id").orderBy("t").rangeBetween(1 - seconds, 0)
    rows = e.select("event_id", "t", (F.count("*").over(back) - 1).alias("misses"), F.min("t").over(back).alias("oldest"))
    wait = F.greatest(F.lit(1).cast("long"), F.ceil((seconds - (F.col("t") - F.col("oldest"))) / 60))
    return rows.select("event_id", "misses", (F.col("misses") >= most).alias("locked"), F.when(F.col("misses") >= most, wait).alias("wait_minutes"))


@query(
    """WITH h AS (SELECT o_orderpriority AS k, o_custkey % 100 AS x, o_totalprice / 1000 AS y, row_number() OVER (PARTITION BY o_orderpriority
      ORDER BY o_orderkey) * 2 <= count(*) OVER (PARTITION BY o_orderpriority) AS train FROM orders),
    f AS (SELECT k, coalesce(regr_slope(y, x) FILTER (WHERE train), 1.0) AS a, avg(y) FILTER (WHERE train) AS my,
      avg(x) FILTER (WHERE train) AS mx FROM h GROUP BY k),
    t AS (SELECT k, x, y, greatest(0.0, a * x + my - a * mx) AS fitted FROM h JOIN f USING (k) WHERE NOT train)
    SELECT k, count(*) AS n, round(avg(abs(x - y)), 4) AS mae_raw, round(avg(abs(fitted - y)), 4) AS mae_fitted FROM t GROUP BY k"""
)
def fit_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line fitted on the first half of each group, and how far marks and fitted marks lie off on the other."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 100).alias("x"), (F.col("o_totalprice") / 1000).alias("y")
    )
    return E.held_out_errors(o, "x", "y", "k", "o_orderkey")


@query(
    """WITH r AS (SELECT vec_id // 20 AS report, vec_id % 20 AS i, CAST(floor(CAST(embedding[1] AS DOUBLE) * 1000000) AS BIGINT) AS v
      FROM embeddings), n AS (SELECT report, count(*) AS n FROM r GROUP BY 1),
    s AS (SELECT report, n, m, unnest(range(0, least(n, m))) AS j FROM n, (VALUES (2), (4), (8)) t(m)), p AS (SELECT report, m, CASE
      WHEN n <= m THEN j ELSE j * n // m END AS i FROM s),
    d AS (SELECT p.report, m, floor(avg(v))::BIGINT AS score FROM p JOIN r USING (report, i) GROUP BY p.report, m),
    c AS (SELECT a.m, avg(abs(a.score - b.score)) AS mean_delta, max(abs(a.score - b.score)) AS max_delta,
      count(*) FILTER (WHERE (a.score >= 0) <> (b.score >= 0)) AS changes FROM d a JOIN d b ON a.report = b.report AND b.m = 8 GROUP BY a.m)
    SELECT m::INT AS max_chunks, round(mean_delta, 2) AS mean_delta, max_delta, changes, m = coalesce((SELECT min(m) FROM c
      WHERE changes = 0 AND mean_delta <= 50000), 8) AS suggested FROM c"""
)
def budget_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the reference of eight chunks: how far each smaller budget's score lies off, how many signals it changes, and the smallest
    budget that changes none and stays within the tolerance."""
    v = F.floor(F.get("embedding", F.lit(0)).cast("double") * 1_000_000)
    r = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("report"), (F.col("vec_id") % 20).alias("i"), v.alias("v"))
    return E.chunk_budgets(r, "report", "i", "v", (2, 4, 8), 50000.0)


@query("""WITH i AS (SELECT o_custkey AS job, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'waiting' WHEN '2-HIGH' THEN 'failed'
      WHEN '3-MEDIUM' THEN 'skipped' ELSE 'evaluated' END AS s, o_orderstatus FROM orders),
    c AS (SELECT job, count(*) AS total, count(*) FILTER (WHERE s = 'evaluated') AS evaluated,
      count(*) FILTER (WHERE s = 'skipped') AS skipped, count(*) FILTER (WHERE s = 'failed') AS failed,
      bool_or(o_orderstatus = 'P') AS stopped FROM i GROUP BY 1)
    SELECT *, CASE WHEN evaluated + skipped + failed = 0 THEN 'queued' WHEN evaluated + skipped + failed < total THEN CASE
      WHEN stopped THEN 'stopped' ELSE 'running' END WHEN failed = total THEN 'failed' ELSE 'done' END AS state FROM c""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's counters and state from its items."""
    outcome = F.when(
        F.col("o_orderpriority") == "1-URGENT", "waiting"
    ).when(F.col("o_orderpriority") == "2-HIGH", "failed").when(F.col("o_orderpriority") == "3-MEDIUM", "skipped").otherwise("evaluated")
    items = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job"), outcome.alias("outcome"), (F.col("o_orderstatus") == "P").alias("stop")
    )
    return E.progress(items, "job", "outcome", F.col("stop"))


@query("""WITH m AS (SELECT doc_id % 100 AS report, CASE WHEN toxic = 1 THEN 'ai'
      ELSE 'human' END AS label, doc_id, (doc_id * 7919 % 1000) / 100.0 AS c FROM labels),
    p AS (SELECT avg(CASE WHEN a.c > h.c THEN 1.0 WHEN a.c = h.c THEN 0.5 ELSE 0 END) AS auc FROM (SELECT c FROM m
      WHERE label = 'ai') a, (SELECT c FROM m WHERE label = 'human') h),
    g AS (SELECT DISTINCT floor(c * 100 + 1) AS t FROM m WHERE label = 'human'), r AS (SELECT t, avg(CASE
      WHEN floor(c * 100 + 1) > t THEN 1.0 ELSE 0 END) AS rate FROM g, m WHERE label = 'human' GROUP BY t),
    s AS (SELECT (SELECT min(t) / 100 FROM r WHERE rate <= 0.01) AS high, (SELECT min(t) / 100 FROM r WHERE rate <= 0.05) AS medium)
    SELECT count(*) FILTER (WHERE label = 'human') AS human, count(*) FILTER (WHERE label = 'ai') AS ai, round(any_value(auc), 6) AS auc,
      any_value(high) AS high, least(any_value(medium), any_value(high)) AS medium,
      round(avg(CASE WHEN c >= 2.0 THEN 1.0 ELSE 0 END) FILTER (WHERE label = 'human'), 6) AS human_flagged, round(avg(CASE
      WHEN c >= 2.0 THEN 1.0 ELSE 0 END) FILTER (WHERE label = 'ai'), 6) AS ai_flagged FROM m, p, s""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, AUC, suggested thresholds (medium at most high) and the flag rates at the current one."""
    label = F.when(F.col("toxic") == 1, "ai").otherwise("human")
    rows = table(spark, sf_dir, "labels").select(label.alias("label"), (F.col("doc_id") * 7919 % 1000 / 100.0).alias("c"))
    return E.calibration(rows, "c", F.col("label") == "ai", 2.0)


@query("""SELECT 'corpus' AS part, coalesce(source, '') AS grp, count(*) AS n FROM documents GROUP BY ALL UNION ALL
      SELECT 'pages', split_part(split_part(url, '//', 2), '/', 1), count(*) FROM pages GROUP BY ALL""")
def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two sources, each with the label of its group."""
    docs = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("part"), F.coalesce("source", F.lit("")).alias("grp"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("part"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("grp")
    )
    return docs.unionByName(pages).groupBy("part", "grp").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT vec_id, round((list_sum(v[1:32]) - list_sum(v[33:64])) / sqrt(greatest(list_sum(list_transform(v[1:32], lambda x: x * x)),
      1e-6)), 6) + 0.0 AS curvature FROM e""")
def chunk_curvatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvature of chunks from a model's outputs, for which halves of vectors stand."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    half = F.slice(v, 1, 32)
    c = C.chunk_curvature(half, F.slice(v, 33, 32), F.transform(half, lambda x: x * x))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(c, 6) + 0.0).alias("curvature"))


@query("""WITH f AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) / 10 AS d FROM events),
    a AS (SELECT user_id, count(*) AS frames, coalesce(avg(d), 0) AS m, count(*) FILTER (WHERE d > 20) AS scenes FROM f GROUP BY 1)
    SELECT user_id, frames, round(m, 2) AS average, scenes, CASE WHEN m < 5 AND frames > 15 THEN 80 WHEN m < 12 THEN 50
      ELSE 20 END AS score, scenes = 0 AND frames > 30 AS no_scene FROM a""")
def recording_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a video of a frame a second: mean difference, scene changes, and how still it is."""
    gap = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))) / 10
    f = table(spark, sf_dir, "events").select("user_id", gap.alias("d"))
    a = f.groupBy("user_id").agg(
        F.count("*").alias("frames"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("m"), F.count_if(F.col("d") > C.SCENE).alias("scenes")
    )
    return a.select(
        "user_id", "frames", F.round("m", 2).alias("average"), "scenes", C.recording_score(F.col("m"), F.col("frames")).alias("score"),
        ((F.col("scenes") == 0) & (F.col("frames") > 30)).alias("no_scene")
    )


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 > 0 THEN 'batch ' || s_nationkey END AS batch FROM supplier)
    SELECT s_suppkey, batch, row_number() OVER (ORDER BY batch IS NULL, CAST(regexp_extract(batch, '([0-9]+)$', 1) AS INT), batch,
      s_suppkey) AS place FROM s""")
def batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone's place by batch in numeric-aware order, those without one last."""
    batch = F.when(F.col("s_nationkey") % 5 > 0, F.concat(F.lit("batch "), F.col("s_nationkey").cast("string")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", batch.alias("batch"))
    number = F.regexp_extract("batch", "([0-9]+)$", 1).try_cast("int")
    return R.placed(s, [F.col("batch").isNull(), number, F.col("batch"), F.col("s_suppkey")], "place")
