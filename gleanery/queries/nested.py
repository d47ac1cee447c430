"""Arrays, maps and texts made of rows: subtitles, criteria, budgets, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import total
from ..sources import files
from .registry import query, table


@query(r"""WITH s AS (SELECT conv_id, turn, turn * 7.5 AS a, turn * 7.5 + length(text) / 16.0 AS b, text FROM conversations),
    m AS (SELECT *, CAST(round(a * 1000) AS BIGINT) AS x, CAST(round(b * 1000) AS BIGINT) AS y, row_number() OVER (PARTITION BY conv_id
      ORDER BY a) AS n FROM s),
    t AS (SELECT conv_id, n, n || chr(10) || printf('%02d:%02d:%02d,%03d', x // 3600000, x // 60000 % 60, x // 1000 % 60,
      x % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', y // 3600000, y // 60000 % 60, y // 1000 % 60,
      y % 1000) || chr(10) || text || chr(10) AS block FROM m)
    SELECT conv_id, string_agg(block, chr(10) ORDER BY n) AS srt FROM t GROUP BY conv_id""")
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", (F.col("turn") * 7.5).alias("a"), (F.col("turn") * 7.5 + F.length("text") / 16.0).alias("b"), "text"
    )
    return files.srt(c, ["conv_id"], "a", "b", "text")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS q FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity) = 1)
    SELECT k AS l_orderkey, string_agg((CASE WHEN n % 3 = 0 THEN 'c' || r ELSE 'id' || n END) || ':' || (CASE WHEN n = 2 THEN 99
      ELSE q END), ',' ORDER BY n) AS criteria, sum(CASE WHEN n = 2 THEN 99 ELSE q END)::BIGINT AS total
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM l) GROUP BY k""")
def criteria_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria in order, missing ids filled by position, element 2 replaced, points summed: all inside one array per submission."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    c = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), "q"))).alias("c"))
    points = lambda x: F.when(x["n"] == 2, 99).otherwise(x["q"])
    named = F.transform(
        "c", lambda x,
        i: F.concat(
            F.when(x["n"] % 3 == 0, F.concat(F.lit("c"), (i + 1).cast("string"))).otherwise(F.concat(F.lit("id"), x["n"].cast("string"))), F.lit(":"),
            points(x).cast("string")
        )
    )
    return c.select(
        "l_orderkey", F.array_join(named, ",").alias("criteria"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + points(x)).alias("total")
    )


@query("""WITH r AS (SELECT vec_id // 20 AS report, vec_id % 20 AS i, CAST(floor(CAST(embedding[1] AS DOUBLE) * 1000000) AS BIGINT) AS v
      FROM embeddings), n AS (SELECT report, count(*) AS n, sum(v) AS full_sum FROM r GROUP BY 1),
    s AS (SELECT report, n, full_sum, m, unnest(range(0, least(n, m))) AS j
      FROM n, (VALUES (2), (4), (8)) t(m)), p AS (SELECT s.report, s.n, full_sum, m, CASE WHEN s.n <= m THEN j ELSE j * s.n // m END AS i
      FROM s),
    d AS (SELECT p.report, m, CAST(floor(abs(sum(v) * any_value(p.n) - any_value(full_sum) * count(*)) / (count(*) * any_value(p.n))) AS
      BIGINT) AS delta FROM p JOIN r USING (report, i) GROUP BY p.report, m)
    SELECT m::INT AS max_chunks, sum(delta)::BIGINT AS total_delta, max(delta) AS max_delta, count(*) AS reports FROM d GROUP BY m""")
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a report's mean over 2, 4 or 8 spread chunks lies from the mean over all, in millionths."""
    v = F.floor(F.get("embedding", F.lit(0)).cast("double") * 1_000_000)
    r = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("report"), (F.col("vec_id") % 20).alias("i"), v.alias("v"))
    packed = r.groupBy("report").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    each = packed.select("report", "v", F.size("v").alias("n"), F.explode(F.array(*map(F.lit, (2, 4, 8)))).alias("max_chunks"))
    places = F.transform(
        F.sequence(F.lit(0), F.least("n", "max_chunks") - 1),
        lambda j: F.when(F.col("n") <= F.col("max_chunks"), j).otherwise(F.floor(j * F.col("n") / F.col("max_chunks")).cast("int"))
    )
    picked = F.transform(places, lambda i: F.get("v", i))
    gap = total(picked) * F.size("v") - total(F.col("v")) * F.size(picked)  # of whole numbers, so the quotient's floor is exact
    d = each.select("max_chunks", F.floor(F.abs(gap) / (F.size("v") * F.size(picked))).alias("delta"))
    return d.groupBy("max_chunks").agg(F.sum("delta").alias("total_delta"), F.max("delta").alias("max_delta"), F.count("*").alias("reports"))


@query("""WITH a AS (SELECT user_id, event_type, max(event_id) AS e FROM events WHERE ts < TIMESTAMP '2024-01-20'
      GROUP BY ALL), b AS (SELECT user_id, event_type, max(event_id) AS e FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL),
    m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS k, coalesce(b.e, a.e) AS e
      FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)
    SELECT user_id, string_agg(k || '=' || e, ',' ORDER BY k) AS merged FROM m GROUP BY user_id""")
def merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of scores by key, updated by newer ones: two maps a user, the newer wins. Every event is in the store up to a day, in the
    update from an earlier day on, or in both."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))

    def scores(rows: DataFrame, name: str) -> DataFrame:
        last = rows.groupBy("user_id", "event_type").agg(F.max("event_id").alias("e"))
        return last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "e"))).alias(name))

    old, new = (e.where(F.expr(f"ts {bound}")) for bound in ("< TIMESTAMP_NTZ '2024-01-20'", ">= TIMESTAMP_NTZ '2024-01-10'"))
    both = scores(old, "old").join(scores(new, "new"), "user_id", "full_outer")
    empty = F.create_map().cast("map<string,bigint>")
    kept = F.map_filter(F.coalesce("old", empty), lambda k, _: ~F.coalesce(F.map_contains_key("new", k), F.lit(False)))
    merged = F.array_sort(F.map_entries(F.map_concat(kept, F.coalesce("new", empty))))
    return both.select(
        "user_id", F.array_join(F.transform(merged, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("merged")
    )


@query(r"""WITH g AS (SELECT page_id, len(regexp_extract_all(html, '(TODO|FIXME)\b')) AS todo, len(list_filter(string_split(html, chr(10)),
      lambda x: length(x) > 120)) AS long FROM pages)
    SELECT page_id, greatest(0, 100 - 5 * todo - long)::INT AS quality FROM g""")
def generic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of source text by reminders left in it and long lines."""
    todo = F.regexp_count("html", F.lit(r"(TODO|FIXME)\b"))
    long = F.size(F.filter(F.split("html", "\n"), lambda x: F.length(x) > 120))
    return table(spark, sf_dir, "pages").select("page_id", F.greatest(F.lit(0), 100 - 5 * todo - long).alias("quality"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS pos, CASE WHEN l_linenumber % 4 = 0 THEN 'reworded'
      ELSE 'crit' || l_linenumber END AS name FROM lineitem), n AS (SELECT k, count(*) AS n FROM e GROUP BY k),
    c AS (SELECT i AS pos, 'crit' || i AS name FROM range(1, 8) t(i)), b AS (SELECT DISTINCT k, name FROM e)
    SELECT n.k AS l_orderkey, c.name, CASE WHEN b.name IS NOT NULL THEN 'name' WHEN n.n = 7 THEN 'position' ELSE 'missing' END AS found_by
      FROM n CROSS JOIN c LEFT JOIN b ON b.k = n.k AND b.name = c.name""")
def criterion_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grader's entries to criteria by name; by position where all are there but one is reworded. Entries ride in one array."""
    pos = F.col("l_linenumber")
    name = F.when(pos % 4 == 0, "reworded").otherwise(F.concat(F.lit("crit"), pos.cast("string")))
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", pos.alias("pos"), name.alias("name")).distinct().groupBy("l_orderkey").agg(
        F.collect_set("name").alias("names"), F.count("*").alias("n")
    )
    c = e.select("l_orderkey", "names", "n", F.explode(F.array(*(F.lit(f"crit{i}") for i in range(1, 8)))).alias("name"))
    return c.select(
        "l_orderkey", "name",
        F.when(F.array_contains("names", F.col("name")), "name").when(F.col("n") == 7, "position").otherwise("missing").alias("found_by")
    )
