"""Listings over customers, orders, suppliers and events, which stand for users, submissions, subjects and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clip, normal_name, slug
from ..operators import relational as R
from .registry import query, table


@query("""SELECT o_custkey, count(*) AS n_total, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_graded,
      count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS n_late FROM orders GROUP BY o_custkey""")
def submission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(
        F.count("*").alias("n_total"), F.count_if(F.col("o_orderstatus") == "F").alias("n_graded"),
        F.count_if(F.col("o_orderpriority").startswith("5")).alias("n_late")
    )


@query("""SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
      ON o_custkey = c_custkey""")
def student_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return R.with_counts(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), counts, ["c_custkey"], ["n_orders"])


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
      count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
    count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS "view",
      max(event_id) AS last_event FROM events GROUP BY user_id""")
def kind_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds), F.max("event_id").alias("last_event"))


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority
      ORDER BY o_orderkey DESC) = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return R.latest(o, ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderstatus")


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type
      ORDER BY ts DESC, event_id DESC) = 1""")
def latest_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return R.latest(e, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
      WHERE n_regionkey = 1)""")
def scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instructor of region 1 sees the orders of its customers."""
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    mine = table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return R.scoped(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), mine, ["o_custkey"])


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.remaining(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '42') OR contains(lower(c_mktsegment), 'auto')""")
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where(F.lower("c_name").contains("42") | F.lower("c_mktsegment").contains("auto")).select("c_custkey", "c_name")


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice END AS mark, CASE
      WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_orderstatus ELSE 'submitted' END AS status FROM orders""")
def release_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and status of work whose release date has not come yet stay hidden."""
    released = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", R.masked(F.col("o_totalprice"), released).alias("mark"),
        F.coalesce(R.masked(F.col("o_orderstatus"), released), F.lit("submitted")).alias("status")
    )


@query("""SELECT c_custkey, lower(trim(regexp_replace(c_mktsegment || '  ' || c_name, '\\s+', ' ', 'g'))) AS name, trim(regexp_replace(lower(c_name),
      '[^a-z0-9]+', '-', 'g'), '-') AS slug,
    CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 11) || '…' ELSE c_name END AS short FROM customer""".replace("\\\\", "\\"))
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", normal_name(F.concat("c_mktsegment", F.lit("  "), "c_name")).alias("name"), slug(F.col("c_name")).alias("slug"),
        clip(F.col("c_name"), 12).alias("short")
    )


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey > f THEN f END AS same_as
      FROM (SELECT *, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS f FROM part)""")
def dup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_row_of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.lower("p_name"), "p_partkey", "same_as")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS nth FROM lineitem""")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return R.numbered(
        rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "nth"
    ).drop("l_quantity", "l_extendedprice")


@query("""SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS k, coalesce(json_extract_string(props, '$.mode'),
      'default') AS mode FROM events""")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.from_json("props", "k INT, mode STRING")
    return table(spark, sf_dir, "events").select("event_id", options.alias("o")).select(
        "event_id", F.coalesce("o.k", F.lit(0)).alias("k"), F.coalesce("o.mode", F.lit("default")).alias("mode")
    )


@query("""WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1), j AS (SELECT c_custkey, last FROM customer LEFT JOIN l
      ON o_custkey = c_custkey)
    SELECT row_number() OVER (ORDER BY last DESC NULLS LAST, c_custkey) AS place, c_custkey FROM j""")
def nulls_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's place by their latest order; those without one come last."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return R.placed(rows, [F.col("last").desc_nulls_last(), F.col("c_custkey")], "place").select("place", "c_custkey")


SUBMITTED_SQL = """s AS (SELECT o_orderkey, o_custkey AS student, o_orderdate AS handed, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice / 600000 END AS share
      FROM orders)"""


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions: open ones have no mark."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", F.col("o_custkey").alias("student"), F.col("o_orderdate").alias("handed"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") / 600000).alias("share")
    )


@query(f"""WITH {SUBMITTED_SQL} SELECT o_orderkey, row_number() OVER (ORDER BY handed DESC, o_orderkey) AS newest, row_number() OVER (ORDER BY handed,
      o_orderkey) AS oldest,
    row_number() OVER (ORDER BY student, handed DESC, o_orderkey) AS by_student, row_number() OVER (ORDER BY coalesce(share, -1) DESC,
      handed DESC, o_orderkey) AS by_mark FROM s""")
def submission_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each submission's place in the four orders of a listing: newest, oldest, by student (theirs newest first), by share of the mark
    (unmarked ones last, then newest)."""
    rows = _submitted(spark, sf_dir)
    newest = F.col("handed").desc()
    orders = {
        "newest": [newest], "oldest": [F.col("handed").asc()], "by_student": [F.col("student"), newest],
        "by_mark": [F.coalesce("share", F.lit(-1.0)).desc(), newest]
    }
    out = None
    for name, order in orders.items():
        one = R.placed(rows, [*order, F.col("o_orderkey")], name).select("o_orderkey", name)
        out = one if out is None else out.join(one, "o_orderkey")
    return out


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE r <= 20""")
def top_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty flagged reports of the highest score, to be looked at by hand."""
    flagged = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return flagged.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""WITH w AS (SELECT user_id, max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS worst FROM events GROUP BY 1)
    SELECT user_id, worst::INT AS worst, row_number() OVER (ORDER BY worst DESC, lower('user ' || user_id), user_id) AS place FROM w""")
def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students by the worst of their parts' signals (high, medium, low), then by name whatever its case."""
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    w = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(rank).alias("worst"))
    name = F.lower(F.concat(F.lit("User "), F.col("user_id").cast("string")))
    return R.placed(w, [F.desc("worst"), name, F.col("user_id")], "place").select("user_id", "worst", "place")


@query("""SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
      LEFT JOIN region ON r_regionkey = n_regionkey""")
def names_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    c = c.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"))


@query("""SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0""")
def subject_staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return s.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("""WITH d AS (SELECT o_custkey, o_orderpriority AS name, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
    SELECT o_custkey, name FROM d QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, name) = 1""")
def most_common_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    return counted.groupBy("o_custkey").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), "name")).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN left(o_orderpriority, 1) IN ('=', '+', '-', '@') THEN '''' || o_orderpriority ELSE o_orderpriority END AS cell
      FROM orders""")
def guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import guarded

    return table(spark, sf_dir, "orders").select("o_orderkey", guarded(F.col("o_orderpriority")).alias("cell"))


@query("""SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(*) AS n_segments
      FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY c_nationkey""")
def collected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return c.groupBy("c_nationkey").agg(
        F.array_join(F.array_sort(F.collect_list("c_mktsegment")), ",").alias("segments"), F.count("*").alias("n_segments")
    )


@query(
    """WITH s AS (SELECT *, row_number() OVER (ORDER BY s_acctbal < 0 DESC, s_acctbal DESC, s_suppkey) - 1 AS n FROM supplier),
    r AS (SELECT '02-results-' || lpad((n // 40)::VARCHAR, 5, '0') || '.xlsx' AS file, n % 40 + 2 AS row,
      s_suppkey || '|' || s_name || '|' || round(s_acctbal * 100)::BIGINT || '|' || CASE WHEN s_acctbal < 0 THEN chr(39) || '=flagged' ELSE chr(39) || '-' END AS cells FROM s)
    SELECT file, row::INT AS row, cells FROM r UNION ALL SELECT DISTINCT file, 1, 'Supplier|Name|Cents|Flag' FROM r
    UNION ALL SELECT '01-summary-00000.xlsx', 1, 'Field|Value'
    UNION ALL SELECT '01-summary-00000.xlsx', 2, 'Suppliers|' || count(*) FROM supplier
    UNION ALL SELECT '01-summary-00000.xlsx', 3, 'Below zero|' || count(*) FILTER (WHERE s_acctbal < 0) FROM supplier"""
)
def result_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary and results in order, flagged ones first, as workbooks of forty rows a part, read back as cells."""
    import uuid

    from ..sources import files, workbooks
    from ..sources.shared import shared_dir, written

    s = table(spark, sf_dir, "supplier")
    below = F.col("s_acctbal") < 0
    rows = s.select(
        F.col("s_suppkey").alias("Supplier"), F.col("s_name").alias("Name"), F.round(F.col("s_acctbal") * 100).cast("long").alias("Cents"),
        F.when(below, "=flagged").otherwise("-").alias("Flag"),
    )
    fact = lambda name, value: F.struct(F.lit(name).alias("Field"), F.col(value).alias("Value"))
    facts = s.agg(F.count("*").alias("a"), F.count(F.when(below, 1)).alias("b")).select(F.inline(F.array(fact("Suppliers", "a"), fact("Below zero", "b"))))
    folder = f"{shared_dir(spark)}/workbooks/{uuid.uuid4().hex}"
    order = [F.desc(F.col("Cents") < 0), F.desc("Cents"), F.asc("Supplier")]
    done = written(workbooks.write_workbooks([("Summary", facts, [F.desc("Field")]), ("Results", rows, order)], folder, 40), "workbooks")
    read = files.workbook_rows(spark.read.format("binaryFile").load(f"{folder}/*.xlsx"))
    cells = read.select(F.substring_index("path", "/", -1).alias("file"), "row", F.array_join("cells", "|").alias("cells"))
    return cells.join(done.select("file"), "file")
