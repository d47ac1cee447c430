"""Conversation repair: the cheapest edits that give a conversation the form ``(system? (user assistant)+)?``.

Windows tell each message's fault. A conversation's messages are then collected in order and folded by ``aggregate``: what has been kept so
far is empty, ends in the system message, in a user's or in an assistant's, and for each of the four the fold carries the least
(cost, audit) as a struct, whose order is Spark's own ``least``. The audit names the edits (Keep, Rerole, Delete, Insert); since the form
leaves no choice of roles, it tells the repaired messages too. All of it is DataFrame expressions after one shuffle by conversation.

Defined results: messages stand by turn, nulls first, ties by role and text; a null role or text counts as one blank; a role is judged by
its first letter, an empty one has none; a blank message must go, whatever its role; repeated rows are duplicates of the first; long texts
stay whole; a null conversation id is a conversation; a conversation without messages gives zeros and an empty audit; an empty table gives
no row; other columns, whatever their names, aren't read. A conversation is one row of the result (its digest is over all of its text), so
its messages meet in one task by the result's own form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
NEVER = 1 << 40
#: Neighbours of a sound conversation, by their roles' first letters.
SOUND = ("su", "ua", "au")
BLANK = r"[^\x20\x09-\x0D]"


def _edit(state: Column, cost: int | Column, letter: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"))


def _either(condition: Column, state: Column) -> Column:
    """The state where the condition holds, one that no fold chooses elsewhere."""
    return F.when(condition, state).otherwise(F.struct(F.lit(NEVER).cast("long").alias("cost"), F.lit("").alias("audit")))


def _states(empty: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(empty.alias("empty"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _with_inserts(s: Column) -> Column:
    """States after any inserts: more than two in a row never pay."""
    user = F.least(s["user"], *(_edit(s[k], INSERT, "I") for k in ("empty", "system", "assistant")))
    return let(user, lambda u: _states(s["empty"], s["system"], u, F.least(s["assistant"], _edit(u, INSERT, "I"))))


def _step(s: Column, row: Column) -> Column:
    """States after one more message: kept, given the role that fits, or deleted."""
    may, more = ~row["must_go"], row["more"]
    is_ = lambda letter: may & (row["initial"] == letter)

    def moved(before: Column) -> Column:  # before: what a user's message may follow
        return _states(
            _edit(s["empty"], DELETE, "D"),
            F.least(_edit(s["system"], DELETE, "D"), _either(is_("s"), _edit(s["empty"], KEEP + more, "K"))),
            F.least(_edit(s["user"], DELETE, "D"), _either(is_("u"), _edit(before, KEEP + more, "K")), _either(may, _edit(before, REROLE + more, "R"))),
            F.least(
                _edit(s["assistant"], DELETE, "D"), _either(is_("a"), _edit(s["user"], KEEP + more, "K")),
                _either(may, _edit(s["user"], REROLE + more, "R")),
            ),
        )

    return let(F.least(s["empty"], s["system"], s["assistant"]), moved)


def cheapest(rows: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of (initial, must_go, more), ties by the audit's bytes."""
    state = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"))
    start = _states(state(0), state(NEVER), state(NEVER), state(NEVER))
    return F.aggregate(
        rows, start, lambda s, row: let(_with_inserts(s), lambda t: _step(t, row)),
        lambda s: let(_with_inserts(s), lambda t: F.least(t["empty"], t["assistant"])),
    )


def applied(rows: Column, audit: Column) -> Column:
    """The repaired messages (role, text): each message's edit with the inserts before it, then roles by place where none was kept."""
    # one element for each message, and one for inserts at the end
    edits = F.regexp_extract_all(audit, F.lit("I*[KRD]|I+"), F.lit(0))
    item = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")

    def edited(e: Column, i: Column) -> Column:
        row, letter = F.get(rows, i), F.substring(e, -1, 1)
        added = F.array_repeat(item(none, F.lit("")), F.length(F.regexp_replace(e, "[^I]", "")))
        own = F.when(letter == "K", F.array(item(row["role"], row["text"]))).when(letter == "R", F.array(item(none, row["text"])))
        return F.concat(added, F.coalesce(own, F.slice(F.array(item(none, F.lit(""))), 1, 0)))

    def filled(x: Column) -> Column:
        first = F.when(F.coalesce(F.get(x, 0)["role"].startswith("s"), F.lit(False)), 1).otherwise(0)
        by_place = lambda k: F.when((k - first) % 2 == 0, "user").otherwise("assistant")
        return F.transform(x, lambda m, k: item(F.coalesce(m["role"], by_place(k)), m["text"]))

    return let(F.flatten(F.transform(edits, edited)), filled)


def faults(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, present, nth, fault), nth counting equal messages of a conversation: blank, duplicate of an earlier message, truncated, or null; the first that holds.
    present: a boolean column; rows without it only tell that their conversation is there."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
        (F.coalesce(present, F.lit(False)) if present else F.lit(True)).alias("present"),
    ).select("conv_id", "turn", blank("role"), blank("text"), "present")
    # equal messages meet where their conversation does: no shuffle of their own
    nth = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    last = F.regexp_extract("text", rf"({BLANK})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.repartition("conv_id").withColumn("nth", nth).withColumn("fault", fault)


def repaired(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), one row a conversation."""
    rows = faults(messages, conv, turn, role, text, present)
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("present"), F.struct("turn", "role", "text", "nth", "fault")))).alias("r")
    )
    count = lambda fault: F.size(F.filter("r", lambda x: x["fault"] == fault)).cast("long").alias(fault)
    initial = lambda x: F.substring(x["role"], 1, 1)
    illegal = F.size(F.filter("r", lambda x, i: (i > 0) & ~F.concat(initial(F.get("r", F.greatest(i - 1, F.lit(0)))), initial(x)).isin(*SOUND)))
    turns = F.filter(F.transform("r", lambda x: x["turn"]), lambda t: t.isNotNull())
    gaps = let(turns, lambda t: F.coalesce(F.array_max(t) - F.array_min(t) + 1 - F.size(F.array_distinct(t)), F.lit(0)).cast("long"))
    judged = F.transform(
        "r", lambda x: F.struct(
            initial(x).alias("initial"), F.coalesce(x["fault"].isin("blank", "duplicate"), F.lit(False)).alias("must_go"),
            F.when(x["fault"] == "truncated", UNFINISHED).otherwise(0).alias("more")
        )
    )
    folded = grouped.select(
        "conv_id", "r", gaps.alias("gaps"), *map(count, ("blank", "duplicate", "truncated")), illegal.cast("long").alias("illegal"),
        cheapest(judged).alias("best")
    )
    return folded.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit",
        applied(F.col("r"), F.col("best.audit")).alias("repaired")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows with planted faults, by the checksum of conversation and turn; dropped rows stay as rows
    that aren't present."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("d") != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))).alias("copy")
    ).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired(damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), present="present")
    said = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"),
        F.size("repaired").cast("long").alias("n_repaired")
    )


#: CRC-32 of an ASCII string {0}: its bytes, each followed by eight shifts, folded over the register.
CRC_SQL = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda b: list_concat([ascii(b)::BIGINT],"
    " list_transform(range(8), lambda i: (-1)::BIGINT))))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e)"
    " WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
)


def _sql() -> str:
    """The fold as a recursion over messages, all conversations at once; a state is its cost in twelve digits with its audit behind it."""
    edit = lambda s, cost, letter: f"lpad((substr({s}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({s}, 13) || '{letter}'"
    never = f"'{NEVER // 2:012d}'"
    u = f"least(u, {', '.join(edit(s, INSERT, 'I') for s in ('e', 's', 'a'))})"
    into = "least(e, s, a)"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {CRC_SQL.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS d FROM conversations),
    x AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
      ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE d <> 0),
    q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM x),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS n,
      regexp_extract(text, '({BLANK})[\\x20\\x09-\\x0D]*\\z', 1) AS last FROM q),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{BLANK}') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?')
      THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS i FROM o),
    j AS (SELECT *, fault IN ('blank', 'duplicate') AS go, (fault = 'truncated')::INT AS more, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS p,
      count(*) OVER (PARTITION BY conv_id) AS m FROM f),
    c AS (SELECT DISTINCT conv_id FROM conversations),
    r AS (SELECT conv_id, 0::BIGINT AS n, '{0:012d}' AS e, {never} AS s, {never} AS u, {never} AS a FROM c
      UNION ALL SELECT conv_id, n, {edit('e', DELETE, 'D')},
        least({edit('s', DELETE, 'D')}, CASE WHEN NOT go AND i = 's' THEN {edit('e', 'more', 'K')} ELSE {never} END),
        least({edit('u', DELETE, 'D')}, CASE WHEN NOT go AND i = 'u' THEN {edit(into, 'more', 'K')} ELSE {never} END,
          CASE WHEN NOT go THEN {edit(into, '2 + more', 'R')} ELSE {never} END),
        least({edit('a', DELETE, 'D')}, CASE WHEN NOT go AND i = 'a' THEN {edit('u', 'more', 'K')} ELSE {never} END,
          CASE WHEN NOT go THEN {edit('u', '2 + more', 'R')} ELSE {never} END)
      FROM (SELECT conv_id, n, go, i, more, e, s, u, least(a, {edit('u', INSERT, 'I')}) AS a
        FROM (SELECT j.conv_id, j.n, go, j.i, more, e, s, {u} AS u, a FROM r JOIN j ON r.conv_id IS NOT DISTINCT FROM j.conv_id AND j.n = r.n + 1))),
    z AS (SELECT conv_id, n, least(e, a, {edit(f'({u})', INSERT, 'I')}) AS best FROM r QUALIFY n = max(n) OVER (PARTITION BY conv_id)),
    t AS (SELECT conv_id, substr(best, 13) AS audit, substr(best, 1, 12)::BIGINT AS cost,
      regexp_extract_all(substr(best, 13), 'I*[KRD]|I+') AS edits FROM z),
    b AS (SELECT conv_id, unnest(edits) AS edit, unnest(range(1, len(edits) + 1)) AS n FROM t),
    d AS (SELECT conv_id, n, unnest(range(len(edit))) AS q, unnest(string_split(edit, '')) AS letter FROM b),
    g AS (SELECT d.conv_id, d.n, q, letter, CASE letter WHEN 'K' THEN role END AS role, CASE letter WHEN 'I' THEN '' ELSE text END AS text,
      row_number() OVER (PARTITION BY d.conv_id ORDER BY d.n, q) - 1 AS place FROM d LEFT JOIN j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.n = d.n
      WHERE letter <> 'D'),
    h AS (SELECT *, CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY place) LIKE 's%' THEN 1 ELSE 0 END AS head FROM g),
    y AS (SELECT conv_id, count(*) AS n_repaired, string_agg(coalesce(role, CASE WHEN (place - head) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text,
      chr(10) ORDER BY place) AS said FROM h GROUP BY conv_id),
    w AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
      count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
      count(*) FILTER (WHERE n > 1 AND p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id)
    SELECT t.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(said, '')) AS repaired_sha256, coalesce(n_repaired, 0) AS n_repaired
    FROM t LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM t.conv_id"""


ORACLE_SQL = _sql()
