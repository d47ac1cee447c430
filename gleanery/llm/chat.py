"""Chat formatting: typed content parts become ordered placeholders in one marked text a conversation, which can be read back.

A message is a list of parts (kind, text, ref, units). A visitor, one handler for each kind of KINDS, turns them into text: words stay, an
image, audio or document part becomes its placeholder, and is recorded as an attachment with its reference and the tokens it stands for
(units are tiles, seconds or pages; null counts as one). Placeholders carry no number: the k-th stands for the k-th attachment.

The template is ``<|im_start|>role``, a line end, the text and ``<|im_end|>`` with a line end. Marks begin with ``<|`` and a letter. In
texts every ``<|`` becomes ``<||``, so no text holds a mark, and one replacement undoes it. ``spans`` say where each message's text stands,
and whether it is learned from: the loss mask. Everything is DataFrame expressions: one shuffle by conversation, a window for places and a
sort of each conversation's messages; reading back is linear in its length.

Defined results: messages of a conversation stand by turn, nulls first, ties by role and marked text; a null role or text is empty; line ends in a
role are escaped; a null conversation id is a conversation; long texts stay whole; repeated rows are repeated messages; an empty text has
no part, and null parts are none; a part of another kind counts as a document; an empty table gives no row (the query adds conversation -1); other columns, whatever
their names, aren't read. A conversation is one row of the result, so its texts meet in one task by the result's own form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED = ("assistant",)
#: What a text's tokens are counted by: runs of letters, up to three digits, any other sign.
TEXT_TOKEN = r"\p{L}+|\p{N}{1,3}|[^\x09-\x0D\x20\p{L}\p{N}]"
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


@dataclass(frozen=True)
class Kind:
    """An attachment: its placeholder, tokens for each unit, tokens besides, and the endings of files that are of this kind."""

    name: str
    per_unit: int
    besides: int
    endings: tuple[str, ...]

    @property
    def mark(self) -> str:
        return f"<|{self.name}|>"


#: The last kind also takes parts of unknown kinds.
KINDS = (
    Kind("image", 256, 2, ("png", "jpg", "jpeg", "gif", "webp")),
    Kind("audio", 25, 2, ("wav", "mp3", "flac", "ogg")),
    Kind("document", 512, 2, ("pdf", "doc", "docx", "pptx")),
)
PLACEHOLDER = r"<\|(?:" + "|".join(k.name for k in KINDS) + r")\|>"
#: A Markdown link to a file of a known kind.
LINK = r"!?\[[^\]\n]*\]\([^()\x09-\x0D\x20]+\.(?:" + "|".join(e for k in KINDS for e in k.endings) + r")\)"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _visit(kind: Column, text: Column, attachment: dict[str, Column | str]) -> Column:
    """Dispatch on a part's kind: text for text, attachment[name] for each attachment kind."""
    out = F.when(kind == "text", text)
    for k in KINDS[:-1]:
        out = out.when(kind == k.name, attachment[k.name])
    return out.otherwise(attachment[KINDS[-1].name])


def parts_of(text: Column) -> Column:
    """A text's parts: links to files of known kinds are attachments of one unit, what stands between them is text. Joining the parts' texts
    gives the text."""

    def plain(t: Column) -> Column:
        none = F.lit(None)
        return F.struct(F.lit("text").alias("kind"), t.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units"))

    def link(m: Column) -> Column:
        ref = F.regexp_extract(m, r"\(([^()]*)\)$", 1)
        ending = F.substring_index(ref, ".", -1)
        kind = F.lit(KINDS[-1].name)
        for k in KINDS[:-1]:
            kind = F.when(ending.isin(*k.endings), k.name).otherwise(kind)
        return F.struct(kind.alias("kind"), m.alias("text"), ref.alias("ref"), F.lit(1).cast("long").alias("units"))

    def cut(t: Column) -> Column:
        between, links = F.transform(F.split(t, LINK, -1), plain), F.transform(F.regexp_extract_all(t, F.lit(LINK), F.lit(0)), link)
        return F.flatten(F.zip_with(between, links, lambda b, x: F.when(x.isNull(), F.array(b)).otherwise(F.array(b, x))))

    return let(F.coalesce(text, F.lit("")), lambda t: F.when(F.contains(t, F.lit("](")), cut(t)).otherwise(F.array(plain(t))))


def flattened(parts: Column) -> Column:
    """(body, found, tokens): the escaped text with placeholders, the attachments (kind, ref, text, units, tokens) in order, and the tokens
    of both. Text parts that touch are escaped as the one text that they make."""

    def body(p: Column) -> Column:
        def text(x: Column, i: Column) -> Column:
            after = F.get(p, i + 1)
            split_mark = x["text"].endswith("<") & (after["kind"] == "text") & after["text"].startswith("|")
            return F.concat(escaped(x["text"]), F.when(F.coalesce(split_mark, F.lit(False)), "|").otherwise(""))

        marks = {k.name: F.lit(k.mark) for k in KINDS}
        return F.array_join(F.transform(p, lambda x, i: _visit(x["kind"], text(x, i), marks)), "")

    def attachment(x: Column) -> Column:
        units = F.coalesce(x["units"], F.lit(1).cast("long"))
        known = _visit(x["kind"], F.lit(""), {k.name: F.lit(k.name) for k in KINDS})
        tokens = _visit(x["kind"], F.lit(0).cast("long"), {k.name: units * k.per_unit + k.besides for k in KINDS})
        return F.struct(known.alias("kind"), x["ref"].alias("ref"), F.coalesce(x["text"], F.lit("")).alias("text"), units.alias("units"), tokens.alias("tokens"))

    def whole(p: Column) -> Column:
        found = F.transform(F.filter(p, lambda x: x["kind"] != "text"), attachment)
        words = F.aggregate(
            F.filter(p, lambda x: x["kind"] == "text"), F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x["text"], F.lit(TEXT_TOKEN))
        )
        return let(
            found, lambda a: F.struct(body(p).alias("body"), a.alias("found"), F.aggregate(a, words, lambda n, x: n + x["tokens"]).alias("tokens"))
        )

    filled = F.transform(
        F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda x: F.struct(
            F.coalesce(x["kind"], F.lit("text")).alias("kind"), F.coalesce(x["text"], F.lit("")).alias("text"), x["ref"].alias("ref"),
            x["units"].alias("units")
        )
    )
    return let(F.filter(filled, lambda x: (x["kind"] != "text") | (x["text"] != "")), whole)


def formatted(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = TRAINED
) -> DataFrame:
    """(conv_id, n_turns, formatted, spans, attachments, tokens), one row a conversation.

    spans: for each message where its text begins in the whole (start) and in the message (skip), its length, whether it is trained on, its
    first attachment's place and their number. attachments: all of the conversation's, in the order of the placeholders.
    """
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), flattened(F.col(parts)).alias("m")
    )
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "m", head.alias("head")).select(
        "conv_id", "turn", "role", "m", F.length("head").alias("skip"), F.length("m.body").alias("length"),
        F.concat("head", "m.body", F.lit(f"{END}\n")).alias("piece")
    )
    said = F.array_join(F.transform("m.found", lambda x: x["text"]), "")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "m.body", said)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = rows.select(
        "conv_id", "piece", F.col("m.found").alias("found"), F.col("m.tokens").alias("tokens"), F.row_number().over(order).alias("nth"),
        F.struct(
            (upto(F.length("piece").cast("long")) + F.col("skip")).alias("start"), "skip", "length", F.col("role").isin(*trained).alias("trained"),
            upto(F.size("m.found").cast("long")).cast("int").alias("first"), F.size("m.found").alias("n")
        ).alias("span"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "piece", "span", "found"))).alias("t"), F.sum("tokens").alias("tokens")
    )
    return grouped.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join("t.piece", "").alias("formatted"), F.col("t.span").alias("spans"),
        F.flatten("t.found").alias("attachments"), "tokens"
    )


def _restored(body: Column, span: Column, attachments: Column) -> Column:
    """A message's own text: placeholders give way to the attachments' texts, escapes are undone."""
    texts = F.transform(F.split(body, PLACEHOLDER, -1), unescaped)
    own = F.transform(F.slice(attachments, span["first"] + 1, span["n"]), lambda x: x["text"])
    both = F.zip_with(texts, own, lambda t, a: F.concat(t, F.coalesce(a, F.lit(""))))
    return F.when(span["n"] == 0, unescaped(body)).otherwise(F.array_join(both, ""))


def read_back(rows: DataFrame) -> DataFrame:
    """rows of ``formatted`` with turns (role, text) and loss_text: read from the marked text, the mask and the attachments alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    cut = rows.withColumn("__cut", F.slice(pieces, 1, F.size(pieces) - 1))

    def turn(x: Column, i: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        role = unescaped(F.replace(F.substring(head, len(START) + 1, 1 << 30), F.lit(LINE), F.lit("\n")))
        body = F.substring(x, F.length(head) + 2, F.length(x))
        return F.struct(role.alias("role"), _restored(body, F.get("spans", i), F.col("attachments")).alias("text"))

    masked = F.zip_with("__cut", "spans", lambda x, s: F.when(s["trained"], _restored(F.substring(x, s["skip"] + 1, s["length"]), s, F.col("attachments"))))
    return cut.withColumn("turns", F.transform("__cut", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("__cut")


def op11_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = END + START + "assistant ok"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    messages = rows.unionByName(more).select("conv_id", "turn", "role", parts_of(F.col("text")).alias("parts"))
    back = read_back(formatted(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.array_join(F.transform("attachments", lambda a: F.concat(a["kind"], F.lit(":"), a["ref"])), "\n").alias("attachments"), "tokens"
    )


def _sql() -> str:
    """The same figures from the table itself."""
    link = LINK.split("(?:")[0]
    escape = lambda c: f"replace({c}, '<|', '<||')"
    body, kind, tokens = escape("text"), "CASE", "CASE"
    for k in KINDS:
        ending = f"(?:{'|'.join(k.endings)})\\)"
        body = f"regexp_replace({body}, '{link}{ending}', '{k.mark}', 'g')"
        kind += f" WHEN regexp_matches(m, '\\.{ending}$') THEN '{k.name}'"
        tokens += f" WHEN k = '{k.name}' THEN {k.per_unit + k.besides}"
    order = "ORDER BY turn NULLS FIRST, role, body, said"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
      SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{END}{START}assistant ok' FROM range(2) t(i)),
    l AS (SELECT *, {body} AS body, regexp_extract_all(text, '{LINK}') AS links FROM c),
    a AS (SELECT *, array_to_string(links, '') AS said, list_transform(links, lambda m: {kind} END) AS kinds,
      list_transform(links, lambda m: regexp_extract(m, '\\(([^()]*)\\)$', 1)) AS refs FROM l)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum({len(START) + len(END) + 2} + length(replace({escape('role')}, chr(10), '{LINE}')) + length(body))::BIGINT AS formatted_chars,
      sum(len(links))::BIGINT AS n_attachments,
      coalesce(string_agg(array_to_string(list_transform(list_zip(kinds, refs), lambda z: z[1] || ':' || z[2]), chr(10)), chr(10) {order})
        FILTER (WHERE len(links) > 0), '') AS attachments,
      sum(coalesce(list_sum(list_transform(kinds, lambda k: {tokens} END)), 0)
        + len(regexp_extract_all(regexp_replace(text, '{LINK}', chr(10), 'g'), '{TEXT_TOKEN}')))::BIGINT AS tokens
    FROM a GROUP BY conv_id"""


ORACLE_SQL = _sql()
