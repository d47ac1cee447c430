"""Python files as tables of syntax nodes, judged by Spark columns.

One small helper walks a tree and writes down what each node is, in the order of the source: its kind, its name, how far its own nodes
reach, and three facts more. All rules are tables and expressions over that array, so a new rule is a new column and no new walk.
"""

from __future__ import annotations

import io
import tokenize
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded, in_slices
from ..functions.columns import let, total

NODE = "struct<kind:string,name:string,last:int,extra:int,holds:string,doc:string,statement:boolean>"
FUNCTIONS, CLASS = ("FunctionDef", "AsyncFunctionDef"), "ClassDef"
#: Kinds of nodes where a path parts, each for one path more; an and/or for each of its values but one.
BRANCHES = ("If", "For", "While", "ExceptHandler", "IfExp", "comprehension")
#: Kinds of statements that do nothing by themselves.
IDLE = ("Pass", "Import", "ImportFrom", *FUNCTIONS, CLASS)
#: Fixed value: a name in the usual form of Python.
SNAKE = r"^_{0,2}[a-z][a-z0-9_]*$"
#: Fixed values. What a smell costs of 100, and at most; undocumented functions cost up to UNDOCUMENTED in all, and a file of under
#: REAL statements that do something is worth IDLE_SCORE at most.
COSTS = {"complex": (10, 40), "names": (5, 20), "reminders": (5, 15), "long_lines": (1, 10)}
MANY_PATHS, LONG, LONG_OTHER, UNDOCUMENTED, IDLE_SCORE, REAL = 10, 100, 120, 15, 10, 2
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Comments that say nothing of the program.
SILENT = r"^(?:#!|#.*coding[:=]|#\s*(?:TODO|FIXME|noqa|type:))"


def nodes_of(source: str) -> list[tuple] | None:
    """A source's nodes in order, None if it can't be read."""
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[list] = []
    todo: list[tuple[ast.AST, int | None]] = [(tree, None)]
    while todo:
        node, opened = todo.pop()
        if opened is not None:  # all below it has been written
            out[opened][2] = len(out) - 1
            continue
        value = getattr(node, "value", None)
        held = None if value is None else type(value.value).__name__ if isinstance(value, ast.Constant) else "value"
        named = isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        name = getattr(node, "name", None) or getattr(node, "id", None)
        todo.append((node, len(out)))
        out.append(
            [type(node).__name__, name if isinstance(name, str) else None, 0, len(getattr(node, "values", ())), held, ast.get_docstring(node) if named else None,
             isinstance(node, ast.stmt)]
        )
        todo += [(child, None) for child in reversed(list(ast.iter_child_nodes(node)))]
    return [tuple(x) for x in out]


def comments_of(source: str) -> list[str]:
    try:
        return [t.string for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError, ValueError):
        return []


def parsed(files: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source, nodes, comments): nodes null where the source is no Python; a null source is an empty file."""
    import pyarrow as pa

    facts = [("kind", pa.string()), ("name", pa.string()), ("last", pa.int32()), ("extra", pa.int32()), ("holds", pa.string()), ("doc", pa.string()), ("statement", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            sources = batch.column(1).to_pylist()
            found = [nodes_of(s) for s in sources]
            columns = list(zip(*(x for n in found if n for x in n), strict=True)) or [[]] * len(facts)
            flat = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, facts, strict=True)], [name for name, _ in facts])
            ends, offsets = 0, []
            for n in found:
                offsets.append(None if n is None else ends)
                ends += len(n or ())
            nodes = pa.ListArray.from_arrays(pa.array([*offsets, ends], pa.int32()), flat)
            comments = pa.array([comments_of(s) if "#" in s else [] for s in sources], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, comments], [key, "source", "nodes", "comments"])

    rows = files.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("s"))
    return bounded(rows).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, source string, nodes array<{NODE}>, comments array<string>")


def _own(nodes: Column, at: Column) -> Column:
    """A node and all below it."""
    return F.slice(nodes, at + 1, F.get(nodes, at)["last"] - at + 1)


def functions(nodes: Column) -> Column:
    """(name, paths, documented) of each function: paths are one and what its nodes add to that."""
    adds = lambda n: F.when(n["kind"].isin(*BRANCHES), 1).when(n["kind"] == "BoolOp", n["extra"] - 1).otherwise(0)
    placed = F.transform(nodes, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    return F.transform(
        F.filter(placed, lambda x: x["n"]["kind"].isin(*FUNCTIONS)), lambda x: F.struct(
            x["n"]["name"].alias("name"), (total(F.transform(_own(nodes, x["i"]), adds)) + 1).alias("paths"), x["n"]["doc"].isNotNull().alias("documented")
        )
    )


def working_statements(nodes: Column) -> Column:
    """How many statements do something: not texts by themselves, returns of nothing, or the guard that asks whether the file is run."""
    asks = lambda n: (n["kind"] == "Name") & (n["name"] == "__name__")
    guard = lambda n, i: (n["kind"] == "If") & F.exists(_own(nodes, i + 1), asks)
    text = lambda n: (n["kind"] == "Expr") & (n["holds"] == "str")
    nothing = lambda n: (n["kind"] == "Return") & (n["holds"].isNull() | (n["holds"] == "NoneType"))
    idle = lambda n: n["kind"].isin(*IDLE) | F.coalesce(text(n), F.lit(False)) | nothing(n)
    some = F.filter(nodes, lambda n: n["statement"] & ~idle(n))
    guarded = F.filter(nodes, lambda n, i: n["statement"] & ~idle(n) & ~guard(n, i))
    return F.when(F.exists(nodes, asks), F.size(guarded)).otherwise(F.size(some))


def smells(nodes: Column, source: Column) -> dict[str, Column]:
    odd = lambda n: ~n["name"].rlike(SNAKE) & (n["kind"].isin(*FUNCTIONS) | ((n["kind"] == CLASS) & ~n["name"].rlike(r"^\p{Lu}")))
    return {
        "complex": F.size(F.filter(functions(nodes), lambda f: f["paths"] > MANY_PATHS)),
        "names": F.size(F.filter(nodes, lambda n: (n["kind"].isin(*FUNCTIONS) | (n["kind"] == CLASS)) & odd(n))),
        "reminders": F.regexp_count(source, F.lit(r"(?i)#\s*(?:TODO|FIXME)\b")), "long_lines": long_lines(source, LONG),
    }


def long_lines(source: Column, most: int) -> Column:
    return F.size(F.filter(F.split(source, LINE_END), lambda x: F.length(x) > most))


def documentation(nodes: Column, comments: Column) -> Column:
    """What a source says of itself: docstrings, then comments of two or more words that aren't for machines or reminders."""
    plain = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    told = F.transform(F.filter(nodes, lambda n: n["doc"].isNotNull() & (n["doc"] != "")), lambda n: plain(n["doc"]))
    said = F.transform(F.filter(comments, lambda c: ~c.rlike(SILENT)), lambda c: F.trim(F.regexp_replace(c, r"^[#! ]+", "")))
    return F.array_join(F.concat(told, F.filter(said, lambda c: c.rlike(r"\S\s+\S"))), "\n")


def file_quality(files: DataFrame, key: str, source: str, name: str) -> DataFrame:
    """(key, functions, classes, docstring_coverage, complex, names, reminders, long_lines, real_logic, quality, documentation) of code files:
    Python by its nodes, others by reminders and long lines alone. A Python file that can't be read has no quality."""
    is_python = F.lower(name).endswith(".py")
    python = parsed(files.where(is_python), key, source)
    found = python.withColumn("f", functions(F.col("nodes"))).withColumns(smells(F.col("nodes"), F.col("source")))
    n = F.size("f")
    coverage = F.when(n > 0, F.size(F.filter("f", lambda f: f["documented"])) / n).otherwise(0.0)
    costs = reduce(lambda a, b: a + b, (F.least(F.lit(most), F.col(k) * each) for k, (each, most) in COSTS.items()))
    undocumented = F.when(n > 0, F.least(F.lit(UNDOCUMENTED), F.floor((1 - coverage) * UNDOCUMENTED).cast("int"))).otherwise(0)
    real = working_statements(F.col("nodes")) >= REAL
    score = F.greatest(F.lit(0), let(100 - costs - undocumented, lambda s: F.when(real, s).otherwise(F.least(s, F.lit(IDLE_SCORE)))))
    read = F.col("nodes").isNotNull()
    classes = F.size(F.filter("nodes", lambda x: x["kind"] == CLASS))
    judged = found.select(
        key, *(F.when(read, c).otherwise(0).alias(k) for k, c in (("functions", n), ("classes", classes))),
        F.coalesce(F.when(read, coverage), F.lit(0.0)).alias("docstring_coverage"), *(F.when(read, F.col(k)).alias(k) for k in COSTS),
        F.when(read, real).alias("real_logic"), F.when(read, score).cast("int").alias("quality"),
        F.coalesce(F.when(read, documentation(F.col("nodes"), F.col("comments"))), F.lit("")).alias("documentation"),
    )
    text = F.coalesce(F.col(source), F.lit(""))
    reminders, long = F.regexp_count(text, F.lit(r"(?:TODO|FIXME)\b")), long_lines(text, LONG_OTHER)
    none = F.lit(None).cast("int")
    other = files.where(~F.coalesce(is_python, F.lit(False))).select(
        key, F.lit(0).alias("functions"), F.lit(0).alias("classes"), F.lit(0.0).alias("docstring_coverage"), none.alias("complex"), none.alias("names"),
        reminders.alias("reminders"), long.alias("long_lines"), F.lit(None).cast("boolean").alias("real_logic"),
        F.greatest(F.lit(0), 100 - 5 * reminders - long).cast("int").alias("quality"), F.lit("").alias("documentation"),
    )
    return judged.unionByName(other)
