"""Readers of submission folders, class lists, manifests and notebooks, and writers of reports and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files that the code checks read.
CODE_EXTENSIONS = ("py", "java", "js", "c", "cpp", "cc", "cxx", "hh", "hxx", "h", "hpp", "cs", "go", "rb", "php", "ipynb")
#: Names of class-list columns, without blanks and case.
COLUMNS = {
    "full_name": ("fullname", "name", "studentname"),
    "email": ("email", "emailaddress", "mail"),
    "batch": ("batch",),
    "number": ("registernumber", "registerno", "regno", "regnumber", "studentnumber", "number"),
}

NOTEBOOK = T.StructType(
    [
        T.StructField("cells", T.ArrayType(T.StructType([T.StructField("cell_type", T.StringType()), T.StructField("source", T.StringType())]))),
        T.StructField("worksheets", T.ArrayType(T.StructType([T.StructField("cells", T.ArrayType(T.StructType([T.StructField("cell_type", T.StringType()), T.StructField("input", T.StringType()), T.StructField("source", T.StringType())])))]))),
    ]
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _submitted(files: DataFrame, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(submission, file, extension, source) of binary files below path."""
    inside = F.regexp_replace("path", r"^.*?" + path.rstrip("/").removeprefix("file://").replace(".", r"\.") + "/", "")
    named = files.select(
        F.split_part(inside, F.lit("/"), F.lit(1)).alias("submission"), F.regexp_replace(inside, "^[^/]*/", "").alias("file"),
        extension(F.col("path")).alias("extension"), F.decode("content", "UTF-8").alias("text")
    )
    wanted = named.where(F.col("extension").isin(*extensions))
    return wanted.select(
        "submission", "file", "extension",
        F.when(F.col("extension") == "ipynb", notebook_code(F.col("text"))).otherwise(F.col("text")).alias("source")
    )


def code_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = CODE_EXTENSIONS) -> DataFrame:
    """(submission, file, extension, source): every code file below path, one folder for each submission; notebooks as their code."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return _submitted(files, path, extensions)


#: What the file source gives of a file.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def walked(spark: SparkSession, path: str, into: str, checkpoint: str, extensions: tuple[str, ...] = CODE_EXTENSIONS, at_once: int = 10_000) -> DataFrame:
    """``code_folder`` of a cohort's folder that grows: files that an earlier walk has seen aren't read again. The file stream keeps what it
    has seen in checkpoint; what was read stays as a table in into, at_once files a batch. Returns all that has been read."""
    files = spark.readStream.schema(BINARY).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", at_once).load(path)
    found = _submitted(files.select("path", "content"), path, extensions)
    writer = found.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(found.schema).parquet(into)


def _cells(text: Column) -> Column:
    """(kind, text) of a notebook's cells, format 4 or 3; a source given as a list of lines is joined."""
    book = F.from_json(text, NOTEBOOK)
    older = F.flatten(
        F.transform(
            F.coalesce(book["worksheets"], F.array()),
            lambda s: F.transform(
                s["cells"], lambda c: F.struct(c["cell_type"].alias("cell_type"), F.coalesce(c["source"], c["input"]).alias("source"))
            )
        )
    )
    cells = F.coalesce(book["cells"], older)
    lines = lambda s: F.coalesce(F.array_join(F.from_json(s, "array<string>"), ""), s)
    return F.transform(
        cells,
        lambda c: F.struct(c["cell_type"].alias("kind"), F.when(c["source"].startswith("["), lines(c["source"])).otherwise(c["source"]).alias("text"))
    )


def notebook_code(text: Column) -> Column:
    """The code cells of a notebook, a blank line between; shell lines and magics are blanked, cells of another language left out."""
    code = F.filter(_cells(text), lambda c: (c["kind"] == "code") & ~(c["text"].rlike(r"^\s*%%") & ~c["text"].rlike(r"^\s*%%(time|timeit|capture)")))
    plain = F.transform(
        code, lambda c: F.regexp_replace(F.regexp_replace(c["text"], r"^\s*%%(time|timeit|capture)[^\n]*\n?", ""), r"(?m)^[ \t]*[%!][^\n]*", "")
    )
    return F.coalesce(F.array_join(F.filter(plain, lambda s: s.rlike(r"\S")), "\n\n"), F.lit(""))


def notebook_markdown(text: Column) -> Column:
    return F.coalesce(
        F.trim(F.array_join(F.transform(F.filter(_cells(text), lambda c: c["kind"] == "markdown"), lambda c: c["text"]), "\n\n")), F.lit("")
    )


#: Bounds of a class list: bytes, rows and columns. It is one person's file; more is a mistake.
LIST_BYTES, LIST_ROWS, LIST_COLUMNS = 2 << 20, 300, 40


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """(row, full_name, email, batch, number) of a CSV class list with a heading line; ``;`` or ``,`` by the heading, names by COLUMNS. UTF-8
    with or without its mark, else Windows-1252. A list beyond LIST_BYTES, LIST_ROWS or LIST_COLUMNS is an error."""
    sizes = spark.read.format("binaryFile").load(path)
    if sizes.agg(F.sum("length")).first()[0] > LIST_BYTES:
        raise ValueError(f"the class list has more than {LIST_BYTES} bytes")
    raw = bytes(sizes.select("content").first()[0])
    try:
        text, encoding = raw.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError:
        text, encoding = raw.decode("cp1252", "replace"), "ISO-8859-1"
    first = text.lstrip("\ufeff").split("\n", 1)[0]
    mark = ";" if first.count(";") > first.count(",") else ","
    rows = spark.read.option("header", True).option("sep", mark).option("quote", '"').option("multiLine", True).option("encoding", encoding).csv(path)
    if encoding != "UTF-8":  # the two differ in these characters alone
        latin = "".join(map(chr, range(0x80, 0xA0)))
        rows = rows.select(*(F.translate(F.col(f"`{c}`"), latin, latin.encode("latin-1").decode("cp1252", "replace")).alias(c) for c in rows.columns))
    if len(rows.columns) > LIST_COLUMNS or len(rows.take(LIST_ROWS + 1)) > LIST_ROWS:
        raise ValueError(f"the class list has more than {LIST_ROWS} rows or {LIST_COLUMNS} columns")
    bare = {"".join(ch for ch in c.lower() if ch.isascii() and ch.isalnum()): c for c in rows.columns}
    found = {k: next((bare[n] for n in names if n in bare), None) for k, names in COLUMNS.items()}
    if missing := [k for k in ("full_name", "email") if found[k] is None]:
        raise ValueError(f"the first row must hold the column headings; missing: {', '.join(missing)}")
    named = rows.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(k) if c else F.lit("").alias(k) for k, c in found.items()))
    numbered = named.withColumn("row", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + 1)
    return numbered.where(F.concat(*found) != "").select("row", *found)


def list_problems(rows: DataFrame) -> DataFrame:
    """rows with problems: an array of what is wrong with each."""
    first = F.min("row").over(Window.partitionBy(F.lower("email")))
    checks = [
        F.when(F.col("full_name") == "", "Full name is missing."),
        F.when(F.col("email") == "", "Email is missing.").when(~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "Email is not valid."),
        F.when((F.col("row") > first) & (F.col("email") != ""), F.concat(F.lit("Same email as row "), first.cast("string"), F.lit("."))),
        F.when(F.length("full_name") > 200, "Full name is too long."),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*checks)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, a, b): the true pairs of a labelled manifest's copy groups."""
    sets = spark.read.option("multiLine", True).schema("name string, code_groups array<array<string>>").json(path)
    groups = sets.select("name", F.explode("code_groups").alias("g"))
    return groups.select("name", F.explode("g").alias("a"), "g").select("name", "a", F.explode("g").alias("b")).where("a < b").distinct()


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(F.substring(cell, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), cell)).otherwise(cell)


def write_csv(rows: DataFrame, path: str) -> None:
    """Text cells guarded; one header per part."""
    safe = rows.select(*(guarded(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    safe.write.mode("overwrite").option("header", True).csv(path)


def replace_keys(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Delete-by-key, then insert: partitions of the keys in rows are overwritten, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends what path doesn't have yet and returns it: running again adds nothing."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = rows.limit(0).select(*keys)
    new = rows.join(done, keys, "left_anti").dropDuplicates(keys)
    new.write.mode("append").parquet(path)
    return new


def pruned(cache: DataFrame, most_bytes: int, size: str = "bytes", age: str = "used_at", key: str = "key") -> DataFrame:
    """The most recently used entries whose sizes sum to at most most_bytes. Days are summed first, so one task ranks days, not entries;
    inside the day where the bound falls, entries are ranked."""
    day = F.to_date(age)
    days = cache.groupBy(day.alias("day")).agg(F.sum(size).alias("b"))
    newer = days.withColumn("before", F.coalesce(F.sum("b").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = cache.withColumn("day", day).join(newer.select("day", "before"), "day")
    inside = F.sum(size).over(Window.partitionBy("day").orderBy(F.desc(age), key).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("upto", F.col("before") + inside).where(F.col("upto") <= most_bytes).select(*cache.columns)
