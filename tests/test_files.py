from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from gleanery.sources import files, tables, workbooks
from gleanery.sources.store import VectorStore


def zipped(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


DOCX = zipped(
    {
        "word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One </w:t><w:t>two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:document>'
    }
)
XLSX = zipped(
    {
        "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><t>Ann</t></si></sst>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>No</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7.0</v></c></row></sheetData></worksheet>',
    }
)


def test_workbook():
    assert files.xlsx_rows(XLSX) == [["Name", "", "No"], ["Ann", "", "7"]]


def test_kinds_and_archives(spark):
    rows = [
        ("a.zip", zipped({"x.py": "1", "../out.py": "2", "/abs": "3", "d/y.py": "4"})), ("b.zip", b"PK\x03\x04broken"), ("c.pdf", b"junk %PDF-1.4"),
        ("d", b"")
    ]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert {
        r.path: r.k for r in df.select("path", files.kind(df.content).alias("k")).collect()
    } == {"a.zip": "zip", "b.zip": "zip", "c.pdf": "pdf", "d": None}
    got = files.unpacked(df.where("path LIKE '%.zip'")).collect()
    assert sorted((r.path, r.name or "", bytes(r.data or b"")) for r in got) == [
        ("a.zip", "d/y.py", b"4"), ("a.zip", "x.py", b"1"), ("b.zip", "", b"")
    ]
    assert [r.error for r in got if r.path == "b.zip"] == ["not a zip file"]


def test_extraction(spark):
    rows = [("a.docx", DOCX), ("b.docx", b"x"), ("c.txt", "é text".encode()), ("d.txt", b" "), ("e.pdf", b"%PDF-")]
    got = {r.path: (r.status, r.words) for r in files.extracted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.docx": ("ok", 3), "b.docx": ("failed", 0), "c.txt": ("ok", 2), "d.txt": ("empty", 0), "e.pdf": ("unsupported", 0)}


def test_reports(spark, tmp_path):
    pairs = spark.createDataFrame(
        [(1, 2, 0.5, 0.9, True), (1, 3, 0.1, 0.2, False)], "a long, b long, jaccard double, containment double, flagged boolean"
    )
    page = files.html_report(pairs, note="<b>")
    assert page.index("90%") < page.index("20%") and "&lt;b&gt;" in page
    files.json_report(pairs, pairs, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/pairs").count() == 2


def test_workbooks_and_counts(spark):
    pictured = io.BytesIO(DOCX)
    with zipfile.ZipFile(pictured, "a") as z:
        z.writestr("word/media/image1.png", b"x")
    rows = [("a.docx", pictured.getvalue()), ("b.docx", DOCX[:50]), ("c.txt", b"one\n\ntwo"), ("d.txt", b"x" * 101)]
    got = {r.path: r for r in files.extracted(spark.createDataFrame(rows, "path string, content binary"), most=5000).collect()}
    assert (got["a.docx"].images, got["a.docx"].status) == (1, "ok") and got["b.docx"].status == "failed"
    assert (got["c.txt"].units, got["c.txt"].words, got["c.txt"].chars) == (2, 2, 8)
    small = files.extracted(spark.createDataFrame(rows[3:], "path string, content binary"), most=100).first()
    assert (small.status, small.error, small.text) == ("unsupported", "more than 100 bytes", None)
    books = files.workbook_rows(spark.createDataFrame([("x.xlsx", XLSX), ("y.xlsx", b"no")], "path string, content binary")).collect()
    assert [(r.row, list(r.cells)) for r in books if r.path == "x.xlsx"] == [(1, ["Name", "", "No"]), (2, ["Ann", "", "7"])]
    assert [r.row for r in books if r.path == "y.xlsx"] == [0]


def test_walk_reads_only_new_files(spark, tmp_path):
    root, into, check = tmp_path / "cohort", str(tmp_path / "into"), str(tmp_path / "check")
    for name, text in (("ann/a.py", "x = 1"), ("ann/sub/b.js", "y"), ("bob/c.txt", "no code")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    first = sorted(map(tuple, tables.walked(spark, str(root), into, check).collect()))
    assert first == [("ann", "a.py", "py", "x = 1"), ("ann", "sub/b.js", "js", "y")] == sorted(map(tuple, tables.code_folder(spark, str(root)).collect()))
    (root / "ann/a.py").unlink()  # what has been read stays read
    (root / "cat").mkdir()
    (root / "cat/d.go").write_text("z")
    assert sorted(map(tuple, tables.walked(spark, str(root), into, check).collect())) == sorted([*first, ("cat", "d.go", "go", "z")])
    assert tables.walked(spark, str(root), into, check).count() == 3


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    keyed = lambda ids: spark.createDataFrame([(hashlib.md5(str(i).encode()).hexdigest(), [float(i), 1.0]) for i in ids], "key string, vec array<double>")  # noqa: E731, S324
    assert {r.vec for r in store.look_up(keyed(range(3))).collect()} == {None}
    store.put(keyed(range(0, 40)))
    store.put(keyed(range(30, 60)))
    store.put(keyed(range(5)).withColumn("vec", F.array(F.lit(9.0))))  # what is there stays
    keys = {hashlib.md5(str(i).encode()).hexdigest(): i for i in range(80)}  # noqa: S324
    assert store.entries().count() == 60
    got = {keys[r.key]: r.vec for r in store.look_up(keyed([1, 35, 59, 70, 70])).collect()}
    assert got == {1: [1.0, 1.0], 35: [35.0, 1.0], 59: [59.0, 1.0], 70: None}
    read = store.entries(keyed([1])).select(F.input_file_name()).distinct().collect()
    assert read and all(f"bucket={hashlib.md5(b'1').hexdigest()[:2]}" in r[0] for r in read)  # noqa: S324
    store.compact(16 * 3)  # the three that were looked up last
    assert {keys[r.key] for r in store.entries().collect()} == {1, 35, 59}
    store.put(keyed([70]))
    assert {keys[r.key] for r in store.look_up(keyed(range(80))).where("vec IS NOT NULL").collect()} == {1, 35, 59, 70}


def test_workbooks_round_trip(spark, tmp_path):
    rows = [(3, "<a> & \u00e9", 1.5), (1, "=1+1", None), (2, None, -2.0), (4, "\x01ctl", 0.25)]
    df = spark.createDataFrame(rows, "k long, t string, x double")
    folder = f"file://{tmp_path}/books"
    done = workbooks.write_workbooks([("One", df, [F.col("k")]), ("No rows", df.where("k > 9"), [F.col("k")])], folder, 3).collect()
    assert sorted((r.file, r.n_rows) for r in done) == [("01-one-00000.xlsx", 3), ("01-one-00001.xlsx", 1), ("02-no-rows-00000.xlsx", 0)]
    read = lambda name: files.xlsx_rows((tmp_path / "books" / name).read_bytes())
    assert read("01-one-00000.xlsx") == [["k", "t", "x"], ["1", "'=1+1", ""], ["2", "", "-2"], ["3", "<a> & \u00e9", "1.5"]]
    assert read("01-one-00001.xlsx") == [["k", "t", "x"], ["4", "ctl", "0.25"]] and read("02-no-rows-00000.xlsx") == [["k", "t", "x"]]
