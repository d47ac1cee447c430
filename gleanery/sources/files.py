"""Files handed in, read inside tasks from (path, content) rows such as Spark's binaryFile gives, and reports written for people."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape
from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_BYTES = 2_000, 200 << 20
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _opened(content: bytes) -> zipfile.ZipFile:
    """The archive, or ValueError with the reason why it isn't taken."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ValueError("not a zip file") from None
    infos = archive.infolist()
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
        raise ValueError("too large once unpacked")
    return archive


def inside(name: str) -> bool:
    """Whether an entry's path stays inside the folder it is unpacked to."""
    path = PurePosixPath(name.replace("\\", "/"))
    return not path.is_absolute() and ".." not in path.parts and ":" not in name


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word file."""
    with _opened(content) as archive:
        tree = ElementTree.fromstring(archive.read("word/document.xml"))  # noqa: S314
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in tree.iter(f"{WORD}p"))


def xlsx_rows(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as text; whole numbers lose their point."""
    with _opened(content) as archive:
        names = archive.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else [
            "".join(
                t.text or "" for t in si.iter(f"{SHEET}t")
            ) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")
        ]  # noqa: S314
        sheet = ElementTree.fromstring(archive.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))  # noqa: S314
    rows = []
    for row in sheet.iter(f"{SHEET}row"):
        cells: dict[int, str] = {}
        for n, c in enumerate(row.iter(f"{SHEET}c")):
            at = 0
            for ch in "".join(x for x in c.get("r", "") if x.isalpha()):
                at = 26 * at + ord(ch) - 64
            raw = "".join(t.text or "" for t in c.iter() if t.tag in (f"{SHEET}v", f"{SHEET}t"))
            value = shared[int(raw)] if c.get("t") == "s" else raw
            cells[at - 1 if at else n] = value.removesuffix(".0") if c.get("t") not in ("s", "inlineStr", "str") else value.strip()
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def kind(content: Column) -> Column:
    """pdf, zip or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    return F.when(head.contains("255044462D"), "pdf").when(head.startswith("504B0304"), "zip")


def unpacked(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, data, error) of every entry of every archive; entries that point outside are left out, a bad archive gives a row
    with its error."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["p"], batch["c"], strict=True):
                try:
                    with _opened(bytes(c)) as archive:
                        rows = [(p, i.filename, archive.read(i), None) for i in archive.infolist() if not i.is_dir() and inside(i.filename)]
                except (ValueError, OSError, RuntimeError, zipfile.BadZipFile) as e:
                    rows = [(p, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "name", "data", "error"])

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, "path string, name string, data binary, error string")


#: Bytes beyond which a report isn't read.
REPORT_BYTES = 50 << 20


def images(content: bytes) -> int:
    """Pictures in a Word file."""
    with _opened(content) as archive:
        return sum(i.filename.startswith("word/media/") and not i.is_dir() for i in archive.infolist())


def extracted(files: DataFrame, path: str = "path", content: str = "content", most: int = REPORT_BYTES) -> DataFrame:
    """(path, status, text, chars, words, units, images, error): plain text and Word files to text, with their paragraphs and pictures counted;
    others and files over ``most`` bytes are unsupported, unreadable ones failed."""
    import pandas as pd

    names = ["path", "status", "text", "chars", "words", "units", "images", "error"]

    def one(p: str, raw: bytes) -> tuple:
        text, error, status, pictures = None, None, "unsupported", 0
        try:
            if len(raw) > most:
                error = f"more than {most} bytes"
            elif p.lower().endswith(".docx"):
                text, pictures = docx_text(raw), images(raw)
            elif p.lower().endswith((".txt", ".md")):
                text = raw.decode("utf-8", "replace")
            if text is not None:
                status = "ok" if text.strip() else "empty"
        except (ValueError, KeyError, OSError, RuntimeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            status, error = "failed", str(e)
        said = text or ""
        return p, status, text, len(said), len(said.split()), sum(bool(x.strip()) for x in said.split("\n")), pictures, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(p, bytes(c or b"")) for p, c in zip(batch["p"], batch["c"], strict=True)], columns=names)

    schema = "path string, status string, text string, chars int, words int, units int, images int, error string"
    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, schema)


def workbook_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, row, cells, error): the rows of each workbook's first sheet, from 1; one row with the error of a workbook that can't be read."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for p, c in zip(batch["p"], batch["c"], strict=True):
                try:
                    out += [(p, i, cells, None) for i, cells in enumerate(xlsx_rows(bytes(c)), 1)]
                except (ValueError, KeyError, OSError, RuntimeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    out.append((p, 0, [], str(e)))
            yield pd.DataFrame(out, columns=["path", "row", "cells", "error"])

    rows = files.select(F.col(path).alias("p"), F.col(content).alias("c"))
    return rows.mapInPandas(run, "path string, row int, cells array<string>, error string")


def srt(segments: DataFrame, keys: list[str], start: str, end: str, text: str) -> DataFrame:
    """(keys, srt): a transcript's segments as subtitles, numbered from 1 in the order of their start."""

    def clock(c: Column) -> Column:
        ms = F.round(c * 1000).cast("long")
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)

    rows = F.array_sort(
        F.collect_list(F.struct(F.col(start).alias("s"), clock(F.col(start)).alias("a"), clock(F.col(end)).alias("b"), F.col(text).alias("t")))
    )
    blocks = F.transform(
        F.col("r"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["a"], F.lit(" --> "), x["b"], F.lit("\n"), x["t"], F.lit("\n"))
    )
    return segments.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.array_join(blocks, "\n").alias("srt"))


def html_report(pairs: DataFrame, most: int = 200, note: str = "") -> str:
    """A page with the first pairs by the greater of both measures: only these come to the driver."""
    top = pairs.orderBy(F.greatest("jaccard", "containment").desc(), "a", "b").limit(most).collect()
    cells = "".join(
        f"<tr class='{'flag' if r.flagged else ''}'><td>{escape(str(r.a))}</td><td>{escape(str(r.b))}</td><td>{r.jaccard:.0%}</td><td>{r.containment:.0%}</td></tr>" for r in top
    )
    return f"<!doctype html><meta charset='utf-8'><title>Pairs</title><p>{escape(note)}</p><table><tr><th>A</th><th>B</th><th>Jaccard</th><th>Containment</th></tr>{cells}</table>"


def json_report(pairs: DataFrame, scores: DataFrame, path: str) -> None:
    """pairs/ and scores/ below path, as JSON lines written by the executors."""
    pairs.write.mode("overwrite").json(f"{path}/pairs")
    scores.write.mode("overwrite").json(f"{path}/scores")
