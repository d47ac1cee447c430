"""Workbooks of several sheets, written by executors: each sheet's rows in their order, in parts of bounded size, a file each."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import placed
from .tables import guarded

ROWS = 50_000
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: The parts of a workbook of one sheet besides its rows.
FRAME = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def sheet_bytes(name: str, header: list[str], rows: list[list]) -> bytes:
    """A workbook of one sheet: numbers as numbers, nulls as empty cells, all else as text."""

    def cell(value) -> str:  # noqa: ANN001
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value:
            return f"<c><v>{value}</v></c>"
        text = "".join(c for c in str(value) if c in "\t\n" or c >= " ")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in [header, *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in FRAME.items():
            z.writestr(path, text)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name={quoteattr(name[:31])} sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def _writer(folder: str, k: int, name: str, columns: list[str]) -> Callable:
    """Writes the rows of one part of a sheet."""
    import pandas as pd

    def write(part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        part = part.sort_values("__place")
        kept = part[part["__place"] > 0][columns].astype(object)
        cells = kept.where(kept.notna(), None).values.tolist()
        number = int(part["__part"].iloc[0])
        file = f"{k:02d}-{name.lower().replace(' ', '-')}-{number:05d}.xlsx"
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{file}") as f:
            f.write(sheet_bytes(name, columns, cells))
        return pd.DataFrame({"file": [file], "sheet": [name], "part": [number], "n_rows": [len(cells)]})

    return write


def write_workbooks(sheets: list[tuple[str, DataFrame, list[Column]]], folder: str, rows_a_part: int = ROWS) -> DataFrame:
    """(file, sheet, part, n_rows) of what was written below folder, a shared one: sheets (name, rows, order) as ``01-name-00000.xlsx`` and so
    on, every part with the header. Text that a spreadsheet would take for a formula is guarded. Files are named by sheet and part, so a
    task that runs twice writes the same file again; a sheet without rows is one part with its header."""
    out = None
    for k, (name, df, order) in enumerate(sheets, 1):
        columns = df.columns
        safe = df.select(*(guarded(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
        numbered = placed(safe, order, "__place")
        rows = numbered.select(F.floor((F.col("__place") - 1) / rows_a_part).cast("int").alias("__part"), "__place", *columns)
        # a row that isn't one makes the first part, whether there are rows or not
        none = df.sparkSession.range(1).select(F.lit(0).alias("__part"), F.lit(0).cast("long").alias("__place"), *(F.lit(None).cast(t).alias(c) for c, t in df.dtypes))

        done = rows.unionByName(none).groupBy("__part").applyInPandas(_writer(folder, k, name, columns), "file string, sheet string, part int, n_rows int")
        out = done if out is None else out.unionByName(done)
    return out
