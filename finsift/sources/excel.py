"""Spreadsheets in the open XML format, read and written with the standard library.

A file is read whole by one task, as its parts are compressed; files of a folder are read by as many tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.storage import write_bytes

# Names that the format uses.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Rows that a sheet can have.
MOST_ROWS = 1 << 20


def _place(reference: str) -> int:
    """The column number, from 0, of a cell such as AB12."""
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _name(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """The rows of a sheet, cells as text; gaps are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        shared = []
        if "xl/sharedStrings.xml" in parts.namelist():
            for item in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        with parts.open(f"xl/worksheets/sheet{sheet}.xml") as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str | None] = {}
                for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                    value = cell.find(f"{_MAIN}v")
                    text = value.text if value is not None else None
                    if cell.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    cells[_place(cell.get("r")) if cell.get("r") else i] = text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


def excel_table(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """The rows of the files at path as text columns, named by the first row of the first of them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.orderBy("path").limit(1).mapInPandas(lambda batches: (pd.DataFrame({"head": [next(sheet_rows(bytes(c), sheet), [])]}) for b in batches for c in b["content"]), "head array<string>").first()
    names = [x or f"column_{i}" for i, x in enumerate(first["head"] if first else [])]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                told = sheet_rows(bytes(content), sheet)
                head = next(told, [])
                held = []
                for row in told:
                    held.append(dict(zip(head, row, strict=False)))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                yield pd.DataFrame(held, columns=names, dtype=object)

    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in names)) if names else spark.createDataFrame([], "column_0 string")


def write_excel(df: DataFrame, path: str) -> str:
    """df as the one sheet of a file. A file is a single value, so at most MOST_ROWS rows go in; more are an error."""
    rows = df.limit(MOST_ROWS).collect()
    if len(rows) == MOST_ROWS:
        raise ValueError(f"a sheet has less than {MOST_ROWS} rows; write CSV or Parquet")

    def cell(value, r: int, c: int) -> str:
        at = f"{_name(c)}{r}"
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = [f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([df.columns, *rows], 1)]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in (("xl/workbook.xml", "sheet.main"), ("xl/worksheets/sheet1.xml", "worksheet")))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in parts.items():
            file.writestr(name, head + text)
    return write_bytes(df.sparkSession, path, out.getvalue())


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").try_cast("double").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))
