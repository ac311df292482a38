"""Word files and workbooks written from tables (SNK-05, SNK-08), without other libraries.

A sheet or document is put together where its rows meet; a file holds no more than its own sheets.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def column_name(col: int) -> str:
    """A, B, ... Z, AA, ... of a column from 1."""
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheet_xml(cells: list[tuple[int, int, str]], merged: list[str] = ()) -> str:
    """The XML of a sheet from (row, col, value) in order; empty values are left out."""
    rows: dict[int, list[str]] = {}
    for row, col, value in cells:
        if value:
            rows.setdefault(row, []).append(f'<c r="{column_name(col)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
    body = "".join(f'<row r="{row}">{"".join(found)}</row>' for row, found in rows.items())
    joined = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
    return f'{_HEAD}<worksheet xmlns="{_SHEET}"><sheetData>{body}</sheetData>{f"<mergeCells>{joined}</mergeCells>" if joined else ""}</worksheet>'


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)  # no time of day: the same cells make the same bytes
    return out.getvalue()


def workbook(sheets: list[tuple[str, bool, str]]) -> bytes:
    """A workbook of (name, hidden, XML) in order."""
    state = lambda hidden: ' state="hidden"' if hidden else ""
    listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"{state(hidden)}/>' for k, (name, hidden, _) in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_RELS}">{links}</Relationships>',
    }
    return _zipped(parts | {f"xl/worksheets/sheet{k}.xml": xml for k, (*_, xml) in enumerate(sheets, 1)})


def document(paragraphs: list[list[tuple[str, bool]]], rows: list[list[str]] = ()) -> bytes:
    """A Word file of paragraphs, each of (text, deleted) runs, and one table."""
    run = lambda text, gone: f'<w:del w:id="1" w:author="a"><w:r><w:delText>{escape(text)}</w:delText><w:t>{escape(text)}</w:t></w:r></w:del>' if gone else f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
    body = "".join(f"<w:p>{''.join(run(*r) for r in p)}</w:p>" for p in paragraphs)
    table = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c, False)}</w:p></w:tc>" for c in row) + "</w:tr>" for row in rows)
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body>{body}{f"<w:tbl>{table}</w:tbl>" if table else ""}</w:body></w:document>',
    }
    return _zipped(parts)


def render_workbooks(cells: DataFrame) -> DataFrame:
    """(book, content): a workbook for each book of cells (book, sheet, sheet_no, row, col, value and, if there, hidden).

    Cells come to their book in order, so that a task holds the cells of one sheet and the sheets of one book, however many
    books it has. Sheets stand in the order of ``sheet_no``.
    """
    sheet = Window.partitionBy("book", "sheet")
    hidden = F.max("hidden").over(sheet) if "hidden" in cells.columns else F.lit(False)
    placed = cells.repartition("book").select("book", "sheet", F.min("sheet_no").over(sheet).alias("no"), hidden.alias("hidden"), "row", "col", "value")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for book, found in groupby(rows, itemgetter(0)):
            sheets = [(name, secret, sheet_xml([c[4:] for c in own])) for (_, name, secret), own in groupby(found, itemgetter(2, 1, 3))]
            yield pa.RecordBatch.from_arrays([pa.array([book], pa.string()), pa.array([workbook(sheets)], pa.binary())], names=["book", "content"])

    return placed.sortWithinPartitions("book", "no", "sheet", "row", "col", "value").mapInArrow(written, "book string, content binary")


def render_documents(docs: DataFrame) -> DataFrame:
    """(path, content): a Word file for each of (path, paragraphs array<array<struct<text, deleted>>>, rows array<array<string>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [document([[(r["text"], r["deleted"]) for r in p] for p in paragraphs or []], rows or []) for paragraphs, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    return docs.select("path", "paragraphs", "rows").mapInArrow(run, "path string, content binary")
