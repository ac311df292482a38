"""Documents, workbooks, logs and profiles as tables (SRC-01 to SRC-03, SRC-10, SRC-15, SRC-16, FN-60 to FN-64)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def _visible(node: ElementTree.Element) -> str:
    """SRC-02: the text of a node without what a tracked change deleted."""
    if node.tag == f"{_W}del":
        return ""
    return (node.text or "" if node.tag == f"{_W}t" else "") + "".join(map(_visible, node))


def docx_text(content: bytes) -> tuple[list[str], list[str]]:
    """SRC-01: (paragraphs, table rows) of a Word file; blank paragraphs are left out, cells stand with blanks between."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraphs = [t for p in body.findall(f"{_W}p") if (t := _visible(p).strip())]
    cell = lambda c: "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.findall(f"{_W}p")).strip()
    rows = [" ".join(cell(c) for c in r.findall(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return paragraphs, rows


def read_docx(files: DataFrame) -> DataFrame:
    """(path, paragraphs, table_rows, full_text, error) of Word files; a broken file has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content):
                try:
                    paragraphs, rows = docx_text(content)
                    out.append((path, paragraphs, rows, "\n".join([*paragraphs, *rows]), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "paragraphs", "table_rows", "full_text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, paragraphs array<string>, table_rows array<string>, full_text string, error string")


def xlsx_cells(content: bytes, hidden: bool = False) -> Iterator[tuple[str, int, int, str]]:
    """SRC-10, SRC-13: (sheet, row, col, value) of the cached values, merged ranges filled with their first cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            if not hidden and sheet.get("state", "visible") != "visible":
                continue
            root = ElementTree.fromstring(z.read("xl/" + targets[sheet.get(f"{_R}id")].removeprefix("/xl/")))
            cells: dict[tuple[int, int], str] = {}
            for c in root.iter(f"{_S}c"):
                kind, v = c.get("t"), c.find(f"{_S}v")
                raw = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                cells[_place(c.get("r"))] = shared[int(raw)] if kind == "s" and raw else {"1": "True", "0": "False"}.get(raw, raw) if kind == "b" else raw
            for merged in root.iter(f"{_S}mergeCell"):
                (r0, c0), (r1, c1) = map(_place, merged.get("ref").split(":"))
                for r in range(r0, r1 + 1):
                    for k in range(c0, c1 + 1):
                        cells[r, k] = cells.get((r0, c0), "")
            width, height = max((k for _, k in cells), default=0), max((r for r, _ in cells), default=0)
            for r in range(1, height + 1):  # SRC-11: rows are as wide as the widest
                for k in range(1, width + 1):
                    yield sheet.get("name"), r, k, cells.get((r, k), "")


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for x in letters:
        col = col * 26 + ord(x) - 64
    return int(digits), col


def read_xlsx(files: DataFrame, hidden: bool = False) -> DataFrame:
    """(path, sheet, row, col, value) of workbooks; broken files give no rows (see :func:`validate`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                try:
                    rows = [(path, *c) for c in xlsx_cells(content, hidden)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, col int, value string")


def extension(path: Column) -> Column:
    """SRC-09."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def images(files: DataFrame) -> DataFrame:
    """SRC-09: files of an image type."""
    return files.where(extension(F.col("path")).isin(vocab.IMAGE_TYPES))


def validate(files: DataFrame, allowed: list[str] | None = None, max_mb: float = vocab.MAX_UPLOAD_MB, strict: bool = False) -> DataFrame:
    """FN-60 to FN-64: (path, is_valid, errors, warnings) by extension, first bytes, size and end of archive."""
    ext, found = extension(F.col("path")), T.magic_type(F.col("content"))
    known = ext.isin(allowed or vocab.UPLOAD_TYPES)
    unknown = known & (F.size(found) == 0)
    tail = F.hex(F.substring("content", -22, 22))
    comment = F.conv(F.concat(F.substring(tail, 43, 2), F.substring(tail, 41, 2)), 16, 10).cast("int")
    archive_broken = F.startswith(tail, F.lit("504B0506")) & (comment > 0)
    errors = F.array_compact(F.array(
        F.when(~known, "extension"), F.when(unknown & F.lit(strict), "unknown type"), F.when(known & (F.size(found) > 0) & ~F.array_contains(found, ext), "type mismatch"),
        F.when(F.col("length") == 0, "empty"), F.when(F.col("length") > int(max_mb * 1024 * 1024), "too large"), F.when((F.col("length") > 0) & (F.col("length") < 22), "truncated"), F.when(archive_broken, "archive end"),
    ))
    warnings = F.array_compact(F.array(F.when(unknown & F.lit(not strict), "unknown type")))
    return files.select("path", errors.alias("errors"), warnings.alias("warnings")).select("path", (F.size("errors") == 0).alias("is_valid"), "errors", "warnings")


AUDIT_SCHEMA = "event string, user_id string, timestamp string, file_name string, action string, error_type string, details string"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: JSON lines of all rotated files; malformed lines are skipped."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


PROFILE_SCHEMA = "name string, created_at string, updated_at string, industry string, amount_keywords array<string>, date_patterns array<string>, risk_rules map<string,string>, comparison_thresholds map<string,double>"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: profiles by name, a JSON file each."""
    return spark.read.schema(PROFILE_SCHEMA).option("multiLine", True).json(path).orderBy("name")
