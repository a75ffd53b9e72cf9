"""Spreadsheets (xlsx) as rows: a zip archive of XML parts, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_COLUMN = re.compile(r"[A-Z]+")


def _column(reference: str) -> int:
    """0 for A, 26 for AA."""
    out = 0
    for c in _COLUMN.match(reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def sheet_rows(data: bytes, sheet: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, values as text) of one sheet, without its first row; rows that are not there are left out.

    A cell without a value is null; so is one between two cells that is not stored.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                values: list[str | None] = []
                for cell in row:
                    at = _column(cell.get("r")) if cell.get("r") else len(values)
                    values += [None] * (at - len(values))
                    text = cell.findtext(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif cell.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    values.append(text)
                if int(row.get("r")) > 1:
                    yield int(row.get("r")), values
                row.clear()


def read_workbooks(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """``path, row, cells`` of every workbook at ``path`` (a file, a folder, a pattern); each file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(sheet_rows(data, sheet))
                yield pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))], ["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, cells array<string>")


def workbook(rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet with these rows as inline text: small tables only."""
    body = []
    for k, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{_letters(j)}{k}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(row) if v is not None)
        body.append(f'<row r="{k}">{cells}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def _letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through Spark's own file systems, so that executors can read it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(data))
    stream.close()
