"""Rows of workbooks (Office Open XML): a ZIP container of sheets and shared strings, read with the standard library alone."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(place: str) -> int:
    """The number (from 0) of the column of a place such as AB12."""
    n = 0
    for c in re.match("[A-Z]*", place).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _said(cell) -> str:
    return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))


def rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet's number, its name, row's number, cells as strings) of all rows that a workbook holds; numbers as they are written there."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_said(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), 1):
            target = targets[sheet.get(_LINK)]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            with z.open(path) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    cells: list[str] = []
                    for cell in row.iter(f"{_MAIN}c"):
                        at = _column(cell.get("r") or "")
                        at = len(cells) if at < 0 else at
                        cells += [""] * (at - len(cells))
                        value = cell.find(f"{_MAIN}v")
                        kind = cell.get("t")
                        text = _said(cell) if kind == "inlineStr" else "" if value is None else value.text or ""
                        cells.append(shared[int(text)] if kind == "s" and text else {"1": "True", "0": "False"}.get(text, text) if kind == "b" else text)
                    yield number, sheet.get("name") or f"sheet{number}", int(row.get("r") or 0), cells
                    row.clear()


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), sheet_no, sheet, row_idx, cells of the .xlsx, .xlsm and zipped .xls files below path; one file is read by one task."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    books = files.where(F.lower("path").rlike(r"\.xls[xm]?$") & (F.substring("content", 1, 2) == F.lit(b"PK"))).select("path", "content")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in rows(bytes(c))]
            yield pd.DataFrame(found, columns=["doc_id", "sheet_no", "sheet", "row_idx", "cells"])

    return books.mapInPandas(run, "doc_id string, sheet_no int, sheet string, row_idx int, cells array<string>")
