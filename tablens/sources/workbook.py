"""Workbooks (``.xlsx``): one task per file reads its cells, Spark shapes the table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import READ_FAILURES, ConfigurationError, DataLoadingError, EmptyDatasetError
from .delimited import _column_names
from .registry import register_reader

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# fixed values: built-in number formats that show dates or times
_DATE_FORMATS = frozenset([*range(14, 23), 45, 46, 47])
_CELLS = "path string, sheet string, sheet_id int, row_no bigint, cells array<string>"


def _part(book: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(book.read(name)) if name in book.namelist() else None


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    root = _part(book, "xl/sharedStrings.xml")
    return [] if root is None else [
        "".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root
    ]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date."""
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    dated = set(_DATE_FORMATS)
    for fmt in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.I):
            dated.add(int(fmt.get("numFmtId")))
    cells = root.find(f"{_MAIN}cellXfs")
    return set() if cells is None else {
        i for i, xf in enumerate(cells) if int(xf.get("numFmtId", 0)) in dated
    }


def _text(cell: ET.Element, strings: Sequence[str], dated: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    raw = cell.findtext(f"{_MAIN}v")
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dated:
        return str(datetime(1899, 12, 30) + timedelta(days=float(raw)))
    return raw


def _position(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _sheets(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """``(sheet, sheet_id, row_no, cells)`` of every row that has cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        links = {
            link.get("Id"): link.get("Target") for link in _part(book, "xl/_rels/workbook.xml.rels")
        }
        strings, dated = _shared_strings(book), _date_styles(book)
        listed = _part(book, "xl/workbook.xml").find(f"{_MAIN}sheets")
        for sheet_id, sheet in enumerate(listed, start=1):
            target = links[sheet.get(_LINK)].lstrip("/")
            name = target if target.startswith("xl/") else f"xl/{target}"
            with book.open(name) as stream:
                for _, row in ET.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    cells: list[str | None] = []
                    for cell in row.iter(f"{_MAIN}c"):
                        at = _position(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        cells[at] = _text(cell, strings, dated)
                    if cells:
                        yield sheet.get("name"), sheet_id, int(row.get("r") or 0), cells
                    row.clear()


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet, sheet_id, row_no, cells)`` of all rows of all workbooks below ``path``."""
    books = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xlsx")
        .load(path)
        .select("path", "content")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ["sheet", "sheet_id", "row_no", "cells"]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for row in _sheets(content):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=fields).assign(path=name)
                        rows = []
                yield pd.DataFrame(rows, columns=fields).assign(path=name)

    return books.mapInPandas(read, _CELLS)


@register_reader([".xlsx"], ["sheet_id", "sheet_name", "has_header"])
def read_workbooks(
    spark: SparkSession,
    path: str,
    sheet_id: int = 1,
    sheet_name: str | None = None,
    has_header: bool = True,
) -> DataFrame:
    """One sheet of every workbook below ``path`` as text columns.

    ``sheet_id=0`` stacks all sheets. Sheets whose columns differ are refused.
    """
    if sheet_id < 0:
        raise ConfigurationError(f"sheet_id must not be negative, got {sheet_id}")
    rows = workbook_rows(spark, path)
    if sheet_name is not None:
        rows = rows.where(F.col("sheet") == sheet_name)
    elif sheet_id:
        rows = rows.where(F.col("sheet_id") == sheet_id)
    try:
        # one record per sheet: where it starts, its first row and its width
        sheets = (
            rows.groupBy("path", "sheet")
            .agg(
                F.min("row_no").alias("start"),
                F.min_by("cells", "row_no").alias("first"),
                F.max(F.size("cells")).alias("width"),
                F.count("*").alias("n"),
            )
            .collect()
        )
    except READ_FAILURES as error:
        raise DataLoadingError(f"cannot read workbook {path}") from error
    if not sheets or all(s["n"] <= int(has_header) for s in sheets):
        raise EmptyDatasetError(f"{path} has no rows")
    layouts = {
        tuple(_column_names(s["first"] if has_header else [None] * s["width"], has_header))
        for s in sheets
    }
    if len(layouts) > 1:
        raise DataLoadingError(f"sheets of {path} have different columns: {sorted(layouts)}")
    names = layouts.pop()
    if has_header:
        starts = spark.createDataFrame(
            [(s["path"], s["sheet"], s["start"]) for s in sheets],
            "path string, sheet string, row_no bigint",
        )
        rows = rows.join(F.broadcast(starts), ["path", "sheet", "row_no"], "left_anti")
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def union_schema_checked(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables whose column names and types are equal; anything else is refused."""
    expected = [(f.name, f.dataType) for f in frames[0].schema.fields]
    for i, other in enumerate(frames[1:], start=2):
        got = [(f.name, f.dataType) for f in other.schema.fields]
        if [n for n, _ in got] != [n for n, _ in expected]:
            raise DataLoadingError(f"table {i} has other columns than the first")
        if got != expected:
            raise DataLoadingError(f"table {i} has other types than the first")
    return reduce(DataFrame.union, frames)
