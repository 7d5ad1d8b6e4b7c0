"""Reading a folder of .xlsx workbooks in parallel, one file per task record.

A workbook sheet holds at most 1,048,576 rows, so one file fits a task. The parsed rows
are written once under the shared working folder, partitioned by file and sheet; the
sheets returned read their own partition only. An unreadable file or sheet is skipped
and listed in the error table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from keyfold.functions.cells import na_to_null
from keyfold.model import ORD, Sheet
from keyfold.session import work_folder

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS = "path string, file string, sheet string, sheet_no int, row_idx bigint, cells array<string>, error string"
_BATCH = 20_000
# fixed values of the file format: number formats that show a date
_DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(_NS + "t")) for item in root.iter(_NS + "si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    ids = set(_DATE_FORMAT_IDS)
    for fmt in root.iter(_NS + "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", fmt.get("formatCode", "")).lower()
        if re.search(r"[ymdh]", code):
            ids.add(int(fmt.get("numFmtId")))
    formats = root.find(_NS + "cellXfs")
    return {i for i, xf in enumerate(formats if formats is not None else []) if int(xf.get("numFmtId", 0)) in ids}


def _cell_text(cell, texts: list[str], date_styles: set[int]) -> str | None:
    kind, value = cell.get("t"), cell.find(_NS + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_NS + "t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return texts[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind in ("str", "e", "d"):
        return value.text
    number = float(value.text)
    if int(cell.get("s", 0)) in date_styles:
        return str(datetime(1899, 12, 30) + timedelta(days=number))
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _sheet_rows(book: zipfile.ZipFile, part: str, texts: list[str], dates: set[int]) -> Iterator[tuple[int, list]]:
    with book.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != _NS + "row":
                continue
            cells: list[str | None] = []
            for cell in row.iter(_NS + "c"):
                at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([None] * (at + 1 - len(cells)))
                cells[at] = _cell_text(cell, texts, dates)
            if any(c is not None for c in cells):
                yield int(row.get("r", 0)), cells
            row.clear()


def _parse_book(file: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        texts, dates = _texts(book), _date_styles(book)
        for no, entry in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_NS + "sheet")):
            target = links[entry.get(_REL)].lstrip("/")
            try:
                for idx, cells in _sheet_rows(book, target if target.startswith("xl/") else f"xl/{target}", texts, dates):
                    yield file, entry.get("name"), no, idx, cells, None
            except Exception as exc:  # a broken sheet does not stop the others
                yield file, entry.get("name"), no, None, None, str(exc)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "file", "sheet", "sheet_no", "row_idx", "cells", "error"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            file, buffer = path.rsplit("/", 1)[-1], []
            try:
                for row in _parse_book(file, content):
                    buffer.append((path, *row))
                    if len(buffer) == _BATCH:
                        yield pd.DataFrame(buffer, columns=columns).astype({"row_idx": "Int64"})
                        buffer = []
            except Exception as exc:  # not a workbook
                buffer.append((path, file, None, None, None, None, str(exc)))
            if buffer:
                yield pd.DataFrame(buffer, columns=columns).astype({"row_idx": "Int64", "sheet_no": "Int64"})


def parse_workbooks(spark: SparkSession, path: str):
    """(path, file, sheet, sheet_no, row_idx, cells, error) of every workbook under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(_parse, _ROWS)


def read_workbooks(spark: SparkSession, path: str) -> list[Sheet]:
    """One sheet per workbook tab that has a header row and was read to its end; tabs that
    break off are left out whole, and parse_workbooks lists their errors. Names are
    file:tab when several files are read, with the whole path where files share a name."""
    table = work_folder(spark, "workbooks")
    parse_workbooks(spark, path).write.partitionBy("path", "sheet").parquet(table)
    rows = spark.read.schema(_ROWS).parquet(table)  # else tabs such as 2024 become numbers
    whole = F.count_if(F.col("error").isNotNull()) == 0
    heads = (
        rows.where("sheet is not null").groupBy("path", "sheet")
        .agg(F.min_by(F.struct("sheet_no", "row_idx", "cells"), "row_idx").alias("h"), F.max(F.size("cells")).alias("width"), whole.alias("whole"))
        .where("whole and h.row_idx is not null").orderBy("path", "h.sheet_no").collect()  # one row per tab
    )
    paths = {h["path"] for h in heads}
    short = {path: path.rsplit("/", 1)[-1] for path in paths}
    names_of_files = short if len(set(short.values())) == len(paths) else {path: path for path in paths}
    sheets = []
    for h in heads:
        header = list(h["h"]["cells"]) + [None] * (h["width"] - len(h["h"]["cells"]))
        names, used = [], {}
        for i, text in enumerate(header):
            name = text if text and text.strip() else f"Unnamed: {i}"
            used[name] = used.get(name, -1) + 1
            names.append(name if used[name] == 0 else f"{name}.{used[name]}")
        body = rows.where((F.col("path") == h["path"]) & (F.col("sheet") == h["sheet"]) & F.col("error").isNull()
                          & (F.col("row_idx") > h["h"]["row_idx"]))
        df = body.select(*[na_to_null(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)],
                         F.col("row_idx").alias(ORD))
        sheets.append(Sheet(f"{names_of_files[h['path']]}:{h['sheet']}" if len(paths) > 1 else h["sheet"], df, short[h["path"]]))
    return sheets
