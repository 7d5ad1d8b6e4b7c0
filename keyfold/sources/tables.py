"""Reading text tables as sheets: every cell text, 'no value' spellings null."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keyfold.functions.cells import na_to_null
from keyfold.model import ORD, Sheet, data_columns
from keyfold.operators.mapping import split_composite_headers

_UNNAMED = re.compile(r"^(unnamed.*|_c\d+)$", re.IGNORECASE)
PROVENANCE_FILE, PROVENANCE_TAB = "meta_source_file", "meta_source_tab"
FILE_ROWS = 42  # bits of a row's number in its file


def named_columns(df: DataFrame) -> list[str]:
    """Columns with a real header."""
    return [c for c in data_columns(df) if c.strip() and not _UNNAMED.match(c.strip())]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Without rows that are null in every data column."""
    return df.na.drop(how="all", subset=[c for c in data_columns(df) if not c.startswith("meta_")])


def tidy_headers(df: DataFrame) -> DataFrame:
    """Only named columns, header names stripped."""
    kept = named_columns(df)
    extra = [F.col(ORD)] if ORD in df.columns else []
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in kept], *extra)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null in every row (one aggregate row tells which)."""
    columns = data_columns(df)
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return df.drop(*[F.col(f"`{c}`") for i, c in enumerate(columns) if row[i] == 0])


def clean_frame(df: DataFrame) -> DataFrame:
    """Tidy headers, no empty rows, no empty columns, composite headers cut to their last part."""
    return split_composite_headers(drop_empty_columns(drop_empty_rows(tidy_headers(df))))


def sheet_verdict(df: DataFrame) -> tuple[bool, str]:
    """Whether a sheet is a data table: at least two named columns, and at least half of
    all; and at least one non-empty row."""
    total, named = len(data_columns(df)), len(named_columns(df))
    if named < 2 or (total and named / total < 0.5):
        return False, "looks like a pivot table"
    if drop_empty_rows(df).isEmpty():
        return False, "empty"
    return True, ""


def sheet_report(sheets: Sequence[Sheet]) -> DataFrame:
    """(sheet, kept, reason)."""
    rows = [(s.name, *sheet_verdict(s.df)) for s in sheets]
    return sheets[0].df.sparkSession.createDataFrame(rows, "sheet string, kept boolean, reason string")


def keep_data_sheets(sheets: Sequence[Sheet]) -> list[Sheet]:
    """Data tables only, with tidy headers and without empty rows."""
    return [s.with_df(drop_empty_rows(tidy_headers(s.df))) for s in sheets if sheet_verdict(s.df)[0]]


def _with_file_order(rows: DataFrame) -> DataFrame:
    """Add the ordinal: number of the file (by path) and of the row in it, the same for any
    split size. Rows count on within a block of a file; the rows of the blocks before it are
    counted by a read without columns."""
    here = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                       F.monotonically_increasing_id().alias("__row"))
    of_file = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = here.groupBy("__file", "__block").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    files = blocks.groupBy("__file").agg(F.lit(1)).select("__file", F.row_number().over(Window.orderBy("__file")).alias("__number"))  # a row per file
    starts = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(of_file), F.lit(0))).join(files, "__file").select(
        "__file", "__block", (F.lit(1 << FILE_ROWS) * F.col("__number") + F.col("__before") - F.col("__first")).alias("__start"))
    found = here.join(starts, ["__file", "__block"], "left")
    missing = F.raise_error(F.lit("a file changed while it was read")).cast("bigint")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.col("__start") + F.col("__row"), missing).alias(ORD))


PLACE_BITS = 16  # of a row's ordinal; ordinals that differ only in them are ranked together


def with_place(df: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows from 1 in the order of their ordinals, without gaps.

    Rows are counted per range of ordinals, the counts (one row per range) are added up, and
    each range is ranked by itself: a range holds 2**PLACE_BITS ordinals of one file, however long that is.
    Rows without an ordinal come first."""
    at = F.shiftright(F.col(ORD), PLACE_BITS)
    sizes = df.groupBy(at.alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    ranked = df.withColumn("__range", at)
    here = F.row_number().over(Window.partitionBy("__range").orderBy(ORD))
    found = ranked.withColumn("__here", here).alias("r").join(F.broadcast(starts.alias("s")), F.expr("r.__range <=> s.__range"))
    return found.select((F.col("__before") + F.col("__here")).cast("bigint").alias(name), *[F.col(f"r.`{c}`") for c in df.columns])


def read_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool = False,
             provenance: bool = False, ordinal: bool = True) -> DataFrame:
    """CSV file(s) of one layout: header line, all text.

    Files are split and read in parallel; multiline=True allows quoted line breaks, at one
    task per file. The ordinal is the row's place in its file and the file's place among
    the paths, whatever the split size; ordinal=False leaves it and its count out."""
    raw = spark.read.options(header=True, multiLine=multiline, escape='"', encoding="UTF-8").csv(path)
    cells = [na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns]
    extra = [F.lit("csv").alias(PROVENANCE_TAB), F.col("_metadata.file_name").alias(PROVENANCE_FILE)] if provenance else []
    rows = _with_file_order(raw) if ordinal else raw
    return drop_empty_rows(tidy_headers(rows.select(*cells, *extra, *([F.col(ORD)] if ordinal else []))))


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Sorted paths of the files with a suffix, on any file system Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return sorted(r["path"] for r in found.collect())


def scan_folder(spark: SparkSession, folder: str, multiline: bool = False) -> list[Sheet]:
    """Every .csv file and every sheet of the workbooks of a folder, in file order."""
    from keyfold.sources.workbooks import read_workbooks

    sheets = []
    for path in list_files(spark, folder, ".csv"):
        name = os.path.basename(path)
        raw = spark.read.options(header=True, multiLine=multiline, escape='"', encoding="UTF-8").csv(path)
        rows = _with_file_order(raw).select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns], ORD)
        sheets.append(Sheet(os.path.splitext(name)[0], rows, name))
    if list_files(spark, folder, ".xlsx"):
        sheets += read_workbooks(spark, folder)
    return sheets


def read_folder(spark: SparkSession, folder: str, multiline: bool = False) -> list[Sheet]:
    """The data sheets of a folder's files; `sheet_report(scan_folder(...))` names the skipped ones."""
    return keep_data_sheets(scan_folder(spark, folder, multiline))


def read_any(spark: SparkSession, path: str, multiline: bool = False) -> list[Sheet]:
    """Sheets of one file, by extension."""
    from keyfold.sources.workbooks import read_workbooks

    stem, suffix = os.path.splitext(os.path.basename(path.rstrip("/")))
    if suffix.lower() == ".csv":
        return [Sheet(stem, read_csv(spark, path, multiline), os.path.basename(path))]
    if suffix.lower() == ".xlsx":
        return keep_data_sheets(read_workbooks(spark, path))
    if suffix.lower() == ".parquet":
        return [Sheet(stem, spark.read.parquet(path), os.path.basename(path))]
    raise ValueError(f"unsupported file type: {suffix or path}")
