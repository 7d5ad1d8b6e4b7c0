"""Column-wise cleaning of text tables. All steps are projections, which Spark collapses
into one; only the yes/no test needs a look at the data (one aggregate row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from keyfold import fixed
from keyfold.functions import cells
from keyfold.operators.derive import ieee_divide
from keyfold.operators.profile import long_text

AUTO_RENEW_COL = "is_auto_renew"
_GENERIC_SEPARATORS = fixed.RANGE_SEPARATORS[:4]


def text_columns(df: DataFrame) -> list[str]:
    """Text columns that hold data (no provenance, no internal column)."""
    return [f.name for f in df.schema
            if f.dataType.typeName() == "string" and not f.name.startswith(("meta_", "_"))]


def sanitize_errors(df: DataFrame) -> DataFrame:
    """Spreadsheet error cells become null."""
    return df.withColumns({c: cells.error_to_null(c) for c in text_columns(df)})


def error_counts(df: DataFrame) -> DataFrame:
    """(column, n_errors) for every text column."""
    return long_text(df, text_columns(df)).groupBy("column").agg(
        F.count_if(cells.is_error_cell("value")).alias("n_errors"))


def split_date_range_columns(df: DataFrame) -> DataFrame:
    """A '...date...range...' column becomes Effective_Date and Expiry_Date, unless the
    table has them; the range column is dropped."""
    for c in [c for c in df.columns if "range" in c.lower() and "date" in c.lower()]:
        start, end = cells.split_range(c)
        new = {"Effective_Date": cells.single_date(start), "Expiry_Date": cells.single_date(end)}
        df = df.withColumns({n: e for n, e in new.items() if n not in df.columns}).drop(c)
    return df


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns
            if c in fixed.CLEAN_DATE_COLS or ("date" in c.lower() and "range" not in c.lower())]


def normalize_dates(df: DataFrame) -> DataFrame:
    """Date columns become dates; a cell that says 'auto-renew' (or N/A) becomes null and
    sets is_auto_renew."""
    df = split_date_range_columns(df)
    columns = [c for c in date_columns(df) if df.schema[c].dataType.typeName() == "string"]
    flag = F.coalesce(F.col(AUTO_RENEW_COL), F.lit(False)) if AUTO_RENEW_COL in df.columns else F.lit(False)
    for c in columns:
        flag = flag | cells.is_auto_renew(c, also_na=True)
    return df.withColumns({
        AUTO_RENEW_COL: flag, **{c: cells.parse_date(c, _GENERIC_SEPARATORS) for c in columns}})


def money_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("meta_") and c != AUTO_RENEW_COL and (
        c in fixed.CLEAN_MONEY_COLS or any(k in c.lower() for k in fixed.CLEAN_MONEY_HINTS))]


def scrub_financials(df: DataFrame) -> DataFrame:
    """Money columns become numbers; a missing ACV is total / months x 12."""
    df = df.withColumns({c: cells.parse_currency(c, billions=False) for c in money_columns(df)})
    if "Total_Value" in df.columns and "Term_Months" in df.columns:
        yearly = ieee_divide(F.col("Total_Value"), cells.as_number(df, "Term_Months")) * 12
        acv = F.col("ACV") if "ACV" in df.columns else F.lit(None).cast("double")
        df = df.withColumn("ACV", F.coalesce(acv, cells.half_even(yearly, 2)))
    return df


def boolean_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Text columns with at least one value whose every value is a yes/no word."""
    columns = [c for c in (columns or text_columns(df)) if c != AUTO_RENEW_COL]
    if not columns:
        return []
    verdict = long_text(df, columns).groupBy("column").agg(F.bool_and(cells.is_boolean_text("value")).alias("ok"))
    found = {r["column"] for r in verdict.where("ok").collect()}  # one row per column
    return [c for c in columns if c in found]


def standardize_booleans(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Yes/no columns become booleans; pass `columns` to skip the test."""
    columns = boolean_columns(df) if columns is None else columns
    return df.withColumns({c: cells.parse_boolean(c) for c in columns})


def clean_table(df: DataFrame, booleans: Sequence[str] | None = None) -> DataFrame:
    """Error cells, then dates, then money, then yes/no columns."""
    df = scrub_financials(normalize_dates(sanitize_errors(df)))
    return standardize_booleans(df, booleans)
