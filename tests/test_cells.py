import datetime as dt

import pytest
from pyspark.sql import functions as F

from keyfold.functions import cells


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column("x").alias("y")).first()["y"]


@pytest.mark.parametrize("text, value", [
    ("$1,234.56", 1234.56), ("£50k", 50000.0), ("1.2M", 1200000.0), ("€1 234", 1234.0), ("2.5b", 2.5e9),
    ("-12.3k", -12300.0), ("1e3", 1000.0), ("N/A", None), ("TBD", None), (" - ", None), ("—", None), ("", None),
    (None, None), ("abc", None), ("1d", None), ("(500)", None), ("0x10", None), ("1.005", 1.0), ("2.675", 2.67),
])
def test_currency(spark, text, value):
    assert one(spark, text, cells.parse_currency) == value


def test_currency_without_billions(spark):
    assert one(spark, "2.5b", lambda c: cells.parse_currency(c, billions=False)) is None
    assert one(spark, "2.5m", lambda c: cells.parse_currency(c, billions=False)) == 2500000.0


@pytest.mark.parametrize("text, value", [
    ("Jan 15, 2024", dt.date(2024, 1, 15)), ("2023-06-01", dt.date(2023, 6, 1)), ("12/31/2025", dt.date(2025, 12, 31)),
    ("25/12/2024", dt.date(2024, 12, 25)), ("15 Jan 2024", dt.date(2024, 1, 15)), ("March 3rd 2021", dt.date(2021, 3, 3)),
    ("2024-01-15T10:00:00", dt.date(2024, 1, 15)), ("OCT 5, 2024 10:00", dt.date(2024, 10, 5)), ("20240115", dt.date(2024, 1, 15)),
    ("1/5/24", dt.date(2024, 1, 5)), ("1/5/71", dt.date(1971, 1, 5)), ("4/15/2025 to 4/14/2026", dt.date(2025, 4, 15)),
    ("4/15/2025 – 4/14/2026", dt.date(2025, 4, 15)), ("Auto-renew", None), ("evergreen", None), ("N/A", None), ("", None),
    ("2024-02-30", None), ("13/13/2020", None), ("Jan 2024", None), (None, None), ("May 9, 2020", dt.date(2020, 5, 9)),
    ("2024/3/7 - x to y", None), ("1/2/2024 TO 3/4/2025 - z", dt.date(2024, 1, 2)), ("5-Sep-2023", dt.date(2023, 9, 5)),
    ("Sept 15, 2024", dt.date(2024, 9, 15)), ("15-Jan-24", dt.date(2024, 1, 15)), ("Jan 15, 24", dt.date(2024, 1, 15)), ("Jan-15-2024", dt.date(2024, 1, 15)),
    ("Monday, January 15, 2024", dt.date(2024, 1, 15)), ("2024 Jan 15", dt.date(2024, 1, 15)), ("2024-Sep-05", dt.date(2024, 9, 5)), ("Tue 16 Jan 71", dt.date(1971, 1, 16)),
    ("15.01.2024", dt.date(2024, 1, 15)), ("2024", None), ("2024-05", None), ("Smith 12 2020", None),
])
def test_dates(spark, text, value):
    assert one(spark, text, cells.parse_date) == value


def test_range_takes_first_listed_separator(spark):
    df = spark.createDataFrame([("a - b to c",), ("a THRU b",), ("plain",)], "x string")
    start, end = cells.split_range("x")
    assert [tuple(r) for r in df.select(start, end).collect()] == [("a - b", "c"), ("a", "b"), ("plain", None)]


@pytest.mark.parametrize("text, value", [
    ("Yes", True), (" no", False), ("X", True), ("Checked", True), ("", False), ("0", False), ("maybe", None), (None, None)])
def test_booleans(spark, text, value):
    assert one(spark, text, cells.parse_boolean) is value


@pytest.mark.parametrize("text, hit", [
    ("#REF!", True), (" #div/0! ", True), ("#name?", True), ("#N/A", True), ("#REF", True), ("see #REF!", False), (None, False)])
def test_error_cells(spark, text, hit):
    assert one(spark, text, cells.is_error_cell) is hit


def test_auto_renew_words(spark):
    df = spark.createDataFrame([("Evergreen",), ("N/A",), (None,), ("2024-01-01",)], "x string")
    got = df.select(cells.is_auto_renew("x"), cells.is_auto_renew("x", also_na=True)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False), (False, False)]


def test_half_even_matches_array_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.12345,)], "x double")
    assert [r[0] for r in df.select(cells.half_even("x", 0)).collect()] == [0.0, 2.0, 2.0, 0.0]
    assert df.select(cells.half_even(F.lit(0.12345), 4)).first()[0] == 0.1234


def test_strip_takes_all_white_space(spark):
    assert one(spark, " \t a b \n", cells.strip) == "a b"


def test_names_are_expanded(spark):
    assert one(spark, " AWS ", cells.expand_name) == "amazon web services"
    assert one(spark, "Acme", cells.expand_name) == "acme"
