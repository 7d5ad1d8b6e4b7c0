import datetime as dt

import pytest
from pyspark.sql import functions as F

from keyfold.model import ORD, Sheet
from keyfold.operators import clean, derive, rollup
from keyfold.plans import consolidate



@pytest.fixture
def lines(spark):
    return spark.createDataFrame([
        (1, "C1", None, 10.0, "b", None, 5.0), (2, "C1", "v1", 20.5, "a", True, None), (3, "C1", "v2", None, "b", False, 7.0),
        (4, "C2", None, None, None, None, None), (5, None, "v9", 3.0, "z", None, 1.0)],
        f"{ORD} long, contract_id string, vendor string, total_value double, product string, auto_renew boolean, other double")


def test_rollup_methods(lines):
    got = {r["contract_id"]: r for r in rollup.rollup(lines).collect()}
    assert got["C1"].asDict() == {"contract_id": "C1", "vendor": "v1", "total_value": 30.5, "product": "b | a",
                                  "auto_renew": True, "other": 12.0, "line_item_count": 3}
    # nothing but nulls: sums are 0, joined values blank
    assert (got["C2"]["total_value"], got["C2"]["product"], got["C2"]["vendor"]) == (0.0, "", None)
    assert (got[None]["total_value"], got[None]["line_item_count"]) == (3.0, 1)


def test_every_method(spark):
    df = spark.createDataFrame([(1, "k", 1.0, None), (2, "k", 4.0, "x"), (3, "k", None, " ")], f"{ORD} long, k string, v double, t string")
    rules = {"v": "mean", "t": "collect_unique"}
    assert rollup.group_aggregate(df, ["k"], rules, F.col(ORD)).first()[1:] == (2.5, "x")
    for method, value in [("min", 1.0), ("max", 4.0), ("count", 3), ("first", 1.0), ("sum", 5.0), ("odd", 1.0)]:
        assert rollup.group_aggregate(df, ["k"], {"v": method}, F.col(ORD)).first()["v"] == value


def test_rollup_is_independent_of_partitioning(lines, rows):
    assert rows(rollup.rollup(lines.repartition(5))) == rows(rollup.rollup(lines.coalesce(1)))


def test_rows_without_a_key_come_out_as_they_were(spark, rows):
    """Also equal rows of one order, blanks of joined columns, missing numbers and lineage columns."""
    df = spark.createDataFrame([
        (1, None, "v", None, " ", "p1", 4), (1, None, "v", None, " ", "p1", 4), (2, None, None, 2.0, None, "p2", None), (3, "C1", "v", 1.0, " ", "p3", 1),
        (3, "C1", None, None, "b", "p4", 2), (5, "C1", "w", 2.0, "b", "p5", 3), (6, "C1", "w", 2.0, "a\t", "p5", 3), (7, "C2", None, None, None, "p6", None)],
        f"{ORD} long, contract_id string, vendor string, total_value double, product string, row_lineage_id string, other int")
    got = rollup.rollup(df)
    assert got.columns == ["contract_id", "vendor", "total_value", "product", "other", "line_item_count", "row_lineage_id"]
    assert rows(got) == sorted([
        (None, "v", None, " ", 4, 1, "p1"), (None, "v", None, " ", 4, 1, "p1"), (None, None, 2.0, None, None, 1, "p2"),
        ("C1", "v", 5.0, "b | a\t", 9, 4, None), ("C2", None, 0.0, "", 0, 1, None)], key=repr)


def test_rollup_reads_its_source_once(spark, lines, tmp_path):
    lines.write.parquet(str(tmp_path / "lines"))
    plan = rollup.rollup(spark.read.parquet(str(tmp_path / "lines")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_joined_values_take_one_aggregate_unless_a_key_has_many_lines(spark, rows, monkeypatch):
    """Both plans give the same, also with missing and equal places, blanks and rows without a key."""
    df = spark.createDataFrame([
        (None, "k", "b", 1.0, "p"), (5, "k", "b", 2.0, None), (None, "k", "z", None, "q"), (None, "k", "y", 1.0, "p"), (7, "k", "a", 4.0, " "),
        (7, "k", "c", None, "r"), (3, "k", " ", 1.0, "q"), (2, "k", None, 1.0, "p"), (9, "k", "a", 0.5, "q"), (1, "l", None, None, None),
        (None, None, " ", 3.0, "p"), (None, None, " ", 3.0, "p"), (4, None, None, None, ""), (None, "m", "x", 1.0, "p")],
        f"{ORD} long, contract_id string, product string, total_value double, notes string")
    few = rollup.rollup(df)
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(few) == 1
    got = {r["contract_id"]: r["product"] for r in few.collect()}
    assert (got["k"], got["l"], got["m"]) == ("y | z | b | a | c", "", "x")
    quotes = lambda: rows(rollup.group_aggregate(df.where("contract_id is not null"), ["contract_id"], {"product": "collect_unique", "notes": "collect_unique"},
                                                 F.col(ORD), "n", keep_blank=True))
    kept = quotes()
    monkeypatch.setattr(rollup, "FEW_LINES", 8)
    many = rollup.rollup(df)
    assert shuffles(many) == 2
    assert rows(few) == rows(many) and kept == quotes()


def test_joined_cells_are_judged_before_the_aggregate(lines):
    """Blanks are told apart once per row, each joined column is collected once, and a row
    without a key carries its own cells in one value."""
    plan = rollup.rollup(lines)._jdf.queryExecution().optimizedPlan().toString()
    whole = " ".join(line for line in plan.splitlines() if "Aggregate" in line)
    assert whole.count("collect_") == 1 and "trim" not in whole and whole.count("first(") == 1


def test_blank_text(spark):
    df = spark.createDataFrame([("",), (" \t\u00a0\n",), (" a ",), ("\u3000x",), (None,)], "t string")
    assert [r[0] for r in df.select(rollup.is_blank(F.col("t"))).collect()] == [True, True, False, False, None]


def test_rolled_up_sheets_are_computed_once(spark, lines):
    """Records and line items read the same staged sheet; a column that cannot be stored keeps it as it is."""
    names = spark.createDataFrame([("C1", "n1"), ("C2", "n2")], "contract_id string, name string")
    out, items = rollup.rollup_sheets({"lines": lines.join(names, "contract_id", "left")}, levels={"lines": "line_item_level"})
    for df in (out["lines"], items):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert items.count() == 5 and {r["name"] for r in out["lines"].collect()} == {"n1", "n2", None}
    odd = lines.withColumn("nothing", F.lit(None))
    out, items = rollup.rollup_sheets({"lines": odd}, levels={"lines": "line_item_level"})
    assert items.count() == 5 and out["lines"].count() == 3


def test_grain(spark, lines):
    assert rollup.classify_grain(lines).first()["level"] == "mixed"
    unique = spark.range(20).select(F.col("id").cast("string").alias("contract_id"))
    assert rollup.classify_grain(unique).first()["level"] == "contract_level"
    assert rollup.classify_grain(unique.select(F.lit("a").alias("contract_id"))).first()["level"] == "line_item_level"
    nulls = unique.select(F.lit(None).cast("string").alias("contract_id"))
    assert rollup.classify_grain(nulls).first()["level"] == "mixed"
    assert rollup.classify_grain(unique.select(F.lit(1).alias("x"))).first()["level"] == "mixed"


def test_quote_lines(spark):
    df = spark.createDataFrame([
        (1, "C001", "2024-01-01", 1000, "A", "t1"), (2, "C001", "2024-01-01", 2000, "B", "t2"), (3, "C002", "2024-01-01", 5, None, "t1"),
        (4, "C003", None, 7, "D", "t1")], f"{ORD} long, Contract_ID string, Contract_Close_Date string, ACV int, Product string, meta_source_tab string")
    got = {r["Contract_ID"]: r for r in rollup.merge_quote_lines(df).collect()}
    assert (got["C001"]["ACV"], got["C001"]["Product"], got["C001"]["meta_source_tab"]) == (3000, "A", "t1 | t2")
    assert got["C003"]["ACV"] == 7 and len(got) == 3


def test_pure_booleans_are_summed(spark):
    df = spark.range(4).select(F.col("id").alias(ORD), F.lit("c").alias("Contract_ID"), (F.col("id") > 1).alias("flag"))
    assert rollup.merge_quote_lines(df).first()["flag"] == 2


def test_key_columns_are_found_by_keyword():
    assert rollup.find_column(["x", "contract_id"], "Contract_ID", []) == "contract_id"
    assert rollup.find_column(["My Quote # no", "Deal ID"], "Contract_ID", ["deal id", "quote #"]) == "Deal ID"
    assert rollup.find_column(["a"], "b", ["c"]) is None


def test_deduplicate_keeps_the_fullest_then_first(spark, rows):
    df = spark.createDataFrame([(1, "v", None, None), (2, "v", "n", None), (3, "v", None, "m"), (4, None, "q", None), (5, None, None, None)],
                               f"{ORD} long, Vendor_Canonical string, Notes string, More string")
    assert rows(rollup.deduplicate(df).drop(ORD)) == sorted([("v", "n", None), (None, "q", None)], key=repr)
    assert rollup.deduplicate(df, ["absent"]).count() == 5
    assert rollup.duplicate_counts(df, "Vendor_Canonical").first()[:] == (3, 2)


def test_dates_set_the_auto_renew_flag(spark):
    df = spark.createDataFrame([("Jan 15, 2024", "Auto-renew"), ("2023-06-01", "1/2/2024"), ("12/31/2025", "N/A")],
                               "Effective_Date string, Renewal_Date string")
    got = clean.normalize_dates(df).collect()
    assert [r["Effective_Date"] for r in got] == [dt.date(2024, 1, 15), dt.date(2023, 6, 1), dt.date(2025, 12, 31)]
    assert [(r["Renewal_Date"], r["is_auto_renew"]) for r in got] == [(None, True), (dt.date(2024, 1, 2), False), (None, True)]


def test_range_column_is_split(spark):
    df = spark.createDataFrame([("4/15/2025 to 4/14/2026",), ("6/1/2025",)], "`Contract Date Range` string")
    got = clean.normalize_dates(df).select("Effective_Date", "Expiry_Date").collect()
    assert [tuple(r) for r in got] == [(dt.date(2025, 4, 15), dt.date(2026, 4, 14)), (dt.date(2025, 6, 1), None)]


def test_money_and_imputed_acv(spark):
    df = spark.createDataFrame([("$120,000", "24", None), ("100", "0", None), ("5", None, "N/A"), ("7", "12", "£1k")],
                               "Total_Value string, Term_Months string, ACV string")
    assert [r["ACV"] for r in clean.scrub_financials(df).collect()] == [60000.0, float("inf"), None, 1000.0]


def test_boolean_columns_need_only_boolean_words(spark):
    df = spark.createDataFrame([("Yes", "Yes", None), ("Checked", "other", None)], "a string, b string, c string")
    assert clean.boolean_columns(df) == ["a"]
    assert [r["a"] for r in clean.standardize_booleans(df).collect()] == [True, True]


def test_errors_are_counted_and_removed(spark):
    df = spark.createDataFrame([("#REF!", "x"), ("1", "#NAME?"), ("#DIV/0!", "y")], "ACV string, Vendor string")
    assert {r["column"]: r["n_errors"] for r in clean.error_counts(df).collect()} == {"ACV": 2, "Vendor": 1}
    assert [tuple(r) for r in clean.sanitize_errors(df).collect()] == [(None, "x"), ("1", None), (None, "y")]


def test_derived_fields(spark):
    df = spark.createDataFrame([
        ("2024-01-01", "2025-01-01", 1200, 12.0, None, None), ("2024-01-01", "2024-01-01", 5, 0.0, True, None),
        ("2024-05-01", None, None, 3.0, False, dt.date(2030, 1, 1)), ("2024-01-01", "2024-01-01", 0, 0.0, None, None)],
        "start_date string, end_date string, total_value int, term_months double, auto_renew boolean, renewal_date date")
    got = derive.derive_fields(df, as_of=F.lit(dt.date(2026, 1, 1))).collect()
    assert [r["contract_duration_days"] for r in got] == [366, 0, None, 0]
    assert [r["duration_years"] for r in got] == [1.0021, 0.0, None, 0.0]
    assert [r["annualized_value"] for r in got] == [1197.4853, None, None, None]
    assert [r["monthly_value"] for r in got] == [100.0, None, None, None]
    assert [r["churn_flag"] for r in got] == [True, False, False, True]
    assert [r["renewal_flag"] for r in got] == [False, True, True, False]


def test_boolean_expressions_know_today(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2026, 1, 1)), (3, None)], "id int, end_date date")
    rules = {"late": {"operation": "boolean_expression", "expression": "coalesce(end_date < today, false)"}, "gone": {"operation": "boolean_expression", "expression": "nowhere > 1"}}
    out = derive.derive_fields(df, rules, F.to_date(F.lit("2025-01-01")))
    assert out.columns == ["id", "end_date", "late", "gone"]
    assert {r["id"]: (r["late"], r["gone"]) for r in out.collect()} == {1: (True, None), 2: (False, None), 3: (False, None)}


def test_divide_by_zero_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, 3.0)], "a double, b double")
    rules = {"q": {"operation": "divide", "numerator": "a", "denominator": "b"},
             "s": {"operation": "safe_divide", "numerator": "a", "denominator": "b", "fallback": 9},
             "m": {"operation": "divide", "numerator": "gone", "denominator": 2},
             "e": {"operation": "boolean_expression", "expression": "a > b"},
             "x": {"operation": "boolean_expression", "expression": "nowhere > 1"},
             "u": {"operation": "unheard_of"}}
    out = derive.derive_fields(df, rules)
    assert out.columns == ["a", "b", "q", "s", "m", "e", "x"]
    got = out.collect()
    assert [r["q"] for r in got] == [float("inf"), float("-inf"), None, None, 0.3333]
    assert [r["s"] for r in got] == [9.0, 9.0, None, None, 0.3333]
    assert {r["m"] for r in got} == {None} and {r["x"] for r in got} == {None}
    assert [r["e"] for r in got] == [True, False, False, None, False]


def test_cleaner_chain(spark):
    a = spark.createDataFrame([
        ("C001", "Jan 15, 2024", "AWS", "$1,000", "Yes"), ("C001", "1/15/2024", "AWS", "2k", "Yes"), ("C002", "2024-02-01", "Amazon Web Services", "#REF!", "no")],
        "`Contract No` string, Signed string, Supplier string, Cost string, Renew string")
    b = spark.createDataFrame([("C009", "2024-03-01", "Google Cloud", "5", "x")], "Ref string, `Close Date` string, Vendor string, Price string, `Auto Renew` string")
    names = ["Contract_ID", "Contract_Close_Date", "Vendor", "ACV", "Auto_Renew"]
    headers = {"a": dict(zip(a.columns, names)), "b": dict(zip(b.columns, names))}
    out = consolidate.clean_chain([Sheet("a", a.withColumn(ORD, F.monotonically_increasing_id())), Sheet("b", b.withColumn(ORD, F.lit(0)))], headers)
    got = {r["Contract_ID"]: r for r in out.collect()}
    assert set(got) == {"C001", "C002", "C009"}
    assert got["C001"]["ACV"] == 3000.0 and got["C001"]["Contract_Close_Date"] == dt.date(2024, 1, 15)
    assert got["C001"]["Vendor_Canonical"] == got["C002"]["Vendor_Canonical"] == "AWS"
    assert got["C009"]["Vendor_Cluster_ID"] == "1"
