import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from keyfold import fixed
from keyfold.model import ORD, Sheet
from keyfold.operators import checks, mlready, profile


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_column_profile(spark):
    df = spark.createDataFrame([("1", "a", 1.0), ("2", " ", 1.0), (None, "b", None), ("2", "a", 3.0)], "id string, t string, n double")
    got = by_column(profile.profile_columns(df))
    assert (got["id"]["null_count"], got["id"]["null_pct"], got["id"]["unique_count"], got["id"]["uniqueness_ratio"]) == (1, 25.0, 2, 0.5)
    assert got["t"]["null_count"] == 1 and got["t"]["unique_count"] == 3
    assert got["n"]["inferred_type"] == "double"


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert {c: (r["n_rows"], r["null_pct"]) for c, r in by_column(profile.profile_columns(df)).items()} == {"a": (0, 0.0), "b": (0, 0.0)}
    assert by_column(profile.completeness(df))["a"]["pct"] == 0.0


def test_top_values_break_ties_by_first_seen(spark):
    values = ["x", "y", "y", "z", "x", "q", "r", "s", "t"]
    df = spark.createDataFrame(list(enumerate(values)), f"{ORD} long, v string")
    assert [r["value"] for r in profile.top_values(df).orderBy("rank").collect()] == ["x", "y", "z", "q", "r"]
    assert by_column(profile.distinct_samples(df, k=3))["v"]["samples"] == ["x", "y", "z"]


def test_random_sample_ignores_partitioning(spark, rows):
    df = spark.range(500).select(F.col("id").alias(ORD), F.concat(F.lit(" v"), F.col("id")).alias("v"))
    a = rows(profile.random_sample(df, "v", 20))
    assert len(a) == 20 and a == rows(profile.random_sample(df.repartition(9), "v", 20))
    assert a != rows(profile.random_sample(df, "v", 20, seed=1))


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0, -1.0, 0.0], [2.0] * 10 + [7.0], [-4.5, -4.25, 1e12, 1e-9, 0.0, -0.0, 3.5, 3.5],
    [random.Random(5).uniform(-1e3, 1e6) for _ in range(1001)], [1000 + i / 1000 for i in range(400)]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    assert profile.exact_medians(df, ["v"]).first()["median"] == statistics.median(values)


def test_medians_of_one_binade_are_refined(spark, monkeypatch):
    """Epoch numbers share their power of two; intervals are split until few rows are left."""
    monkeypatch.setattr(profile, "SMALL", 3)
    monkeypatch.setattr(profile, "SPLITS", 8)
    rng = random.Random(2)
    columns = {"epoch": [1.6e9 + rng.randrange(10**7) for _ in range(600)], "odd": [1e300, -1e300, 5e-324, 0.0, 1e-310, 2.0, float("inf")] * 3,
               "same": [7.25] * 50, "ties": [1.0 + i % 2 * 2**-52 for i in range(41)], "far": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(99)]}
    df = spark.createDataFrame([(c, float(v)) for c, vs in columns.items() for v in vs], "column string, v double").repartition(4)
    assert {r["column"]: r["median"] for r in profile.medians_of(df).collect()} == {c: statistics.median(vs) for c, vs in columns.items()}
    counted = df.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    assert {r["column"]: r["median"] for r in profile.medians_of(counted).collect()} == {c: statistics.median(vs) for c, vs in columns.items()}


def test_numeric_stats_read_text_and_skip_words(spark):
    df = spark.createDataFrame([("1", "a"), ("2.5", "b"), ("1d", "c"), ("x", "d"), (" 4 ", "e")], "n string, t string")
    got = profile.numeric_stats(df).collect()
    assert len(got) == 1
    assert got[0].asDict() == {"column": "n", "n": 3, "min": 1.0, "max": 4.0, "mean": 2.5, "median": 2.5, "std": 1.5}
    single = spark.createDataFrame([("7",)], "n string")
    assert profile.numeric_stats(single).first()["std"] == 0.0


def test_date_ranges_need_half_of_the_cells(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01"), ("1/5/2023", "x"), (None, "y"), ("z", "q")], "d string, e string")
    got = by_column(profile.date_ranges(df))
    assert list(got) == ["d"] and got["d"]["min_date"] == dt.date(2023, 1, 5)


def test_duplicate_rows_and_full_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None)], "a string, b int")
    assert profile.profile_sheet(Sheet("s", df)).first()[1:] == (4, 2, 2, 50.0)
    full = by_column(profile.full_profile(Sheet("s", df)))
    assert full["a"]["top_values"][0]["n"] == 2 and full["b"]["mean"] == 1.0


def test_relations(spark):
    a = Sheet("a", spark.createDataFrame([("1", "p"), ("2", "q"), ("3", "q"), ("4", "q")], "Cust_ID string, kind string"))
    b = Sheet("b", spark.createDataFrame([("1",), ("2",), ("9",), ("1",)], "cust_id string"))
    fk = profile.foreign_keys([a, b]).collect()
    assert [tuple(r) for r in fk] == [("a", "Cust_ID", "b", "cust_id", 66.7)]
    assert [tuple(r) for r in profile.shared_columns([a, b]).collect()] == [("cust_id", ["a", "b"])]
    keys = profile.key_candidates(profile.profile_columns(a.df)).collect()
    assert [r["column"] for r in keys] == ["Cust_ID"]
    many = Sheet("m", spark.range(9).select((F.col("id") % 2).cast("string").alias("deal_id")))
    hints = profile.line_item_hints(many)
    assert hints.first()["duplicate_ratio"] == 0.778
    assert profile.suggest_grain(hints).first()[:] == ("line_item_level", "high")
    assert profile.suggest_grain(profile.line_item_hints(a)).first()[:] == ("contract_level", "medium")
    assert profile.value_overlap(a.df, "Cust_ID", b.df, "cust_id").first()[0] == 2


def test_scorecard(spark):
    df = spark.createDataFrame([("a", None, "m")] * 6 + [("b", "x", "m")] * 4, "full string, poor string, meta_x string")
    got = [tuple(r) for r in profile.quality_scorecard(df).collect()]
    assert got == [("full", 10, 10, 100.0, "Excellent"), ("poor", 4, 10, 40.0, "Poor")]
    assert profile.overall_quality(profile.quality_scorecard(df)).first()[0] == 70.0


@pytest.fixture
def records(spark):
    return spark.createDataFrame([
        ("C1", 100.0, "2024-01-01", "2024-12-31"), ("C1", None, "2024-01-01", "2023-12-31"), (None, -5.0, "2024-01-01", "2024-01-01")],
        "contract_id string, total_value double, start_date string, end_date string")


def test_validation_issues(records):
    got = {(r["type"], r["field"]): (r["severity"], r["n"]) for r in checks.validate(records).collect()}
    assert got == {
        ("null_in_required", "contract_id"): ("error", 1), ("null_in_required", "total_value"): ("error", 1),
        ("end_before_start", None): ("error", 1), ("zero_duration", None): ("warning", 1),
        ("negative_financial", "total_value"): ("warning", 1), ("duplicate_contract_id", None): ("error", 1)}
    assert not checks.passed(checks.validate(records))


def test_validation_settings(records, spark):
    rules = {"structural": {"no_nulls_in_required": {"enabled": False}, "no_duplicate_contract_id": {"severity": "info"}},
             "logical": {"no_zero_duration": {"allow_zero": True}, "end_gte_start": {"enabled": False}}}
    got = {r["type"]: r["severity"] for r in checks.validate(records, rules).collect()}
    assert got == {"negative_financial": "warning", "duplicate_contract_id": "info"}
    issue = checks.validate(spark.createDataFrame([("a",)], "contract_id string")).first()
    assert issue["type"] == "required_fields_missing" and issue["n"] == 3


def test_reconciliation(spark):
    agg = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 0.0), (None, 9.0)], "contract_id string, total_value double")
    lines = spark.createDataFrame([("a", 4.0), ("a", 6.005), ("b", 4.0)], "contract_id string, total_value double")
    assert [tuple(r)[:3] for r in checks.reconcile_totals(agg, lines).collect()] == [("b", 5.0, 4.0)]
    kinds = [r["type"] for r in checks.validate(agg, {}, lines).collect()]
    assert "aggregation_mismatch" in kinds


def test_outliers_need_enough_values(spark):
    few = spark.createDataFrame([(1.0,)] * 8 + [(1e6,)], "total_value double")
    many = spark.createDataFrame([(1.0,)] * 30 + [(1e6,)], "total_value double")
    rules = {"outlier_detection": {"fields": ["total_value"]}}
    assert "outlier" not in [r["type"] for r in checks.validate(few, rules).collect()]
    assert [r["n"] for r in checks.validate(many, rules).collect() if r["type"] == "outlier"] == [1]


def test_anomaly_flags_in_order(spark):
    base = [("C%d" % i, "v", "A", 10.0, 12, dt.date(2024, 1, 1), dt.date(2024, 6, 1), dt.date(2024, 1, 1)) for i in range(20)]
    odd = [(None, " ", None, -1e6, 130, dt.date(2024, 1, 1), dt.date(2023, 1, 1), dt.date(2030, 1, 1)), (None,) * 8]
    df = spark.createDataFrame(base + odd, "Contract_ID string, Vendor string, Account_ID string, ACV double, Term_Months int, "
                               "Effective_Date date, Expiry_Date date, Contract_Close_Date date")
    as_of = F.lit(dt.date(2025, 1, 1))
    flags = [r["_anomaly_flags"] for r in checks.flag_anomalies(df, as_of).collect()]
    assert flags[:20] == [""] * 20
    assert flags[20] == ("negative_ACV | long_term | date_mismatch | outlier_ACV | missing_Contract_ID | missing_Vendor | "
                         "missing_Account_ID | future_close")
    assert flags[21] == "missing_Contract_ID | missing_Vendor | missing_Account_ID | empty_row"
    summary = {r["type"]: (r["n"], r["severity"]) for r in checks.anomaly_summary(df, as_of).collect()}
    assert summary["Missing Vendor"] == (2, "medium") and summary["Empty Rows"] == (1, "medium") and summary["Negative ACV"] == (1, "high")
    assert checks.anomaly_summary(df.limit(0), as_of).isEmpty()


def test_ml_preparation(spark):
    df = spark.createDataFrame([
        ("C1", 10.0, "2024-01-01", "2025-01-01", None, None, "x", 1, "s"), ("C2", 20.0, "2024-01-01", "2025-01-01", 12.0, 3.0, "2", None, "s"),
        ("C3", 30.0, "2024-01-01", "2025-01-01", 36.0, None, None, 2, "s")],
        "contract_id string, total_value double, start_date string, end_date string, term_months double, quantity double, acv string, "
        "line_item_count int, meta_source_tab string").withColumn("_x", F.lit(1))
    got = mlready.prepare_for_ml(df).orderBy("contract_id").collect()
    assert [r["term_months"] for r in got] == [24.0, 12.0, 36.0]
    assert [r["quantity"] for r in got] == [1.0, 3.0, 1.0] and [r["acv"] for r in got] == [0.0, 2.0, 0.0]
    assert [r["line_item_count"] for r in got] == [1, 0, 2] and got[0]["start_date"] == dt.date(2024, 1, 1)
    assert "_x" not in got[0].asDict() and "meta_source_tab" not in got[0].asDict()
    with pytest.raises(mlready.ContractViolation, match="total_value"):
        mlready.prepare_for_ml(df.withColumn("total_value", F.lit(None).cast("double")))
    assert mlready.contract_violations(df.drop("end_date")).first()["field"] == "end_date"
    assert mlready.is_ready(df, checks.validate(df))
    assert fixed.ML_CONTRACT["null_handling"]["quantity"] == "fill_one"


def test_timeline_limits_before_it_filters(spark):
    df = spark.range(5).select(F.col("id").alias(ORD), F.when(F.col("id") > 1, F.lit("2024-01-01")).alias("start_date"),
                               F.lit(None).cast("string").alias("end_date"), F.lit("v").alias("vendor"))
    assert profile.timeline(df, 3, F.col(ORD)).count() == 1


def test_numbers_are_read_from_one_staged_table(spark, tmp_path, rows):
    """The rounds of the median search do not compute the sheet again."""
    path = str(tmp_path / "lines")
    spark.range(50).select((F.col("id") * 1.5).alias("a b"), F.concat(F.col("id"), F.when(F.col("id") % 5 == 0, "x").otherwise("")).alias("t"), F.current_date().alias("d"), F.lit(float("nan")).alias("none")) \
        .write.parquet(path)
    found = profile.numeric_stats(spark.read.parquet(path))
    assert [r[:3] for r in rows(found)] == [("a b", 50, 0.0), ("t", 40, 1.0)]
    assert found.inputFiles() and not any("/lines/" in f for f in found.inputFiles())
    assert profile.numeric_stats(spark.read.parquet(path).select("d")).count() == 0
