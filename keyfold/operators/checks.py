"""Validation issues, row anomaly flags and the totals reconciliation.

Counting checks share one aggregate over the table. Mean and deviation enter as scalar
subqueries, so flagging outliers needs neither a join nor a window over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keyfold import fixed
from keyfold.functions import cells
from keyfold.model import ORD, data_columns
from keyfold.operators.rollup import duplicate_counts

ISSUE_SCHEMA = "severity string, type string, field string, n bigint, message string"


def _rule(rules: dict, name: str) -> dict | None:
    """A rule's settings, or None when it is switched off."""
    rule = rules.get(name, {})
    return rule if rule.get("enabled", True) else None


def flatten_rules(config: dict) -> dict:
    """Accept rules grouped as structural / logical / statistical."""
    groups = [config[g] for g in ("structural", "logical", "statistical") if g in config]
    return {k: v for g in groups for k, v in g.items()} if groups else config


def spread(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Per column a scalar-subquery struct(n, mean, std) over its numeric cells."""
    columns = list(columns)
    if not columns:
        return {}
    one = df.select(*[cells.as_number(df, c).alias(c) for c in columns]).agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns])
    return {c: one.select(c).scalar() for c in columns}


def is_outlier(x: Column, stats: Column, k: float, least: int) -> Column:
    """Farther than k deviations from the mean, in a column of at least `least` values."""
    usable = (stats["n"] >= least) & (stats["std"] > 0)
    return usable & (F.abs(x - stats["mean"]) > F.lit(k) * stats["std"])


def reconcile_totals(records: DataFrame, lines: DataFrame, key: str = "contract_id",
                     value: str = "total_value", tolerance: float = 0.01) -> DataFrame:
    """(key, record_total, line_total, diff) of records whose total is off; a record
    without lines compares with 0."""
    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(
            F.coalesce(F.sum(cells.as_number(df, value)), F.lit(0.0)).alias(name))

    both = totals(records, "record_total").join(totals(lines, "line_total"), key, "left").na.fill(0.0, ["line_total"])
    diff = F.abs(F.col("record_total") - F.col("line_total"))
    return both.withColumn("diff", diff).where(F.col("diff") > tolerance)


def validate(df: DataFrame, rules: dict = fixed.VALIDATION_RULES, line_items: DataFrame | None = None,
             as_of: Column | None = None) -> DataFrame:
    """Issues of a record table: (severity, type, field, n, message). The table passed
    when no issue has severity 'error'."""
    rules = flatten_rules(rules)
    as_of = as_of if as_of is not None else F.current_date()
    spark, have = df.sparkSession, set(df.columns)
    counted: list[tuple[str, str, str | None, Column, Column]] = []  # severity, type, field, condition, message

    def count_check(rule: dict, default: str, kind: str, field: str | None, hit: Column, message) -> None:
        counted.append((rule.get("severity", default), kind, field, hit, message))

    parts: list[DataFrame] = []
    rule = _rule(rules, "required_fields_present")
    missing = sorted(set(fixed.REQUIRED_FIELDS) - have)
    if rule is not None and missing:
        parts.append(spark.createDataFrame(
            [(rule.get("severity", "error"), "required_fields_missing", None, len(missing),
              f"Missing required columns: {missing}")], ISSUE_SCHEMA))

    rule = _rule(rules, "no_nulls_in_required")
    if rule is not None:
        for c in rule.get("fields", fixed.REQUIRED_FIELDS):
            if c in have:
                count_check(rule, "error", "null_in_required", c, F.col(c).isNull(),
                            lambda n, total, c=c: F.format_string(f"'{c}' has %s null values (%s/%s rows)", n, n, total))
    rule = _rule(rules, "no_invalid_numeric")
    if rule is not None:
        for c in fixed.VALIDATION_NUMERIC_FIELDS:
            if c in have:
                bad = F.col(c).isNotNull() & cells.as_number(df, c).isNull()
                count_check(rule, "warning", "invalid_numeric", c, bad,
                            lambda n, total, c=c: F.format_string(f"'{c}' has %s non-numeric values", n))
    rule = _rule(rules, "end_gte_start")
    if rule is not None:
        start, end = rule.get("start_field", "start_date"), rule.get("end_field", "end_date")
        if {start, end} <= have:
            count_check(rule, "error", "end_before_start", None, cells.as_date(df, end) < cells.as_date(df, start),
                        lambda n, total: F.format_string("%s rows have end_date before start_date", n))
    rule = _rule(rules, "no_zero_duration")
    if rule is not None and not rule.get("allow_zero", False):
        days = None
        if "contract_duration_days" in have:
            days = cells.as_number(df, "contract_duration_days")
        elif {"start_date", "end_date"} <= have:
            days = F.datediff(cells.as_date(df, "end_date"), cells.as_date(df, "start_date"))
        if days is not None:
            count_check(rule, "warning", "zero_duration", None, days == 0,
                        lambda n, total: F.format_string("%s contracts have zero duration", n))
    rule = _rule(rules, "no_negative_financials")
    if rule is not None:
        for c in rule.get("fields", ["total_value", "acv", "net_arr", "unit_price"]):
            if c in have:
                count_check(rule, "warning", "negative_financial", c, cells.as_number(df, c) < 0,
                            lambda n, total, c=c: F.format_string(f"'{c}' has %s negative values", n))
    rule = _rule(rules, "outlier_detection")
    if rule is not None:
        k, least = rule.get("std_threshold", 3.0), rule.get("min_sample_size", 10)
        fields = [c for c in rule.get("fields", ["total_value", "acv", "net_arr"]) if c in have]
        for c, stats in spread(df, fields).items():
            count_check(rule, "warning", "outlier", c, is_outlier(cells.as_number(df, c), stats, k, least),
                        lambda n, total, c=c: F.format_string(f"'{c}': %s values > {k}σ from mean", n))
    rule = _rule(rules, "extreme_duration")
    if rule is not None:
        months = rule.get("max_months", 120)
        over = None
        if "term_months" in have:
            over = cells.as_number(df, "term_months") > months
        elif "contract_duration_days" in have:
            over = cells.as_number(df, "contract_duration_days") > months * 30
        if over is not None:
            count_check(rule, "warning", "extreme_duration", None, over,
                        lambda n, total: F.format_string(f"%s contracts exceed {months} months", n))
    rule = _rule(rules, "future_date_detection")
    if rule is not None:
        years = rule.get("max_years_ahead", 1)
        for c in rule.get("fields", ["close_date"]):
            if c in have:
                count_check(rule, "info", "future_date", c, cells.as_date(df, c) > F.add_months(as_of, 12 * years),
                            lambda n, total, c=c: F.format_string(f"'{c}': %s values more than {years} year(s) in the future", n))

    if counted:
        # conditions become columns first: an aggregate may not hold a subquery that reads
        # a generated row position
        flagged = df.select(*[x[3].alias(f"n{i}") for i, x in enumerate(counted)])
        one = flagged.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(f"n{i}").alias(f"n{i}") for i in range(len(counted))])
        rows = [F.struct(F.lit(s).alias("severity"), F.lit(t).alias("type"), F.lit(f).cast("string").alias("field"),
                         F.col(f"n{i}").alias("n"), m(F.col(f"n{i}"), F.col("total")).alias("message"))
                for i, (s, t, f, _, m) in enumerate(counted)]
        parts.append(one.select(F.inline(F.array(*rows))))

    rule = _rule(rules, "no_duplicate_contract_id")
    if rule is not None and "contract_id" in have:
        n = F.col("rows_beyond_first")
        parts.append(duplicate_counts(df, "contract_id").select(
            F.lit(rule.get("severity", "error")).alias("severity"), F.lit("duplicate_contract_id").alias("type"),
            F.lit(None).cast("string").alias("field"), n.alias("n"),
            F.format_string("%s duplicate contract_id values found after aggregation", n).alias("message")))
    rule = _rule(rules, "aggregation_totals_match")
    if rule is not None and line_items is not None and {"contract_id", "total_value"} <= (have & set(line_items.columns)):
        n = F.col("n")
        parts.append(reconcile_totals(df, line_items).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(rule.get("severity", "warning")).alias("severity"), F.lit("aggregation_mismatch").alias("type"),
            F.lit(None).cast("string").alias("field"), n.alias("n"),
            F.format_string("%s contracts have aggregated totals that don't match line-item sums", n).alias("message")))
    if not parts:
        return spark.createDataFrame([], ISSUE_SCHEMA)
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def passed(issues: DataFrame) -> bool:
    return issues.where("severity = 'error'").isEmpty()


# --- anomalies ---------------------------------------------------------------------------


def _row_checks(df: DataFrame, as_of: Column) -> list[tuple[str, str, str, Column]]:
    """(flag, summary type, severity, condition) in reporting order."""
    have = set(df.columns)
    money = [c for c in fixed.ANOMALY_MONEY_COLS if c in have]
    checks = [(f"negative_{c}", f"Negative {c}", "high", cells.as_number(df, c) < 0) for c in money]
    if "Term_Months" in have:
        checks.append(("long_term", "Long Term (>10yr)", "medium", cells.as_number(df, "Term_Months") > 120))
    if {"Effective_Date", "Expiry_Date"} <= have:
        checks.append(("date_mismatch", "Date Mismatch", "high",
                       cells.as_date(df, "Expiry_Date") < cells.as_date(df, "Effective_Date")))
    checks += [(f"outlier_{c}", f"{c} Outlier", "medium", is_outlier(cells.as_number(df, c), stats, 3.0, 11))
               for c, stats in spread(df, money).items()]
    for c in fixed.CRITICAL_COLS:
        if c in have:
            checks.append((f"missing_{c}", f"Missing {c}", "medium" if c == "Vendor" else "high",
                           F.col(c).isNull() | (cells.strip(c) == "")))
    if "Contract_Close_Date" in have:
        checks.append(("future_close", "Far Future Close", "low",
                       cells.as_date(df, "Contract_Close_Date") > F.add_months(as_of, 12)))
    data = [c for c in data_columns(df) if not c.startswith("meta_")]
    if data:
        checks.append(("empty_row", "Empty Rows", "medium", reduce(lambda a, b: a & b, [F.col(c).isNull() for c in data])))
    return checks


def flag_anomalies(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add `_anomaly_flags`: the labels of all hit checks, joined with ' | '."""
    checks = _row_checks(df, as_of if as_of is not None else F.current_date())
    return df.withColumn("_anomaly_flags", F.concat_ws(" | ", *[F.when(hit, label) for label, _, _, hit in checks]))


def anomaly_summary(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(type, n, severity, description): row checks that hit, columns more than a fifth
    empty, and rows sharing an id."""
    checks = _row_checks(df, as_of if as_of is not None else F.current_date())
    data = [c for c in data_columns(df) if not c.startswith("meta_")]
    missing = [F.col(c).isNull() | ((cells.strip(c) == "") if df.schema[c].dataType.typeName() == "string" else F.lit(False))
               for c in data]
    names = [f"c{i}" for i in range(len(checks))] + [f"m{i}" for i in range(len(missing))]
    flagged = df.select(*[c.alias(n) for n, c in zip(names, [x[3] for x in checks] + missing)])
    one = flagged.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(n).alias(n) for n in names])
    rows = [F.struct(F.lit(kind).alias("type"), F.col(f"c{i}").alias("n"), F.lit(severity).alias("severity"),
                     F.format_string(f"%s rows: {label}", F.col(f"c{i}")).alias("description"),
                     (F.col(f"c{i}") > 0).alias("hit"))
            for i, (label, kind, severity, _) in enumerate(checks)]
    for i, c in enumerate(data):
        n, pct = F.col(f"m{i}"), F.col(f"m{i}") / F.col("total") * 100
        rows.append(F.struct(F.lit(f"Empty: {c}").alias("type"), n.alias("n"),
                             F.when(pct > 50, "medium").otherwise("low").alias("severity"),
                             F.format_string(f"{c} is empty in %s of %s rows", n, F.col("total")).alias("description"),
                             ((pct > 20) & (n > 5)).alias("hit")))
    out = one.where("total > 0").select(F.inline(F.array(*rows))).where("hit").drop("hit")
    if "Contract_ID" in df.columns:
        n = F.col("rows_sharing_id")
        out = out.unionByName(duplicate_counts(df, "Contract_ID").where("rows_sharing_id > 0").select(
            F.lit("Duplicate Contract IDs").alias("type"), n.alias("n"), F.lit("medium").alias("severity"),
            F.format_string("%s rows share the same Contract_ID with other rows", n).alias("description")))
    return out
