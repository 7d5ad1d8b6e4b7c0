"""Derived fields from ordered rules; a later rule may use an earlier field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyfold import fixed
from keyfold.functions.cells import as_date, as_number, half_even


def ieee_divide(num: Column, den: Column) -> Column:
    """Quotient; a zero denominator gives plus or minus infinity by the numerator's sign,
    and null for 0/0."""
    zero = F.when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(float("-inf")))
    return F.when(den == 0, zero).otherwise(F.try_divide(num, den))


def date_diff_days(df: DataFrame, start: str, end: str) -> Column:
    """Whole days between two date columns; null when one is absent."""
    if start not in df.columns or end not in df.columns:
        return F.lit(None).cast("int")
    return F.datediff(as_date(df, end), as_date(df, start))


def _operand(df: DataFrame, value) -> Column:
    if isinstance(value, str):
        return as_number(df, value) if value in df.columns else F.lit(None).cast("double")
    return F.lit(value).cast("double")


def divide(df: DataFrame, numerator, denominator) -> Column:
    """Column or constant over column or constant, four decimals."""
    quotient = ieee_divide(_operand(df, numerator), _operand(df, denominator))
    return half_even(quotient, 4)


def safe_divide(df: DataFrame, numerator, denominator, fallback=None) -> Column:
    """As `divide`, with infinite results replaced; missing inputs stay missing."""
    num, den = _operand(df, numerator), _operand(df, denominator)
    return F.when((den == 0) & (num != 0), F.lit(fallback).cast("double")) \
        .otherwise(half_even(F.try_divide(num, den), 4))


def churn_flag(df: DataFrame, as_of: Column) -> Column:
    """Ended before `as_of` and not renewing by itself."""
    ended = (as_date(df, "end_date") < as_of) if "end_date" in df.columns else F.lit(False)
    auto = F.col("auto_renew").eqNullSafe(True) if "auto_renew" in df.columns else F.lit(False)
    return F.coalesce(ended, F.lit(False)) & ~auto


def renewal_flag(df: DataFrame) -> Column:
    """Renews by itself or has a renewal date."""
    auto = F.col("auto_renew").eqNullSafe(True) if "auto_renew" in df.columns else F.lit(False)
    planned = F.col("renewal_date").isNotNull() if "renewal_date" in df.columns else F.lit(False)
    return auto | planned


def derive_fields(df: DataFrame, rules: dict[str, dict] = fixed.DERIVED_FIELDS,
                  as_of: Column | None = None) -> DataFrame:
    """Apply the rules in order. A boolean expression is any Spark SQL over the row and
    `today`, which `as_of` stands for; an unknown operation is skipped, a rule Spark cannot
    resolve gives a null column."""
    as_of = as_of if as_of is not None else F.current_date()
    for name, rule in rules.items():
        op = rule.get("operation")
        if op == "date_diff_days":
            value = date_diff_days(df, rule["start"], rule["end"])
        elif op == "divide":
            value = divide(df, rule["numerator"], rule["denominator"])
        elif op == "safe_divide":
            value = safe_divide(df, rule["numerator"], rule["denominator"], rule.get("fallback"))
        elif op == "churn_flag":
            value = churn_flag(df, as_of)
        elif op == "renewal_flag":
            value = renewal_flag(df)
        elif op == "boolean_expression":
            value = F.expr(rule.get("expression", ""))
        else:
            continue
        own = op == "boolean_expression" and "today" not in df.columns
        try:
            df = df.withColumn("today", as_of).withColumn(name, value).drop("today") if own else df.withColumn(name, value)
        except Exception:  # the rule names something this table lacks
            df = df.withColumn(name, F.lit(None).cast("double" if op in ("date_diff_days", "divide", "safe_divide") else "boolean"))
    return df
