"""The model-input contract: check it, then fill, coerce and project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyfold import fixed
from keyfold.functions import cells
from keyfold.operators.checks import passed
from keyfold.operators.mapping import drop_internal
from keyfold.operators.profile import exact_medians


class ContractViolation(ValueError):
    """The table does not meet the model-input contract."""


def contract_violations(df: DataFrame, contract: dict = fixed.ML_CONTRACT) -> DataFrame:
    """(field, n, message): absent required columns, and nulls where none are allowed."""
    missing = [c for c in contract.get("required_columns", []) if c not in df.columns]
    reject = [c for c, p in contract.get("null_handling", {}).items() if p == "reject" and c in df.columns]
    out = df.sparkSession.createDataFrame(
        [(c, None, f"Missing required column: {c}") for c in missing], "field string, n bigint, message string")
    if reject:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in reject]).unpivot([], reject, "field", "n")
        out = out.unionByName(nulls.where("n > 0").select(
            "field", "n", F.format_string("'%s' has %s nulls (policy: reject)", "field", "n").alias("message")))
    return out


def apply_null_policies(df: DataFrame, contract: dict = fixed.ML_CONTRACT) -> DataFrame:
    """fill_zero, fill_one, fill_median (0 when there is no value) and reject."""
    policies = {c: p for c, p in contract.get("null_handling", {}).items() if c in df.columns}
    df = df.na.drop(subset=[c for c, p in policies.items() if p == "reject"])
    fills = {c: F.coalesce(cells.as_number(df, c), F.lit(0.0 if p == "fill_zero" else 1.0))
             for c, p in policies.items() if p in ("fill_zero", "fill_one")}
    with_median = [c for c, p in policies.items() if p == "fill_median"]
    if with_median:
        medians = exact_medians(df, with_median)
        for c in with_median:
            middle = medians.where(F.col("column") == c).select("median").scalar()
            fills[c] = F.coalesce(cells.as_number(df, c), middle, F.lit(0.0))
    return df.withColumns(fills)


def _coerced(df: DataFrame, c: str, kind: str) -> Column:
    if kind == "float64":
        return cells.as_number(df, c)
    if kind == "int64":
        return F.coalesce(cells.as_number(df, c), F.lit(0.0)).cast("bigint")
    if kind == "datetime64":
        return cells.as_date(df, c)
    return F.col(c).cast("string")


def coerce_types(df: DataFrame, contract: dict = fixed.ML_CONTRACT) -> DataFrame:
    """Cast columns to the contract's types; cells that do not convert are null."""
    kinds = {c: k for c, k in contract.get("expected_dtypes", {}).items() if c in df.columns}
    return df.withColumns({c: _coerced(df, c, k) for c, k in kinds.items()})


def prepare_for_ml(df: DataFrame, contract: dict = fixed.ML_CONTRACT, check: bool = True) -> DataFrame:
    """Checked (raises on a violation), filled, coerced, without internal columns.
    `check=False` leaves out the query behind the check; rejected rows then just go."""
    if check:
        found = contract_violations(df, contract).collect()  # one row per contract column at most
        if found:
            raise ContractViolation("; ".join(r["message"] for r in found))
    return drop_internal(coerce_types(apply_null_policies(df, contract), contract), also_provenance=True)


def is_ready(df: DataFrame, issues: DataFrame, contract: dict = fixed.ML_CONTRACT) -> bool:
    """Contract met and no validation error."""
    return contract_violations(df, contract).isEmpty() and passed(issues)
