"""Audit tables of a run: what went in, what came out, and how columns were mapped."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from keyfold import fixed
from keyfold.model import Sheet
from keyfold.operators.mapping import MappingConfig
from keyfold.plans.consolidate import LayeredResult


def audit_sheets(sheets: Sequence[Sheet], levels: dict[str, str]) -> DataFrame:
    """(sheet, rows_ingested, level), one row per sheet."""
    counts = [s.df.agg(F.count(F.lit(1)).alias("rows_ingested")).select(
        F.lit(s.name).alias("sheet"), "rows_ingested", F.lit(levels.get(s.name)).cast("string").alias("level")) for s in sheets]
    return reduce(DataFrame.unionByName, counts)


def audit_run(sheets: Sequence[Sheet], result: LayeredResult, dataset_id: str = "default") -> DataFrame:
    """(metric, value) of a run: rows in and out, tabs, vendors, merged line items, versions."""
    have = result.contracts.columns
    lines = F.sum(fixed.LINE_COUNT_COL) - F.count(F.lit(1)) if fixed.LINE_COUNT_COL in have else F.lit(0)
    vendors = F.count_distinct("vendor_canonical") if "vendor_canonical" in have else F.lit(0)
    out = result.contracts.agg(F.count(F.lit(1)).alias("final_rows"), lines.alias("line_items_merged"), vendors.alias("unique_vendors"))
    into = audit_sheets(sheets, result.levels).agg(F.sum("rows_ingested").alias("rows_ingested"), F.count(F.lit(1)).alias("tabs_processed"))
    metrics = ["rows_ingested", "tabs_processed", "final_rows", "line_items_merged", "unique_vendors"]
    one = into.crossJoin(out).select(*[F.col(m).cast("string").alias(m) for m in metrics])  # two single rows
    versions = [F.struct(F.lit(f"{k}_version").alias("metric"), F.lit(v).alias("value")) for k, v in sorted(result.versions.items())]
    named = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    return one.select(F.inline(F.array(F.struct(F.lit("dataset_id").alias("metric"), F.lit(dataset_id).alias("value")), *named, *versions)))


def audit_mapping(sheets: Sequence[Sheet], config: MappingConfig, suggestions: DataFrame | None = None) -> DataFrame:
    """(sheet, raw, canonical, score, method) of every column; columns without a field have a
    null one. Without suggestions every mapped column counts as confirmed."""
    spark = sheets[0].df.sparkSession
    columns = spark.createDataFrame([(s.name, c) for s in sheets for c in s.data_columns], "sheet string, raw string")
    chosen = config.frame(spark).withColumnRenamed("column", "raw")
    out = columns.join(chosen, ["sheet", "raw"], "left")
    if suggestions is None:
        return out.select("sheet", "raw", "canonical", F.lit(None).cast("int").alias("score"), F.when(F.col("canonical").isNotNull(), "confirmed").alias("method"))
    hints = suggestions.select("sheet", "raw", F.col("canonical").alias("hint"), "score", "method")
    same = F.col("hint").eqNullSafe(F.col("canonical"))
    return out.join(hints, ["sheet", "raw"], "left").select(
        "sheet", "raw", "canonical", F.when(same, F.col("score")).alias("score"), F.when(same, F.col("method")).when(F.col("canonical").isNotNull(), "confirmed").alias("method"))
