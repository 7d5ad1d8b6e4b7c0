"""The unit of work: a named table, plus the row order some operators depend on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

ORD = "_ord"


@dataclass(frozen=True)
class Sheet:
    """One table of a data set. Counts and samples are queries, not stored facts."""

    name: str
    df: DataFrame
    source_file: str | None = None
    dataset_id: str = "default"
    company_id: str = "unknown"

    def with_df(self, df: DataFrame) -> "Sheet":
        return replace(self, df=df)

    @property
    def data_columns(self) -> list[str]:
        return data_columns(self.df)


def data_columns(df: DataFrame) -> list[str]:
    """Columns that carry data; the row ordinal is not one of them."""
    return [c for c in df.columns if c != ORD]


def is_internal(name: str) -> bool:
    return name.startswith("_")


def with_ordinal(df: DataFrame) -> DataFrame:
    """Add a row ordinal. It is stable across task retries because a scan's
    partitions are; for an order that survives re-partitioning pass a real column."""
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())
