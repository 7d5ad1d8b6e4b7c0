"""What is known of a stored sheet without reading it again.

A state holds the rows, filled cells per column and summed row hashes of some rows. States
add up: the state of two sets of rows is the sum of theirs, and its hash equals the
fingerprint of all rows read at once. A write observes the state of what it writes, so
neither a catalog nor a run log costs a pass over the data, and an append adds its own."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from keyfold.model import ORD, Sheet
from keyfold.sources.catalog import LANES, hash_lanes, lane_sums

STATE_SCHEMA = ("sheet string, sheet_append int, dataset_id string, columns array<string>, inferred_types array<string>, n_rows bigint, "
                "lanes array<decimal(38,0)>, filled map<string,bigint>")


@dataclass(frozen=True)
class State:
    """Rows, summed row hashes and filled cells of a set of rows."""

    n_rows: int
    lanes: tuple[int, ...]
    filled: dict[str, int] = field(default_factory=dict)

    def __add__(self, other: State) -> State:
        if list(self.filled) != list(other.filled):
            raise ValueError("states of different columns do not add up")
        return State(self.n_rows + other.n_rows, tuple(a + b for a, b in zip(self.lanes, other.lanes, strict=True)),
                     {c: n + other.filled[c] for c, n in self.filled.items()})

    @property
    def content_hash(self) -> str:
        return hashlib.sha256("-".join(map(str, [self.n_rows, *self.lanes])).encode()).hexdigest()


class Observed:
    """A table that notes its state while it is written: write `rows`, then read `state`."""

    def __init__(self, df: DataFrame, name: str = "state"):
        self.columns = [c for c in df.columns if c != ORD]
        self._seen = Observation(name)
        counted = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(self.columns)]
        self.rows = hash_lanes(df).observe(self._seen, F.count(F.lit(1)).alias("n"), *counted, *lane_sums()).select(*[f"`{c}`" for c in df.columns])

    @property
    def state(self) -> State:
        got = self._seen.get
        lanes = tuple(sum(int(got[f"s{i}_{k}"]) << bits for k, bits in enumerate(shifts)) for i, shifts in LANES.items())
        return State(got["n"], lanes, {c: got[f"c{i}"] for i, c in enumerate(self.columns)})


def append_sheet(sheet: Sheet, root: str, number: int) -> State:
    """Add a sheet's rows to the stored sheet of its name as append `number`. The rows and
    their state lie in a folder of that number, so a repeated append replaces itself."""
    df = sheet.df.drop(ORD)
    seen = Observed(df)
    seen.rows.write.mode("overwrite").parquet(f"{root}/rows/sheet={sheet.name}/sheet_append={number}")
    state, kinds = seen.state, {f.name: f.dataType.simpleString() for f in df.schema}
    row = (sheet.name, number, sheet.dataset_id, seen.columns, [kinds[c] for c in seen.columns], state.n_rows, list(map(_decimal, state.lanes)), state.filled)
    df.sparkSession.createDataFrame([row], STATE_SCHEMA).drop("sheet", "sheet_append").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/states/sheet={sheet.name}/sheet_append={number}")
    return state


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(x)


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """(sheet, sheet_append, dataset_id, columns, inferred_types, n_rows, lanes, filled), a row per append."""
    return spark.read.schema(STATE_SCHEMA).parquet(f"{root}/states")


def read_sheet(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a stored sheet."""
    return spark.read.option("basePath", f"{root}/rows/sheet={name}").parquet(f"{root}/rows/sheet={name}").drop("sheet_append")


def stored_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored sheet and set of columns, from the states alone: dataset_id, sheet, row_count,
    column_count, columns, inferred_types, content_hash."""
    lanes = [F.sum(F.col("lanes")[i]).cast("decimal(38,0)").cast("string") for i in LANES]
    return read_states(spark, root).groupBy("dataset_id", "sheet", "columns", "inferred_types").agg(
        F.sum("n_rows").alias("row_count"), F.array(*lanes).alias("sums")).select(
        "dataset_id", "sheet", "row_count", F.size("columns").alias("column_count"), "columns", "inferred_types",
        F.sha2(F.concat_ws("-", F.col("row_count").cast("string"), F.array_join("sums", "-")), 256).alias("content_hash"))


def stored_completeness(spark: SparkSession, root: str) -> DataFrame:
    """(sheet, column, non_null, total, pct) of the stored sheets, from the states alone."""
    from keyfold.functions.cells import round_exact

    per_column = read_states(spark, root).select("sheet", "n_rows", F.explode("filled").alias("column", "n"))
    pct = F.when(F.col("total") > 0, round_exact(F.col("non_null") / F.col("total") * 100, 1)).otherwise(0.0)
    return per_column.groupBy("sheet", "column").agg(F.sum("n").alias("non_null"), F.sum("n_rows").alias("total")).withColumn("pct", pct)


def total(states: Sequence[State]) -> State:
    """The state of all their rows."""
    first, *rest = states
    for s in rest:
        first = first + s
    return first
