"""A stored master that an append rewrites only where its keys fall.

Rows lie in parts by a hash of the leading key columns. An append reads the parts its keys
fall into, finds the rows of its keys by a semi join, checks and merges those, and replaces
just these parts by dynamic partition overwrite; other parts are neither read nor written.
New columns are added to the list of columns first, so older parts read them as null.

Each part carries the number of the append that wrote it last. An append that was stopped
while its parts were put in place is repeated with its number: parts that carry it already are
left as they are, so no row is merged twice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from keyfold import fixed
from keyfold.model import ORD
from keyfold.operators.conflicts import refuse_conflicts
from keyfold.operators.merge import concat_sheets, merge_sheets, outer_merge, require_keys
from keyfold.session import staged

PART, APPEND = "__part", "__append"
PARTS = 256
_SETTINGS = "keys array<string>, leading array<string>, parts int"


@dataclass(frozen=True)
class Appended:
    """What an append did: parts and rows written, of how many parts."""

    parts_written: int
    rows_written: int
    parts: int


def _part(leading: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in leading]), F.lit(parts)).cast("int")


def _put(rows: DataFrame, path: str, leading: Sequence[str], parts: int, number: int) -> int:
    """Write rows into their parts and replace only those. A large part is dealt over several tasks and files."""
    seen = Observation("rows")
    placed = rows.withColumns({APPEND: F.lit(number), PART: _part(leading, parts)}).observe(seen, F.count(F.lit(1)).alias("n"))
    placed.hint("rebalance", PART).write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
    return seen.get["n"]


def _columns(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(f"{path}/columns").schema


def create_master(df: DataFrame, path: str, keys: Sequence[str] = fixed.KEY_COLS, parts: int = PARTS,
                  leading: Sequence[str] | None = None) -> None:
    """Store a table as append 0. `leading` are the key columns that name the part, by default
    the first one, so that all rows of an account lie together; the number of parts is best
    some times the number of parts an append should touch."""
    require_keys(df, keys, "Master")
    leading = list(leading or keys[:1])
    df = df.drop(ORD)
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/columns")
    _put(df, path, leading, parts, 0)
    spark.createDataFrame([(list(keys), leading, parts)], _SETTINGS).coalesce(1).write.json(f"{path}/settings")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*_columns(spark, path).fields, T.StructField(APPEND, T.IntegerType()), T.StructField(PART, T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """The master after all appends."""
    return _stored(spark, path).drop(PART, APPEND)


def _with_types(new: DataFrame, stored: T.StructType) -> DataFrame:
    """The new rows with the key types of the store; other columns must have the stored type."""
    kinds = {f.name: f.dataType for f in stored}
    wrong = [f"{f.name} is {f.dataType.simpleString()}, stored as {kinds[f.name].simpleString()}"
             for f in new.schema if f.name in kinds and f.dataType != kinds[f.name]]
    if wrong:
        raise ValueError("Column types differ from the stored master: " + "; ".join(wrong))
    return new


def append_rows(spark: SparkSession, path: str, new: DataFrame | Sequence[DataFrame], number: int,
                on_conflict: str = "error") -> Appended:
    """Outer-merge new rows and columns into the stored master as append `number`, which counts
    up from 1. Several new sheets are merged with each other first. A conflict raises before
    anything is written. Rows without a key are kept.

    Only parts the new keys fall into are read, and of those only rows of the new keys are merged."""
    settings = spark.read.schema(_SETTINGS).json(f"{path}/settings").first()
    keys, leading, parts = settings["keys"], settings["leading"], settings["parts"]
    if not isinstance(new, DataFrame):
        new = merge_sheets(list(new), keys, on_conflict)
    require_keys(new, keys, "New data")
    columns = _columns(spark, path)
    new = staged(_with_types(new.drop(ORD), columns).withColumn(PART, _part(leading, parts)), "append")
    touched = [r[0] for r in new.select(PART).distinct().collect()]  # at most `parts` numbers
    before = _stored(spark, path).where(F.col(PART).isin(touched))
    done = [r[0] for r in before.groupBy(PART).agg(F.max(APPEND).alias("n")).where(F.col("n") >= number).collect()]
    open_parts = [p for p in touched if p not in set(done)]
    if not open_parts:
        return Appended(0, 0, parts)
    rows = new.where(F.col(PART).isin(open_parts)).drop(PART)
    before = before.where(F.col(PART).isin(open_parts)).drop(PART, APPEND)
    mine = rows.select(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    hit = before.join(mine, same, "left_semi")
    refuse_conflicts([hit, rows], keys, on_conflict, ["Master", "Appended file"])
    merged = concat_sheets([outer_merge(hit, rows, keys), before.join(mine, same, "left_anti")])
    wider = [f for f in rows.schema if f.name not in columns.names]
    if wider:
        _replace_columns(spark, path, T.StructType([*columns.fields, *wider]))
    written = _put(merged, path, leading, parts, number)
    return Appended(len(open_parts), written, parts)


def _replace_columns(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """The list of columns is one empty file; a reader finds the old or the new list."""
    spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in schema])).write.mode("overwrite").parquet(f"{path}/columns")
