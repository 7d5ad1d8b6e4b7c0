"""Merging sheets over one stored distribution.

All sheets are stacked and stored once, dealt into buckets by their keys. A key part is stored as
text beside a flag for a missing one, so keys compare by plain equality and rows of a key
lie in one bucket. Counting rows per key, the conflict check and the merge then read the
stored table and shuffle nothing more: aggregates and joins on the keys follow the buckets.

The merge of repeated keys joins the distinct keys with each sheet in turn. Left joins keep the
buckets of their left side, and a sheet without a key leaves one row of empty cells, as an outer merge
does. Keys with a large share of the rows cannot be split in a stored bucket; for them the
salted plan reads the same table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from keyfold import fixed
from keyfold.model import ORD
from keyfold.operators import conflicts, merge
from keyfold.session import discard, recorded, staged, work_folder

# Rows of all sheets that a bucket, and so a task, holds on average; buckets a Spark table may have.
BUCKET_ROWS, MAX_BUCKETS = 250_000, 100_000


@dataclass(frozen=True)
class StoredSheets:
    """The stacked sheets as a bucketed table."""

    name: str
    table: DataFrame
    keys: list[str]
    columns: list[list[str]]
    flags: list[str]

    @property
    def merged_columns(self) -> list[str]:
        return list(dict.fromkeys(c for own in self.columns for c in own))

    def sheet(self, i: int) -> DataFrame:
        """Rows of a sheet with its own columns, and the stored keys."""
        return self.table.where(F.col("__sheet") == i).select(*self.flags, *[F.col(f"`{c}`") for c in self.columns[i]])

    def drop(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def store_sheets(sheets: Sequence[DataFrame], keys: Sequence[str] = fixed.KEY_COLS, buckets: int | None = None,
                 keep_keyless: bool = False) -> StoredSheets:
    """Stack the sheets and store them by their keys; rows without any key part are left out
    unless asked for. A column of several sheets gets the type that holds them all.

    A task reads one bucket, so their number grows with the rows: `buckets` is the least number,
    and each holds about BUCKET_ROWS rows at most. The sheets are computed once, into a table that
    is counted, dealt and deleted."""
    for i, s in enumerate(sheets, 1):
        merge.require_keys(s, keys, f"Sheet {i}")
    spark = sheets[0].sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [s.drop(ORD) if keep_keyless else merge.drop_keyless(s.drop(ORD), keys) for s in sheets]
    stacked = merge.concat_sheets([s.withColumn("__sheet", F.lit(i)) for i, s in enumerate(plain)])
    flags = {}
    for i, k in enumerate(keys):
        flags[f"__key{i}"] = F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(""))
        flags[f"__none{i}"] = F.col(f"`{k}`").isNull()
    name = f"keyfold_sheets_{uuid.uuid4().hex[:12]}"
    with recorded() as paths:
        rows = staged(stacked, "stacked")
    buckets = min(max(buckets, -(-rows.count() // BUCKET_ROWS)), MAX_BUCKETS)
    # one task per bucket, so one file each
    rows.withColumns(flags).repartition(buckets, *flags).write.bucketBy(buckets, *flags).format("parquet").option(
        "path", work_folder(spark, "sheets")).saveAsTable(name)
    discard(spark, paths)
    return StoredSheets(name, spark.table(name), list(keys), [s.columns for s in plain], list(flags))


def stored_conflicts(stored: StoredSheets, examples: int = 3) -> DataFrame:
    """Conflicts of each sheet with the merge of those before it, see `conflicts.sheet_conflicts`."""
    part = lambda i, k: F.concat(F.lit(f"{k}="), F.when(F.col(f"__none{i}"), "null").otherwise(F.col(f"__key{i}")))
    text = F.concat_ws(", ", *[part(i, k) for i, k in enumerate(stored.keys)])
    return conflicts.stacked_conflicts(stored.table, stored.flags, stored.columns, stored.keys, text, examples)


def merge_stored(stored: StoredSheets, on_conflict: str = "error", hot_rows: int = merge.HOT_ROWS) -> DataFrame:
    """Outer merge of the stored sheets, as `merge.merge_sheets` gives it."""
    if on_conflict == "error":
        conflicts.refuse(stored_conflicts(stored), [f"Sheet {i}" for i in range(1, len(stored.columns) + 1)])
    elif on_conflict != "keep_left":
        raise ValueError("on_conflict is 'error' or 'keep_left'")
    counts = stored.table.groupBy(*stored.flags, "__sheet").agg(F.count(F.lit(1)).alias("__n"))
    top, total = counts.agg(F.max("__n"), F.sum("__n")).first()
    numbers, columns = range(len(stored.columns)), stored.merged_columns
    if (top or 0) <= 1:
        first = lambda c: F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("__sheet"))).alias(c)
        return stored.table.groupBy(*stored.flags).agg(*[first(c) for c in columns]).select(*[f"`{c}`" for c in columns])
    if top > max(hot_rows, total // merge.HOT_SHARE):
        sheets = [stored.sheet(i).drop(*stored.flags) for i in numbers]
        return merge.pad_merge(sheets, stored.keys, merge.key_facts(sheets, stored.keys, hot_rows).hot)
    out = stored.table.groupBy(*stored.flags).agg(*[F.any_value(F.col(f"`{k}`"), ignoreNulls=True).alias(f"__all_{k}") for k in stored.keys])
    for i in numbers:
        own = [c for c in stored.columns[i] if c not in stored.keys]
        side = stored.sheet(i).select(*stored.flags, *[F.col(f"`{c}`").alias(f"__{i}_{c}") for c in own])
        out = out.join(side, stored.flags, "left")
    owners = {c: [F.col(f"`__{i}_{c}`") for i in numbers if c in stored.columns[i]] for c in columns if c not in stored.keys}
    return out.select(*[F.col(f"`__all_{c}`").alias(c) if c in stored.keys else F.coalesce(*owners[c]).alias(c) for c in columns])
