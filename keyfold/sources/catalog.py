"""Sheet catalog and content fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keyfold.model import Sheet, data_columns

_LANE_HEX, _CHUNK_BITS, _CHUNKS = 15, 20, 3
#: 4 lanes of 60 bits of each row's SHA-256, each in pieces of 20 bits with their places.
LANES = {i: [_CHUNK_BITS * k for k in range(_CHUNKS)] for i in range(4)}


def row_text(df: DataFrame) -> Column:
    """A row as text: cells in column order, null marked apart from blank."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in data_columns(df)])


def hash_lanes(df: DataFrame) -> DataFrame:
    """Add the lanes of each row's hash."""
    hashed = df.withColumn("__hash", F.sha2(row_text(df), 256))
    return hashed.withColumns({f"__lane{i}": F.conv(F.substring("__hash", 1 + _LANE_HEX * i, _LANE_HEX), 16, 10).cast("bigint") for i in LANES})


def lane_sums() -> list[Column]:
    """Sums of the lanes, 20 bits at a time: a plain long holds the sum of 2^43 rows."""
    mask = F.lit((1 << _CHUNK_BITS) - 1)
    return [F.coalesce(F.sum(F.shiftright(f"__lane{i}", bits).bitwiseAND(mask)), F.lit(0)).alias(f"s{i}_{k}")
            for i, shifts in LANES.items() for k, bits in enumerate(shifts)]


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, content_hash): the same for the same rows in any order and partitioning.

    Sums of four slices of each row's SHA-256 are combined, so it is one aggregate; the
    multiset of rows decides, a doubled row included."""
    sums = hash_lanes(df).agg(F.count(F.lit(1)).alias("n_rows"), *lane_sums())
    piece = lambda i, k, bits: F.col(f"s{i}_{k}").cast("decimal(38,0)") * F.lit(1 << bits).cast("decimal(20,0)")
    whole = [sum((piece(i, k, bits) for k, bits in list(enumerate(shifts))[1:]), F.col(f"s{i}_0").cast("decimal(38,0)")).cast("decimal(38,0)")
             for i, shifts in LANES.items()]
    return sums.select("n_rows", F.sha2(F.concat_ws("-", F.col("n_rows").cast("string"),
                                                    *[w.cast("string") for w in whole]), 256).alias("content_hash"))


def catalog(sheets: Sequence[Sheet], with_hash: bool = False) -> DataFrame:
    """One row per sheet: ids, file, row and column counts, columns, types (and hash)."""
    rows = []
    for s in sheets:
        columns = s.data_columns
        facts = fingerprint(s.df.select(*[f"`{c}`" for c in columns])) if with_hash else s.df.agg(F.count(F.lit(1)).alias("n_rows"))
        types = {f.name: f.dataType.simpleString() for f in s.df.schema}
        rows.append(facts.select(
            F.lit(s.dataset_id).alias("dataset_id"), F.lit(s.company_id).alias("company_id"),
            F.sha2(F.lit(f"{s.dataset_id}|{s.name}"), 256).alias("sheet_id"), F.lit(s.name).alias("sheet"),
            F.lit(s.source_file).cast("string").alias("source_file"), F.col("n_rows").alias("row_count"),
            F.lit(len(columns)).alias("column_count"), F.array(*map(F.lit, columns)).alias("columns"),
            F.array(*[F.lit(types[c]) for c in columns]).alias("inferred_types"),
            *([F.col("content_hash")] if with_hash else [])))
    return reduce(DataFrame.unionByName, rows)
