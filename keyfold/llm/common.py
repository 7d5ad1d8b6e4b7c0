"""Helpers shared by the operators: Arrow batches, staged tables, words."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.session import staged

#: A word: a run of anything but ASCII blanks. `bytes.split()` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step of a task holds as Python objects.
SLICE_BYTES = 4 << 20

__all__ = ["WORD", "ascii_lower", "read", "slices", "staged", "strings", "word_count", "words"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in `column` hold at most `limit` bytes, or one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for begin, end in itertools.pairwise(cuts):
            yield batch.slice(begin, end - begin)
