"""Vectors in pivot cells and blocks of bounded size.

Pivots come from a bounded sample; every vector goes to the cell of its nearest pivot, and a
cell of more than BLOCK vectors is dealt into several blocks by a hash of the id. What the
driver learns of the data is one row per cell: its size and its ranges of pivot distances."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.session import discard, recorded

from .common import staged

#: Vectors of a block, pivots, and rows of the sample the pivots are picked from.
BLOCK, PIVOTS, SAMPLE = 4096, 16, 2048
#: Blocks of a file, the least that a task reads of a staged table of blocks.
FILE_BLOCKS = 8

Place = Callable[[np.ndarray], np.ndarray]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): one row per id, without vectors that are null or hold null or non-finite components.

    Rows without an id take no part; of several rows with one id the smallest vector counts."""
    vec = F.col("vec").cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("vec"))
    return rows.where("id is not null and vec is not null").where(good).groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros to the longest (or to `width`)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(lengths.max(initial=0)), width or 0)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.maximum(np.abs(x).max(axis=1, initial=0), 1e-308)[:, None]
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1), 1e-308)[:, None]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0))


@dataclass
class Cells:
    """Pivots, and per cell: number of blocks, centre range and lowest and highest distance to each pivot."""

    pivots: np.ndarray
    blocks: dict[int, int]
    low: dict[int, np.ndarray]
    high: dict[int, np.ndarray]


def pick_pivots(df: DataFrame, place: Place, width: int) -> np.ndarray:
    """Farthest-first pivots from a sample of bounded size, the same at every run."""
    rows = df.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    x = place(matrix(rows["vec"], width))
    if not len(x):
        return np.zeros((0, width))
    chosen, gap = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def in_cells(df: DataFrame, place: Place) -> tuple[DataFrame, Cells]:
    """Stage (id, vec, cell) and describe the cells. `place` gives the points distances are taken of."""
    with recorded() as read:
        points = staged(df.select("id", "vec"), "points")
    width = points.agg(F.max(F.size("vec")).alias("w")).first()["w"] or 0
    pivots = pick_pivots(points, place, width)
    kind = df.schema["vec"].dataType.simpleString()
    at = range(len(pivots))

    def far(column):
        return distances(place(matrix(column, width)), pivots)

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "vec": batch.column("vec"), "cell": pa.array(far(batch.column("vec")).argmin(1), pa.int32())})

    def ranges(batches):
        for batch in batches:
            cell, d = batch.column("cell").to_numpy(), far(batch.column("vec"))
            for c in np.unique(cell):
                own = d[cell == c]
                yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "n": [len(own)], **{f"l{i}": own[:, i].min(keepdims=True) for i in at}, **{f"h{i}": own[:, i].max(keepdims=True) for i in at}})

    if not len(pivots):
        return points.withColumn("cell", F.lit(0)).where("false"), Cells(pivots, {}, {}, {})
    rows = staged(points.mapInArrow(assign, f"id long, vec {kind}, cell int"), "cells")
    discard(df.sparkSession, read)
    low, high = ([f"{x}{i}" for i in at] for x in "lh")
    found = rows.select("vec", "cell").mapInArrow(ranges, "cell int, n long, " + ", ".join(f"{c} double" for c in [*low, *high])).groupBy("cell").agg(
        F.sum("n").alias("n"), *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high]).collect()
    return rows, Cells(pivots, {r["cell"]: math.ceil(r["n"] / BLOCK) for r in found}, *({r["cell"]: np.array([r[c] for c in names]) for r in found} for names in (low, high)))


def with_block(rows: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """Add `block`, the number of a row's block within its cell."""
    if not blocks:
        return rows.withColumn("block", F.lit(0))
    count = F.element_at(F.create_map(*[F.lit(int(x)) for pair in sorted(blocks.items()) for x in pair]), F.col("cell"))
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), count).cast("int"))


def meetings(blocks: DataFrame, others: DataFrame, where: Column) -> DataFrame:
    """Pairs of rows of two staged tables of blocks, the pairs of a left row one after another.

    Each task reads some files of both tables, so neither is shuffled, nor gathered and sent by
    the driver, whatever number of pairs a block takes part in."""
    return blocks.hint("shuffle_replicate_nl").join(others, where)
