"""Near-duplicate vectors by an exact metric range join.

Pivots partition the unit vectors into cells, and cells into blocks. A vector may have a
neighbour within the range in another block only if, for every pivot, its distance lies within
the block's range of distances widened by the search range (triangle inequality). Blocks whose
ranges are that close meet, vectors that lie that close are compared, and the answers are counts
and a spanning forest, never pairs. Tasks read the blocks they compare from the staged table, so
disk grows with the vectors, not with the pairs of blocks. Cosine c and distance d of unit
vectors: d*d = 2-2c."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import Forest, components
from .vectors import FILE_BLOCKS, distances, in_cells, matrix, meetings, unit, usable, with_block

ROWS = 512  # rows of a block compared at a time


def _forest(links: np.ndarray, forest: Forest, at: np.ndarray, shift: int) -> None:
    """Join what a boolean matrix links: rows that stand at `at` with columns shift.. of the forest."""
    rows, cols = np.nonzero(links)
    if not len(rows):
        return
    first = np.r_[True, rows[1:] != rows[:-1]]
    chains = np.unique(np.c_[cols[:-1], cols[1:]][~first[1:]], axis=0)  # columns that one row links
    for x, y in zip(at[rows[first]].tolist(), (cols[first] + shift).tolist(), strict=True):
        forest.join(x, y)
    for x, y in (chains + shift).tolist():
        forest.join(x, y)


def _joined(ids: np.ndarray, x: np.ndarray, more_ids: np.ndarray | None, y: np.ndarray | None, least: float):
    """Ids with their number of links and the root of their tree, of one block or of two.

    Rows are first compared in single precision, whose error is below the slack."""
    own = y is None
    all_ids = ids if own else np.r_[ids, more_ids]
    shift = 0 if own else len(ids)
    y = x if own else y
    forest, count = Forest(len(all_ids)), np.zeros(len(all_ids), np.int64)
    rough, other, slack = x.astype(np.float32), y.astype(np.float32).T, (x.shape[1] + 8) * 2.0**-23
    for begin in range(0, len(ids), ROWS):
        cosines = rough[begin:begin + ROWS] @ other
        if own:
            np.fill_diagonal(cosines[:, begin:], -2)
        at = begin + np.flatnonzero(cosines.max(axis=1, initial=-2) >= least - slack)
        if not len(at):
            continue
        links = x[at] @ y.T >= least
        if own:
            links &= np.arange(len(y))[None, :] > at[:, None]
        count[at] += links.sum(1)
        count[shift:shift + len(y)] += links.sum(0)
        _forest(links, forest, at, shift)
    at = np.flatnonzero(count)
    roots = np.array([forest.root(i) for i in at.tolist()], np.int64)
    return all_ids[at], count[at], all_ids[roots]


def links(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id, links, root) rows: partial link counts, and a forest of the links as edges id - root."""
    rows = usable(df, id_col, vector_col).where(F.exists("vec", lambda v: v != 0))
    rows, cells = in_cells(rows, unit)
    reach = math.sqrt(max(2 - 2 * cosine, 0)) * (1 + 1e-9) + 1e-7
    pivots, width = cells.pivots, cells.pivots.shape[1]
    kind = "<f4" if rows.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"
    before = dict(zip(sorted(cells.blocks), np.cumsum([0, *(cells.blocks[c] for c in sorted(cells.blocks))]).tolist()))
    fields = [("number", pa.int32()), ("size", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]

    def far(x: np.ndarray) -> np.ndarray:
        return distances(np.pad(x, ((0, 0), (0, width - x.shape[1]))), pivots)

    def near(d: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Which vectors may have one of the others within reach."""
        return ((d >= other.min(0) - reach) & (d <= other.max(0) + reach)).all(1)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A block's vectors of one length, which link with no others, and their ranges of pivot distances."""
        ids, out = table["id"].to_numpy().astype("<i8"), []
        lengths = pa.compute.list_value_length(table["vec"]).to_numpy()
        for size in np.unique(lengths):
            same = np.flatnonzero(lengths == size)
            own = matrix(table["vec"].take(pa.array(same)))
            d = far(unit(own))
            out.append((before[key[0].as_py()] + key[1].as_py(), int(size), ids[same].tobytes(), own.astype(kind).tobytes(), d.min(0).tolist(), d.max(0).tolist()))
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])

    def opened(size: int, ids: pa.Scalar, vecs: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = unit(np.frombuffer(vecs.as_buffer(), kind).reshape(-1, size).astype(np.float64))
        return np.frombuffer(ids.as_py(), "<i8"), x, far(x)

    def compare(batches):
        at = None
        for batch in batches:
            for i in range(batch.num_rows):
                number, size, ids, vecs, more, more_ids, more_vecs = (c[i] for c in batch.columns)
                if at != (number.as_py(), size.as_py()):
                    at = number.as_py(), size.as_py()
                    own, x, d = opened(at[1], ids, vecs)
                if more.as_py() == at[0]:
                    found = _joined(own, x, None, None, cosine)
                else:
                    others, y, e = opened(at[1], more_ids, more_vecs)
                    mine, theirs = near(d, e), near(e, d)
                    found = _joined(own[mine], x[mine], others[theirs], y[theirs], cosine)
                yield pa.RecordBatch.from_pydict(dict(zip(("id", "links", "root"), found, strict=True)))

    blocks = staged(with_block(rows, cells.blocks).groupBy("cell", "block").applyInArrow(
        pack, "number int, size int, ids binary, vecs binary, low array<double>, high array<double>"), "blocks", FILE_BLOCKS)
    others = blocks.select(*[F.col(c).alias(f"more_{c}") for c in blocks.columns])
    reached = [F.forall(F.zip_with(a, b, lambda x, y: x <= y + reach), lambda x: x) for a, b in (("low", "more_high"), ("more_low", "high"))]
    pairs = meetings(blocks, others, (F.col("number") <= F.col("more_number")) & (F.col("size") == F.col("more_size")) & reached[0] & reached[1])
    found = pairs.select("number", "size", "ids", "vecs", "more_number", "more_ids", "more_vecs").mapInArrow(compare, "id long, links long, root long")
    return staged(found.groupBy("id", "root").agg(F.sum("links").alias("links")).select("id", "links", "root"), "links")


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Per id: n_links, component_id (smallest id reachable by links) and kept (it is that id).

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different length. Rows of one id count as one vector; null ids come back unlinked."""
    found = links(df, id_col=id_col, vector_col=vector_col, cosine=cosine)
    number = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    members = components(found, "id", "root")
    ids = df.select(df[id_col].cast("long").alias("id")).distinct()
    out = ids.join(number, "id", "left").join(members, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
