"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt into blocks of their pivot cells; each block becomes a cover tree, and so do
the queries. A pair of nodes is dropped when no inner product between them can reach the worst
kth score of the node's queries: q.p <= cq.cp + rq|cp| + rp|cq| + rq rp for centres c and
covering radii r. Every query block first meets one block of its own cell, which gives the
scores to beat; then only cells that may beat them are visited, block by block. Tasks read the
blocks they compare from the staged tables; no tree is shuffled or sent by the driver. Partial
results are at most k rows per query and run, merged by a window."""

from __future__ import annotations

import copy
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import FILE_BLOCKS, in_cells, matrix, meetings, usable, with_block

#: Points of a leaf, queries of a block.
LEAF, QUERIES = 32, 512
_NONE, _EXACT = -(2**63) + 1, 2.0**53


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(1024 * x)


class CoverTree:
    """Nodes cover runs of the points: a centre, the largest distance to it, and children whose
    centres are further apart than half that distance. Points that coincide share a leaf."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        spans, kids, centres, radii, at = [(0, len(ids))], [], [], [], 0
        while at < len(spans):
            begin, end = spans[at]
            run = order[begin:end]
            centre = run[0]
            gap = np.linalg.norm(points[run] - points[centre], axis=1)
            centres.append(centre)
            radii.append(gap.max())
            kids.append((len(spans), len(spans)))
            if end - begin > LEAF and radii[-1] > 0:
                groups, cut = [run[gap <= radii[-1] / 2]], radii[-1] / 2
                rest = run[gap > cut]
                while len(rest):
                    near = np.linalg.norm(points[rest] - points[rest[0]], axis=1) <= cut
                    groups.append(rest[near])
                    rest = rest[~near]
                kids[-1] = (len(spans), len(spans) + len(groups))
                for group in groups:
                    order[begin:begin + len(group)] = group
                    spans.append((begin, begin + len(group)))
                    begin += len(group)
            at += 1
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.__setstate__((ids[order], points[order], np.array(spans), np.array(kids), np.array(radii), place[np.array(centres, np.int64)]))

    def __getstate__(self):
        """Centres as places among the points, whole numbers in as few bytes as hold them."""
        small = [kind for kind in (np.int16, np.int32) if np.abs(self.points).max(initial=0) <= np.iinfo(kind).max]
        return self.ids, self.points.astype(small[0]) if small else self.points, self.spans.astype(np.int32), self.kids.astype(np.int32), self.radii, self.at.astype(np.int32)

    def __setstate__(self, state):
        self.ids, points, self.spans, self.kids, self.radii, self.at = state
        self.points = points.astype(np.float64)
        self.centres = self.points[self.at]
        self.norms = np.linalg.norm(self.centres, axis=1)
        self.longest = np.linalg.norm(self.points, axis=1).max()

    def leaf(self, node: int) -> bool:
        return self.kids[node][0] == self.kids[node][1]


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), _NONE)
        self.ids = np.full((queries, k), 2**63 - 1)

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.scores[at, -1:]).any(0)
        if not keep.any():
            return
        k = self.scores.shape[1]
        scores = np.concatenate([self.scores[at], scores[:, keep]], axis=1)
        ids = np.concatenate([self.ids[at], np.broadcast_to(ids[keep], (len(scores), int(keep.sum())))], axis=1)
        first = np.lexsort((ids, -scores), axis=1)[:, :k]
        self.scores[at], self.ids[at] = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)


def inner_products(q: np.ndarray, p: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; beyond what doubles hold they are taken with Python's integers and cut to a long."""
    if exact:
        return (q @ p.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q).dot(whole(p).T), _NONE + 1, 2**63 - 1).astype(np.int64)


def search(q: CoverTree, p: CoverTree, best: Best) -> None:
    """Dual-tree search of all of q's queries among p's points."""
    exact = q.longest * p.longest < _EXACT

    def compare(node: int, spans: np.ndarray) -> None:
        begin, end = q.spans[node]
        sizes = spans[:, 1] - spans[:, 0]
        at = np.repeat(spans[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        if at[-1] - at[0] == len(at) - 1:  # spans come in order
            at = slice(at[0], at[-1] + 1)
        scores = inner_products(q.points[begin:end], p.points[at], exact)
        scores[q.ids[begin:end, None] == p.ids[at][None, :]] = _NONE
        best.offer(slice(begin, end), scores, p.ids[at])

    def bounds(a: int, b: slice) -> np.ndarray:
        top = p.centres[b] @ q.centres[a] + q.radii[a] * p.norms[b] + p.radii[b] * q.norms[a] + q.radii[a] * p.radii[b]
        return top + 1e-9 * (q.norms[a] + q.radii[a]) * (p.norms[b] + p.radii[b]) + 1

    def beaten(a: int) -> float:
        begin, end = q.spans[a]
        return best.scores[begin:end, -1].min()

    stack = [(0, 0, math.inf)]
    while stack:
        a, b, bound = stack.pop()
        if bound < beaten(a):
            continue
        if p.leaf(b) and q.leaf(a):
            compare(a, p.spans[b:b + 1])
        elif not p.leaf(b) and (q.leaf(a) or p.radii[b] >= q.radii[a]):
            begin, end = p.kids[b]
            top = bounds(a, slice(begin, end))
            alive = np.flatnonzero(top >= beaten(a))
            leaf = p.kids[begin + alive, 0] == p.kids[begin + alive, 1]
            if leaf.any():
                compare(a, p.spans[begin + alive[leaf]])
            inner = alive[~leaf]
            stack += [(a, int(begin + i), float(top[i])) for i in inner[np.argsort(top[inner])]]
        else:
            stack += [(kid, b, float(bounds(kid, slice(b, b + 1))[0])) for kid in range(*q.kids[a].tolist())]


def _tree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    tree = CoverTree(table["id"].to_numpy(), quantised(matrix(table["vec"])))
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _same_width(a: CoverTree, b: CoverTree) -> None:
    """Blocks whose vectors are of different length meet as if the shorter ones went on with zeros."""
    width = max(a.points.shape[1], b.points.shape[1])
    for t in (a, b):
        if t.points.shape[1] < width:
            t.points, t.centres = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (t.points, t.centres))


def top_k(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, id_col, score): the k highest inner products of floor(1024 x) for each row
    whose id is divisible by `every`, among all other rows; ties go to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids; rows
    of one id count as one vector; missing components of shorter vectors count as 0; a query
    with fewer than k others gets them all. An empty table gives an empty result."""
    rows, cells = in_cells(usable(df, id_col, vector_col), quantised)
    counts = cells.blocks
    schema = "cell int, block int, tree binary"
    trees = staged(with_block(rows, counts).select("id", "vec", "cell", "block").groupBy("cell", "block").applyInArrow(_tree, schema), "trees", FILE_BLOCKS)
    asked = rows.where(F.col("id") % every == 0)
    per_cell = {r["cell"]: math.ceil(r["count"] / QUERIES) for r in asked.groupBy("cell").count().collect()}
    queries = staged(with_block(asked, per_cell).select("id", "vec", "cell", "block").groupBy("cell", "block").applyInArrow(_tree, schema), "queries", FILE_BLOCKS)
    state = "qcell int, qblock int, tree binary, best binary, to array<int>"

    def searched(batches):
        """Search each query block in the trees it meets; (block, queries, best before, best) per run of rows of a query block."""
        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                if at != (r["qcell"].as_py(), r["qblock"].as_py()):
                    if held:
                        yield held
                    at, q = (r["qcell"].as_py(), r["qblock"].as_py()), pickle.loads(r["tree"].as_buffer())
                    before = pickle.loads(r["best"].as_buffer()) if "best" in r else None
                    held = at, q, before, copy.deepcopy(before) if before else Best(len(q.ids), k)
                p = pickle.loads(r["other"].as_buffer())
                _same_width(held[1], p)
                search(held[1], p, held[3])
        if held:
            yield held

    def begin(batches):
        """What a query block found in the first tree, and the cells that may hold better scores."""
        for at, q, _, best in searched(batches):
            yield pa.RecordBatch.from_pydict({"qcell": pa.array([at[0]], pa.int32()), "qblock": pa.array([at[1]], pa.int32()), "tree": pa.array([pickle.dumps(q)], pa.binary()),
                                              "best": pa.array([pickle.dumps(best)], pa.binary()), "to": pa.array([may_beat(q, best)], pa.list_(pa.int32()))})

    def may_beat(q: CoverTree, best: Best) -> list[int]:
        """Cells that may hold better scores: no point lies further from the cell's pivot than its range says."""
        norms, found = np.linalg.norm(q.points, axis=1), []
        width = min(q.points.shape[1], cells.pivots.shape[1])
        for cell in counts:
            pivot, reach = cells.pivots[cell][:width], cells.high[cell][cell]
            top = q.points[:, :width] @ pivot + norms * reach
            if (top + 1e-9 * norms * (np.linalg.norm(pivot) + reach) + 1 >= best.scores[:, -1]).any():
                found.append(cell)
        return found

    def go_on(batches):
        """What a query block found in other trees and not before."""
        for _, q, before, best in searched(batches):
            yield answers(q, best, (best.scores > _NONE) & ~(best.ids[:, :, None] == before.ids[:, None, :]).any(2))

    def rows_of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                best = pickle.loads(r["best"])
                yield answers(pickle.loads(r["tree"]), best, best.scores > _NONE)

    def answers(q: CoverTree, best: Best, some: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": np.repeat(q.ids, some.sum(1)), "id": best.ids[some], "score": best.scores[some]})

    result = "query_id long, id long, score long"
    other = trees.select("cell", "block", F.col("tree").alias("other"))
    number = F.element_at(F.create_map(*[F.lit(int(x)) for pair in sorted(counts.items()) for x in pair]), F.col("qcell")) if counts else F.lit(1)
    begun = queries.select(F.col("cell").alias("qcell"), F.col("block").alias("qblock"), "tree")
    own = (F.col("cell") == F.col("qcell")) & (F.col("block") == F.pmod(F.col("qblock"), number))
    first = staged(meetings(begun, other, own).mapInArrow(begin, state), "first", FILE_BLOCKS)
    second = meetings(first, other, F.array_contains("to", F.col("cell")) & ~own).mapInArrow(go_on, result)
    found = first.mapInArrow(rows_of, result).unionByName(second)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
