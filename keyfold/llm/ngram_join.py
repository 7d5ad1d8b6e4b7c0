"""N-gram Jaccard join of documents by prefix trees.

Texts of the same words are one node from the start. The n-grams of a set are ordered alike
everywhere, rarest first by a bounded count sketch. Two sets with a similarity of t share k of the
first n - ceil(t n) + k n-grams of each, so these go, packed by hash range, to where nodes that
share one meet. The nodes of such a group form a star around its smallest node; a star is never
turned into pairs. Only in groups of FEW nodes at most their pairs are counted, ten of them: two nodes that meet
in such groups alone, and fewer than k times, are no candidates. The sets of a star's members go into a trie, shared n-grams first; one
walk carries the overlaps of all members along each path, so common beginnings are counted
once, and drops members, then subtrees, that cannot reach the needed overlap in the length
that remains. Stars of more than STAR members are joined block by block; their blocks first meet
the star's centre, and only stars that this leaves in several components are joined across blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, staged, words
from .components import Forest, components
from .shingles import mixed, shingle_set, text_hash

#: Cells of the count sketch, prefix n-grams of a hash range, members of one trie.
SKETCH, RANGE, STAR = 1 << 18, 1_000_000, 256
#: Members of a group whose pairs are counted one by one; a larger one becomes a star at once.
FEW = 5
#: A prefix is longer by the size divided by this, and two sets must share as many more of its n-grams.
EXTRA = 25
#: Bits (as a power of two) of the filter that keeps texts nobody asks for out of a shuffle.
FILTER = 24
_PARTS, _FAN = 16, 256


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles) >> np.uint64(46)).astype(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """Staged rows (doc_id, n_shingles, node), and per task the parts of a sketch of n-gram counts."""

    def run(batches):
        counts, held = np.zeros(SKETCH, np.int32), False
        for batch in slices(batches, "text"):
            sizes, nodes = [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(words(text), n)
                counts += np.bincount(_cells(shingles), minlength=SKETCH).astype(np.int32) if len(shingles) > SKETCH // 64 else 0
                if len(shingles) <= SKETCH // 64:
                    np.add.at(counts, _cells(shingles), 1)
                sizes.append(len(shingles))
                nodes.append(text_hash(text))
                held = True
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.int64()),
                                              "part": pa.nulls(len(sizes), pa.int32()), "counts": pa.nulls(len(sizes), pa.binary())})
        if held:
            parts = [zstandard.compress(p.astype("<i8").tobytes()) for p in np.split(counts, _PARTS)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(_PARTS, pa.int64()), "n_shingles": pa.nulls(_PARTS, pa.int64()), "node": pa.nulls(_PARTS, pa.int64()),
                                              "part": pa.array(range(_PARTS), pa.int32()), "counts": pa.array(parts, pa.binary())})

    return staged(docs.mapInArrow(run, "doc_id long, n_shingles long, node long, part int, counts binary"), "signatures")


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.decompress(c), "<i8") for c in table["counts"].to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zstandard.compress(total.tobytes())], pa.binary())})


def sketch(signed: DataFrame) -> np.ndarray:
    """The summed sketch, of SKETCH numbers; tasks are summed in groups of a bounded number first."""
    parts = signed.where("part is not null").select("part", "counts")
    for fan in (F.pmod(F.xxhash64("counts"), F.lit(_FAN)), F.lit(0)):
        parts = parts.withColumn("fan", fan).groupBy("part", "fan").applyInArrow(_summed, "part int, counts binary")
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    return np.concatenate([np.frombuffer(zstandard.decompress(bytes(r["counts"])), "<i8") for r in rows]) if rows else np.zeros(SKETCH, np.int64)


def stars(docs: DataFrame, order: np.ndarray, ranges: int, n: int, percent: int) -> DataFrame:
    """Distinct (centre, node): nodes that share prefix n-grams, each group around its smallest node."""
    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(order, 2**31 - 1).astype(np.int32))  # SKETCH numbers

    def flush(held: list[tuple[int, int, np.ndarray]]):
        nodes, sizes = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        shingles = np.concatenate([h[2] for h in held])
        owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(h[2]) for h in held])
        by = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[by], owner[by]
        ranged = ((shingles >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, ranged[1:] != ranged[:-1]])
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shingles)], strict=True):
            local, own = np.unique(owner[a:b], return_inverse=True)
            out.append((int(ranged[a]), shingles[a:b].astype("<u8").tobytes(), own.astype("<i4").tobytes(), nodes[local].astype("<i8").tobytes(), sizes[local].astype("<i8").tobytes()))
        fields = [("range", pa.int32()), *[(c, pa.binary()) for c in ("shingles", "own", "nodes", "sizes")]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [f for f, _ in fields])

    def prefixes(batches):
        held, number, seen = [], 0, set()
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                node = text_hash(text)
                shingles = shingle_set(words(text), n) if node not in seen else ()
                if not len(shingles):
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                size = len(shingles)
                first = size - -(-percent * size // 100) + 1 + size // EXTRA
                held.append((node, size, shingles[np.argsort(counts.value[_cells(shingles)], kind="stable")[:first]]))
                number += first
            if number > 1_000_000:
                yield flush(held)
                held, number = [], 0
        if held:
            yield flush(held)

    def group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Groups of one hash range, cut where sizes lie too far apart to link."""
        column = lambda c, t: [np.frombuffer(x, t) for x in table[c].to_pylist()]
        nodes, own, sizes = column("nodes", "<i8"), column("own", "<i4"), column("sizes", "<i8")
        shingle = np.concatenate(column("shingles", "<u8"))
        node, size = (np.concatenate([a[o] for a, o in zip(x, own, strict=True)]) for x in (nodes, sizes))
        by = np.lexsort((node, size, shingle))
        by = by[np.r_[True, (shingle[by][1:] != shingle[by][:-1]) | (node[by][1:] != node[by][:-1])]]
        shingle, node, size = shingle[by], node[by], size[by]
        fresh = np.r_[True, shingle[1:] != shingle[:-1]] | np.r_[True, 100 * size[:-1] < percent * size[1:]]
        start = np.flatnonzero(fresh)
        members = np.diff(np.r_[start, len(node)])
        centre = np.repeat(np.minimum.reduceat(node, start), members)
        many = np.repeat(members > FEW, members) & (centre != node)
        found = [(centre[many], node[many], np.zeros(many.sum(), np.int64))]  # need 0: candidates at once
        for count in range(2, FEW + 1):
            at = start[members == count][:, None] + np.arange(count)
            i, j = np.triu_indices(count, 1)
            x, y = node[at[:, i]].ravel(), node[at[:, j]].ravel()
            found.append((np.minimum(x, y), np.maximum(x, y), 1 + size[at[:, i]].ravel() // EXTRA))  # sizes ascend within a group
        centre, node, need = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((need, node, centre))
        centre, node, need = centre[by], node[by], need[by]
        at = np.flatnonzero(np.r_[len(by) > 0, (centre[1:] != centre[:-1]) | (node[1:] != node[:-1])])
        if not len(at):
            return pa.table({c: np.zeros(0, np.int64) for c in ("centre", "node", "need", "times")})
        times = np.diff(np.r_[at, len(by)])
        return pa.table({"centre": centre[at], "node": node[at], "need": need[at], "times": times.astype(np.int64)})  # the smallest need comes first

    packed = docs.select("text").mapInArrow(prefixes, "range int, shingles binary, own binary, nodes binary, sizes binary")
    met = packed.groupBy("range").applyInArrow(group, "centre long, node long, need long, times long").groupBy("centre", "node").agg(
        F.min("need").alias("need"), F.sum("times").alias("times"))
    return staged(met.where("times >= need").select("centre", "node"), "stars")


def _place(nodes: np.ndarray) -> np.ndarray:
    return (mixed(nodes.astype(np.uint64)) >> np.uint64(64 - FILTER)).astype(np.int64)


def marked(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the places of the nodes are set."""

    def places(batches):
        for batch in batches:
            place = np.unique(_place(batch.column("node").to_numpy()))
            yield pa.RecordBatch.from_pydict({"part": pa.array(place >> FILTER - 8, pa.int32()), "place": pa.array(place & (1 << FILTER - 8) - 1, pa.int32())})

    def bitmap(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = np.zeros(1 << FILTER - 8, np.uint8)
        held[table["place"].to_numpy()] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((256, 1 << FILTER - 11), np.uint8)
    for r in nodes.select("node").mapInArrow(places, "part int, place int").distinct().groupBy("part").applyInArrow(bitmap, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def trie_links(sets: list[np.ndarray], percent: int) -> Forest:
    """Forest of the links among sorted sets, by one walk through their trie."""
    forest, many = Forest(len(sets)), len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, flat, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(many), sizes)
    shared = df[flat] > 1  # an n-gram of one set adds to no overlap
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(values))
    ranks, owners = rank[flat[shared]], owner[shared]
    by = np.lexsort((owners, ranks))
    posted, bounds = owners[by], np.searchsorted(ranks[by], np.arange(int((df > 1).sum()) + 1))
    by = np.lexsort((ranks, owners))
    paths = np.split(ranks[by], np.cumsum(np.bincount(owners, minlength=many))[:-1])
    order = sorted(range(many), key=lambda i: paths[i].astype(">u4").tobytes())
    lengths = np.array([len(p) for p in paths])

    def along(path: np.ndarray) -> np.ndarray:
        """How many n-grams of a stretch of path each set holds."""
        if not len(path):
            return np.zeros(many, np.int64)
        return np.bincount(np.concatenate([posted[bounds[r]:bounds[r + 1]] for r in path.tolist()]), minlength=many)

    stack = [(0, many, 0, np.zeros(many, np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        group = order[lo:hi]
        first, last = paths[group[0]], paths[group[-1]]
        common = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:common] != last[depth:common])
        deep = depth + int(differ[0]) if len(differ) else common
        overlap = overlap + along(first[depth:deep])
        while lo < hi and lengths[order[lo]] == deep:  # sets that end here
            i = order[lo]
            for j in np.flatnonzero((100 + percent) * overlap >= percent * (sizes + sizes[i])).tolist():
                forest.join(i, j)
            lo += 1
        while lo < hi:
            step, end = paths[order[lo]][deep], lo + 1
            while end < hi and paths[order[end]][deep] == step:
                end += 1
            below = order[lo:end]
            reach = overlap + (lengths[below].max() - deep)
            alive = (100 + percent) * reach >= percent * (sizes + sizes[below].min())
            alive[below[0]] &= end - lo > 1
            if alive.any():
                stack.append((lo, end, deep, overlap))
            lo = end
    return forest


def _links(percent: int, n: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Edges (node, root) among the members of one block, or of two."""
        nodes, at = np.unique(table["node"].to_numpy(), return_index=True)
        packed = table["packed"].take(pa.array(at)).to_pylist()
        sets = [shingle_set(zstandard.decompress(p).split(b" "), n) for p in packed]
        forest = trie_links(sets, percent)
        roots = nodes[[forest.root(i) for i in range(len(nodes))]] if len(nodes) else nodes
        moved = roots != nodes
        return pa.table({"node": nodes[moved], "root": roots[moved]})

    return run


def _joined(jobs: DataFrame, packed: DataFrame, percent: int, n: int) -> DataFrame:
    keys = [c for c in jobs.columns if c != "node"]
    return jobs.join(packed, "node").groupBy(*keys).applyInArrow(_links(percent, n), "node long, root long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Documents link when 100 * intersection >= percent * union of their sets of n-word shingles, A-Z
    lower-cased; a shorter text is one shingle; texts without words, or null, link with nothing.
    Shingles and texts are compared by 64-bit hashes. Rows of one id are one vertex; a row without
    an id has no component; an empty table gives an empty result; other columns are ignored."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = signatures(docs, n)
    rows = signed.where("part is null").select("doc_id", "n_shingles", "node")
    live = rows.where("n_shingles > 0 and doc_id is not null")
    total = live.agg(F.sum("n_shingles")).first()[0] or 0
    reps = live.groupBy("node").agg(F.min("doc_id").alias("rep"))
    ranges = max(1, math.ceil(total * (100 - percent) / 100 / RANGE))
    found = stars(docs.where("doc_id is not null"), sketch(signed), ranges, n, percent)

    asked = found.select("node").union(found.select("centre")).distinct()
    wanted = reps.join(asked, "node").select("node", F.col("rep").alias("doc_id"))
    bits = docs.sparkSession.sparkContext.broadcast(marked(asked))  # FILTER bits, whatever the data

    def pack(batches):
        """Texts whose node may be asked for; the join after it is exact."""
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            nodes = np.array([text_hash(t) for t in texts], np.int64)
            place = _place(nodes)
            some = np.flatnonzero(bits.value[place >> 3] >> (place & 7) & 1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(some)), "node": nodes[some],
                                              "packed": pa.array([zstandard.compress(b" ".join(words(texts[i])), 1) for i in some.tolist()], pa.binary())})

    texts = docs.mapInArrow(pack, "doc_id long, node long, packed binary")
    packed = staged(texts.join(wanted, ["node", "doc_id"]).dropDuplicates(["node", "doc_id"]).select("node", "packed"), "packed")

    sizes = found.groupBy("centre").count().withColumn("blocks", F.ceil(F.col("count") / STAR).cast("int"))
    dealt = found.join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = staged(dealt.select("centre", "block", "node", "blocks"), "dealt")
    centres = dealt.select("centre", "block").distinct().withColumn("node", F.col("centre"))
    near = staged(_joined(dealt.select("centre", "block", "node").unionByName(centres), packed, percent, n), "near")

    members = components(near, "node", "root").withColumnRenamed("component", "label")
    wide = dealt.where("blocks > 1").join(members.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = wide.groupBy("centre").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("centre")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    across = wide.join(open_, "centre").select("centre", "block", "node", other.alias("other")).where("block <> other").select(
        "centre", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node")
    far = staged(_joined(across, packed, percent, n), "far")

    # Rows of one id with different texts are one vertex: their nodes are linked by it.
    several = live.groupBy("doc_id").agg(F.min("node").alias("root"), F.max("node").alias("most")).where("root <> most")
    named = near.unionByName(far).unionByName(live.join(several, "doc_id").where("node <> root").select("node", "root"))
    for c in ("node", "root"):
        named = named.join(reps.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_id")), c)
    labels = components(named, "node_id", "root_id").withColumnRenamed("id", "rep")
    named = reps.join(labels, "rep", "left").select("node", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, "node", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
