"""Filter interaction audit over sorted posting lists.

Each filter keeps, per part and range of row numbers, the sorted list of the rows that fail it. Two
lists are merged by galloping: the shorter one's numbers are sought in the longer one, each search
going on from the last find, and the stretches between two finds are taken whole. k lists are
folded into every union that some order of the filters needs; what a filter removes after others
is its list less their union. Sizes of all ranges are summed per part, and every order of the
filters is read off these sums.

Row numbers stand for documents, so repeated ids stay apart, and a range holds RANGE rows at
most, whatever the parts are: no list, group or union grows with a hot part."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged

FILTERS = "ABCDE"
#: Bits of a range of row numbers; a text with more than one of HOT_SHARE copies is looked up in a table of that many rows at most.
RANGE_BITS, HOT_SHARE = 16, 1000
#: Least words, percent of distinct words, percent of capitals, marks.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, re.compile(rb"[#$%&*|]")
_A_Z = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COPY = FILTERS.index("E")


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    data = text.encode("utf-8", "surrogatepass")
    tokens = data.split()
    capitals = len(data) - len(data.translate(None, _A_Z))
    return ((len(tokens) < LEAST_WORDS) | (100 * len(set(tokens)) < DISTINCT * len(tokens)) << 1
            | (100 * capitals > CAPITALS * len(text)) << 2 | (MARKS.search(data) is not None) << 3)


def tested(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Staged (row, doc_id, part, mask, digest): one row per document, numbered; 128 bits tell texts apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array([text_mask(t) for t in texts], pa.int32()),
                 pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())],
                ["doc_id", "part", "mask", "digest"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    facts = rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")
    return staged(facts.withColumn("row", F.monotonically_increasing_id()), "tested")


def later_copies(facts: DataFrame) -> DataFrame:
    """The rows whose text some row of a smaller doc_id has, too; a null id is neither smaller nor larger.

    Texts with a large share of all rows are met by broadcast, at most HOT_SHARE of them; the
    others meet their first id in a shuffle in which no key holds more than that share."""
    named = facts.where("doc_id is not null")
    firsts = staged(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    limit = facts.count() // HOT_SHARE
    hot, rest = firsts.where(F.col("n") > limit).drop("n"), firsts.where(F.col("n") <= limit).drop("n")
    near = named.join(F.broadcast(hot), "digest")
    far = named.join(F.broadcast(hot), "digest", "left_anti").join(rest, "digest")
    return near.unionByName(far).where("doc_id > first").select(*facts.columns)


# --- posting lists -----------------------------------------------------------------------

def _found(keys: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys stand in a sorted list, and whether they are in it."""
    place = np.searchsorted(within, keys)
    if not len(within):
        return place, np.zeros(len(keys), bool)
    return place, within[np.minimum(place, len(within) - 1)] == keys


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted union of sorted lists without repeats, folded from the shortest on."""
    out = np.zeros(0, np.int64)
    for other in sorted(lists, key=len):
        short, long = sorted((out, other), key=len)
        place, there = _found(short, long)
        out = np.insert(long, place[~there], short[~there])
    return out


def difference(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sorted list `left` without what is in `right`."""
    if len(left) <= len(right):
        return left[~_found(left, right)[1]]
    place, there = _found(right, left)
    return np.delete(left, place[there])


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    short, long = sorted((left, right), key=len)
    return short[_found(short, long)[1]]


def list_sizes(table: pa.Table, filters: int) -> pa.Table:
    """Of one range: per part, filter and set of earlier filters (bits) what the filter removes.

    The number of a part goes before the row number, so one list serves all parts of the range."""
    parts = table["part"].combine_chunks().dictionary_encode()
    width = (1 << RANGE_BITS) - 1
    entry = parts.indices.to_numpy().astype(np.int64) << RANGE_BITS | table["row"].to_numpy() & width
    mask = table["mask"].to_numpy()
    chosen = lambda rows: np.unique(entry[rows])
    lists = [chosen(mask >> f & 1 == 1) for f in range(filters)]
    good, toxic = (chosen(table[c].to_numpy(zero_copy_only=False).astype(bool)) for c in ("good", "toxic"))
    unions = {before: union([lists[f] for f in range(filters) if before >> f & 1]) for before in range(1 << filters)}
    out = {c: [] for c in ("part", "filter", "before", "removed", "good", "toxic")}
    for f, before in itertools.product(range(filters), range(1 << filters)):
        if before >> f & 1:
            continue
        gone = difference(lists[f], unions[before])
        sizes = [np.bincount(x >> RANGE_BITS, minlength=len(parts.dictionary)) for x in (gone, _common(gone, good), _common(gone, toxic))]
        some = np.flatnonzero(sizes[0])
        out["part"].append(some)
        out["filter"].append(np.full(len(some), f, np.int32))
        out["before"].append(np.full(len(some), before, np.int32))
        for c, size in zip(("removed", "good", "toxic"), sizes, strict=True):
            out[c].append(size[some])
    columns = {c: np.concatenate(v) for c, v in out.items()}
    return pa.table({**columns, "part": parts.dictionary.take(pa.array(columns["part"], pa.int64()))})


def removals(postings: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, filter, before, removed, good, toxic) over all ranges, from (row, part, mask, good, toxic).

    A row may come more than once, each time with some of its bits. Zeros are left out."""
    ranged = postings.select(F.shiftright("row", RANGE_BITS).alias("range"), "row", "part", "mask", "good", "toxic")
    sizes = ranged.groupBy("range").applyInArrow(lambda table: list_sizes(table, filters), "part string, filter int, before int, removed long, good long, toxic long")
    return sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])


def orders(filters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, filter, earlier filters as bits) of every order of the filters."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(filters[i] for i in order), step, f, before))
            before |= 1 << f
    return out


def interactions(parts: DataFrame, sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step from the parts' sizes (part, total) and `removals`.

    Orders are the factorial of the number of filters, at most 6 of them."""
    n = len(filters)
    if n > 6:
        raise ValueError("orders of more than 6 filters are too many to list")
    weight = [math.factorial(bin(b).count("1")) * math.factorial(max(n - 1 - bin(b).count("1"), 0)) for b in range(1 << n)]
    cells = [(f, b) for f in range(n) for b in range(1 << n) if not b >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before")) for f, b in cells])).alias("cell")
    grid = parts.select("part", "total", each).select("part", "total", "cell.*").join(sums, ["part", "filter", "before"], "left")
    grid = grid.na.fill(0, ["removed", "good", "toxic"])
    same = Window.partitionBy("part", "filter")
    others = F.element_at(F.array(*[F.lit((1 << n) - 1 - (1 << f)) for f in range(n)]), F.col("filter") + 1)
    weighed = F.element_at(F.array(*[F.lit(w) for w in weight]), F.col("before") + 1) * F.col("removed")
    grid = grid.select("*", F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(same).alias("fails"),
                       F.sum(F.when(F.col("before") == others, F.col("removed"))).over(same).alias("unique_fails"),
                       F.sum(weighed).over(same).alias("shapley"))
    steps = parts.sparkSession.createDataFrame(orders(filters), "filter_order string, step int, filter int, before int")
    in_order = Window.partitionBy("part", "filter_order").orderBy("step")
    # a fixed number of rows: the orders of the filters
    return grid.join(F.broadcast(steps), ["filter", "before"]).select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(in_order)).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five filters A to E over whole texts: a row per part, order of the filters and step.

    A: under 50 words; B: under 65 % distinct words; C: over 5 % capitals; D: a mark of `#$%&*|`;
    E: the same text as a row of a smaller id. Null texts are empty, null parts the part ''. Every row
    is a document, also where ids repeat; rows of one id are no copies of each other, and a null id has no
    copies. A document is good or toxic if any of its ratings says so; ratings of unknown or
    null ids count for none. An empty table gives no rows; other columns are ignored."""
    facts = tested(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    entries = facts.where("mask > 0").unionByName(later_copies(facts).withColumn("mask", F.lit(1 << _COPY)))
    rated = labels.where("doc_id is not null").groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    postings = entries.join(rated.where("good or toxic"), "doc_id", "left").na.fill(False, ["good", "toxic"])
    parts = facts.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    return interactions(parts, removals(postings))
