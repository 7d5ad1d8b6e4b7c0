"""Source divergence audit by count cells.

Terms of one source are grouped by (count in the source, count in the language): all terms of a
cell have the same value, which is evaluated once. Cells rank by value, with the number of
terms before them as their offset; equal values of several cells are merged, and only values that start
within the wanted ranks are expanded into terms, in UTF-8 order. Two sources meet in
cells as well: (count in one, count in the other). Terms that one of them lacks need no pair, as
they follow from the cells (count, 0) and (0, count) of either alone.

Tasks count terms locally before anything is shuffled, so a frequent term is a few rows. All
arithmetic is in whole numbers: counts times 10**9 in decimals of 38 digits, the rest in longs."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged

#: Terms that a task counts before it hands them on; least documents of a term; ranks of the terms; scale of the shares.
HELD, LEAST, RANKS, SCALE = 800_000, 3, 200, 1_000_000_000
#: Bytes that are no part of a term become blanks, A-Z small letters.
_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_GROUP = ["lang", "source"]
#: Counts below this, times SCALE, fit a long; pairs that a task adds up together, terms looked at together.
FITS, PAIRS, ROWS = 9_000_000_000, 3 << 20, 1000


def terms(text: str) -> list[bytes]:
    """Runs of letters A-Z, made small, and of code points from U+0080 on."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, in parts that are still to be summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, found, held = defaultdict(Counter), defaultdict(Counter), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for key in list(counts):
                counter, documents = counts.pop(key), found.pop(key)
                n, d = np.fromiter(counter.values(), np.int64, len(counter)), np.fromiter(map(documents.__getitem__, counter), np.int64, len(counter))
                words = pa.array(list(counter), pa.binary()).cast(pa.string())
                lang, source = (pa.repeat(pa.scalar(k, pa.string()), len(counter)) for k in key)
                yield pa.RecordBatch.from_arrays([lang, source, words, pa.array(n), pa.array(d)], ["lang", "source", "term", "n", "d"])

        for batch in slices(batches, "text"):
            for lang, source, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
                tokens, key = terms(text), (lang, source)
                before = len(counts[key])
                counts[key].update(tokens)
                found[key].update(set(tokens))
                held += len(counts[key]) - before
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, d long")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Staged (lang, term, c, sources, counts): the terms in at least `least` documents of the language,
    with their count there and, in the order of the sources, the sources that have them.

    Dealt by language and term once; a term has an entry per source."""
    summed = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    wide = summed.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return staged(wide.where(F.col("d") >= least).select("lang", "term", "c", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts")), "terms")


def unfolded(kept: DataFrame) -> DataFrame:
    """(lang, source, term, n, c): a row per term and source that has it."""
    return kept.select("lang", "term", "c", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", F.col("x.sources").alias("source"), "term", F.col("x.counts").alias("n"), "c")


def pair_cells(kept: DataFrame) -> DataFrame:
    """(lang, source, item, a, b, m): terms that two sources have, source before item, by their counts in both.

    Terms are unfolded to pairs of their sources in arrays of a batch, whose equal cells are added
    up at once; there are as many pairs of sources as the result lists."""
    limit = 1 << 20

    def added(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        lang, source = (table.column(c).combine_chunks() for c in ("lang", "sources"))
        sizes = np.diff(source.offsets.to_numpy())
        lang, source, counts = lang.dictionary_encode(), source.flatten().dictionary_encode(), table.column("counts").combine_chunks().flatten().to_numpy()
        width, codes = len(source.dictionary), source.indices.to_numpy().astype(np.int64)
        starts, langs = np.cumsum(sizes) - sizes, lang.indices.to_numpy().astype(np.int64)
        found = [np.zeros((3, 0), np.int64)]
        for size in np.unique(sizes[sizes > 1]).tolist():
            rows = np.flatnonzero(sizes == size)
            at = starts[rows][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            pair = ((langs[rows][:, None] * width + codes[at][:, i]) * width + codes[at][:, j]).ravel()
            found.append(np.stack([pair, counts[at][:, i].ravel(), counts[at][:, j].ravel()]))
        pair, a, b = np.concatenate(found, axis=1)
        small = (a < limit) & (b < limit) & (pair < 1 << 23)
        packed, m = np.unique(pair[small] << 40 | a[small] << 20 | b[small], return_counts=True)
        pair, a, b, m = (np.concatenate(x) for x in ((packed >> 40, pair[~small]), (packed >> 20 & limit - 1, a[~small]), (packed & limit - 1, b[~small]), (m, np.ones((~small).sum(), np.int64))))
        names = source.dictionary
        return pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(pair // (width * width))), names.take(pa.array(pair // width % width)), names.take(pa.array(pair % width)), *map(pa.array, (a, b, m))],
            ["lang", "source", "item", "a", "b", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                sizes = np.diff(part.column("sources").offsets.to_numpy()).astype(np.int64)
                held.append(part)
                number += int((sizes * (sizes - 1) // 2).sum())
                if number > PAIRS:
                    yield added(pa.Table.from_batches(held))
                    held, number = [], 0
        if held:
            yield added(pa.Table.from_batches(held))

    cells = kept.select("lang", "sources", "counts").mapInArrow(run, "lang string, source string, item string, a long, b long, m long")
    return cells.groupBy("lang", "source", "item", "a", "b").agg(F.sum("m").alias("m"))


def share(count: Column, total: Column, types: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + types)); null without types."""
    long, all_ = count.cast("long"), F.nullif(total.cast("long") + types.cast("long"), F.lit(0))
    small = F.call_function("div", F.lit(SCALE).cast("long") * (long + 1), all_)
    large = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (long.cast("decimal(20,0)") + 1), all_.cast("decimal(21,0)"))
    return F.when(long < FITS, small).otherwise(large) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); shares are at most SCALE + 1, so this is a long."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), q)


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Staged (lang, source, n_group, n_lang, types): a row per occurring group."""
    groups = docs.select(*_GROUP).distinct().join(unfolded(kept).groupBy(*_GROUP).agg(F.sum("n").alias("n_group")), _GROUP, "left")
    langs = kept.groupBy("lang").agg(F.sum("c").alias("n_lang"), F.count(F.lit(1)).alias("types"))
    return staged(groups.join(langs, "lang", "left").na.fill(0, ["n_group", "n_lang", "types"]), "totals")


def top_terms(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, item, value, rank): the terms with a larger share in the source than in the language."""
    rows = unfolded(kept)
    cells = rows.groupBy(*_GROUP, "n", "c").agg(F.count(F.lit(1)).alias("m")).join(groups, _GROUP)
    p, q = share(F.col("n"), F.col("n_group"), F.col("types")), share(F.col("c"), F.col("n_lang"), F.col("types"))
    cells = cells.select(*_GROUP, "n", "c", "m", p.alias("p"), q.alias("q")).where("p > q").select(*_GROUP, "n", "c", "m", divergence(F.col("p"), F.col("q")).alias("value"))
    down = Window.partitionBy(*_GROUP).orderBy(F.desc("value"))
    # every value has a term, so later values than these start past the last rank
    values = cells.groupBy(*_GROUP, "value").agg(F.sum("m").alias("m")).withColumn("at", F.row_number().over(down)).where(F.col("at") <= ranks)
    starts = values.withColumn("start", F.sum("m").over(down) - F.col("m")).where(F.col("start") < ranks)
    wanted = cells.join(starts.select(*_GROUP, "value", "start"), [*_GROUP, "value"]).select(*_GROUP, "n", "c", "value", "start")
    within = Window.partitionBy(*_GROUP, "value").orderBy("term")
    found = rows.join(wanted, [*_GROUP, "n", "c"]).withColumn("at", F.row_number().over(within)).where(F.col("at") <= ranks)
    return found.select(*_GROUP, F.col("term").alias("item"), "value", (F.col("start") + F.col("at")).cast("int").alias("rank")).where(F.col("rank") <= ranks)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each source against every other of its language.

    The sum over all kept terms is that of the terms neither has, corrected by the cells of either
    source and by the cells of both. As many rows as pairs of sources."""
    here = groups.select("lang", "source", F.col("n_group").alias("n_a"), "types")
    there = groups.select("lang", F.col("source").alias("item"), F.col("n_group").alias("n_b"))
    pairs = staged(here.join(there, "lang").where("source <> item"), "pairs")
    whole = lambda x: x.cast("decimal(38,0)")

    def f(a: Column | int, b: Column | int) -> Column:
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        return (divergence(share(a, F.col("n_a"), F.col("types")), share(b, F.col("n_b"), F.col("types"))))

    m, a, b, out = whole(F.col("m")), F.col("a"), F.col("b"), ["lang", "source", "item"]
    alone = unfolded(kept).groupBy("lang", "source", F.col("n").alias("a")).agg(F.count(F.lit(1)).alias("m"))
    other = alone.select("lang", F.col("source").alias("item"), F.col("a").alias("b"), "m")
    met = pair_cells(kept)
    both = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("a"), F.col("a").alias("b"), "m"))
    amounts = [
        pairs.select(*out, (whole(F.col("types")) * whole(f(0, 0))).alias("v")),
        alone.join(pairs, ["lang", "source"]).select(*out, (m * whole(f(a, 0) - f(0, 0))).alias("v")),
        other.join(pairs, ["lang", "item"]).select(*out, (m * whole(f(0, b) - f(0, 0))).alias("v")),
        both.join(pairs, out).select(*out, (m * whole(f(a, b) - f(a, 0) - f(0, b) + f(0, 0))).alias("v")),
    ]
    summed = amounts[0].unionByName(amounts[1]).unionByName(amounts[2]).unionByName(amounts[3]).groupBy(*out).agg(
        F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item"))
    return summed.select(*out, "value", rank.cast("int").alias("rank"))


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` and part `term`, see `pair_values`, `top_terms`.

    Null text, lang and source are ''. Every row is a document, also a repeated one. Texts are counted
    whole. Groups without terms are compared with the others by the share of an unseen term; a
    language without kept terms has pairs of value 0. An empty table gives no rows; other
    columns are ignored."""
    docs = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = kept_terms(docs)
    groups = totals(docs, kept)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs, top = pair_values(kept, groups).withColumn("part", F.lit("pair")), top_terms(kept, groups).withColumn("part", F.lit("term"))
    return pairs.select(columns).unionByName(top.select(columns))
