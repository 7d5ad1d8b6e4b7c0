"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: each source asks for its weight's share of all words, at most `cap` times its own;
what a capped source leaves is shared again by weight. Slots of BLOCK words are numbered; the
van der Corput point of a slot falls into one source's part of the cumulative targets and so
names its source. A source's documents are shuffled by hash and laid end to end; its slots,
ranked, take equal blocks of that line in turn, over again when it ends.

Running sums and ranks go in two levels (within hash buckets, then over bucket totals), so no
source has to fit one task. Nothing is broadcast or gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count

#: Words of a slot, buckets of a two-level running sum, cells of the cumulative targets, slots of a task.
BLOCK, BUCKETS, GRID, SLOTS = 128, 1024, 4096, 1 << 20
#: Slots of a bucket when they are ranked.
SLOT_BUCKET = 1 << 14
_BITS = 40


def running(df: DataFrame, keys: list[str], bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over all earlier rows of the keys, by bucket, then by `order`."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum")
    df = df.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return df.join(sums, [*keys, "_bucket"]).withColumn(name, (F.col("_base") + F.col("_inner")).cast("long")).drop("_bucket", "_value", "_inner", "_base")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source_no, source, source_size, target) of (source, source_size): shares by weight, capped.

    Sources rank by code point, null last, and take the weights in turn. The sources that the cap
    binds are those with the least cap/weight; each is capped if, with all before it capped, its
    share of the rest would pass its cap."""
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("source_no", number).withColumn("weight", w).withColumn("limit", cap * F.col("source_size"))
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    share = F.greatest(left, F.lit(0.0)) / F.sum("weight").over(after)
    level = ranked.withColumn("level", share).withColumn("need", F.row_number().over(by_need))
    free = level.withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    first = free.withColumn("from", F.min(F.when(F.col("fits"), F.col("need"))).over(everything))
    level = first.withColumn("free", F.max(F.when(F.col("need") == F.col("from"), F.col("level"))).over(everything))
    target = F.when(F.col("need") >= F.col("from"), F.least(F.col("free") * F.col("weight"), F.col("limit"))).otherwise(F.col("limit"))
    return level.withColumn("target", target).select("source_no", "source", "source_size", "target")


def van_der_corput(i: Column) -> Column:
    """The bits of i reversed, as a whole number of 40 bits."""
    return F.conv(F.reverse(F.lpad(F.bin(i), _BITS, "0")), 2, 10).cast("long")


def schedule(plan: DataFrame) -> DataFrame:
    """(source_no, rank, words, position): the slots of each source, ranked in the order of the schedule.

    `plan`: source_no, whole (target in whole words). As many slots as the words ask for are
    drawn; a source's slots past its number are dropped and missing ones appended, so that it
    gets its words exactly; its last slot may be short."""
    ends = plan.withColumn("hi", F.sum("whole").over(Window.orderBy("source_no"))).withColumn("lo", F.col("hi") - F.col("whole"))
    ends = ends.withColumn("total", F.sum("whole").over(Window.partitionBy())).where("whole > 0").withColumn("slots", F.ceil(F.col("whole") / BLOCK))
    cell = lambda x: F.floor(x / F.col("total") * GRID).cast("long")
    parts = ends.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(GRID - 1)))))
    spark = plan.sparkSession
    number = plan.agg(F.coalesce(F.ceil(F.sum("whole") / BLOCK), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, number // SLOTS)
    drawn = spark.range(0, number, 1, tasks).withColumnRenamed("id", "position")
    point = van_der_corput(F.col("position")) / float(1 << _BITS)
    drawn = drawn.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * GRID).cast("long"))
    at = F.col("point") * F.col("total")
    placed = drawn.join(parts, "cell").where((at >= F.col("lo")) & (at < F.col("hi"))).select("source_no", "position")
    ranked = running(placed, ["source_no"], F.floor(F.col("position") / SLOT_BUCKET), ["position"], F.lit(1), "rank")
    need = ends.select("source_no", "whole", "slots")
    got = need.join(ranked.groupBy("source_no").count(), "source_no", "left")
    more = got.where(F.coalesce("count", F.lit(0)) < F.col("slots")).select(
        "source_no", "whole", F.explode(F.sequence(F.coalesce("count", F.lit(0)), F.col("slots") - 1)).alias("rank"), F.lit(None).cast("long").alias("position"))
    slots = ranked.join(need, "source_no").where(F.col("rank") < F.col("slots")).select("source_no", "whole", "rank", "position").unionByName(more)
    return slots.select("source_no", "rank", F.least(F.lit(BLOCK), F.col("whole") - F.col("rank") * BLOCK).alias("words"), "position")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
        cap: float = 3.0, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its documents.

    Mixture: (position, source_no, rank, epoch, row, begin, words): words `begin` on of a document
    that a slot takes; a null position stands after all others. Documents: (row, doc_id, source,
    size, source_size, target, source_no), one per input row; `row` tells repeated rows apart
    (`row_col` if there is such a column, else a number of this run).
    Null texts have no words and are never taken; an empty table gives empty results."""
    sized = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"),
                        (docs[row_col] if row_col else F.monotonically_increasing_id()).alias("row"))
    sized = staged(sized, "sized")
    plan = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    members = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    line = running(members.where("size > 0").withColumn("order", order), ["source_no"], F.pmod(F.shiftright("order", 32), F.lit(BUCKETS)), ["order", "doc_id", "size", "row"], F.col("size"), "start")
    slots = schedule(plan.select("source_no", F.least(F.round("target"), F.floor(cap * F.col("source_size"))).cast("long").alias("whole")))
    # A slot is a stretch of the endless line of a source; cut where the line starts again, then into fixed blocks.
    length = plan.where("source_size > 0").select("source_no", "source_size")
    from_ = F.col("rank") * BLOCK
    cut = slots.join(length, "source_no").withColumn("epoch", F.explode(F.sequence(F.floor(from_ / F.col("source_size")), F.floor((from_ + F.col("words") - 1) / F.col("source_size")))))
    cut = cut.withColumn("lo", F.greatest(from_ - F.col("epoch") * F.col("source_size"), F.lit(0))).withColumn("hi", F.least(from_ + F.col("words") - F.col("epoch") * F.col("source_size"), F.col("source_size")))
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BLOCK), F.floor((hi - 1) / BLOCK)))
    cut = cut.select("position", "source_no", "rank", "epoch", "lo", "hi", blocks(F.col("lo"), F.col("hi")).alias("block"))
    pieces = line.select("source_no", "row", "start", "size", blocks(F.col("start"), F.col("start") + F.col("size")).alias("block"))
    begin = F.greatest("lo", "start", F.col("block") * BLOCK)
    end = F.least("hi", F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    mixture = cut.join(pieces, ["source_no", "block"]).withColumn("words", end - begin).where("words > 0").select(
        "position", "source_no", "rank", "epoch", "row", (begin - F.col("start")).alias("begin"), "words")
    return mixture, members


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's) and taken, the words the mix takes of it."""
    mixture, members = mix(docs, **options)
    words = mixture.groupBy("row").agg(F.sum("words").alias("taken"))
    return members.join(words, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
