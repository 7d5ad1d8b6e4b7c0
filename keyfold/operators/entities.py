"""Name resolution: leader clusters of similar names, exact and without all-pairs work.

Names are taken in first-seen order, equal positions by name. A name that matches no earlier leader becomes a
leader; any other name joins the earliest leader it matches. That sequential rule is
kept, but run in rounds: the next block of undecided names (a fixed number, so small
enough for the driver and for every task) yields its leaders, then all remaining names
are matched against just those leaders in parallel. A name settled in one round never
comes back, so the work is names x leaders, no pair inside a cluster is ever formed,
and one huge cluster costs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from keyfold import fixed
from keyfold.functions.cells import expand_name, strip
from keyfold.functions.similarity import NameIndex
from keyfold.session import staged, work_folder

_NAMES = "name string, n bigint, first_ord bigint"
_SETTLED = _NAMES + ", cluster_id bigint"
BLOCK = 1000


def name_counts(df: DataFrame, name_col: str, order: Column) -> DataFrame:
    """Distinct stripped names with their row count and first position."""
    return (
        df.select(strip(name_col).alias("name"), order.cast("bigint").alias("ord"))
        .where(F.col("name") != "")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    )


def _lead(block: list, threshold: float, next_id: int) -> tuple[list[str], list[tuple]]:
    """Leaders of one block, and the block's rows with their cluster ids."""
    index, leaders, settled = NameIndex([], threshold), [], []
    for row in block:
        hit = index.first_match(row["name"])
        if hit is None:
            hit = len(leaders)
            leaders.append(row["name"])
            index.add(row["name"])
        settled.append((row["name"], row["n"], row["first_ord"], next_id + hit))
    return leaders, settled


def _assign(names: DataFrame, leaders: list[str], threshold: float, next_id: int) -> DataFrame:
    """Give every name its earliest matching leader of this round, else null."""
    shared = names.sparkSession.sparkContext.broadcast(leaders)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = NameIndex(shared.value, threshold)
        for pdf in batches:
            hits = [index.first_match(name) for name in pdf["name"]]
            ids = pd.array([None if h is None else next_id + h for h in hits], dtype="Int64")
            yield pdf.assign(cluster_id=ids)

    return names.mapInPandas(match, _SETTLED)


def cluster_names(names: DataFrame, threshold: float = fixed.NAME_THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(name, n, first_ord) -> the same plus cluster_id, numbered in leader order.

    Names of one form (lower case, short forms written out) match alike, so the first of
    them is clustered and the others follow it."""
    formed = staged(names.withColumn("__form", expand_name("name")), "forms")
    firsts = formed.groupBy("__form").agg(F.min_by("name", F.struct("first_ord", "name")).alias("name"), F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))
    found = _cluster_forms(firsts.select("name", "n", "first_ord"), threshold, block)
    ids = found.select(expand_name("name").alias("__form"), "cluster_id")
    return formed.join(ids, "__form").select("name", "n", "first_ord", "cluster_id")


def _cluster_forms(names: DataFrame, threshold: float, block: int) -> DataFrame:
    """The rounds; every size takes the same way."""
    spark = names.sparkSession
    folder = work_folder(spark, "names")
    names.write.parquet(f"{folder}/open/round=0")
    next_id, turn, parts = 0, 0, []
    while True:
        # every round reads a written table, so a lost executor repeats one round at most
        open_names = spark.read.schema(_NAMES).parquet(f"{folder}/open/round={turn}")
        head = open_names.orderBy("first_ord", "name").limit(block).collect()
        if not head:
            break
        leaders, settled = _lead(head, threshold, next_id)
        spark.createDataFrame(settled, _SETTLED).write.parquet(f"{folder}/settled/turn={turn}/part=head")
        parts.append(f"{folder}/settled/turn={turn}/part=head")
        if len(head) < block:
            break
        last = head[-1]
        rest = open_names.where((F.col("first_ord") > last["first_ord"]) | (F.col("first_ord") == last["first_ord"]) & (F.col("name") > F.lit(last["name"])))
        matched = f"{folder}/matched/turn={turn}"
        _assign(rest, leaders, threshold, next_id).write.parquet(matched)
        decided = spark.read.schema(_SETTLED).parquet(matched)
        decided.where("cluster_id is null").drop("cluster_id").write.parquet(f"{folder}/open/round={turn + 1}")
        parts.append(matched)
        next_id += len(leaders)
        turn += 1
    return spark.read.schema(_SETTLED).parquet(*parts).where("cluster_id is not null")


def canonical_names(clusters: DataFrame) -> DataFrame:
    """The most frequent spelling of each cluster; the first seen wins a tie."""
    best = clusters.groupBy("cluster_id").agg(
        F.max_by("name", F.struct("n", -F.col("first_ord"))).alias("canonical"))
    return clusters.join(best, "cluster_id").select("name", "n", "first_ord", "canonical", "cluster_id")


def resolve_names(
    df: DataFrame,
    name_col: str,
    order: Column,
    threshold: float = fixed.NAME_THRESHOLD,
    canonical_col: str = "vendor_canonical",
    cluster_col: str | None = "vendor_cluster_id",
    block: int = BLOCK,
) -> DataFrame:
    """Add the canonical spelling, and a cluster id unless `cluster_col` is None."""
    if name_col not in df.columns:
        out = df.withColumn(canonical_col, F.lit(None).cast("string"))
        return out.withColumn(cluster_col, F.lit(None).cast("bigint")) if cluster_col else out
    clusters = cluster_names(name_counts(df, name_col, order), threshold, block)
    lookup = canonical_names(clusters).select(
        F.col("name").alias("__name"), F.col("canonical").alias(canonical_col),
        *([F.col("cluster_id").alias(cluster_col)] if cluster_col else []))
    return df.join(lookup, strip(name_col) == F.col("__name"), "left").drop("__name")
