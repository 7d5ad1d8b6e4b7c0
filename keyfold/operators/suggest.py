"""Suggesting a canonical field per header: exact spelling, then fuzzy, then content.

Headers and spellings are metadata (a few hundred rows at most), so they are compared
inside one Arrow function; only the content test reads data, as one aggregate per sheet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from keyfold import fixed
from keyfold.functions import cells, similarity
from keyfold.model import Sheet
from keyfold.operators.mapping import MappingConfig
from keyfold.operators.profile import long_text
from keyfold.schema import CanonicalSchema


def column_catalog(sheets: Sequence[Sheet]) -> DataFrame:
    """(sheet, position, header) of every column."""
    rows = [(s.name, i, c) for s in sheets for i, c in enumerate(s.data_columns)]
    return sheets[0].df.sparkSession.createDataFrame(rows, "sheet string, position int, header string")


def best_alias(header: Column, aliases: Sequence[str], threshold: float) -> Column:
    """struct(alias, score) of the spelling with the highest token-sort ratio, the first
    listed on a tie; null below the threshold."""
    listed = list(aliases)

    @F.pandas_udf("alias string, score double")
    def search(headers: pd.Series) -> pd.DataFrame:
        prepared = [similarity.sort_tokens(a) for a in listed]
        found = []
        for h in headers:
            key, best, score = similarity.sort_tokens(h), None, threshold
            for alias, other in zip(listed, prepared):
                shorter, total = min(len(key), len(other)), len(key) + len(other)
                bound = 200.0 * shorter / total if total else 100.0
                if bound < score or (best is not None and bound <= score):
                    continue
                ratio = similarity.indel_ratio(key, other)
                if ratio > score or (best is None and ratio >= score):
                    best, score = alias, ratio
            found.append((best, score if best is not None else None))
        return pd.DataFrame(found, columns=["alias", "score"])

    return search(header)


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(c, "_", " "), r"\s+"), lambda w: w != ""))


def sensible(header: Column, alias: Column, canonical: Column, score: Column) -> Column:
    """Veto on fuzzy matches: money words never lead to an id, id words alone never to
    money, and a score below 90 needs a shared word of more than two letters."""
    words = _words(header)
    money = F.arrays_overlap(words, F.array(*map(F.lit, fixed.FINANCIAL_WORDS)))
    ids = F.arrays_overlap(words, F.array(*map(F.lit, fixed.ID_WORDS)))
    shared = F.exists(F.array_intersect(words, _words(alias)), lambda w: F.length(w) > 2)
    veto = ((canonical == "contract_id") & money) \
        | (canonical.isin("acv", "total_value") & ids & ~money) \
        | ((score < 90) & ~shared)
    return ~veto


def value_types(sheets: Sequence[Sheet], only: dict[str, list[str]] | None = None) -> DataFrame:
    """(sheet, column, non_blank, value_type): the shape of more than 60 % of the
    non-blank cells; dates are tried first, then money, then ids. Whole columns, all of
    them or those listed in `only` per sheet."""
    cell = F.nullif(cells.strip("value"), F.lit(""))
    wanted = {s.name: s.data_columns if only is None else only.get(s.name, []) for s in sheets}
    sheets = [s for s in sheets if wanted[s.name]]
    longs = [long_text(s.df, wanted[s.name]).select(F.lit(s.name).alias("sheet"), "column", cell.alias("cell")) for s in sheets]
    hits = cells.shape_hits(F.col("cell"))
    rows = reduce(DataFrame.unionByName, longs).groupBy("sheet", "column").agg(
        F.count("cell").alias("non_blank"), *[F.count_if(hit).alias(shape) for shape, hit in hits.items()])
    rate = {shape: F.try_divide(F.col(shape), F.col("non_blank")) > fixed.SHAPE_RATE for shape in hits}
    kind = F.when(rate["date"], "date").when(rate["currency"], "currency").when(rate["id"], "id")
    return rows.select("sheet", "column", "non_blank", kind.alias("value_type"))


def _has_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def field_from_type(header: Column, value_type: Column) -> Column:
    """A field from the value shape and the words in the header."""
    low = F.lower(F.trim(header))
    by_date = F.when(_has_any(low, fixed.CLOSE_HINTS), "close_date") \
        .when(_has_any(low, fixed.START_HINTS), "start_date") \
        .when(_has_any(low, fixed.END_HINTS), "end_date") \
        .when(_has_any(low, fixed.RENEWAL_HINTS), "renewal_date")
    return F.when(value_type == "date", by_date) \
        .when(value_type == "currency", F.when(_has_any(low, fixed.TOTAL_HINTS), "total_value").otherwise("acv")) \
        .when(value_type == "id", F.when(_has_any(low, fixed.ID_HINTS), "contract_id"))


def suggest_mappings(sheets: Sequence[Sheet], schema: CanonicalSchema | None = None,
                     threshold: float = fixed.HEADER_THRESHOLD) -> DataFrame:
    """(sheet, position, raw, canonical, score, method, matched_alias); unmapped headers
    have a null field. A content suggestion is only made for a field no other header of
    the sheet leads to, and goes to the first such column."""
    schema = schema or CanonicalSchema.default()
    spark = sheets[0].df.sparkSession
    alias_of = schema.alias_frame(spark).select("alias", "canonical")
    headers = column_catalog(sheets).withColumn("low", F.lower(cells.strip("header")))

    exact = headers.join(F.broadcast(alias_of.withColumnsRenamed({"alias": "low", "canonical": "exact"})), "low", "left")
    fuzzy = exact.withColumn("hit", F.when(F.col("exact").isNull(), best_alias(F.col("low"), schema.all_aliases, threshold)))
    fuzzy = fuzzy.join(F.broadcast(alias_of.withColumnsRenamed({"canonical": "near"})),
                       F.col("hit.alias") == F.col("alias"), "left")
    ok = F.coalesce(sensible(F.col("low"), F.col("alias"), F.col("near"), F.col("hit.score")), F.lit(False))
    named = fuzzy.select(
        "sheet", "position", "header", "exact",
        F.when(ok, F.col("near")).alias("near"), F.when(ok, F.floor("hit.score")).alias("near_score"),
        F.when(ok, F.col("alias")).alias("matched_alias"))

    # one row per header; only columns no name led to are read
    known = named.collect()
    named = spark.createDataFrame(known, named.schema)
    unnamed: dict[str, list[str]] = {}
    for r in known:
        if r["exact"] is None and r["near"] is None:
            unnamed.setdefault(r["sheet"], []).append(r["header"])
    kinds = value_types(sheets, unnamed) if unnamed else spark.createDataFrame([], "sheet string, column string, value_type string")
    typed = named.join(kinds.withColumnRenamed("column", "header"), ["sheet", "header"], "left") \
        .withColumn("by_name", F.coalesce("exact", "near")) \
        .withColumn("guess", F.when(F.col("by_name").isNull(), field_from_type(F.col("header"), F.col("value_type"))))
    # one row per header from here on: windows over catalog rows only
    taken = typed.withColumn("named_fields", F.collect_set("by_name").over(Window.partitionBy("sheet")))
    first = Window.partitionBy("sheet", "guess").orderBy("position")
    content = F.when(F.col("guess").isNotNull() & ~F.array_contains("named_fields", F.col("guess"))
                     & (F.row_number().over(first) == 1), F.col("guess"))
    out = taken.withColumn("content", content)
    return out.select(
        "sheet", "position", F.col("header").alias("raw"),
        F.coalesce("by_name", "content").alias("canonical"),
        F.when(F.col("exact").isNotNull(), F.lit(100)).when(F.col("near").isNotNull(), F.col("near_score"))
        .when(F.col("content").isNotNull(), F.lit(fixed.CONTENT_SCORE)).cast("int").alias("score"),
        F.when(F.col("exact").isNotNull(), "exact_alias").when(F.col("near").isNotNull(), "fuzzy")
        .when(F.col("content").isNotNull(), "content_detection").alias("method"),
        "matched_alias")


def accept_suggestions(suggestions: DataFrame, version: str = "v1") -> MappingConfig:
    """A mapping configuration of all suggested entries (one row per header, so small)."""
    rows = suggestions.where("canonical is not null").orderBy("sheet", "position").collect()
    return MappingConfig([(r["canonical"], r["sheet"], r["raw"]) for r in rows], version)
