"""Rolling line items up to one row per record, and keeping the best of duplicates.

Every aggregate here combines map-side, so a key that holds a large part of all rows
reaches the reducers as a few partial rows. Where values are joined, that takes two aggregates;
if a count shows that no key has very many lines, one aggregate does it. 'first' means first non-null value in row
order, which needs an explicit order column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keyfold import fixed
from keyfold.functions.cells import round_exact, strip
from keyfold.model import ORD
from keyfold.session import staged

# Up to so many lines a key's cells are collected before equal ones become one.
FEW_LINES = 10_000
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)

GRAINS = ("contract_level", "line_item_level", "mixed")


def is_blank(c: Column) -> Column:
    """Whether text holds white space only; it is read up to the first other character."""
    return F.ltrim(c, F.lit(fixed.WHITESPACE)) == ""


def _first(c: str, order: Column) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), order))


def _simple_agg(c: str, method: str, order: Column, boolean: bool = False) -> Column:
    if method == "sum":
        value = F.col(c).cast("bigint") if boolean else F.col(c)
        return F.coalesce(F.sum(value), F.lit(0))
    if method in ("min", "max"):
        return getattr(F, method)(c)
    if method == "mean":
        return F.avg(c)
    if method == "count":
        return F.count(F.lit(1))
    return _first(c, order)  # 'first', and the fallback for unknown methods


def pure_booleans(df: DataFrame) -> list[str]:
    """Boolean columns declared without nulls."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType) and not f.nullable]


def default_method(df: DataFrame, c: str, flags: Sequence[str] | None = None) -> str:
    """Numbers and booleans that are never missing (`flags`, by default those declared so)
    are summed, true counting 1; anything else keeps its first value."""
    flags = pure_booleans(df) if flags is None else flags
    return "sum" if c in flags or isinstance(df.schema[c].dataType, T.NumericType) else "first"


def stored_rows(df: DataFrame, label: str = "lines") -> DataFrame:
    """The rows as a staged table, or as they are where a column's type cannot be stored."""
    return staged(df, label) if all(isinstance(f.dataType, _PLAIN) for f in df.schema) else df


def most_lines(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the complete key that has most, at the least: keys of one 64-bit hash count as one."""
    return df.na.drop(subset=list(keys)).groupBy(F.xxhash64(*keys)).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0


def group_aggregate(df: DataFrame, keys: Sequence[str], methods: dict[str, str], order: Column,
                    count_col: str | None = None, keep_blank: bool = False, orphans: bool = False,
                    orphan_cols: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """Group by keys with one method per column, reading `df` once.

    Where distinct values of columns are joined (`collect_unique`), the needed columns are staged
    unless `df` is `stored` already, and rows per key are counted there. If no key has over FEW_LINES
    rows, one aggregate collects the cells and equal ones become one afterwards.

    Otherwise these columns are unfolded to rows of (key, column, value) beside the row that carries all
    other columns. A first aggregate makes values distinct and sums up the rest, a second one
    puts the rows of a key together; only distinct values are collected for one key then, which is
    exactly the content of the result cell.

    With `orphans` rows without a complete key go through the same aggregates, each under
    its own order and content, and come out as they were in the types of the grouped
    columns (a summed boolean counts 0 or 1, a joined column is text); `orphan_cols` are
    kept for them only. Without it the keys must not be null."""
    unique = [c for c, m in methods.items() if m == "collect_unique"]
    simple = [c for c in methods if c not in unique]
    booleans = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
    alone = F.lit(None).cast("string")
    if orphans:
        incomplete = reduce(or_, [F.col(k).isNull() for k in keys])
        content = F.xxhash64(*[F.col(c) for c in dict.fromkeys([*keys, *methods, *orphan_cols])])
        alone = F.when(incomplete, F.concat_ws(":", order.cast("string"), content.cast("string")))
    by = [*keys, "__alone"] if orphans else list(keys)
    lone = F.col("__alone").isNotNull()
    rows = df.select(*keys, *dict.fromkeys([*simple, *unique, *orphan_cols]), order.alias("__ord"), alone.alias("__alone"))

    def cell(c: str) -> Column:  # what a lone row shows of a summed or counted column
        if methods[c] == "count":
            return F.col(c).try_cast("bigint")
        return F.col(c).cast("bigint") if c in booleans else F.col(c)

    kept = [c for c in simple if methods[c] in ("sum", "count")] if orphans else []
    aggs = [_simple_agg(c, methods[c], F.col("__ord"), c in booleans).alias(c) for c in simple]
    aggs.append(F.count(F.lit(1)).alias("__n"))
    if kept or orphan_cols:  # a lone row keeps its cells, also missing ones
        aggs.append(F.any_value(F.when(lone, F.struct(*[cell(c).alias(c) for c in kept], *orphan_cols)), ignoreNulls=True).alias("__own_cells"))
    if unique and not stored:
        rows = stored_rows(rows)
    if unique and most_lines(rows, keys) <= FEW_LINES:
        # cells are read and judged once per row, before the aggregate: its own expressions are not compiled
        entries = {f"__entry{i}": F.struct("__ord", F.col(c).cast("string").alias("value")) for i, c in enumerate(unique)}
        told = lambda e: e["value"].isNotNull() if keep_blank else ~is_blank(e["value"]) | (lone & e["value"].isNotNull())
        cells = rows.select(*by, "__ord", *([] if orphans else ["__alone"]), *dict.fromkeys([*simple, *orphan_cols]),
                            *[F.when(told(e), e).alias(i) for i, e in entries.items()])
        out = cells.groupBy(*by).agg(*aggs, *[F.sort_array(F.collect_list(i)).alias(i) for i in entries])
        for i, c in zip(entries, unique):
            values = F.array_distinct(F.col(i)["value"])
            # values without a place come first, and only if they have none elsewhere
            placed = F.array_distinct(F.filter(i, lambda x: x["__ord"].isNotNull())["value"])
            unplaced = F.filter(values, lambda x: ~F.array_contains(placed, x))
            text = F.concat_ws(" | ", F.when(F.get(i, F.lit(0))["__ord"].isNull(), F.concat(unplaced, placed)).otherwise(values))
            out = out.withColumn(c, F.when(~lone | (F.size(values) > 0), text) if orphans else text)
    elif unique:
        cell = lambda i, c: F.struct(F.lit(i).alias("tag"), F.col(c).cast("string").alias("value"))
        tagged = rows.select("*", F.explode(F.array(F.struct(F.lit(0).alias("tag"), F.lit(None).cast("string").alias("value")),
                                                    *[cell(i, c) for i, c in enumerate(unique, 1)])).alias("__cell"))
        told = F.col("__cell.value").isNotNull() if keep_blank else (strip("__cell.value") != "") | (lone & F.col("__cell.value").isNotNull())
        tagged = tagged.where((F.col("__cell.tag") == 0) | told)
        own = F.col("__cell.tag") == 0
        tagged = tagged.select(*by, "__ord", own.alias("__own"), F.col("__cell.tag").alias("__tag"), F.col("__cell.value").alias("__value"),
                               *([] if orphans else ["__alone"]), *[F.when(own, F.col(c)).alias(c) for c in dict.fromkeys([*simple, *orphan_cols])])
        partial = tagged.groupBy(*by, "__tag", "__value").agg(F.min("__ord").alias("__ord"), *aggs)
        entry = F.struct("__ord", "__value")
        only = lambda c: F.any_value(F.when(F.col("__tag") == 0, F.col(c)), ignoreNulls=True).alias(c)
        joined = lambda i, c: F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.when(F.col("__tag") == i, entry))), lambda x: x["__value"])).alias(c)
        own_cells = ["__own_cells"] if kept or orphan_cols else []
        out = partial.groupBy(*by).agg(*[only(c) for c in [*simple, *own_cells, "__n"]], *[joined(i, c) for i, c in enumerate(unique, 1)],
                                       *[F.count_if(F.col("__tag") == i).alias(f"__some{i}") for i in range(1, len(unique) + 1)])
        if orphans:
            out = out.withColumns({c: F.when(~lone | (F.col(f"__some{i}") > 0), F.col(c)) for i, c in enumerate(unique, 1)})
    else:
        out = rows.groupBy(*by).agg(*aggs)
    own_cell = lambda c: F.col("__own_cells")[c]
    out = out.withColumns({**{c: F.when(lone, own_cell(c)).otherwise(F.col(c)) for c in kept}, **{c: own_cell(c) for c in orphan_cols}})
    if orphans:  # equal rows of one order are one group; they come out as often as they came in
        copies = F.when(lone, F.sequence(F.lit(1).cast("bigint"), F.col("__n"))).otherwise(F.array(F.lit(1).cast("bigint")))
        out = out.withColumn("__copy", F.explode(copies))
        out = out.withColumn("__n", F.when(lone, F.lit(1).cast("bigint")).otherwise(F.col("__n")))
    counted = [F.col("__n").alias(count_col)] if count_col else []
    return out.select(*keys, *methods, *counted, *orphan_cols)


def rollup(df: DataFrame, keys: Sequence[str] = fixed.GROUP_BY, rules: dict[str, str] = fixed.ROLLUP_RULES,
           order: Column | None = None, count_col: str = fixed.LINE_COUNT_COL, stored: DataFrame | None = None) -> DataFrame:
    """One row per key by configured rules; columns without a rule use the default one.
    Rows without a complete key are kept as they are, with a line count of 1. `stored` is the
    same table where it is staged already."""
    keys = [k for k in keys if k in df.columns]
    order = order if order is not None else F.col(ORD)
    if not keys:
        return df.withColumn(count_col, F.lit(1).cast("bigint"))
    lineage = [c for c in df.columns if c in fixed.LINEAGE_COLS and c not in keys]
    skip = {*keys, *fixed.LINEAGE_COLS, ORD}
    methods = {c: rules.get(c) or default_method(df, c) for c in df.columns if c not in skip}
    return group_aggregate(df if stored is None else stored, keys, methods, order, count_col, orphans=True, orphan_cols=lineage, stored=stored is not None)


def classify_grain(df: DataFrame, id_col: str = "contract_id") -> DataFrame:
    """(level, total_rows, unique_ids, uniqueness_ratio): above 0.9 distinct ids per row
    a record-level table, below 0.5 a line-item table, else mixed."""
    if id_col not in df.columns:
        return df.sparkSession.createDataFrame(
            [("mixed", None, None, None)],
            "level string, total_rows bigint, unique_ids bigint, uniqueness_ratio double")
    counts = df.groupBy(id_col).agg(F.count(id_col).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.when(F.col("n") > 0, 1)).alias("unique_ids"))
    ratio = F.try_divide(F.col("unique_ids"), F.col("total_rows"))
    level = F.when(ratio > 0.9, "contract_level").when(ratio < 0.5, "line_item_level").otherwise("mixed")
    return counts.select(level.alias("level"), "total_rows", "unique_ids",
                         round_exact(ratio, 4).alias("uniqueness_ratio"))


def rollup_sheets(sheets: dict[str, DataFrame], keys: Sequence[str] = fixed.GROUP_BY,
                  rules: dict[str, str] = fixed.ROLLUP_RULES, order: Column | None = None,
                  count_col: str = fixed.LINE_COUNT_COL, levels: dict[str, str] | None = None,
                  ) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Roll up every sheet that is not record-level already; also the stacked line items
    of the rolled-up sheets. `levels` skips the classification query. The sheets rolled up are
    staged: both results read them."""
    out, items = {}, []
    for name, df in sheets.items():
        level = (levels or {}).get(name) or classify_grain(df).first()["level"]
        if level == "contract_level" or not any(k in df.columns for k in keys):
            out[name] = df.withColumn(count_col, F.lit(1).cast("bigint"))
            continue
        lines = stored_rows(df)
        items.append(lines)
        out[name] = rollup(df, keys, rules, order, count_col, stored=lines)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), items) if items else None
    return out, stacked


def find_column(columns: Sequence[str], preferred: str, keywords: Sequence[str]) -> str | None:
    """A header by exact name, then case-insensitively, then by the first listed keyword
    some header contains."""
    if preferred in columns:
        return preferred
    folded = {c.strip().lower(): c for c in columns}
    if preferred.lower() in folded:
        return folded[preferred.lower()]
    return next((c for k in keywords for c in columns if k in c.lower()), None)


def merge_quote_lines(df: DataFrame, id_col: str = "Contract_ID", date_col: str = "Contract_Close_Date",
                      order: Column | None = None, flags: Sequence[str] | None = None) -> DataFrame:
    """Group quote lines by detected id (and close date): numbers are summed, provenance
    columns keep every distinct value, other columns their first one; lines without a
    complete key stay."""
    order = order if order is not None else F.col(ORD)
    id_found = find_column(df.columns, id_col, fixed.ID_HEADER_KEYWORDS)
    if id_found is None:
        return df
    date_found = find_column(df.columns, date_col, fixed.CLOSE_DATE_HEADER_KEYWORDS)
    keys = [id_found] + ([date_found] if date_found else [])
    methods = {}
    for c in df.columns:
        if c in keys or c == ORD:
            continue
        methods[c] = "collect_unique" if c in fixed.PROVENANCE_COLS else default_method(df, c, flags)
    return group_aggregate(df, keys, methods, order, keep_blank=True, orphans=True).select(
        *[c for c in df.columns if c != ORD])


def deduplicate(df: DataFrame, subset: Sequence[str] = fixed.DEDUP_SUBSET, order: Column | None = None) -> DataFrame:
    """Of rows equal in the subset columns keep the one with most non-null cells, the
    first in row order on a tie. Null equals null. An aggregate instead of a window: a
    group is never sorted as a whole, and a hot one shrinks before the shuffle."""
    subset = [c for c in subset if c in df.columns]
    if not subset:
        return df
    order = order if order is not None else F.col(ORD)
    data = [c for c in df.columns if c != ORD]
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in data])
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.distinct()
    best = F.min_by(F.struct(*rest), F.struct(-filled, order)).alias("__row")
    return df.groupBy(*subset).agg(best).select(
        *[F.col(c) if c in subset else F.col("__row")[c].alias(c) for c in df.columns])


def duplicate_counts(df: DataFrame, id_col: str) -> DataFrame:
    """(rows_sharing_id, rows_beyond_first) over non-null ids."""
    n = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_sharing_id"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_beyond_first"))
