"""Column and sheet profiles, relations between sheets, completeness reports.

Tables are unpivoted to (column, value) and grouped, so the generated code has one size
for any number of columns, and every aggregate combines map-side: a task sends one row
per column, or per column and distinct value where values are counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from keyfold import fixed
from keyfold.functions import cells
from keyfold.model import ORD, Sheet, data_columns
from keyfold.session import staged


def _text(df: DataFrame, c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def long_text(df: DataFrame, columns: Sequence[str], *ids: Column) -> DataFrame:
    """(ids, column, value): every cell as text, null cells included."""
    names = [f"__id{i}" for i in range(len(ids))]
    return df.select(*[x.alias(n) for x, n in zip(ids, names)], *[_text(df, c).alias(c) for c in columns]).unpivot(
        names, [f"`{c}`" for c in columns], "column", "value")


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, v): every cell that is a number, text cells parsed; NaN is a missing value."""
    kinds = {f.name: f.dataType for f in df.schema}
    text = [c for c in columns if isinstance(kinds[c], T.StringType)]
    numbers = [c for c in columns if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    parts = []
    if text:
        parts.append(long_text(df, text).select("column", cells.to_number("value").alias("v")))
    if numbers:
        parts.append(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numbers]).unpivot(
            [], [f"`{c}`" for c in numbers], "column", "v"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, v double")
    return reduce(DataFrame.unionByName, parts).where("v is not null and not isnan(v)")


def stored_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from a staged table of the parsed columns, for callers that read them several
    times: what led to `df` is computed once."""
    kinds = {f.name: f.dataType for f in df.schema}
    kept = [c for c in columns if isinstance(kinds[c], (T.StringType, T.NumericType, T.BooleanType))]
    if not kept:
        return long_numbers(df, columns)
    number = lambda c: cells.to_number(F.col(f"`{c}`")) if isinstance(kinds[c], T.StringType) else F.col(f"`{c}`").cast("double")
    wide = staged(df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(kept)]), "numbers").toDF(*kept)
    return long_numbers(wide, kept)


def _every_column(df: DataFrame, columns: Sequence[str], found: DataFrame) -> DataFrame:
    """One row per column even when the table is empty."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, order: Column | None = None) -> DataFrame:
    """(column, value, n, first_ord) over non-null values as text."""
    columns = list(columns or data_columns(df))
    order = order if order is not None else (F.col(ORD) if ORD in df.columns else F.monotonically_increasing_id())
    long = long_text(df, columns, order).where("value is not null")
    return long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("__id0").alias("first_ord"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_rows, null_count, null_pct); blank text counts as missing."""
    columns = list(columns or data_columns(df))
    found = long_text(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value").isNull() | (cells.strip("value") == "")).alias("null_count"))
    rows = _every_column(df, columns, found).na.fill(0, ["n_rows", "null_count"])
    pct = F.when(F.col("n_rows") > 0, cells.round_exact(F.col("null_count") / F.col("n_rows") * 100, 2)).otherwise(0.0)
    return rows.select("column", "n_rows", "null_count", pct.alias("null_pct"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, inferred_type, n_rows, null_count, null_pct, unique_count, uniqueness_ratio)."""
    columns = list(columns or data_columns(df))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    type_of = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    distinct = value_counts(df, columns, F.lit(0)).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    ratio = F.when(F.col("n_rows") > 0, cells.round_exact(F.col("unique_count") / F.col("n_rows"), 4)).otherwise(0.0)
    return (
        null_profile(df, columns).join(distinct, "column", "left").na.fill(0, ["unique_count"])
        .select("column", F.element_at(type_of, F.col("column")).alias("inferred_type"), "n_rows",
                "null_count", "null_pct", "unique_count", ratio.alias("uniqueness_ratio"))
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, order: Column | None = None) -> DataFrame:
    """(column, value, n, rank): the most frequent values, first seen wins a tie. Spark
    keeps k rows per column in every task before the shuffle."""
    best = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("first_ord"))
    return value_counts(df, columns, order).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("column", "value", "n", "rank")


def distinct_samples(df: DataFrame, columns: Sequence[str] | None = None, k: int = 8, order: Column | None = None) -> DataFrame:
    """(column, samples): the first k distinct non-null values in row order, as text."""
    first = Window.partitionBy("column").orderBy("first_ord")
    top = value_counts(df, columns, order).withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= k)
    return top.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("samples"))


def random_sample(df: DataFrame, column: str, n: int = 50, seed: int = 42, order: Column | None = None) -> DataFrame:
    """n stripped non-blank values of a column, chosen by a seeded hash of value and row
    position: the same rows on any partitioning."""
    order = order if order is not None else F.col(ORD)
    cell = cells.strip(f"`{column}`")
    return (
        df.select(cell.alias("value"), order.cast("string").alias("__ord"))
        .where((F.col("value") != ""))
        .select("value", F.md5(F.concat_ws("|", F.lit(str(seed)), "__ord", "value")).alias("__h"))
        .orderBy("__h", "value").limit(n).select("value")
    )


# Parts of an interval in one round of the median search; rows of an interval that are ordered by value.
SPLITS, SMALL = 4096, 100_000


def _binade(v: Column) -> Column:
    """A number that grows with v: sign, power of two and 1/1024 of it."""
    size = F.abs(v)
    infinite = size == float("inf")
    power = F.when(infinite, F.lit(1024)).when(size > 0, F.floor(F.log2(size)))
    step = F.when(infinite, F.lit(0)).otherwise(F.floor((size / F.pow(F.lit(2.0), power) - 1) * 1024))
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * ((power + 1100) * 1024 + step + 1)).cast("bigint")


def medians_of(numbers: DataFrame) -> DataFrame:
    """(column, median) of (column, v) or (column, v, n), with n equal values a row.

    The two middle ranks are searched for in rounds, all columns at once. The first round
    counts values by sign and power of two; each later one splits what holds a middle rank,
    between its smallest and largest value, into equal parts and counts those. A column
    is done when one value or at most SMALL rows are left; as doubles of one power of two are
    equally spaced, five rounds are the most. A round shuffles one row per part and task, and
    the driver holds two intervals per column."""
    spark = numbers.sparkSession
    if "n" not in numbers.columns:
        numbers = numbers.withColumn("n", F.lit(1).cast("bigint"))

    def chosen(parts: DataFrame) -> list:
        """Per column and rank the part that holds it, from (column, which, rank, part, n, lo, hi)."""
        same = Window.partitionBy("column", "which").orderBy("part")
        upto = parts.withColumn("upto", F.sum("n").over(same))
        return upto.where("upto - n < rank and rank <= upto").select(
            "column", "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n", "lo", "hi").collect()

    found = [F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    first = numbers.groupBy("column", _binade(F.col("v")).alias("part")).agg(*found)
    total = F.sum("n").over(Window.partitionBy("column"))
    middle = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("total") + 1) / 2).alias("rank")),
                               F.struct(F.lit(1).alias("which"), F.floor((F.col("total") + 2) / 2).alias("rank"))))
    state = chosen(first.withColumn("total", total).select("*", middle.alias("m")).select("column", "m.*", "part", "n", "lo", "hi"))
    done = {(r["column"], r["which"]): r["lo"] for r in state if r["lo"] == r["hi"]}

    def inside(rows: list) -> DataFrame:
        table = spark.createDataFrame([(r["column"], r["which"], r["rank"], r["lo"], r["hi"]) for r in rows],
                                      "column string, which int, rank bigint, a double, b double")
        # two rows per column at most
        return numbers.join(F.broadcast(table), "column").where("v >= a and v <= b")

    left = [r for r in state if r["lo"] < r["hi"]]
    while wide := [r for r in left if r["n"] > SMALL]:
        half = lambda x: F.col(x) / 2  # the width of two doubles can be more than a double holds
        width = half("b") - half("a")
        part = F.when(width > 0, F.floor((half("v") - half("a")) / F.nullif(width, F.lit(0.0)) * SPLITS)).otherwise((F.col("v") > F.col("a")).cast("bigint"))
        split = inside(wide).groupBy("column", "which", "rank", part.alias("part")).agg(*found)
        narrow = chosen(split)
        done |= {(r["column"], r["which"]): r["lo"] for r in narrow if r["lo"] == r["hi"]}
        left = [r for r in left if r["n"] <= SMALL] + [r for r in narrow if r["lo"] < r["hi"]]
    if left:
        values = inside(left).groupBy("column", "which", "rank", F.col("v").alias("part")).agg(*found)
        done |= {(r["column"], r["which"]): r["lo"] for r in chosen(values)}
    medians = [(c, (v + done[c, 1]) / 2) for (c, which), v in done.items() if which == 0]
    return spark.createDataFrame(medians, "column string, median double")


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median) of the numeric cells of columns that have any."""
    return medians_of(stored_numbers(df, list(columns)))


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, min, max, mean, median, std) of the numeric cells, for columns that
    have any; two decimals, sample deviation, 0 for a single value. The rounds of the median
    search read a staged table of the numbers."""
    columns = list(columns or data_columns(df))
    numbers = stored_numbers(df, columns)
    rows = numbers.groupBy("column").agg(
        F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    std = F.when(F.col("n") > 1, cells.round_exact("std", 2)).otherwise(0.0)
    return rows.join(medians_of(numbers), "column").select(
        "column", "n", "min", "max", cells.round_exact("mean", 2).alias("mean"),
        cells.round_exact("median", 2).alias("median"), std.alias("std"))


def date_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, min_date, max_date) of columns where half of the non-null cells are dates."""
    columns = list(columns or data_columns(df))
    day = cells.parse_date("value")
    rows = long_text(df, columns).where("value is not null").select("column", day.alias("day")).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count("day").alias("ok"), F.min("day").alias("min_date"), F.max("day").alias("max_date"))
    return rows.where("ok > 0 and ok >= 0.5 * n").select("column", "min_date", "max_date")


def profile_sheet(sheet: Sheet) -> DataFrame:
    """(sheet, row_count, column_count, duplicate_row_count, duplicate_row_pct)."""
    columns = sheet.data_columns
    same = sheet.df.groupBy(*[f"`{c}`" for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    one = same.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
                   F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_row_count"))
    pct = F.when(F.col("row_count") > 0,
                 cells.round_exact(F.col("duplicate_row_count") / F.col("row_count") * 100, 2)).otherwise(0.0)
    return one.select(F.lit(sheet.name).alias("sheet"), "row_count", F.lit(len(columns)).alias("column_count"),
                      "duplicate_row_count", pct.alias("duplicate_row_pct"))


def value_table(df: DataFrame, columns: Sequence[str] | None = None, order: Column | None = None) -> DataFrame:
    """Staged (column, value, v, n, first_ord): every distinct cell as text, null cells included,
    with its number if it is one, its frequency and first position. One read of `df`; a task
    sends a row per column and distinct value."""
    columns = list(columns or data_columns(df))
    order = order if order is not None else (F.col(ORD) if ORD in df.columns else F.monotonically_increasing_id())
    kinds = {f.name: f.dataType for f in df.schema}
    own = lambda c: F.col(f"`{c}`").cast("double") if isinstance(kinds[c], (T.NumericType, T.BooleanType)) else F.lit(None).cast("double")
    cell = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value"), own(c).alias("v")) for c in columns]))
    counted = df.select(order.alias("ord"), cell).groupBy("column", "value").agg(
        F.min("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    text = [c for c in columns if isinstance(kinds[c], T.StringType)]
    number = F.when(F.col("column").isin(text), cells.to_number("value")).otherwise(F.col("v"))
    return staged(counted.withColumn("v", F.when(~F.isnan(number), number)), "values")


def full_profile(sheet: Sheet) -> DataFrame:
    """Everything known per column of one sheet, one row each, for the profile sink.

    The sheet is read once, into a table of its distinct cells; null counts, top values,
    number statistics, medians and date ranges all come from that, and patterns and dates are
    tested once per distinct cell."""
    df, columns = sheet.df, sheet.data_columns
    values = value_table(df, columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    type_of = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    n, v, there = F.col("n"), F.col("v"), F.col("value").isNotNull()
    day = F.when(there, cells.parse_date("value"))
    seen = values.withColumn("day", day).groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~there | (cells.strip("value") == ""), n)), F.lit(0)).alias("null_count"),
        F.count_if(there).alias("unique_count"), F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("filled"),
        F.sum(F.when(v.isNotNull(), n)).alias("numeric_count"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum(v * n).alias("sum"),
        F.coalesce(F.sum(F.when(F.col("day").isNotNull(), n)), F.lit(0)).alias("days"), F.min("day").alias("min_date"), F.max("day").alias("max_date"))
    means = seen.select("column", (F.col("sum") / F.col("numeric_count")).alias("mean"), (F.col("numeric_count") - 1).alias("free")).where("mean is not null")
    spread = values.where("v is not null").join(means, "column").groupBy("column", "mean", "free").agg(
        F.sum((v - F.col("mean")) * (v - F.col("mean")) * n).alias("squares"))
    std = F.when(F.col("free") > 0, cells.round_exact(F.sqrt(F.col("squares") / F.nullif(F.col("free"), F.lit(0))), 2)).otherwise(0.0)
    numbers = spread.join(medians_of(values.where("v is not null").select("column", "v", "n")), "column").select(
        "column", cells.round_exact("mean", 2).alias("mean"), cells.round_exact("median", 2).alias("median"), std.alias("std"))
    best = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("first_ord"))
    tops = values.where(there).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 5).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                    lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))
    share = lambda a, digits, scale: F.when(F.col("n_rows") > 0, cells.round_exact(F.col(a) / F.col("n_rows") * scale, digits)).otherwise(0.0)
    dated = (F.col("days") > 0) & (F.col("days") >= 0.5 * F.col("filled"))
    return _every_column(df, columns, seen).na.fill(0, ["n_rows", "null_count", "unique_count"]).join(numbers, "column", "left").join(tops, "column", "left").select(
        F.lit(sheet.name).alias("sheet"), "column", F.element_at(type_of, F.col("column")).alias("inferred_type"), "n_rows", "null_count",
        share("null_count", 2, 100).alias("null_pct"), "unique_count", share("unique_count", 4, 1).alias("uniqueness_ratio"),
        "numeric_count", "min", "max", "mean", "median", "std",
        F.when(dated, F.col("min_date")).alias("min_date"), F.when(dated, F.col("max_date")).alias("max_date"), "top_values")


# --- relations between columns and sheets ------------------------------------------


def key_candidates(profile: DataFrame) -> DataFrame:
    """Profiled columns that look like a primary key."""
    return profile.where("uniqueness_ratio > 0.9 and null_pct < 5")


def line_item_hints(sheet: Sheet) -> DataFrame:
    """(sheet, column, duplicate_ratio, unique_values, total_rows) of id-like columns in
    which more than 30 % of the values repeat."""
    columns = [c for c in sheet.data_columns if any(k in c.lower() for k in fixed.LINE_ITEM_HINTS)]
    if not columns:
        return sheet.df.sparkSession.createDataFrame(
            [], "sheet string, column string, duplicate_ratio double, unique_values bigint, total_rows bigint")
    ratio = 1 - F.col("unique_values") / F.col("total_rows")
    return (
        value_counts(sheet.df, columns, F.lit(0)).groupBy("column")
        .agg(F.count(F.lit(1)).alias("unique_values"), F.sum("n").alias("total_rows"))
        .where(ratio > 0.3)
        .select(F.lit(sheet.name).alias("sheet"), "column", cells.round_exact(ratio, 3).alias("duplicate_ratio"),
                "unique_values", "total_rows")
    )


def suggest_grain(hints: DataFrame) -> DataFrame:
    """One row (suggestion, confidence) from the line-item hints of a sheet."""
    one = hints.agg(F.count(F.lit(1)).alias("n"), F.max("duplicate_ratio").alias("top"))
    return one.select(
        F.when(F.col("top") > 0.5, "line_item_level").when(F.col("n") > 0, "mixed").otherwise("contract_level").alias("suggestion"),
        F.when(F.col("top") > 0.5, "high").when(F.col("n") > 0, "low").otherwise("medium").alias("confidence"))


def shared_columns(sheets: Sequence[Sheet]) -> DataFrame:
    """(column, sheets): header names found in more than one sheet, ignoring case."""
    rows = [(s.name, c.strip().lower(), i) for i, s in enumerate(sheets) for c in s.data_columns]
    catalog = sheets[0].df.sparkSession.createDataFrame(rows, "sheet string, column string, pos int")
    return catalog.groupBy("column").agg(
        F.array_sort(F.collect_list("sheet")).alias("sheets")).where(F.size("sheets") > 1)


def foreign_keys(sheets: Sequence[Sheet]) -> DataFrame:
    """(sheet_1, column_1, sheet_2, column_2, overlap_pct) of column pairs of different
    sheets that share more than half of the smaller column's distinct values, three
    distinct values at least.

    Distinct values meet in one shuffle; a value brings at most one entry per column, so
    the pairs it makes are bounded by the number of columns, whatever its frequency."""
    names = [(s.name, c) for s in sheets for c in s.data_columns]
    code = {pair: i for i, pair in enumerate(names)}
    sheet_no = {s.name: i for i, s in enumerate(sheets)}
    longs = []
    for s in sheets:
        columns = s.data_columns
        longs.append(s.df.select(*[_text(s.df, c).alias(str(code[(s.name, c)])) for c in columns]).unpivot(
            [], [str(code[(s.name, c)]) for c in columns], "col", "value"))
    values = reduce(DataFrame.unionByName, longs).where("value is not null") \
        .select(F.col("col").cast("int").alias("col"), "value").distinct()
    sizes = values.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    catalog = sheets[0].df.sparkSession.createDataFrame(
        [(i, sheet_no[s], s, c) for (s, c), i in code.items()], "col int, sheet_no int, sheet string, column string")
    sides = catalog.join(sizes, "col").where("n >= 3")

    # columns of too few values, and then columns of one sheet, never make a pair
    kept = values.join(F.broadcast(sides.select("col", "sheet_no")), "col")  # one row per column
    holders = kept.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("sheet_no", "col"))).alias("cols")).where(F.size("cols") > 1)
    rest = F.slice("cols", F.col("at") + 2, F.size("cols"))
    pairs = (
        holders.select(F.posexplode("cols").alias("at", "x"), "cols")
        .select(F.col("x.col").alias("a"), F.explode(F.filter(rest, lambda y: y["sheet_no"] > F.col("x.sheet_no"))).alias("y"))
        .groupBy("a", F.col("y.col").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    )

    def side(k: str) -> DataFrame:
        return sides.select(F.col("col").alias("a" if k == "1" else "b"), F.col("sheet").alias(f"sheet_{k}"),
                            F.col("column").alias(f"column_{k}"), F.col("n").alias(f"n_{k}"),
                            F.col("sheet_no").alias(f"no_{k}"))

    smaller = F.least("n_1", "n_2")
    return (
        pairs.join(side("1"), "a").join(side("2"), "b").where("no_1 < no_2")
        .where(F.col("common") / smaller > 0.5)
        .select("sheet_1", "column_1", "sheet_2", "column_2",
                cells.round_exact(F.col("common") / smaller * 100, 1).alias("overlap_pct"))
    )


def value_overlap(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """One row: number of distinct values two columns share."""
    return left.select(_text(left, left_col).alias("v")).where("v is not null").intersect(
        right.select(_text(right, right_col).alias("v")).where("v is not null")).agg(F.count(F.lit(1)).alias("overlap"))


# --- completeness ---------------------------------------------------------------------


def completeness(df: DataFrame, columns: Sequence[str] | None = None, blank_is_missing: bool = False) -> DataFrame:
    """(column, non_null, total, pct), one decimal."""
    columns = list(columns or data_columns(df))
    if blank_is_missing:
        filled = F.count(F.nullif(cells.strip("value"), F.lit("")))
        found = long_text(df, columns).groupBy("column").agg(filled.alias("non_null"), F.count(F.lit(1)).alias("total"))
    else:
        total = F.count(F.lit(1)).alias("total")
        found = df.agg(total, *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot(
            ["total"], [f"`{c}`" for c in columns], "column", "non_null")
    rows = _every_column(df, columns, found).na.fill(0, ["non_null", "total"])
    pct = F.when(F.col("total") > 0, cells.round_exact(F.col("non_null") / F.col("total") * 100, 1)).otherwise(0.0)
    return rows.select("column", "non_null", "total", pct.alias("pct"))


def overall_completeness(report: DataFrame) -> DataFrame:
    """Mean of the column percentages."""
    return report.agg(cells.round_exact(F.avg("pct"), 1).alias("overall_pct"))


def preview_completeness(df: DataFrame, rows: int | None = None) -> DataFrame:
    """(column, pct) in whole percent, blanks missing, worst first; over the whole table
    or, as the page shows it, over its first `rows` rows."""
    report = completeness(df if rows is None else df.limit(rows), blank_is_missing=True)
    whole = F.floor(F.try_divide(F.col("non_null") * 100, F.col("total")) + 0.5)
    return report.select("column", F.coalesce(whole, F.lit(0)).cast("int").alias("pct")).orderBy("pct", "column")


def quality_scorecard(df: DataFrame) -> DataFrame:
    """(column, non_null, total, pct, rating), best first; provenance columns left out."""
    report = completeness(df, [c for c in data_columns(df) if not c.startswith("meta_")])
    rating = F.when(F.col("pct") >= 90, "Excellent").when(F.col("pct") >= 60, "Fair").otherwise("Poor")
    return report.withColumn("rating", rating).orderBy(F.col("pct").desc(), "column")


def overall_quality(scorecard: DataFrame) -> DataFrame:
    """Filled cells over all cells, in percent."""
    filled = F.try_divide(F.sum("non_null"), F.sum("total")) * 100
    return scorecard.agg(F.coalesce(cells.round_exact(filled, 1), F.lit(0.0)).alias("overall_pct"))


def timeline(df: DataFrame, rows: int = 100, order: Column | None = None) -> DataFrame:
    """Of the first `rows` records, those with a start or an end."""
    head = df.orderBy(order) if order is not None else df
    vendor = F.coalesce(*[F.col(c) for c in ("vendor_canonical", "vendor") if c in df.columns] or [F.lit(None).cast("string")])
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast("string")
            for c in ("contract_id", "start_date", "end_date", "total_value")}
    return head.limit(rows).where(have["start_date"].isNotNull() | have["end_date"].isNotNull()).select(
        have["contract_id"].alias("contract_id"), vendor.alias("vendor"), have["start_date"].alias("start_date"),
        have["end_date"].alias("end_date"), have["total_value"].alias("total_value"))
