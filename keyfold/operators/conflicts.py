"""Conflicting values between the sheets of a merge, for any number of sheets at once.

A merge takes sheets one after another, and each is held against what all before it have
become: per key one row for every combination of their rows, each column with its first
value in sheet order. None of these merges is formed. All cells are counted once per key,
column and value, with one counter per sheet, and a second aggregate keeps per key and
column of every sheet its rows (n), its empty cells (z) and, for every two sheets, the
pairs of equal values. They say everything:

* the value of sheet j shows in a row of the merge where the sheets before it are empty,
  so it shows z(1) .. z(j-1) times for all rows of the sheets after it, n(j+1) .. n(i-1);
* of the row pairs of j and i all those with two values differ, but for the equal pairs.

Two shuffles do for any number of sheets, both combine map-side, and a key with many rows
costs no more than its rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyfold import fixed
from keyfold.functions.cells import strip
from keyfold.model import ORD

_SALTS = 64  # parts a column's conflicts are ranked in before the parts' firsts are


class ConflictError(ValueError):
    """Overlapping columns hold different values for one key."""

    def __init__(self, rows: list):
        self.rows = rows
        lines = [f"Column '{r['column']}' has {r['n_conflicts']} conflicting value(s) from {r['source']}"
                 for r in rows if r["example_no"] == 1]
        super().__init__("Column value conflicts detected during merge:\n" + "\n".join(lines))


def _whole(c: Column) -> Column:
    """A count whose products with other counts do not overflow."""
    return c.cast("decimal(38,0)")


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


_SCHEMA = "sheet int, column string, n_conflicts bigint, example_no int, key string, existing string, new string"


def _owners(columns: Sequence[Sequence[str]], keys: Sequence[str]) -> dict[str, list[int]]:
    owners: dict[str, list[int]] = {}
    for i, own in enumerate(columns):
        for c in own:
            if c not in keys and c != ORD:
                owners.setdefault(c, []).append(i)
    return {c: o for c, o in owners.items() if len(o) > 1}


def shared_columns(sheets: Sequence[DataFrame], keys: Sequence[str]) -> dict[str, list[int]]:
    """Columns of two sheets or more, with the numbers of those sheets."""
    return _owners([s.columns for s in sheets], keys)


def _counted(stacked: DataFrame, keys: Sequence[str], overlap: Sequence[str], n: int) -> DataFrame:
    """(keys, __column, __value, c0, c1, ...): cells of each sheet per stripped value. A
    sheet without the column has an empty cell in every row, as it has in the merge."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("__column"), F.col(f"`{c}`").alias("__value")) for c in overlap]))
    long = stacked.select(*keys, "__sheet", cells)  # unlike unpivot, this keeps a distribution by the keys
    return long.groupBy(*keys, "__column", "__value").agg(*[F.count_if(F.col("__sheet") == i).alias(f"c{i}") for i in range(n)])


def sheet_conflicts(sheets: Sequence[DataFrame], keys: Sequence[str] = fixed.KEY_COLS, examples: int = 3) -> DataFrame:
    """Conflicts of each sheet with the merge of all before it, compared as stripped text
    where both sides have a value: (sheet, column, n_conflicts, example_no, key, existing,
    new); sheets count from 1.

    The number is that of joined row pairs that differ. Examples are the first keys in key
    order. Keys compare null-safe."""
    owners = shared_columns(sheets, keys)
    if not owners:
        return sheets[0].sparkSession.createDataFrame([], _SCHEMA)
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null"))) for k in keys])
    parts = [s.select(*keys, *[strip(F.col(f"`{c}`")).alias(c) for c in owners if c in s.columns], F.lit(i).alias("__sheet"))
             for i, s in enumerate(sheets)]
    return _conflicts(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), keys, owners, len(sheets), text, examples)


def stacked_conflicts(stacked: DataFrame, by: Sequence[str], columns: Sequence[Sequence[str]], keys: Sequence[str], text: Column, examples: int = 3) -> DataFrame:
    """The same of sheets that are stacked already, with their number from 0 in `__sheet`, grouped by
    the columns `by`; `text` writes a key out."""
    owners = _owners(columns, keys)
    if not owners:
        return stacked.sparkSession.createDataFrame([], _SCHEMA)
    cells = stacked.select(*by, "__sheet", *[strip(F.col(f"`{c}`")).alias(c) for c in owners])
    return _conflicts(cells, by, owners, len(columns), text, examples)


def _conflicts(stacked: DataFrame, keys: Sequence[str], owners: dict[str, list[int]], n: int, text: Column, examples: int) -> DataFrame:
    c = [F.col(f"c{i}") for i in range(n)]
    pairs = sorted({(j, i) for o in owners.values() for i in o for j in o if j < i})
    having = sorted({i for pair in pairs for i in pair})
    filled = F.col("__value").isNotNull()
    # a sum of products is at most the product of two sheets' rows of one key, which a long holds
    per_key = _counted(stacked, keys, list(owners), n).groupBy(*keys, "__column").agg(
        *[F.sum(c[i]).alias(f"n{i}") for i in range(n)],
        *[F.coalesce(F.sum(F.when(~filled, c[i])), F.lit(0)).alias(f"z{i}") for i in range(n)],
        *[F.coalesce(F.sum(F.when(filled, c[j] * c[i])), F.lit(0)).alias(f"same{j}_{i}") for j, i in pairs],
        *[F.min(F.when(c[i] > 0, F.col("__value"))).alias(f"lo{i}") for i in having],
        *[F.max(F.when(c[i] > 0, F.col("__value"))).alias(f"hi{i}") for i in having])
    differ = {(j, i): (F.col(f"n{j}") - F.col(f"z{j}")) * (F.col(f"n{i}") - F.col(f"z{i}")) - F.col(f"same{j}_{i}") for j, i in pairs}
    suspect = per_key.where(reduce(lambda a, b: a | b, [d > 0 for d in differ.values()]))

    # products of all sheets' rows fit a long below this many rows a key and sheet
    small = _greatest([F.col(f"n{i}") for i in range(n)]) <= int((2 ** 62 / n) ** (1 / n) * 0.99)

    def numbers(number) -> dict[int, Column]:
        """Per sheet the pairs that differ: each pair of values as often as it shows in the merge."""
        times = lambda a, b: number(a * b)
        rows = [number(F.greatest(F.col(f"n{i}"), F.lit(1))) for i in range(n)]
        empty = [number(F.when(F.col(f"n{i}") == 0, F.lit(1)).otherwise(F.col(f"z{i}"))) for i in range(n)]
        found = {}
        for i in sorted({i for _, i in pairs}):
            whole, before = None, None  # the pairs so far; empty cells of the sheets so far
            for j in range(i):
                whole = whole if whole is None else times(whole, rows[j])
                if (j, i) in differ:
                    own = number(differ[j, i]) if before is None else times(before, number(differ[j, i]))
                    whole = own if whole is None else number(whole + own)
                before = empty[j] if before is None else times(before, empty[j])
            found[i] = whole
        return found

    short, long = numbers(lambda x: x), numbers(_whole)
    against = [F.struct(F.lit(i + 1).alias("sheet"), F.when(small, _whole(short[i])).otherwise(long[i]).alias("n")) for i in short]
    bounds = [f"{x}{i}" for i in having for x in ("lo", "hi")]
    shows = {i: reduce(lambda a, b: a & b, [(F.col(f"n{k}") == 0) | (F.col(f"z{k}") > 0) for k in range(i)], F.lit(True)).alias(f"shows{i}") for i in having}
    found = suspect.select(F.col("__column").alias("column"), text.alias("key"), F.explode(F.array(*against)).alias("x"), *bounds, *shows.values()) \
        .select("column", "key", "x.*", *bounds, *[f"shows{i}" for i in having]).where("n > 0")
    existing, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in short:  # examples are told apart from the counts, so a caller who leaves them out does not pay for them
        earlier = [j for j, k in pairs if k == i]
        lo_l = _least([F.when(F.col(f"shows{j}"), F.col(f"lo{j}")) for j in earlier])
        hi_l = _greatest([F.when(F.col(f"shows{j}"), F.col(f"hi{j}")) for j in earlier])
        lo_r, hi_r, here = F.col(f"lo{i}"), F.col(f"hi{i}"), F.col("sheet") == i + 1
        existing = F.when(here, F.when((lo_l == lo_r) & (hi_r == lo_l), hi_l).otherwise(lo_l)).otherwise(existing)
        new = F.when(here, F.when(lo_l == lo_r, F.when(hi_r == lo_l, lo_r).otherwise(hi_r)).otherwise(lo_r)).otherwise(new)
    found = found.select("column", "key", "sheet", "n", existing.alias("existing"), new.alias("new"))

    # each part of a column's conflicts gives its first keys and its sum; those are few
    part = Window.partitionBy("sheet", "column", "__part")
    firsts = (
        found.withColumn("__part", F.pmod(F.xxhash64("key"), F.lit(_SALTS)))
        .withColumn("at", F.row_number().over(part.orderBy("key"))).withColumn("sum", F.sum("n").over(part))
        .where(F.col("at") <= examples)
    )
    whole = Window.partitionBy("sheet", "column")
    return (
        firsts.withColumn("example_no", F.row_number().over(whole.orderBy("key")))
        .withColumn("n_conflicts", F.sum(F.when(F.col("at") == 1, F.col("sum"))).over(whole).cast("bigint"))
        .where(F.col("example_no") <= examples)
        .select("sheet", "column", "n_conflicts", "example_no", "key", "existing", "new")
    )


def find_conflicts(left: DataFrame, right: DataFrame, keys: Sequence[str] = fixed.KEY_COLS,
                   source: str = "new data", examples: int = 3) -> DataFrame:
    """Conflicts of two tables: (column, n_conflicts, source, example_no, key, existing, new)."""
    return sheet_conflicts([left, right], keys, examples).select(
        "column", "n_conflicts", F.lit(source).alias("source"), "example_no", "key", "existing", "new")


def refuse_conflicts(sheets: Sequence[DataFrame], keys: Sequence[str], on_conflict: str, sources: Sequence[str]) -> None:
    """Raise for the first sheet that conflicts with those before it; one query for all."""
    if on_conflict == "keep_left":
        return
    if on_conflict != "error":
        raise ValueError("on_conflict is 'error' or 'keep_left'")
    if not shared_columns(sheets, keys):
        return
    refuse(sheet_conflicts(sheets, keys), sources)


def refuse(found: DataFrame, sources: Sequence[str]) -> None:
    """Raise if there are conflicts, with those of the first sheet that has any."""
    rows = [r.asDict() | {"source": sources[r["sheet"] - 1]} for r in found.collect()]  # sheets x columns x examples
    if rows:
        first = min(r["sheet"] for r in rows)
        raise ConflictError(sorted((r for r in rows if r["sheet"] == first), key=lambda r: (r["column"], r["example_no"])))
