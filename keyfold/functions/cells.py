"""Cell parsers as Column expressions. Everything here stays on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keyfold import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Both-ends strip of every kind of white space, not only blanks."""
    return F.btrim(_col(c).cast("string"), F.lit(fixed.WHITESPACE))


def half_even(c: Column | str, digits: int) -> Column:
    """Round half to even on the scaled double, as array libraries do."""
    scale = float(10 ** digits)
    return F.rint(_col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def round_exact(c: Column | str, digits: int) -> Column:
    """Round the exact binary value, half to even on true ties, as scalar rounding does:
    2.675 lies below the tie and gives 2.67, where scaling first would give 2.68."""
    pattern = F.lit("0." + "0" * digits if digits else "0")
    return F.call_function("format_number", _col(c).cast("double"), pattern).try_cast("double")


def na_to_null(c: Column | str) -> Column:
    """Cells that spell 'no value' become null."""
    c = _col(c)
    return F.when(~c.isin(fixed.NA_TOKENS), c)


_DECIMAL = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"


def to_number(c: Column | str) -> Column:
    """Text to double, null when it is no plain decimal number. The cast alone would also
    take Java literals such as '1d', '2f' and '0x1p3'."""
    c = _col(c)
    return F.when(c.rlike(_DECIMAL), c.try_cast("double"))


def as_number(df, name: str) -> Column:
    """Numeric view of a column: numbers pass through, text is parsed."""
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        return to_number(F.col(name))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.lit(None).cast("double")
    return F.col(name).cast("double")


def parse_currency(c: Column | str, billions: bool = True) -> Column:
    """'$1,234.56', '£50k', '1.2M' -> double with two decimals; null when unreadable,
    which N/A, TBD, a dash and blanks are too."""
    bare = F.translate(_col(c).cast("string"), fixed.CURRENCY_SYMBOLS + fixed.WHITESPACE + ",", "")
    factors = {k: v for k, v in fixed.CURRENCY_SUFFIXES.items() if billions or k != "b"}
    lookup = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    factor = F.coalesce(F.try_element_at(lookup, F.lower(F.right(bare, F.lit(1)))), F.lit(1.0))
    body = F.regexp_replace(bare, f"(?i)[{''.join(factors)}]$", "")
    return round_exact(to_number(body) * factor, 2)


def split_range(c: Column | str, separators: list[str] = fixed.RANGE_SEPARATORS) -> tuple[Column, Column]:
    """'a to b' -> (a, b); any other text -> (text, null). The first listed separator
    that occurs decides, at its first occurrence."""
    s = strip(c)
    low = F.lower(s)
    start, end = s, F.lit(None).cast("string")
    for sep in reversed(separators):
        at = F.locate(sep, low)
        start = F.when(at > 0, strip(F.substring(s, F.lit(1), at - 1))).otherwise(start)
        end = F.when(at > 0, strip(F.substring(s, at + len(sep), F.length(s)))).otherwise(end)
    return start, end


def is_auto_renew(c: Column | str, also_na: bool = False) -> Column:
    """Whether a date cell says 'renews by itself' instead of naming a day."""
    s = strip(c)
    hit = F.lower(s).isin(fixed.AUTO_RENEW_TOKENS)
    if also_na:
        hit = hit | (F.upper(s) == "N/A")
    return F.coalesce(hit, F.lit(False))


_GAP, _DAY, _YEAR = r"[\s/.\-]+", r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|\d{2})"
_MONTH_NO = r"(0?[1-9]|1[0-2])"
_TIME = r"(?:[t\s]+\d{1,2}:\d{2}.*)?"
_WRITTEN_IN_DIGITS = "(?s)^(?:" + "|".join([
    rf"(\d{{4}}){_GAP}{_MONTH_NO}{_GAP}(\d{{1,2}})",       # groups 1-3: y m d
    rf"(\d{{4}}){_GAP}(\d{{1,2}}){_GAP}{_MONTH_NO}",       # 4-6: y d m
    rf"{_MONTH_NO}{_GAP}(\d{{1,2}}){_GAP}{_YEAR}",          # 7-9: m d y
    rf"(\d{{1,2}}){_GAP}{_MONTH_NO}{_GAP}{_YEAR}",          # 10-12: d m y
    r"(\d{4})(\d{2})(\d{2})",                             # 13-15: y m d
]) + f"){_TIME}$|^.*$"
_DIGITS_TO_ISO = "$1$4$9$12$13-$2$6$7$11$14-$3$5$8$10$15"
_WEEKDAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?[.,]?\s+"
_SEPT = r"(?<![a-z])sept(?![a-z])"
_LETTERS = r"[a-z]{3}"
_WRITTEN_IN_WORDS = "(?s)^(?:" + "|".join([
    rf"([a-z]{{3,}})[\s.\-]+{_DAY}[\s,\-]+{_YEAR}",       # 1-3: m d y
    rf"{_DAY}[\s\-]+([a-z]{{3,}})[\s.,\-]+{_YEAR}",      # 4-6: d m y
    rf"(\d{{4}})[\s,\-]+([a-z]{{3,}})[\s.\-]+{_DAY}",    # 7-9: y m d
]) + f"){_TIME}$|^.*$"


def _full_year(dated: Column) -> Column:
    """A leading two-digit year written out."""
    recent = f"[0-{fixed.TWO_DIGIT_YEAR_PIVOT // 10 - 1}]"
    return F.regexp_replace(F.regexp_replace(dated, rf"^({recent}\d)(?=[- ])", "20$1"), r"^(\d\d)(?=[- ])", "19$1")


def _read_day(low: Column) -> Column:
    """One day from stripped lower-case text. Digits are put in ISO order by one pattern
    and cast; only text with a month name goes through a date formatter."""
    iso = _full_year(F.regexp_replace(low, _WRITTEN_IN_DIGITS, _DIGITS_TO_ISO))  # '--' for anything else
    named = F.regexp_replace(F.regexp_replace(low, _WEEKDAY, ""), _SEPT, "sep")
    words = _full_year(F.regexp_replace(named, _WRITTEN_IN_WORDS, "$3$6$7 $1$5$8 $2$4$9"))
    return F.when(low.rlike(_LETTERS), F.try_to_date(words, "yyyy [MMMM][MMM] d")).otherwise(iso.try_cast("date"))


def single_date(c: Column | str) -> Column:
    """One written day -> date. Reads year-month-day, month/day/year (day and month
    trade places when only that is possible), 'Jan 15, 2024', '15 Jan 2024' and '2024 Jan 15',
    with blanks, commas or hyphens, two-digit years and a weekday in front, each with an
    optional time of day; anything incomplete is null."""
    return _read_day(F.lower(strip(c)))


def _cut_range(low: Column, separators: list[str]) -> Column:
    """The text before the first listed separator that occurs: one search for any of
    them, each only where no separator listed before it follows."""
    ends = []
    for i, sep in enumerate(separators):
        later = f"(?!.*(?:{'|'.join(separators[:i])}))" if i else ""
        ends.append(f"{sep[:-1]}(?= ){later}.*$")
    return F.regexp_replace(low, "(?s)" + "|".join(ends), "")


def parse_date(c: Column | str, separators: list[str] = fixed.RANGE_SEPARATORS) -> Column:
    """A date cell -> date; a range gives its start. Blanks, N/A and auto-renew words name
    no day, so they are null like any other text."""
    return _read_day(F.rtrim(_cut_range(F.lower(strip(c)), separators)))


def as_date(df, name: str) -> Column:
    """Date view of a column: dates pass through, text is parsed."""
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        return parse_date(F.col(name))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.col(name).cast("date")
    return F.lit(None).cast("date")


def parse_boolean(c: Column | str) -> Column:
    key = F.lower(strip(c))
    return F.when(key.isin(fixed.TRUE_TOKENS), True).when(key.isin(fixed.FALSE_TOKENS), False)


def is_boolean_text(c: Column | str) -> Column:
    return F.lower(strip(c)).isin(fixed.TRUE_TOKENS + fixed.FALSE_TOKENS)


def is_error_cell(c: Column | str) -> Column:
    """Whether the whole cell is a spreadsheet error such as #REF! (any case)."""
    return F.coalesce(strip(c).rlike(fixed.ERROR_CELL), F.lit(False))


def error_to_null(c: Column | str) -> Column:
    return F.when(~is_error_cell(c), _col(c))


def parse_text(c: Column | str) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def parse_as(c: Column | str, kind: str | None, source: str = "string") -> Column:
    """The parser of a canonical type; unknown types are stripped text. A column that
    already has a fitting type (`source`) is not printed and read again."""
    if kind == "numeric" and source in ("double", "float", "tinyint", "smallint", "int", "bigint") or \
            kind == "numeric" and source.startswith("decimal"):
        return round_exact(c, 2)
    if kind == "date" and source in ("date", "timestamp", "timestamp_ntz"):
        return _col(c).cast("date")
    if kind == "boolean" and source == "boolean":
        return _col(c)
    if kind == "numeric":
        return parse_currency(c)
    if kind == "date":
        return parse_date(c)
    if kind == "boolean":
        return parse_boolean(c)
    return parse_text(c) if kind == "string" else strip(c)


def expand_name(c: Column | str) -> Column:
    """Lower-cased name with a known short form written out."""
    low = F.lower(strip(c))
    out = low
    for short, full in fixed.ABBREVIATIONS.items():
        out = F.when(low == short, F.lit(full)).otherwise(out)
    return out


def shape_hits(c: Column | str) -> dict[str, Column]:
    """Per shape, whether a stripped cell has it."""
    s = _col(c)
    return {
        "date": s.rlike(fixed.DATE_SHAPE),
        "currency": s.rlike(fixed.CURRENCY_SHAPE),
        "id": s.rlike(fixed.ID_SHAPE),
    }
