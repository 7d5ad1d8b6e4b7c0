"""From raw headers to shared names: projections decided by column names alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from keyfold import fixed
from keyfold.functions import cells
from keyfold.model import ORD, Sheet, is_internal
from keyfold.schema import CanonicalSchema


def apply_mapping(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Keep mapped columns under their target names; blank targets and unmapped columns
    are dropped, mappings of absent columns are ignored."""
    pairs = [(raw, target.strip()) for raw, target in mapping.items()
             if raw in df.columns and target and target.strip()]
    targets = [t for _, t in pairs]
    doubled = sorted({t for t in targets if targets.count(t) > 1})
    if doubled:
        raise ValueError(f"several columns are mapped to {doubled}")
    position = {raw: i for i, raw in enumerate(df.columns)}
    pairs.sort(key=lambda p: position[p[0]])
    kept = [F.col(f"`{raw}`").alias(target) for raw, target in pairs]
    return df.select(*kept, *([F.col(ORD)] if ORD in df.columns else []))


def select_sheets(sheets: Sequence[Sheet], names: Sequence[str] | None) -> list[Sheet]:
    """The named sheets (all when no name is given); an error when none is left."""
    chosen = [s for s in sheets if not names or s.name in names]
    if not chosen:
        raise ValueError("no sheets selected")
    return chosen


def map_sheets(sheets: Sequence[Sheet], mapping: dict[str, str | None],
               keys: Sequence[str] = fixed.KEY_COLS, skip_keyless: bool = True) -> list[Sheet]:
    """Apply one mapping to many sheets, each narrowed to the columns it has. Every key
    must be some target; sheets that end up without any key are skipped."""
    targets = {t.strip() for t in mapping.values() if t and t.strip()}
    missing = [k for k in keys if k not in targets]
    if missing:
        raise ValueError(f"required key column(s) not mapped: {missing}")
    out = []
    for s in sheets:
        own = {raw: t for raw, t in mapping.items() if raw in s.df.columns and t and t.strip()}
        if skip_keyless and not any(t.strip() in keys for t in own.values()):
            continue
        out.append(s.with_df(apply_mapping(s.df, own)))
    return out


def detect_key_columns(columns: Sequence[str]) -> dict[str, str]:
    """Guess a mapping: an 'account ... id' header is the account key, a 'close ... date'
    header the date key, anything else keeps its name. The first match takes the key."""
    out: dict[str, str] = {}
    for c in columns:
        low, target = c.lower(), c
        if "account" in low and "id" in low:
            target = "account_id"
        elif "close" in low and "date" in low:
            target = "close_date"
        out[c] = c if target in out.values() else target
    return out


def suffix_duplicates(targets: dict[str, str]) -> dict[str, str]:
    """The second column of one target becomes target_1, the third target_2 ..."""
    seen: dict[str, int] = {}
    out = {}
    for raw, target in targets.items():
        n = seen.get(target)
        out[raw] = target if n is None else f"{target}_{n + 1}"
        seen[target] = 0 if n is None else n + 1
    return out


def split_composite_headers(df: DataFrame) -> DataFrame:
    """'A : B : C' is renamed to 'C'; when any header was, the other composite ones go."""
    composite = [c for c in df.columns if " : " in c]
    taken, renamed = set(df.columns), {}
    for c in composite:
        short = c.split(" : ")[-1].strip()
        if short not in taken:
            taken.add(short)
            renamed[c] = short
    if not renamed:
        return df
    plain = [F.col(f"`{c}`") for c in df.columns if c not in composite]
    return df.select(*plain, *[F.col(f"`{c}`").alias(short) for c, short in renamed.items()])


@dataclass(frozen=True)
class MappingEntry:
    canonical: str
    sheet: str
    column: str


class MappingConfig:
    """Confirmed mapping entries; one field may come from several sheets."""

    def __init__(self, entries: Sequence[MappingEntry | tuple] = (), version: str = "v1",
                 required: Sequence[str] = fixed.REQUIRED_FIELDS):
        self.entries = [e if isinstance(e, MappingEntry) else MappingEntry(*e) for e in entries]
        self.version = version
        self.required = list(required)

    def for_sheet(self, sheet: str) -> dict[str, str]:
        """canonical -> raw column; the last entry of a field wins."""
        return {e.canonical: e.column for e in self.entries if e.sheet == sheet}

    def primary(self) -> dict[str, tuple[str, str]]:
        """canonical -> first (sheet, column)."""
        out: dict[str, tuple[str, str]] = {}
        for e in self.entries:
            out.setdefault(e.canonical, (e.sheet, e.column))
        return out

    def without(self, canonical: str) -> "MappingConfig":
        return MappingConfig([e for e in self.entries if e.canonical != canonical], self.version, self.required)

    def unmapped_required(self) -> list[str]:
        mapped = {e.canonical for e in self.entries}
        return [f for f in self.required if f not in mapped]

    @property
    def complete(self) -> bool:
        return not self.unmapped_required()

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(e.canonical, e.sheet, e.column) for e in self.entries],
                                     "canonical string, sheet string, column string")


def extract_sheet(sheet: Sheet, columns: dict[str, str], schema: CanonicalSchema) -> DataFrame:
    """One sheet as typed canonical columns plus lineage: error cells are null, each cell
    is parsed by its field's type, an absent column is null. One projection."""
    if ORD in sheet.df.columns:
        index = F.col(ORD).cast("bigint")
    else:
        index = F.monotonically_increasing_id()
    raw = sheet.df.withColumn("__idx", index)
    parsed = []
    for canonical, column in columns.items():
        cell, source = F.lit(None).cast("string"), "string"
        if column in raw.columns:
            cell, source = F.col(f"`{column}`"), raw.schema[column].dataType.simpleString()
            if source == "string":
                cell = cells.error_to_null(cell)
        parsed.append(cells.parse_as(cell, schema.type_of(canonical), source).alias(canonical))
    lineage = F.sha2(F.concat_ws("|", F.lit(sheet.dataset_id), F.lit(sheet.name), F.col("__idx")), 256)
    return raw.select(lineage.alias("row_lineage_id"), F.lit(sheet.name).alias("_source_sheet_id"),
                      F.col("__idx").alias("_source_row_idx"), *parsed)


def extract_sheets(sheets: Sequence[Sheet], config: MappingConfig, schema: CanonicalSchema) -> dict[str, DataFrame]:
    """Typed extraction of every sheet that has mapping entries."""
    return {s.name: extract_sheet(s, config.for_sheet(s.name), schema)
            for s in sheets if config.for_sheet(s.name)}


def canonical_order(df: DataFrame) -> DataFrame:
    """Preferred columns first, the rest after them, internal columns dropped."""
    shown = [c for c in df.columns if not is_internal(c)]
    head = [c for c in fixed.OUTPUT_ORDER if c in shown]
    return df.select(*head, *[c for c in shown if c not in head])


def drop_internal(df: DataFrame, also_provenance: bool = False) -> DataFrame:
    """Without '_*' columns, and without 'meta_*' ones when asked."""
    return df.drop(*[c for c in df.columns
                     if is_internal(c) or (also_provenance and c.startswith("meta_"))])
