"""Whole flows over the operators: merge and append, the layered run, the cleaner chain."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from keyfold import fixed
from keyfold.model import ORD, Sheet, with_ordinal
from keyfold.operators import checks, derive, mapping, merge, mlready, rollup, suggest
from keyfold.operators.clean import clean_table
from keyfold.operators.entities import resolve_names
from keyfold.schema import CanonicalSchema
from keyfold.session import staged
from keyfold.sources import sinks
from keyfold.sources.tables import PROVENANCE_FILE, PROVENANCE_TAB, clean_frame


def build_master(sheets: Sequence[Sheet], column_mapping: dict[str, str | None],
                 selected: Sequence[str] | None = None, keys: Sequence[str] = fixed.KEY_COLS,
                 on_conflict: str = "error", plan: str = "auto") -> DataFrame:
    """Select sheets, map their columns, merge them on the keys."""
    mapped = mapping.map_sheets(mapping.select_sheets(sheets, selected), column_mapping, keys)
    return merge.merge_sheets([s.df for s in mapped], keys, on_conflict, plan)


def extend_master(master: DataFrame, sheets: Sequence[Sheet], column_mapping: dict[str, str | None],
                  selected: Sequence[str] | None = None, keys: Sequence[str] = fixed.KEY_COLS,
                  on_conflict: str = "error") -> DataFrame:
    """Append mapped sheets to a master; on a conflict the master stays as it was."""
    mapped = mapping.map_sheets(mapping.select_sheets(sheets, selected), column_mapping, keys)
    return merge.append_to_master(master, [s.df for s in mapped], keys, on_conflict)


@dataclass
class LayeredResult:
    contracts: DataFrame
    line_items: DataFrame | None
    issues: DataFrame
    levels: dict[str, str]
    versions: dict[str, str] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return checks.passed(self.issues)

    def ready_for_ml(self, contract: dict = fixed.ML_CONTRACT) -> bool:
        return mlready.is_ready(self.contracts, self.issues, contract)


def run_layers(sheets: Sequence[Sheet], config: mapping.MappingConfig | None = None,
               schema: CanonicalSchema | None = None, rules: dict[str, str] = fixed.ROLLUP_RULES,
               derived: dict[str, dict] = fixed.DERIVED_FIELDS, validation: dict = fixed.VALIDATION_RULES,
               as_of: Column | None = None, primary: str | None = None,
               join_keys: Sequence[str] = fixed.JOIN_KEYS) -> LayeredResult:
    """Extract typed columns, resolve vendors, classify, roll up, join, derive, validate.

    Without a mapping configuration the suggestions are taken as they are. The extracted
    sheets and the contracts feed several queries, so they are written once each."""
    schema = schema or CanonicalSchema.default()
    config = config or suggest.accept_suggestions(suggest.suggest_mappings(sheets, schema))
    extracted = {}
    for name, df in mapping.extract_sheets(sheets, config, schema).items():
        if "vendor" in df.columns:
            df = resolve_names(df, "vendor", F.col("_source_row_idx"), cluster_col=None)
        extracted[name] = staged(df, f"extracted-{len(extracted)}")
    levels = {n: rollup.classify_grain(df).first()["level"] for n, df in extracted.items()}
    rolled, items = rollup.rollup_sheets(extracted, rules=rules, order=F.col("_source_row_idx"), levels=levels)
    joined = merge.join_entities(rolled, primary, join_keys)
    contracts = staged(mapping.canonical_order(derive.derive_fields(joined, derived, as_of)), "contracts")
    issues = checks.validate(contracts, validation, items, as_of)
    versions = {"schema": schema.version, "mapping": config.version}
    return LayeredResult(contracts, items, issues, levels, versions)


def store_layers(result: LayeredResult, root: str, dataset_id: str = "default", run_id: str | None = None) -> DataFrame:
    """Write outputs and issues, and add the run to the log."""
    spark = result.contracts.sparkSession
    metadata = sinks.write_canonical(result.contracts, result.line_items, f"{root}/canonical", dataset_id, result.versions)
    sinks.write_report(result.issues, f"{root}/issues")
    counts = metadata.first()
    status = "failed" if not spark.read.schema(checks.ISSUE_SCHEMA).json(f"{root}/issues").where(
        "severity = 'error'").isEmpty() else "passed"
    sinks.append_run_log(spark, f"{root}/run_log", run_id or uuid.uuid4().hex, dataset_id, result.versions,
                         ",".join(sorted(set(result.levels.values()))),
                         counts["line_item_count"] or counts["contract_count"], counts["contract_count"], status, counts["content_hash"])
    return metadata


def clean_chain(sheets: Sequence[Sheet], headers: dict[str, dict[str, str]], vendor_col: str = "Vendor",
                subset: Sequence[str] = fixed.DEDUP_SUBSET) -> DataFrame:
    """Rename headers per sheet, stack, clean, resolve vendors, merge quote lines, drop
    duplicates. `headers` maps sheet -> {raw: name}; a doubled name gets a suffix."""
    ordered = all(ORD in s.df.columns for s in sheets)
    frames = []
    for i, s in enumerate(sheets):
        df = clean_frame(s.df)
        if ordered:  # row order within a sheet, sheets one after another
            df = df.withColumn(ORD, F.lit(i << 52) + F.col(ORD).cast("bigint"))
        df = df.withColumns({
            PROVENANCE_TAB: F.lit(s.name), PROVENANCE_FILE: F.lit(s.source_file or s.name)})
        names = mapping.suffix_duplicates(headers.get(s.name, {}))
        frames.append(df.withColumnsRenamed({r: n for r, n in names.items() if r in df.columns}))
    stacked = merge.concat_sheets(frames if ordered else [f.drop(ORD) for f in frames])
    # cleaned once; read by name counting, both rollup branches and the orphan rows
    cleaned = with_ordinal(clean_table(stacked))
    flags = rollup.pure_booleans(cleaned)  # a stored table no longer says so
    df = staged(cleaned, "cleaned")
    df = resolve_names(df, vendor_col, F.col(ORD), canonical_col="Vendor_Canonical", cluster_col="Vendor_Cluster_ID")
    merged = rollup.merge_quote_lines(df, order=F.col(ORD), flags=flags)
    return rollup.deduplicate(merged, subset, F.xxhash64(*merged.columns))  # no row order left after a shuffle
