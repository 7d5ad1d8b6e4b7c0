"""Writing snapshots, outputs and the run log.

Tables are written whole into a new place beside the old one, and only a finished one takes its
name. A write that stops leaves the old table readable; between two names there is a
short moment without a table where the file system has no exchange of names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from keyfold.model import ORD, Sheet
from keyfold.operators.mapping import canonical_order, drop_internal
from keyfold.operators.merge import key_ordered
from keyfold.sources.catalog import catalog
from keyfold.sources.states import Observed, State
from keyfold import fixed

CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
RUN_LOG_SCHEMA = (
    "run_id string, dataset_id string, logged_at timestamp, versions map<string,string>, level string, "
    "rows_before bigint, rows_after bigint, validation_status string, content_hash string"
)


def replace_table(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Write a table under another name, then give it the name of the old one."""
    spark = df.sparkSession
    new = f"{path.rstrip('/')}__new_{uuid.uuid4().hex[:12]}"
    df.write.format(kind).options(**options).save(new)
    jvm = spark._jvm.org.apache.hadoop.fs
    target, source = jvm.Path(path), jvm.Path(new)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"could not name {new} as {path}")
    spark.catalog.refreshByPath(path)


def write_raw(sheets: Sequence[Sheet], root: str) -> None:
    """Parquet per sheet plus the catalog."""
    for s in sheets:
        replace_table(s.df.drop(ORD), f"{root}/raw/{s.name}")
    replace_table(catalog(sheets, with_hash=True), f"{root}/catalog")


def write_master(df: DataFrame, root: str, version: int) -> str:
    """One Parquet snapshot per append; the previous ones stay readable."""
    path = f"{root}/master/version={version}"
    replace_table(df, path)
    return path


def read_master(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/master/version={version}")


def export_csv(df: DataFrame, path: str, keys: Sequence[str] = fixed.KEY_COLS, ordered: bool = True) -> None:
    """CSV with a header; key order is a range-partitioned sort."""
    keys = [k for k in keys if k in df.columns]
    out = key_ordered(df, keys) if ordered and keys else df
    replace_table(out.drop(ORD), path, "csv", **CSV_OPTIONS)


def write_canonical(contracts: DataFrame, line_items: DataFrame | None, root: str, dataset_id: str,
                    versions: dict[str, str]) -> DataFrame:
    """Contracts as Parquet and CSV, line items as Parquet, and one metadata row. Row counts
    and the contracts' fingerprint are observed while writing, without another pass. The line items
    are written beside the contracts, so their tasks fill cores that the other's stages leave idle."""
    contracts = canonical_order(contracts)
    seen = Observed(contracts, "contracts")
    spark = contracts.sparkSession
    items = drop_internal(line_items) if line_items is not None else None

    def write_items() -> int:
        seen_items = Observation("line_items")
        replace_table(items.observe(seen_items, F.count(F.lit(1)).alias("n")), f"{root}/line_items")
        return seen_items.get["n"]

    with ThreadPoolExecutor(1) as beside:
        written = beside.submit(inheritable_thread_target(spark)(write_items)) if items is not None else None
        replace_table(seen.rows, f"{root}/contracts")
        state = seen.state
        replace_table(spark.read.schema(contracts.schema).parquet(f"{root}/contracts"), f"{root}/contracts_csv", "csv", **CSV_OPTIONS)
        n_items, item_columns = (written.result(), items.columns) if written else (None, None)
    row = [(dataset_id, versions, state.n_rows, contracts.columns, n_items, item_columns, state.content_hash)]
    metadata = spark.createDataFrame(row, "dataset_id string, versions map<string,string>, contract_count bigint, contract_columns array<string>, "
                                     "line_item_count bigint, line_item_columns array<string>, content_hash string")
    replace_table(metadata, f"{root}/output_metadata", "json")
    return metadata


def write_report(df: DataFrame, path: str) -> None:
    """A profile, relation or issue table as JSON lines."""
    replace_table(df, path, "json")


def append_run_log(spark: SparkSession, path: str, run_id: str, dataset_id: str, versions: dict[str, str],
                   level: str, rows_before: int, rows_after: int, status: str = "pending",
                   content_hash: str | None = None) -> None:
    """Add one run to the append-only log, with the fingerprint its write observed."""
    row = spark.createDataFrame(
        [(run_id, dataset_id, versions, level, rows_before, rows_after, status, content_hash)],
        "run_id string, dataset_id string, versions map<string,string>, level string, rows_before bigint, "
        "rows_after bigint, validation_status string, content_hash string")
    row.withColumn("logged_at", F.current_timestamp()).select(
        "run_id", "dataset_id", "logged_at", "versions", "level", "rows_before", "rows_after", "validation_status", "content_hash"
    ).write.mode("append").parquet(path)


def write_run(df: DataFrame, root: str, run_id: str, dataset_id: str, versions: dict[str, str], level: str = "mixed",
              rows_before: int | None = None, status: str = "pending") -> State:
    """Write a run's output and log it; rows and fingerprint are observed by the write itself."""
    seen = Observed(df, "run")
    seen.rows.write.mode("overwrite").parquet(f"{root}/runs/{run_id}")
    state = seen.state
    append_run_log(df.sparkSession, f"{root}/run_log", run_id, dataset_id, versions, level, rows_before, state.n_rows, status, state.content_hash)
    return state


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path)


def _versions_text(log: DataFrame) -> DataFrame:
    return log.withColumn("versions", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("versions")))))


def reproducible_runs(log: DataFrame) -> DataFrame:
    """(dataset_id, versions, runs, equal): runs of one data set with equal versions, which must
    give equal output; `equal` says whether their fingerprints are, null where one has none.
    Only the log is read; it has one row per run."""
    return _versions_text(log).groupBy("dataset_id", "versions").agg(
        F.array_sort(F.collect_list("run_id")).alias("runs"),
        F.when(F.count("content_hash") == F.count(F.lit(1)), F.min("content_hash") == F.max("content_hash")).alias("equal")).where(F.size("runs") > 1)


def differing_runs(log: DataFrame) -> DataFrame:
    """(dataset_id, versions, run_id, first_run): runs whose output differs from that of the first
    run with the same versions."""
    runs = _versions_text(log).where("content_hash is not null").select("dataset_id", "versions", "run_id", "logged_at", "content_hash")
    first = runs.groupBy("dataset_id", "versions").agg(F.min_by(F.struct("run_id", "content_hash"), F.struct("logged_at", "run_id")).alias("first"))
    return runs.join(first, ["dataset_id", "versions"]).where(F.col("content_hash") != F.col("first.content_hash")).select(
        "dataset_id", "versions", "run_id", F.col("first.run_id").alias("first_run"))


def same_versions(log: DataFrame, run_a: str, run_b: str) -> bool:
    """Whether two runs used the same configuration versions."""
    entries = F.array_sort(F.map_entries("versions"))
    rows = log.where(F.col("run_id").isin(run_a, run_b)).select("run_id", entries.alias("v")).collect()
    found = {r["run_id"]: r["v"] for r in rows}
    return run_a in found and run_b in found and found[run_a] == found[run_b]
