"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# A generated method above this size is not compiled to machine code by the JVM, so wide
# parsing projections run faster split into several methods than fused into one.
CODE_SIZE = {"spark.sql.codegen.hugeMethodLimit": "8000"}


_SHIPPED: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in CODE_SIZE.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "keyfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **CODE_SIZE,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers, which may not have it on their path.

    The archive is written on the driver and served to the executors by Spark."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="keyfold-"), "keyfold"), "zip",
                                      os.path.dirname(package), os.path.basename(package))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
    return spark


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder every executor can reach, under spark.checkpoint.dir.

    Only a local-mode session may fall back to the machine's temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = os.path.join(tempfile.gettempdir(), "keyfold-work")
    return f"{base.rstrip('/')}/keyfold-{label}-{uuid.uuid4().hex[:12]}"


_RECORDS = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that `staged` writes meanwhile in this thread, for `discard`."""
    paths: list[str] = []
    open_ = _RECORDS.__dict__.setdefault("open", [])
    open_.append(paths)
    try:
        yield paths
    finally:
        open_.pop()


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete staged tables that nothing will read again."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write a table that several queries read to the shared folder and read it back.

    What led to it is computed once; later readers prune columns, and a lost executor
    costs no more than its own tasks. `rows_per_file` bounds the files of a table of large rows."""
    path = work_folder(df.sparkSession, label)
    for paths in _RECORDS.__dict__.get("open", []):
        paths.append(path)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
