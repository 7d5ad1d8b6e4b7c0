"""Appending sheets to the stored master as files arrive.

No operator of its own: every micro-batch is one append to the stored master, which rewrites
only the parts its keys fall into. The append carries the number of the batch, so a batch
that is retried after a failure finishes what it began and counts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from keyfold.functions.cells import na_to_null
from keyfold.operators.mapping import apply_mapping
from keyfold.sources.master import append_rows


def append_stream(spark: SparkSession, folder: str, headers: Sequence[str], column_mapping: dict[str, str | None],
                  master: str, checkpoint: str, on_conflict: str = "error"):
    """Start a query that appends the CSV files of `folder` to the master stored at `master`,
    which must exist. Processes what is there and stops."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    arriving = spark.readStream.schema(schema).options(header=True, escape='"').csv(folder)

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = apply_mapping(batch.select(*[na_to_null(batch[h]).alias(h) for h in headers]), column_mapping)
        append_rows(batch.sparkSession, master, rows, batch_id + 1, on_conflict)

    return (arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
