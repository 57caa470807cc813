"""Extraction as pages arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import sinks


BATCH = "written_in_batch"


def stream_records(
    pages: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    path: str,
    fmt: str,
    checkpoint: str,
    on_batch: Callable[[int, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the records of each batch of pages to the output at `path`.

    A batch writes its own folder, so one that is tried again after a failure replaces what it
    wrote before. `on_batch` gets the batch number and its rows (Q5: did the output grow?).
    `trigger` is passed on: by default all that is there, once; `{"processingTime": "10 seconds"}` keeps
    going. Read the output with `load_stream_output`.
    """
    spark = pages.sparkSession
    present = load_stream_output(spark, path, fmt).columns if sinks.exists(spark, path) else None

    def write(batch: DataFrame, batch_id: int) -> None:
        records = job(batch)
        names = sinks.written_names(records.columns, fmt)
        if present is not None and set(present) != set(names):
            raise sinks.ColumnMismatch(f"{path} has {present}, records have {names}")
        rows = sinks.save(records, f"{path}/{BATCH}={batch_id:08d}", fmt)
        if on_batch:
            on_batch(batch_id, rows)

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def load_stream_output(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None
) -> DataFrame:
    return sinks.load(spark, path, fmt, schema).drop(BATCH)
