"""Run events as a stream, folded to the newest status per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import runs as R
from ..sources.snapshots import Log
from .records import BATCH

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("percent", T.IntegerType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(R.EVENT_SCHEMA).parquet(path)


def stream_status(
    events: DataFrame, path: str, checkpoint: str, known: DataFrame | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Append the newest event per run of each batch at `path`; events of runs not in `known` are ignored.

    Newest means largest (ts, seq), over all batches once `current_status` folds them, so an event
    that comes late cannot replace a newer one. The stream keeps no state that would grow with the
    runs, and a batch that is tried again replaces the folder it wrote before. `trigger` as in
    `stream_records`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = R.latest_status(batch)
        if known is not None:
            newest = newest.join(known.select("run_id").distinct(), "run_id", "left_semi")
        newest.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id:08d}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _newest(changes: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("status", "percent", "file_name", "ts", "seq"), F.struct("ts", "seq"))
    return changes.groupBy("run_id").agg(newest.alias("e")).select("run_id", "e.*")


def compact(spark: SparkSession, path: str) -> int:
    """Fold the batches at `path` into a snapshot beside them, also while a stream adds more; returns how many files.

    A batch that is written again afterwards is read again, which changes nothing.
    """
    return Log(spark, path, STATUS_SCHEMA, _newest).compact()


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """Newest status per run over the newest snapshot and all batches behind it."""
    return _newest(Log(spark, path, STATUS_SCHEMA, _newest).rows())
