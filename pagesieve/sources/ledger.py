"""The run ledger in storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import runs as R
from . import sinks
from .snapshots import Log

_FILE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "file_name", "titles", "status", "date", "time", "action")]
)


def _newest(events: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*R.EVENT_SCHEMA.names), F.struct("ts", "seq"))
    return events.groupBy("run_id").agg(newest.alias("e")).select("e.*")


class Ledger:
    """Runs and their events below `path`, both append-only; the state of a run is folded on read.

    `compact` folds the events so far into a snapshot with one per run, from which readers start.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.runs_path, self.events_path = f"{path}/runs", f"{path}/events"
        self.removed_path = f"{path}/removed"
        self.event_log = Log(spark, self.events_path, R.EVENT_SCHEMA, _newest)

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        if not sinks.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def open(self, run: DataFrame) -> str:
        """Add the row of a new run (`runs.open_run`); returns its id."""
        row = run.first()
        self.spark.createDataFrame([tuple(row)], R.RUN_SCHEMA).write.mode("append").parquet(self.runs_path)
        return row["run_id"]

    def record(self, events: DataFrame) -> None:
        events.select(*R.EVENT_SCHEMA.names).write.mode("append").parquet(self.events_path)

    def events(self) -> DataFrame:
        """All events, of those in a snapshot the newest per run."""
        return self.event_log.rows()

    def compact(self) -> int:
        return self.event_log.compact()

    def runs(self, restarted: bool = False) -> DataFrame:
        """Runs with their newest status; after a restart none is under way."""
        opened = self._read(self.runs_path, R.RUN_SCHEMA)
        gone = self._read(self.removed_path, T.StructType([T.StructField("run_id", T.StringType())]))
        kept = opened.join(gone.distinct(), "run_id", "left_anti")
        current = R.update_runs(kept, self.events())
        return current.withColumn("status", R.after_restart(F.col("status"))) if restarted else current

    def remove(self, run_id: str) -> None:
        """Drop a run from the ledger; its output file is left to the caller."""
        self.spark.range(1).select(F.lit(run_id).alias("run_id")).write.mode("append").parquet(self.removed_path)

    def clear(self) -> None:
        """Drop all runs."""
        self._read(self.runs_path, R.RUN_SCHEMA).select("run_id").write.mode("append").parquet(self.removed_path)


def read_ledger_file(spark: SparkSession, path: str) -> DataFrame:
    """A ledger kept as CSV without header, as it looks after a restart."""
    rows = spark.read.schema(_FILE_SCHEMA).csv(path)
    return rows.withColumn("status", R.after_restart(F.col("status").try_cast("int")))
