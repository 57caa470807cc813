"""Append-only logs with snapshots."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import sinks

SNAPSHOTS = "_snapshots"  # readers of the log's folder pass over names that begin like this
_FILES = T.StructType([T.StructField("file", T.StringType())])


class Log:
    """Rows in Parquet files at `path`, and beside them what older files fold to.

    `fold` gives rows that stand for all rows of a log, together with any that come later or were still
    being written: the newest per key with its time, removals included. A snapshot names the files it
    stands for, so a file that a slow writer adds behind it is read like any later one: writers never
    wait. Files count as folded only once their names are written, which is the last step, and a reader
    may go on with an older snapshot. Files that the newest snapshot names are not read again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.fold = spark, path, schema, fold

    def _files(self) -> list[str]:
        if not sinks.exists(self.spark, self.path):
            return []
        # names come as addresses
        return [unquote(f) for f in self.spark.read.schema(self.schema).parquet(self.path).inputFiles()]

    def _versions(self) -> list[str]:
        folder = f"{self.path}/{SNAPSHOTS}"
        return sorted(v for v in sinks.names_in(self.spark, folder) if sinks.exists(self.spark, f"{folder}/{v}/files/_SUCCESS"))

    def _split(self) -> tuple[DataFrame | None, list[str], list[str]]:
        """The snapshot's rows, the files it does not stand for, and all files."""
        versions = self._versions()
        files = self._files()
        if not versions:
            return None, files, files
        newest = f"{self.path}/{SNAPSHOTS}/{versions[-1]}"
        # as many names as the log has files, which the listing holds as well
        folded = {r.file for r in self.spark.read.schema(_FILES).parquet(f"{newest}/files").collect()}
        return self.spark.read.schema(self.schema).parquet(f"{newest}/state"), [f for f in files if f not in folded], files

    def _rows(self, state: DataFrame | None, later: list[str]) -> DataFrame:
        parts = [] if state is None else [state]
        if later:
            parts.append(self.spark.read.schema(self.schema).parquet(*later))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def rows(self) -> DataFrame:
        """The newest snapshot and all rows it does not stand for."""
        state, later, _ = self._split()
        return self._rows(state, later)

    def compact(self) -> int:
        """Fold what came since the last snapshot into a new one; returns how many files that were.

        Of two that fold at once, the second raises if both take the same number; nothing is lost.
        """
        state, later, files = self._split()
        if not later:
            return 0
        # unfinished snapshots keep their number
        numbers = [int(v) for v in sinks.names_in(self.spark, f"{self.path}/{SNAPSHOTS}") if v.isdigit()]
        target = f"{self.path}/{SNAPSHOTS}/{max(numbers, default=-1) + 1:08d}"
        self.fold(self._rows(state, later)).select(*self.schema.names).write.parquet(f"{target}/state")
        self.spark.createDataFrame([(f,) for f in files], _FILES).coalesce(1).write.parquet(f"{target}/files")
        return len(later)
