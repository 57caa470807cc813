"""The run ledger (R1-R6, E12) as a fold over run events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import urls as U
from .joins import lookup_join
from .statuses import ERROR, FINISHED, RUNNING, STOPPED, UNDER_WAY

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("file_name", T.StringType()),
    ]
)
RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("titles", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("date", T.StringType()),
        T.StructField("time", T.StringType()),
    ]
)


def latest_status(events: DataFrame) -> DataFrame:
    """Status and file name of the newest event per run; ties in time go to the larger `seq`.

    `max_by` combines before the shuffle, so a run with very many events stays cheap. The same
    expression runs on a stream.
    """
    newest = F.max_by(F.struct("status", "file_name", "ts", "seq"), F.struct("ts", "seq"))
    return (
        events.groupBy("run_id")
        .agg(newest.alias("e"))
        .select("run_id", X.status_code(F.col("e.status")).alias("status"), X.percent(F.col("e.status")).alias("percent"),
                F.col("e.file_name").alias("file_name"), F.col("e.ts").alias("ts"), F.col("e.seq").alias("seq"))
    )


def update_runs(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with the newest event applied; events of unknown runs meet no run and are ignored."""
    news = latest_status(events).select(
        "run_id", F.col("status").alias("__status"), F.col("file_name").alias("__file"), F.lit(True).alias("__new")
    )
    return (
        runs.join(news, "run_id", "left")
        .withColumn("status", F.when(F.col("__new"), F.col("__status")).otherwise(F.col("status")))
        .withColumn("file_name", F.when(F.col("__new"), F.col("__file")).otherwise(F.col("file_name")))
        .select(*runs.columns)
    )


def after_restart(status: Column) -> Column:
    """R2: nothing is under way after a restart; a blank status is an error."""
    return F.when(status.isin(*UNDER_WAY), F.lit(STOPPED)).otherwise(F.coalesce(status, F.lit(ERROR)))


def open_run(spark: SparkSession, url: str, file_name: str, titles: list[str]) -> DataFrame:
    """The ledger row of a new run."""
    now = F.current_timestamp()
    return spark.range(1).select(
        F.lit(str(uuid.uuid4())).alias("run_id"), F.lit(url).alias("url"), F.lit(file_name).alias("file_name"),
        X.join_titles(F.array(*map(F.lit, titles))).alias("titles"), F.lit(RUNNING).alias("status"),
        X.date_text(now).alias("date"), X.time_text(now).alias("time"),
    )


def superseded(runs: DataFrame, file: str = "file_name", order: tuple[str, ...] = ("ts", "run_id")) -> DataFrame:
    """Runs with `removed` set where a later run has the same output; their file name is blank.

    Runs without an output share none.

    The newest run per file is an aggregate, not a window: a file written by a third of all runs
    does not have to be sorted in one task.
    """
    at = F.struct(*order)
    named = F.coalesce(F.col(file).cast("string"), F.lit("")) != ""
    # structs are compared by max_by on their own order; the newest key is all that a file needs
    newest = runs.filter(named).groupBy(file).agg(F.max_by(at, at).alias("__newest"))
    joined = lookup_join(runs.filter(named), newest, file, "left", spread=F.struct(*order), unique_right=True)
    kept = joined.withColumn("removed", F.coalesce(F.col("__newest") > at, F.lit(False))).select(*runs.columns, "removed")
    blank = F.lit("" if runs.schema[file].dataType == T.StringType() else None).cast(runs.schema[file].dataType)
    marked = kept.withColumn(file, F.when(F.col("removed"), blank).otherwise(F.col(file)))
    return marked.unionByName(runs.filter(~named).withColumn("removed", F.lit(False)))


def result_status(n_rows: Column, failed: Column | None = None) -> Column:
    """Rows mean finished, none or an exception means error."""
    ok = (n_rows > 0) if failed is None else (n_rows > 0) & ~failed
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(FINISHED)).otherwise(F.lit(ERROR))


def cancel_status(n_rows: Column) -> Column:
    """A cancelled run is finished if its output has rows, else stopped."""
    return F.when(F.coalesce(n_rows, F.lit(0)) > 0, F.lit(FINISHED)).otherwise(F.lit(STOPPED))


def upsert_by_domain(registry: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """Entries replace those of the registry with the same registrable domain, else are added."""
    site = U.registrable(F.col(url))
    old = registry.withColumn("__d", site)
    new = entries.withColumn("__d", site).filter(F.col("__d").isNotNull())
    # a site that holds most of the entries is split where the list of new sites is long
    kept = lookup_join(old, new.select("__d").distinct(), "__d", "left_anti", unique_right=True).select(*old.columns)
    return kept.unionByName(new).drop("__d")


def lookup_by_domain(pages: DataFrame, registry: DataFrame, url: str = "url", rank: str = "id") -> DataFrame:
    """Pages with the first registry entry (smallest `rank`) of their registrable domain."""
    first = registry.withColumn("domain", U.registrable(F.col(url))).filter(F.col("domain").isNotNull())
    first = first.groupBy("domain").agg(F.min_by(F.struct(*registry.columns), rank).alias("entry"))
    sited = pages.withColumn("domain", U.registrable(F.col("url")))
    return lookup_join(sited, first, "domain", unique_right=True)
