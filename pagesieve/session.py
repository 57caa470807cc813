"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are designed for. On a cluster pass them to spark-submit;
# `tune` applies the ones that may still be changed on a running session.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # pages are wide rows: few per Arrow batch, or one batch holds gigabytes of html
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # collect_list groups are small (one record each); 128 groups per task would spill to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def build_session(cores: str | int = "*", shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """Local session for tests and the benchmark; `shared` is the folder of intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagesieve")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, else one in the session's warehouse.

    A session with executors on other machines must name a folder that all of them see: there, a
    warehouse on the driver's own disk is refused.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        named = fallback_folder(conf.get("spark.master", ""), warehouse)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fallback_folder(master: str, warehouse: str) -> str:
    """Folder for intermediate tables where the session names none."""
    on_own_disk = warehouse.startswith(("file:", "/"))
    if on_own_disk and not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse.rstrip('/')}/_intermediate"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(table: DataFrame, name: str) -> DataFrame:
    """Kept in the shared folder and read again: cuts the lineage, and what follows starts from it."""
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
