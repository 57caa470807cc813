"""Saved templates as an append-only table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import selectors as S
from ..operators.extract import TEMPLATE_SCHEMA
from .snapshots import Log

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("change", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("template", TEMPLATE_SCHEMA),
    ]
)
CLEAR = "*"


def _newest(log: DataFrame) -> DataFrame:
    """The newest change per id; deletions and the newest clearing stay, for rows that are still under way."""
    return log.groupBy("id").agg(F.max_by(F.struct("change", "at", "template"), "at").alias("l")).select("id", "l.*")


class TemplateStore:
    """Templates at `path`. Every change is a row; the newest row per id counts.

    Nothing is rewritten, so a reader never meets a half-replaced table. `compact` folds the changes so
    far into a snapshot, from which readers start.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = Log(spark, path, LOG_SCHEMA, _newest)

    def _log(self) -> DataFrame:
        return self.log.rows()

    def compact(self) -> int:
        return self.log.compact()

    def _add(self, rows: DataFrame) -> None:
        rows.select("id", "change", F.current_timestamp().alias("at"), "template").write.mode("append").parquet(self.path)

    def _mark(self, template_id: str, change: str) -> None:
        none = F.lit(None).cast(TEMPLATE_SCHEMA)
        self._add(self.spark.range(1).select(F.lit(template_id).alias("id"), F.lit(change).alias("change"), none.alias("template")))

    def save(self, templates: DataFrame) -> None:
        """Save templates that have an id."""
        self._add(templates.select("id", F.lit("save").alias("change"), F.struct(*TEMPLATE_SCHEMA.names).alias("template")))

    def save_new(self, url: str, columns: list[tuple], pagination_xpath: str | None = None) -> str:
        """Save one template under a new id, which is returned."""
        template_id = str(uuid.uuid4())
        self.save(self.spark.createDataFrame([(template_id, url, pagination_xpath, columns)], TEMPLATE_SCHEMA))
        return template_id

    def templates(self) -> DataFrame:
        log = self._log()
        cleared = log.filter(F.col("id") == CLEAR).agg(F.max("at")).first()[0]
        alive = log.filter(F.col("id") != CLEAR)
        if cleared is not None:
            alive = alive.filter(F.col("at") > F.lit(cleared))
        return _newest(alive).filter(F.col("change") == "save").select("template.*")

    def list(self) -> DataFrame:
        return self.templates().select("id")

    def load(self, template_id: str) -> DataFrame:
        return self.templates().filter(F.col("id") == template_id)

    def delete(self, template_id: str) -> bool:
        if self.load(template_id).isEmpty():
            return False
        self._mark(template_id, "delete")
        return True

    def clear(self) -> None:
        self._mark(CLEAR, "clear")


def read_template_files(spark: SparkSession, path: str) -> DataFrame:
    """Templates kept as one JSON file each."""
    return spark.read.schema(TEMPLATE_SCHEMA).option("multiLine", "true").json(path)


def column_values(templates: DataFrame, key: str) -> DataFrame:
    """(id, values): one property over the columns of each template."""
    return templates.select("id", S.column_data(F.col("columns"), key).alias("values"))
