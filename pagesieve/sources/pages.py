"""Stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def spread(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Give every core a share when the files hold fewer splits than there are cores.

    At scale a scan has many splits and this adds nothing; it matters for a single small file, which
    one task would otherwise tokenise alone.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() >= cores:
        return pages
    return pages.repartition(cores, key)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from parquet; filters on `page_id` and `url` reach the scan."""
    return spread(spark.read.schema(PAGE_SCHEMA).parquet(path))


def pages_from_html(spark: SparkSession, htmls: list[str], url: str = "http://localhost/") -> DataFrame:
    """A handful of pages already in memory, such as the one a user looks at."""
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], PAGE_SCHEMA).coalesce(1)


def streamable(spark: SparkSession, path: str) -> str:
    """`path` as a stream reads it: a folder as it is, a single file as a pattern that only it fits.

    By its plain path a stream takes a single file for a folder and fails.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target) or files.getFileStatus(target).isDirectory():
        return path
    return f"{target.getParent().toString()}/{{{target.getName()}}}"


def stream_pages(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None, pattern: str = "*.parquet"
) -> DataFrame:
    """Pages that keep arriving as parquet files in a folder, or those of a single file."""
    reader = spark.readStream.schema(PAGE_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(streamable(spark, folder))
