"""Record outputs (S2-S10, E12): folders of part files in CSV, JSON lines, XML or Parquet."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

BOM = "\ufeff"
NOTE = "_columns"  # a name that readers of the records pass over
FORMATS = ("csv", "json", "xml", "parquet")
OPTIONS = {
    # quotes are doubled inside quoted values
    "csv": {"header": "true", "encoding": "UTF-8", "escape": '"', "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false"},
    "json": {"ignoreNullFields": "false"},
    # a prefix no column has: the default one turns columns that begin with `_` into attributes
    "xml": {"rootTag": "root", "rowTag": "item", "attributePrefix": "@", "ignoreSurroundingSpaces": "false"},
    "parquet": {},
}


class ColumnMismatch(ValueError):
    """The columns of an existing output are not those of the new records."""


def xml_name(title: str) -> str:
    """Element name for a title."""
    name = re.sub("[^a-zA-Z0-9]", "_", title)
    if not name:
        raise ValueError("a column without a title cannot be written as XML")
    return f"_{name}" if name[0].isdigit() else name


def output_name(path: str, fmt: str) -> str:
    """`path` with the extension of the format."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    return path if path.endswith(f".{fmt}") else f"{path}.{fmt}"


def format_of(path: str) -> str:
    """Format by lower-case suffix."""
    fmt = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file format: .{fmt}")
    return fmt


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where there is no folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not exists(spark, path):
        return []
    return [s.getPath().getName() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]


def written_names(titles: list[str], fmt: str) -> list[str]:
    """Column names as they appear in an output."""
    names = [xml_name(t) for t in titles] if fmt == "xml" else list(titles)
    if len(set(names)) != len(names):
        raise ValueError(f"titles collide: {names}")
    return names


def _marked(df: DataFrame, fmt: str) -> DataFrame:
    """The byte order mark goes in front of the first header name."""
    if fmt != "csv":
        return df
    return df.toDF(BOM + df.columns[0], *df.columns[1:])


def load(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Records of an output. Values are text, so nothing is inferred."""
    fmt = fmt or format_of(path)
    reader = spark.read.format(fmt).options(**OPTIONS[fmt])
    if schema is None and fmt != "parquet" and (names := _remembered(spark, path)):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if fmt == "csv":
        # with its default the reader takes a quoted empty text for no value, too
        reader = reader.option("inferSchema", "false").option("multiLine", "true").option("nullValue", "\u0001")
    if fmt == "json":
        reader = reader.option("primitivesAsString", "true")
    if fmt == "xml":
        reader = reader.option("inferSchema", "false")
    if schema is not None:
        reader = reader.schema(schema)
    found = reader.load(path)
    first = found.columns[0] if found.columns else ""
    return found.withColumnRenamed(first, first.removeprefix(BOM))


def load_array(spark: SparkSession, path: str) -> DataFrame:
    """A single JSON array, as written by other tools."""
    return spark.read.option("multiLine", "true").option("primitivesAsString", "true").json(path)


def output_columns(spark: SparkSession, path: str, fmt: str) -> list[str]:
    return [c.strip() for c in load(spark, path, fmt).columns]


def _remembered(spark: SparkSession, path: str) -> list[str] | None:
    """Columns noted beside the records of an output, so that nobody has to look for them in the records."""
    noted = f"{path}/{NOTE}"
    return json.loads(spark.read.text(noted).first()[0]) if exists(spark, noted) else None


def _remember(spark: SparkSession, path: str, names: list[str]) -> None:
    spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{NOTE}")


def save(df: DataFrame, path: str, fmt: str | None = None, append: bool = False) -> int:
    """Write or append `df`; returns the rows written.

    Appending needs the same set of columns and goes by name. It adds part files; what is there
    already is not read again: its columns are noted beside it.
    """
    fmt = fmt or format_of(path)
    spark = df.sparkSession
    out = df.toDF(*written_names(df.columns, fmt))
    mode = "overwrite"
    if append and exists(spark, path):
        mode = "append"
        try:
            present = output_columns(spark, path, fmt)
        except AnalysisException as error:  # a folder without any part file yet
            if "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            present = []
        if present:
            if set(present) != set(out.columns):
                raise ColumnMismatch(f"{path} has {present}, records have {out.columns}")
            out = out.select(*[F.col(f"`{c}`") for c in present])
    seen = Observation()
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"))
    _marked(out, fmt).write.format(fmt).options(**OPTIONS[fmt]).mode(mode).save(path)
    if mode == "overwrite" and fmt != "parquet":
        _remember(spark, path, out.columns)
    return seen.get["rows"]


def count_rows(spark: SparkSession, path: str | None) -> int | None:
    """Records of an output; None if it is missing or of no known format."""
    if not path:
        return None
    try:
        fmt = format_of(path)
    except ValueError:
        return None
    return load(spark, path, fmt).count() if exists(spark, path) else None
