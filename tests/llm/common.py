"""Small tables with every awkward row, and plain versions of shared definitions."""

import re
import zlib

FOLDER = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"
#: ids and texts: nulls, empty, blanks, no letter, one word, ties, repeated rows, a very long text
ODD_ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "123 ###"), (5, "Alpha"), (6, "Alpha"), (6, "Alpha"), (7, LONG), (None, "no id here"),
    (None, None), (8, "one two three four five six\nseven eight nine ten eleven"), (9, "ün ïcode 日本 𝒳 text ▁ mark"),
]


def odd_documents(spark):
    """The odd rows, with extra columns named like those that operators return."""
    names = ["key", "score", "ids", "shard", "size", "length", "own", "next", "node", "group", "row", "h1", "bands", "r", "n", "range"]
    df = spark.createDataFrame(ODD_ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    return df.selectExpr("*", *[f"'x' AS `{n}`" for n in names])


def no_documents(spark):
    return odd_documents(spark).limit(0)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
