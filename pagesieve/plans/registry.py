"""Named queries over the given tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.pages import read_pages, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the name of its function."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(spark, f"{folder}/pages.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- pieces of SQL -------------------------------------------------------------------------------


def decoded(text: str) -> str:
    """The character references that the pages hold."""
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


def tidied(text: str) -> str:
    """clean_text on decoded text."""
    flat = f"replace(replace(replace({text}, chr(13), ''), chr(9), ''), chr(10), '')"
    flat = f"replace(replace({flat}, '  ', ' '), chr(160), ' ')"
    return f"(CASE WHEN {flat} = ' ' THEN ' ' ELSE trim({flat}) END)"


LINK = '<li><a href="([^"]*)">([^<]*)</a></li>'
LINK_TEXTS = f"regexp_extract_all(html, '{LINK}', 2)"
LINK_HREFS = f"regexp_extract_all(html, '{LINK}', 1)"
LINKS = f"""links AS (
  SELECT page_id, i, {decoded('texts[i]')} AS raw, hrefs[i] AS href, len(texts) AS n
  FROM (SELECT page_id, texts, hrefs, unnest(range(1, len(texts) + 1)) AS i
        FROM (SELECT page_id, {LINK_TEXTS} AS texts, {LINK_HREFS} AS hrefs FROM pages)))"""
H1 = decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")
FOOTER = decoded("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")
AD = decoded("""regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)""")
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
DOMAIN = f"regexp_replace({HOST}, '^www\\.', '')"
SITE = f"list_aggregate(string_split({HOST}, '.')[-2:], 'string_agg', '.')"
# content of each <p> of the article, in order: the part before the first one is dropped
PARAGRAPHS = """paragraphs AS (
  SELECT page_id, i AS n, parts[i + 1] AS body
  FROM (SELECT page_id, parts, unnest(range(1, len(parts))) AS i
        FROM (SELECT page_id, string_split(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p>') AS parts
              FROM pages)))"""
