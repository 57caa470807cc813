"""Text and address functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from .registry import DOMAIN, HOST, SITE, documents, pages, query, table, tidied


@query(f"SELECT doc_id, {tidied('text')} AS cleaned FROM documents")
def clean_text_documents(spark, folder):
    """T1"""
    return documents(spark, folder).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query(f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {tidied('x')}), '|') AS cleaned FROM documents""")
def clean_lines(spark, folder):
    """T2"""
    lines = X.clean_list(F.split("text", "\n"))
    return documents(spark, folder).select("doc_id", F.array_join(lines, "|").alias("cleaned"))


_WORDS = """asked AS (
    SELECT doc_id, words, coalesce(words[3], words[1]) || coalesce(words[4], '') AS wanted
    FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents) t),
  firsts AS (SELECT *, list_position(list_transform(words, lambda w: starts_with(wanted, w)), true) - 1 AS first FROM asked),
  runs AS (SELECT *, list_position(list_transform(range(1, least(len(words) - first, length(wanted)) + 1),
    lambda k: array_to_string(words[first + 1:first + k], '') = wanted), true) AS k FROM firsts)"""


@query(f"""WITH {_WORDS} SELECT doc_id, first::BIGINT AS first,
    CASE WHEN list_contains(words, wanted) THEN array_to_string(words, '|')
         WHEN len(words) > 1 AND first >= 0 AND k > 0 THEN array_to_string(list_transform(range(0, len(words), k), lambda s: array_to_string(words[s + 1:s + k], '')), '|')
    END AS found FROM runs""")
def regroup_fragments(spark, folder):
    """Words of a document in chunks, so that one chunk is the wanted text: two words, or what a short one has."""
    words = documents(spark, folder).select("doc_id", F.split("text", " ").alias("words"))
    first = F.coalesce(F.get("words", F.lit(2)), F.get("words", F.lit(0)))
    asked = words.withColumn("wanted", F.concat(first, F.coalesce(F.get("words", F.lit(3)), F.lit(""))))
    return asked.select(
        "doc_id", X.first_fragment(F.col("words"), F.col("wanted")).cast("long").alias("first"),
        F.array_join(X.find_text(F.col("words"), F.col("wanted")), "|").alias("found"),
    )


@query("""SELECT o_orderkey, concat_ws(', ', o_orderstatus, o_orderpriority) AS titles,
  strftime(o_orderdate, '%d/%m/%Y') AS date, strftime(o_orderdate, '%H:%M:%S') AS time FROM orders""")
def run_date_text(spark, folder):
    """T6, T7"""
    orders = table(spark, folder, "orders")
    titles = F.array("o_orderstatus", "o_orderpriority")
    return orders.select(
        "o_orderkey", X.join_titles(titles).alias("titles"),
        X.date_text(F.col("o_orderdate")).alias("date"), X.time_text(F.col("o_orderdate")).alias("time"),
    )


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN floor(value)::BIGINT ELSE -1 END AS percent,
  CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 4 WHEN 'click' THEN 2 WHEN 'signup' THEN 6 ELSE 3 END::BIGINT AS code,
  CASE event_type WHEN 'view' THEN 'Running' WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Stopping...'
    WHEN 'signup' THEN 'Interacting...' ELSE 'Finished' END AS label FROM events""")
def status_text(spark, folder):
    """T8, T9"""
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", F.concat(F.floor("value").cast("string"), F.lit("%")))
        .when(kind == "error", F.lit("")).when(kind == "click", F.lit("2"))
        .when(kind == "signup", F.lit("6")).otherwise(F.lit("3"))
    )
    events = table(spark, folder, "events").select("event_id", status.alias("status"))
    coded = events.withColumn("code", X.status_code(F.col("status")))
    return coded.select(
        "event_id", F.coalesce(X.percent(F.col("status")), F.lit(-1)).cast("long").alias("percent"),
        F.col("code").cast("long").alias("code"), X.status_label(F.col("code")).alias("label"),
    )


@query(f"SELECT page_id, {DOMAIN} AS domain FROM pages")
def page_domain(spark, folder):
    """U1"""
    return pages(spark, folder).select("page_id", U.domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, {SITE} AS site FROM pages")
def registrable_domain(spark, folder):
    """U2"""
    return pages(spark, folder).select("page_id", U.registrable(F.col("url")).alias("site"))


@query(f"""SELECT page_id, CASE form WHEN 1 THEN url WHEN 2 THEN 'https://' || regexp_replace(url, '^https?://', '')
    ELSE 'https://www.google.com/search?q=page+' || page_id || '+' || {HOST} END AS address
  FROM pages, (VALUES (1), (2), (3)) f(form)""")
def normalise_address(spark, folder):
    """An address, one without scheme, and a search."""
    url = F.col("url")
    forms = F.array(
        url, F.regexp_replace(url, "^https?://", ""), F.concat_ws(" ", F.lit("page"), "page_id", U.authority(url))
    )
    typed = pages(spark, folder).select("page_id", F.explode(forms).alias("typed"))
    return typed.select("page_id", U.normalise_address(F.col("typed")).alias("address"))
