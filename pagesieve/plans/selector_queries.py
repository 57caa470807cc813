"""Selector functions and induction, on selectors that come out of the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import selectors as S
from ..operators import dom, induce
from ..operators import extract as E
from ..functions import text as X
from .registry import AD, H1, LINKS, PARAGRAPHS, decoded, pages, query, table

BLANKS = "chr(9) || chr(10) || chr(13) || chr(32) || chr(160)"


def _list_paths(spark, folder, path):
    """(page_id, paths): a path per nav item, in order."""
    nodes = dom.dom_nodes(pages(spark, folder), elements={"li"}, texts_in=set(), columns=("pre", "path"))
    ordered = F.array_sort(F.collect_list(F.struct("pre", path(F.col("path")).alias("x"))))
    return nodes.groupBy("page_id").agg(F.transform(ordered, lambda r: r["x"]).alias("paths"))


_PREFIX = "//html[1]//body[1]//nav[1]//ul[1]"


@query(f"""WITH {LINKS} SELECT page_id, '{_PREFIX}' || CASE WHEN count(*) = 1 THEN '//li[1]' ELSE '' END AS container,
  CASE WHEN count(*) = 1 THEN '//text()' ELSE string_agg('//li[' || i || ']//text()', ' ' ORDER BY i) END AS suffixes
  FROM links GROUP BY page_id""")
def selector_compile(spark, folder):
    """Container and relative paths of the items of each page."""
    general = _list_paths(spark, folder, lambda p: S.generalise(dom.full_path(p)))
    return general.withColumn("container", S.common_container(F.col("paths"))).select(
        "page_id", "container",
        F.array_join(S.suffixes(F.col("container"), F.col("paths")), " ").alias("suffixes"),
    )


@query(f"""WITH {LINKS} SELECT page_id, '//html[1]//body[1]' AS container,
  './/nav[1]//ul[1]//li[1]//text() | .//nav[1]//ul[1]//li[' || count(*) || ']//text()' AS first_field,
  './/footer[1]//text()' AS second_field FROM links GROUP BY page_id""")
def union_suffixes(spark, folder):
    """Fields made of alternatives."""
    items = _list_paths(spark, folder, dom.full_path)
    union = F.concat(F.element_at("paths", 1), F.lit(" | "), F.element_at("paths", -1))
    fields = items.withColumn("xpaths", F.array(union, F.lit("/html[1]/body[1]/footer[1]"))).withColumn(
        "container", S.common_container(S.all_alternatives(F.col("xpaths")))
    )
    relative = S.field_suffixes(F.col("container"), F.col("xpaths"))
    return fields.select("page_id", "container", relative.alias("r")).select(
        "page_id", "container",
        F.concat(F.lit("."), F.col("r")[0]).alias("first_field"), F.concat(F.lit("."), F.col("r")[1]).alias("second_field"),
    )


@query(f"""WITH {LINKS} SELECT page_id,
  CASE WHEN count(*) = 1 THEN '//html//body//nav//ul//li[1]' ELSE '//html//body//nav//ul//li' END AS merged,
  '//html//body//nav//ul//li[1] | //html//body//h1' AS unlike FROM links GROUP BY page_id""")
def combine_selectors(spark, folder):
    """P5"""
    items = _list_paths(spark, folder, induce.data_selector)
    return items.select(
        "page_id",
        S.merge_selectors(F.element_at("paths", 1), F.element_at("paths", -1)).alias("merged"),
        S.merge_selectors(F.element_at("paths", 1), F.lit("//html//body//h1")).alias("unlike"),
    )


def _examples(spark, folder):
    """First link and ad text of each page as they are shown: what a user would click."""
    shown = E.extract_fields(
        pages(spark, folder), "//body", {"link": "//nav//li[1]//text()", "ad": '//div[contains(@class, "ad")]//text()'}, clean=False,
    )
    listed = shown.select("page_id", F.expr("stack(2, 'link', link, 'ad', ad) AS (column_title, text)"))
    return listed.withColumn("text", X.collapse(F.col("text")))


def _shown(text):
    return rf"trim(regexp_replace({text}, '[\s' || chr(160) || ']+', ' ', 'g'))"


# where a heading, paragraph or bold text of the page equals the ad, it lies deeper and is the one clicked
_CLICKED = f"""ads AS (SELECT page_id, {_shown(AD)} AS ad, trim({AD}, {BLANKS}) AS cell FROM pages),
  texts AS (
    SELECT page_id, 0 AS n, 4 AS depth, {H1} AS text FROM pages
    UNION ALL SELECT page_id, n, CASE WHEN body LIKE '<b>%' THEN 5 ELSE 4 END,
      {decoded("regexp_replace(body, '<[^>]*>', '', 'g')")} FROM paragraphs),
  clicked AS (SELECT page_id, ad, coalesce(depth, 3) AS depth, n, coalesce(trim(text, {BLANKS}), cell) AS cell FROM (
    SELECT a.page_id, ad, cell, depth, n, t.text, row_number() OVER (PARTITION BY a.page_id ORDER BY depth DESC, n) AS rn
    FROM ads a LEFT JOIN texts t ON t.page_id = a.page_id AND {_shown('t.text')} = ad) r WHERE rn = 1)"""


@query(f"""WITH {LINKS}, {PARAGRAPHS}, {_CLICKED} SELECT page_id, 'link' AS column_title, {_shown('raw')} AS text,
  '//html//body//nav//ul//li//a[1]' AS xpath, '/html[1]/body[1]/nav[1]/ul[1]/li[1]/a[1]' AS full_path FROM links WHERE i = 1
  UNION ALL SELECT page_id, 'ad', ad,
    CASE WHEN depth = 3 THEN '//html//body//div[1][contains(@class, "ad")]' WHEN depth = 5 THEN '//html//body//article//p//b[1]'
      WHEN n = 0 THEN '//html//body//article//h1[1]' ELSE '//html//body//article//p[' || n || ']' END,
    CASE WHEN depth = 3 THEN '/html[1]/body[1]/div[contains(@class, "ad")]'
      ELSE '/html[1]/body[1]/article[1]/' || CASE WHEN n = 0 THEN 'h1[1]' ELSE 'p[' || n || ']' END || CASE WHEN depth = 5 THEN '/b[1]' ELSE '' END END
  FROM clicked""")
def induced_selectors(spark, folder):
    """Examples to selectors."""
    return induce.induce_selectors(pages(spark, folder), _examples(spark, folder)).drop("pre")


@query(f"""WITH {LINKS}, {PARAGRAPHS}, {_CLICKED} SELECT page_id, 'link' AS column_title, '/html/body/nav/ul/li/a[text()="' || trim(raw, {BLANKS}) || '"]' AS xpath
  FROM links WHERE i = 1
  UNION ALL SELECT page_id, 'ad', '/html/body/' || CASE WHEN depth = 3 THEN 'div' WHEN depth = 5 THEN 'article/p/b'
    WHEN n = 0 THEN 'article/h1' ELSE 'article/p' END || '[text()="' || cell || '"]' FROM clicked""")
def induced_next_selectors(spark, folder):
    """P8"""
    return induce.induce_next_selector(pages(spark, folder), _examples(spark, folder)).select("page_id", "column_title", "xpath")


@query(r"""SELECT p_partkey, CASE WHEN kept = '' THEN '' ELSE '[contains(@class, "' || kept || '")]' END AS test FROM (
  SELECT p_partkey, array_to_string(list_slice(words, 1, coalesce(list_position(
    list_transform(words, lambda w: regexp_matches(w, '[0-9]') OR w = 'selected'), true), len(words) + 1) - 1), ' ') AS kept
  FROM (SELECT p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ') AS words FROM part) t) u""")
def class_tests(spark, folder):
    """Words up to the first with a digit."""
    part = table(spark, folder, "part")
    return part.select("p_partkey", S.stable_classes(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("test"))


@query("""WITH typed AS (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT event_id, user_id, event_type FROM typed WHERE before IS NULL OR before <> event_type""")
def captured_examples(spark, folder):
    """P10: repeats of the previous text of a session are dropped; sessions are worked on day by day."""
    clicks = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    kept = induce.capture_examples(
        clicks, session="user_id", order=("ts", "event_id"), text="event_type", bucket=F.to_date("ts")
    )
    return kept.select("event_id", "user_id", "event_type")


@query("""WITH typed AS (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events)
  SELECT event_id, event_type FROM typed WHERE before IS NULL OR before <> event_type""")
def captured_in_one_session(spark, folder):
    """P10: all events of the site as one session, worked on in sampled ranges of time."""
    clicks = table(spark, folder, "events").select("event_id", "event_type", "ts", F.lit("site").alias("session"))
    return induce.capture_examples(clicks, order=("ts", "event_id"), text="event_type").select("event_id", "event_type")


@query(f"""WITH {LINKS}, ends AS (SELECT page_id, n, '//li[' || n || ']' AS last FROM links WHERE i = 1)
  SELECT page_id, CASE WHEN contains('//li[1]', last) THEN '//li[1]' ELSE '//li[1]' || chr(10) || last END AS selectors,
    (CASE WHEN contains('//li[1]', last) THEN page_id ELSE 3 END)::BIGINT AS budget FROM ends""")
def selector_lists(spark, folder):
    """A list of selectors sets its own page budget."""
    items = _list_paths(spark, folder, lambda p: F.concat(F.lit("//"), F.regexp_replace(F.substring_index(p, "\x1e", -1), "@.*", "")))
    lists = items.select(
        "page_id", S.add_selector(F.element_at("paths", 1), F.element_at("paths", -1)).alias("selectors")
    )
    return lists.withColumn("budget", S.page_budget(F.col("selectors"), F.col("page_id")).cast("long"))
