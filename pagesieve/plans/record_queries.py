"""Records, previews, templates, page checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import selectors as S
from ..functions import urls as U
from ..operators import checks as C
from ..operators import extract as E
from ..operators import runs as R
from ..operators import templates as TP
from .registry import AD, DOMAIN, FOOTER, H1, LINKS, PARAGRAPHS, decoded, pages, query, tidied


def _links(spark, folder, **options):
    return E.extract(pages(spark, folder), {"link": "//html//body//nav//ul//li//a[1]"}, **options)


@query(f"WITH {LINKS} SELECT page_id, {tidied('raw')} AS link FROM links")
def nav_links(spark, folder):
    """D1, D4, E1-E6, E11"""
    return E.extract_fields(pages(spark, folder), "//nav//li", {"link": ".//a//text()"}).select("page_id", "link")


@query(f"SELECT page_id, {tidied(H1)} AS heading, {tidied(decoded('''regexp_extract(html, '<title>([^<]*)</title>', 1)'''))} AS title FROM pages")
def page_title_h1(spark, folder):
    """Two columns whose only common container is the page."""
    return E.extract(
        pages(spark, folder), {"heading": "//html//body//article//h1[1]", "title": "//html//head//title[1]"}
    ).select("page_id", "heading", "title")


@query(f"SELECT page_id, {tidied(FOOTER)} AS footer FROM pages")
def footer_text(spark, folder):
    """D4, T1"""
    return E.extract(pages(spark, folder), {"footer": "/html/body/footer"}).select("page_id", "footer")


@query(f"""WITH {PARAGRAPHS} SELECT page_id,
    {tidied(decoded("regexp_extract(body, '^<b>([^<]*)', 1)"))} AS lead,
    {tidied(decoded("regexp_replace(regexp_replace(body, '<br>', ''), '<[^>]*>', '', 'g')"))} AS content
  FROM paragraphs WHERE regexp_replace(body, '<[^>]*>', '', 'g') <> ''""")
def missing_field_fill(spark, folder):
    """Paragraphs without a lead get '', without any text no record."""
    fields = {"lead": "//b//text()", "content": "//text()"}
    return E.extract_fields(pages(spark, folder), "//article/p", fields).select("page_id", "lead", "content")


@query(f"""WITH {LINKS} SELECT page_id, {tidied("string_agg(raw, ' ' ORDER BY i)")} AS link FROM links WHERE i IN (1, 3) GROUP BY page_id""")
def joined_alternatives(spark, folder):
    """A column made of two paths; its text nodes are joined in document order."""
    columns = {"link": "//nav//ul//li[1]//a | //nav//ul//li[3]//a", "none": "//nav//ul//b"}
    return E.extract(pages(spark, folder), columns).select("page_id", "link")


@query(f"""WITH {LINKS} SELECT page_id, {tidied('raw')} AS link, i::BIGINT AS n FROM links WHERE i <= 5""")
def preview_nav(spark, folder):
    """E8"""
    return E.preview(_links(spark, folder)).select("page_id", "link", F.col("row").cast("long").alias("n"))


@query(f"""WITH {LINKS} SELECT page_id, {tidied('raw')} AS link, CASE WHEN i = 1 THEN 'example' ELSE '' END AS price, i::BIGINT AS n
  FROM links WHERE i <= 5""")
def preview_with_examples(spark, folder):
    """E9"""
    records = E.extract_fields(pages(spark, folder), "//nav//li", {"link": "//a//text()", "price": "//span//text()"})
    shown = E.preview_fallback(E.preview(records), {"link": "x", "price": "example"})
    return shown.select("page_id", "link", "price", F.col("row").cast("long").alias("n"))


@query(f"""WITH {PARAGRAPHS} SELECT page_id, 'lead' AS title, count(*)::BIGINT AS n_missing FROM paragraphs
  WHERE body NOT LIKE '<b>%' AND regexp_replace(body, '<[^>]*>', '', 'g') <> '' GROUP BY page_id""")
def incomplete_pages(spark, folder):
    """E10"""
    fields = {"lead": "//b//text()", "content": "//text()"}
    records = E.extract_fields(pages(spark, folder), "//article/p", fields, clean=False)
    return E.missing_by_page(records, ["lead", "content"])


@query(f"""WITH {LINKS} SELECT p.page_id, coalesce(n, 0)::BIGINT AS n_rows, coalesce(n, 0) > 0 AS grew,
    CASE WHEN coalesce(n, 0) > 0 THEN 3 ELSE 4 END::BIGINT AS status, CASE WHEN coalesce(n, 0) > 0 THEN 3 ELSE 7 END::BIGINT AS cancelled
  FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM links WHERE raw = 'the' GROUP BY page_id) l USING (page_id)""")
def result_status(spark, folder):
    """Pages that add no row end in an error."""
    source = pages(spark, folder)
    records = E.extract_fields(source, '//nav//li//a[@href="/the"]', {"link": "//text()"}, clean=False)
    grown = C.page_growth(source, records)
    return grown.select(
        "page_id", "n_rows", "grew", R.result_status(F.col("n_rows")).cast("long").alias("status"),
        R.cancel_status(F.col("n_rows")).cast("long").alias("cancelled"),
    )


@query(f"""WITH {LINKS} SELECT page_id, 'first' AS run, {tidied('raw')} AS link FROM links
  UNION ALL SELECT page_id, 'second', {tidied(FOOTER)} FROM pages""")
def concatenated_runs(spark, folder):
    """E7"""
    first = _links(spark, folder).select("page_id", F.lit("first").alias("run"), "link")
    second = E.extract(pages(spark, folder), {"link": "//footer"}).select("link", F.lit("second").alias("run"), "page_id")
    return E.concat_runs(first, second)


def domain_templates(source):
    """One saved template per domain of the pages; the ad has a title, the footer only a position."""
    none = F.lit(None)
    columns = F.array(
        E._column(F.lit('//html//body//div[1][contains(@class, "ad")]'), F.lit(1), none, none, F.lit("ad")),
        E._column(F.lit("//html//body//footer[1]"), F.lit(2), none, none, none),
    )
    return source.groupBy(U.domain(F.col("url")).alias("id")).agg(F.min("url").alias("url")).select(
        "id", "url", none.cast("string").alias("pagination_xpath"), columns.alias("columns")
    )


@query(f"SELECT page_id, {DOMAIN} AS template_id, {tidied(AD)} AS ad, {tidied(FOOTER)} AS footer FROM pages")
def template_by_domain(spark, folder):
    """E13, U1"""
    source = pages(spark, folder)
    records = TP.extract_by_template(source, domain_templates(source))
    return records.select(
        "page_id", "template_id", F.col("record")["ad"].alias("ad"), F.col("record")["2"].alias("footer")
    )


@query(f"""WITH {LINKS}, sited AS (SELECT page_id, {DOMAIN} AS domain, raw, i, bool_or(raw = 'the') OVER (PARTITION BY page_id) AS holds FROM links JOIN pages USING (page_id))
  SELECT page_id, domain || ':text' AS template_id, {tidied('raw')} AS link FROM sited WHERE raw = 'the'
  UNION ALL SELECT page_id, domain || ':exists', {tidied('raw')} FROM sited WHERE holds
  UNION ALL SELECT DISTINCT page_id, domain || ':rank', 'the' FROM sited WHERE raw = 'the'""")
def template_tests(spark, folder):
    """E13 with D6, D9, D10: templates of every domain whose paths test other nodes, in one pass."""
    source = pages(spark, folder)
    paths = {"text": '//nav//li//a[text()="the"]', "exists": '//nav//ul[.//li/a[text()="the"]]//li//a', "rank": '//nav//ul//li[.//a[text()="the"]][1]//a'}
    none = F.lit(None)
    kinds = F.explode(F.create_map(*[F.lit(x) for pair in paths.items() for x in pair])).alias("kind", "xpath")
    sites = source.groupBy(U.domain(F.col("url")).alias("domain")).agg(F.min("url").alias("url")).select("domain", "url", kinds)
    templates = sites.select(
        F.concat_ws(":", "domain", "kind").alias("id"), "url", none.cast("string").alias("pagination_xpath"),
        F.array(E._column(F.col("xpath"), F.lit(1), none, none, F.lit("link"))).alias("columns"),
    )
    records = TP.extract_by_template(source, templates)
    return records.select("page_id", "template_id", F.col("record")["link"].alias("link"))


@query(f"""SELECT {DOMAIN} AS id, '3' AS n_columns, 'ad | foot | 3' AS titles,
    '//html//body//div[1][contains(@class, "ad")] | //html//body//footer[1]' AS combined, '//html//body//footer[1]' AS left_over
  FROM pages GROUP BY {DOMAIN}""")
def template_edits(spark, folder):
    """E14, E15, S12"""
    edited = domain_templates(pages(spark, folder)).withColumn(
        "more", E.add_column(E.rename_column(F.col("columns"), F.lit(2), F.lit("foot")), F.lit("//h1"))
    )
    return edited.select(
        "id", F.size("more").cast("string").alias("n_columns"),
        F.array_join(S.column_titles(F.col("more")), " | ").alias("titles"),
        F.array_join(S.column_data(E.combine_columns(F.col("columns"), F.lit(1), F.lit(2)), "xpath"), " ; ").alias("combined"),
        F.array_join(S.column_data(E.remove_column(F.col("columns"), F.lit(1)), "xpath"), " ; ").alias("left_over"),
    )


@query(f"""WITH {LINKS} SELECT page_id, {tidied('raw')} AS item FROM links""")
def combined_column_records(spark, folder):
    """Two columns of one list, combined, give the whole list."""
    first, second = "//html//body//nav//ul//li[1]//a[1]", "//html//body//nav//ul//li[2]//a[1]"
    merged = spark.range(1).select(S.merge_selectors(F.lit(first), F.lit(second)).alias("x")).first()["x"]
    return E.extract(pages(spark, folder), {"item": merged}).select("page_id", "item")


# --- checks ---------------------------------------------------------------------------------------


@query(f"""WITH {LINKS} SELECT page_id, 'link' AS title FROM pages
    WHERE page_id NOT IN (SELECT page_id FROM links WHERE contains(raw, 'the'))
  UNION ALL SELECT page_id, 'footer' FROM pages WHERE NOT contains({FOOTER}, 'example.net')""")
def example_failures(spark, folder):
    """Q1"""
    return C.example_failures(
        pages(spark, folder), {"link": ("//nav//li//a[1]", " the "), "footer": ("//body//footer[1]", "example.net")}
    )


@query(f"""WITH {LINKS} SELECT page_id, 'tested' AS title FROM pages WHERE page_id NOT IN (SELECT page_id FROM links WHERE raw = 'the')
  UNION ALL SELECT page_id, 'plain' FROM pages WHERE NOT contains({FOOTER}, 'example.net')""")
def example_failures_by_tests(spark, folder):
    """Q1: a path that tests other nodes next to a plain one."""
    return C.example_failures(
        pages(spark, folder), {"tested": ('//nav/ul/li[.//a[text()="the"]]', "the"), "plain": ("//body//footer[1]", "example.net")}
    )


@query(f"""WITH {LINKS}, sited AS (SELECT page_id, {DOMAIN} AS domain, {FOOTER} AS footer, {AD} AS ad FROM pages),
  firsts AS (SELECT domain, min_by(footer, page_id) AS footer, min_by(ad, page_id) AS ad FROM sited GROUP BY domain),
  holds AS (SELECT page_id, bool_or(raw = 'the') AS tested FROM links GROUP BY page_id)
  SELECT s.domain AS template_id, page_id, 'link' AS title FROM sited s LEFT JOIN holds h USING (page_id) WHERE NOT coalesce(tested, false)
  UNION ALL SELECT s.domain, page_id, '2' FROM sited s JOIN firsts f ON f.domain = s.domain WHERE NOT contains(s.footer, trim(f.footer))
  UNION ALL SELECT s.domain, page_id, 'either' FROM sited s JOIN firsts f ON f.domain = s.domain
    WHERE NOT contains(s.ad, trim(f.ad)) AND NOT contains(s.footer, trim(f.ad))""")
def example_failures_by_template(spark, folder):
    """The examples stored with a template of every domain, on all its pages; the last column has none."""
    source = pages(spark, folder)

    def within(tag, end):
        return F.min_by(F.regexp_extract("html", f"<{tag}>([^<]*)</{end}>", 1), "page_id")

    one, none = F.lit(1), F.lit(None)
    sites = source.groupBy(U.domain(F.col("url")).alias("id")).agg(
        F.min("url").alias("url"), within("footer", "footer").alias("footer"), within('div class="ad"', "div").alias("ad")
    )
    columns = F.array(
        E._column(F.lit('//nav//ul//li[.//a[text()="the"]]'), one, F.lit(" the\n"), none, F.lit("link")),
        E._column(F.lit("//html//body//footer[1]"), F.lit(2), F.col("footer"), none, none),
        E._column(F.lit('//div[contains(@class, "ad")] | //footer'), one, F.col("ad"), none, F.lit("either")),
        E._column(F.lit("//article//h1"), one, F.lit(" "), none, F.lit("unchecked")),
    )
    return C.example_failures_by_template(source, sites.select("id", "url", none.cast("string").alias("pagination_xpath"), columns.alias("columns")))


@query(f"""WITH {LINKS}, lists AS (
    SELECT page_id, list({tidied('raw')} ORDER BY i) AS texts FROM links GROUP BY page_id),
  asked AS (SELECT *, texts[1] || coalesce(texts[2], '') AS wanted, range(0, len(texts), 2) AS starts FROM lists)
  SELECT page_id, array_to_string(CASE WHEN list_contains(texts, wanted) THEN texts
    ELSE list_transform(starts, lambda s: array_to_string(texts[s + 1:s + 2], '')) END, '|') AS found FROM asked""")
def regrouped_examples(spark, folder):
    """An example that the page splits over its first two elements, or holds in its only one."""
    fragments = C.page_fragments(pages(spark, folder), "//nav//li//a")
    asked = fragments.withColumn("text", F.concat(F.col("fragments")[0], F.coalesce(F.get("fragments", F.lit(1)), F.lit(""))))
    return C.regroup_check(asked).select("page_id", F.array_join("found", "|").alias("found"))


def _guarded_pages(spark, folder):
    """Pages with a login form or a challenge frame put in, depending on their language."""
    login = '<form><input type="email"><input type="password"></form><footer>'
    frame = '<iframe title="reCAPTCHA"></iframe><footer>'
    html = F.col("html")
    return pages(spark, folder).withColumn(
        "html",
        F.when(F.contains(html, F.lit('<html lang="fr">')), F.replace(html, F.lit("<footer>"), F.lit(login)))
        .when(F.contains(html, F.lit('<html lang="de">')), F.replace(html, F.lit("<footer>"), F.lit(frame)))
        .otherwise(html),
    )


@query("""SELECT page_id, html LIKE '%<html lang="de">%' AS is_challenge, html LIKE '%<html lang="fr">%' AS is_login FROM pages""")
def login_or_challenge_flags(spark, folder):
    """Q3, Q4"""
    return C.page_flags(_guarded_pages(spark, folder))


@query("""SELECT page_id, url FROM pages WHERE html NOT LIKE '%<html lang="de">%'""")
def pages_without_challenge(spark, folder):
    """Q3"""
    return C.without_challenges(_guarded_pages(spark, folder)).select("page_id", "url")
