"""Node table and location paths."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import selectors as S
from ..functions.register import register
from ..operators import dom, induce
from ..operators import extract as E
from ..operators import xpath as XP
from ..session import scratch_path
from .registry import AD, DOMAIN, FOOTER, H1, LINKS, PARAGRAPHS, SITE, decoded, pages, query, tidied


def _counted(nodes):
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def _selected(spark, folder, xpath):
    """Nodes a path selects, tokenising only what the path can reach."""
    locations = XP.read_alternatives(xpath)
    tags, text_tags, attrs = XP.needs(locations)
    far = any(s.far_tests for loc in locations for s in loc.steps)
    columns = dom.NODE_COLUMNS if far else ("pre", "kind", "tag", "attrs", "text", "path")
    nodes = dom.dom_nodes(
        pages(spark, folder), elements=tags, texts_in=text_tags, path_attrs=attrs, columns=columns
    )
    return XP.select_nodes(nodes, xpath)


@query("SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages")
def stored_pages(spark, folder):
    """S1"""
    return pages(spark, folder).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query(r"""SELECT page_id, tag, count(*)::BIGINT AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) t GROUP BY ALL""")
def element_tag_counts(spark, folder):
    """D1"""
    nodes = dom.dom_nodes(pages(spark, folder), texts_in=set(), path_attrs=(), columns=("tag",))
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT page_id, {decoded("regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*)', 1, 's'), '<!--[^>]*-->', '', 'g'), '<[^>]*>', '', 'g')")} AS body_text
  FROM pages""")
def body_text(spark, folder):
    """D1, D12"""
    nodes = dom.dom_nodes(
        pages(spark, folder), elements=set(), texts_in={"body"}, path_attrs=(), columns=("pre", "text")
    )
    return nodes.groupBy("page_id").agg(XP.ordered_text().alias("body_text"))


@query("""SELECT page_id, tag, CASE WHEN tag IN ('p', 'li') THEN n * (n + 1) // 2 ELSE n END AS rank_sum, 0::BIGINT AS n_wrong
  FROM (SELECT page_id, tag, count(*)::BIGINT AS n FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) t GROUP BY ALL) c""")
def sibling_ranks(spark, folder):
    """`idx` of the tokeniser against ranks recomputed from the table."""
    nodes = dom.dom_nodes(
        pages(spark, folder), texts_in=set(), path_attrs=(), columns=("pre", "parent_pre", "kind", "tag", "idx")
    )
    return dom.sibling_rank(nodes).groupBy("page_id", "tag").agg(
        F.sum(F.col("idx").cast("long")).alias("rank_sum"),
        F.sum((F.col("idx") != F.col("rank")).cast("long")).alias("n_wrong"),
    )


@query(f"""WITH {LINKS} SELECT page_id, '/html[1]/body[1]/nav[1]/ul[1]/li[' || i || ']/a[1]' AS full_path, 6::BIGINT AS depth
  FROM links""")
def ancestor_chains(spark, folder):
    """D3, P9"""
    nodes = dom.dom_nodes(
        pages(spark, folder), elements={"a"}, texts_in=set(), columns=("pre", "kind", "path")
    )
    return nodes.select(
        "page_id", dom.full_path(F.col("path")).alias("full_path"),
        F.size(dom.ancestor_pres(F.col("path"))).cast("long").alias("depth"),
    )


@query(f"WITH {LINKS} SELECT page_id, count(*)::BIGINT AS n FROM links GROUP BY ALL")
def descendant_step(spark, folder):
    """D4"""
    return _counted(_selected(spark, folder, "//nav//a"))


@query(f"WITH {PARAGRAPHS} SELECT page_id, count(*)::BIGINT AS n FROM paragraphs GROUP BY ALL")
def child_step(spark, folder):
    """D5"""
    return _counted(_selected(spark, folder, "/html/body/article/p"))


@query(f"WITH {LINKS} SELECT page_id, raw AS link FROM links WHERE i = 2")
def nth_nav_link(spark, folder):
    """D6"""
    return _selected(spark, folder, "//nav//li[2]/a/text()").select("page_id", F.col("text").alias("link"))


@query(f"""WITH {PARAGRAPHS}, bold AS (
    SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY n) AS k FROM paragraphs WHERE body LIKE '<b>%')
  SELECT page_id, n::BIGINT AS paragraph FROM bold WHERE k = 2""")
def nth_of_filtered(spark, folder):
    """A position after another test counts only what passed it."""
    nodes = dom.dom_nodes(pages(spark, folder), elements={"p", "b"}, texts_in=set(), path_attrs=())
    return XP.select_nodes(nodes, "//article/p[.//b][2]").select("page_id", F.col("idx").cast("long").alias("paragraph"))


@query(f"""WITH {LINKS} SELECT page_id, 'article' AS tag, '' AS link FROM pages UNION ALL SELECT page_id, 'li', raw FROM links WHERE i = 2""")
def nth_of_any(spark, folder):
    """A position among children of any tag."""
    found = _selected(spark, folder, "//body/*[3] | //nav/ul/*[2]/a/text()")
    text = F.col("kind") == "text"
    return found.select("page_id", F.when(text, F.lit("li")).otherwise(F.col("tag")).alias("tag"), F.coalesce("text", F.lit("")).alias("link"))


@query(f"""WITH {LINKS} SELECT page_id, 'then' AS test FROM links WHERE i = 2 AND raw = 'and'
  UNION ALL SELECT page_id, 'before' FROM (SELECT page_id, count(*) AS n FROM links WHERE raw = 'the' GROUP BY page_id) t WHERE n >= 2
  UNION ALL SELECT page_id, 'class' FROM pages""")
def position_between_tests(spark, folder):
    """Tests count in the order they are written."""
    paths = {
        "then": '//nav/ul/li[.//a][2][.//a[text()="and"]]', "before": '//nav/ul/li[.//a[text()="the"]][2]',
        "class": '//body/*[contains(@class, "a")][1][@class="ad"]',
    }
    found = [_selected(spark, folder, p).select("page_id", F.lit(t).alias("test")) for t, p in paths.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"SELECT page_id, {FOOTER} AS inside FROM pages")
def deep_nesting(spark, folder):
    """What stands behind 600 open and closed elements is still inside the outer one."""
    opened = F.concat(F.lit('<div id="outer">'), F.repeat(F.lit("<div>"), 600), F.repeat(F.lit("</div>"), 600), F.lit("<footer>"))
    closed = F.lit("</footer></div><footer>outside</footer>")
    html = F.replace(F.replace(F.col("html"), F.lit("</footer>"), closed), F.lit("<footer>"), F.lit("<footer>"))
    first = F.concat(F.substring_index(html, "<footer>", 1), opened, F.substring(html, F.length(F.substring_index(html, "<footer>", 1)) + F.lit(9), F.length(html)))
    deep = pages(spark, folder).withColumn("html", first)
    return E.extract_fields(deep, '//div[@id="outer"]', {"inside": "//footer//text()"}, clean=False).select("page_id", "inside")


@query(f"SELECT page_id, {tidied(AD)} AS ad FROM pages")
def ad_block(spark, folder):
    """D7"""
    return E.extract_fields(pages(spark, folder), '//div[contains(@class, "a")]', {"ad": "//text()"}).select("page_id", "ad")


@query("""SELECT * FROM (SELECT page_id, len(regexp_extract_all(html, '<a href="/the">'))::BIGINT AS n FROM pages) t WHERE n > 0""")
def attribute_equality(spark, folder):
    """D8"""
    return _counted(_selected(spark, folder, '//a[@href="/the"]'))


@query(f"WITH {LINKS} SELECT page_id, i::BIGINT AS n, href FROM links")
def nav_hrefs(spark, folder):
    """D8"""
    links = _selected(spark, folder, "//nav//li/a").withColumn("href", F.element_at("attrs", "href"))
    order = W.partitionBy("page_id").orderBy("pre")
    return links.select("page_id", F.row_number().over(order).cast("long").alias("n"), "href")


@query(f"WITH {LINKS} SELECT page_id, count(*)::BIGINT AS n FROM links WHERE raw = 'the' GROUP BY ALL")
def text_equality(spark, folder):
    """D9"""
    return _counted(_selected(spark, folder, '//a[text()="the"]'))


@query(f"WITH {LINKS} SELECT page_id, count(*)::BIGINT AS n FROM links GROUP BY page_id HAVING bool_or(raw = 'the')")
def existence_test(spark, folder):
    """D10"""
    return _counted(_selected(spark, folder, '//nav/ul[.//li/a[text()="the"]]//li'))


@query(f"""SELECT page_id, 'h1' AS tag, {H1} AS text FROM pages UNION ALL SELECT page_id, 'footer', {FOOTER} FROM pages""")
def path_union(spark, folder):
    """D11"""
    found = _selected(spark, folder, "//h1//text() | //body/footer/text()")
    return found.select("page_id", dom.step_tag(F.element_at(dom.path_steps(F.col("path")), -1)).alias("tag"), "text")


@query(f"WITH {LINKS} SELECT page_id, string_agg(raw, '|' ORDER BY i) AS texts FROM links GROUP BY ALL")
def text_nodes(spark, folder):
    """D12"""
    found = _selected(spark, folder, "//nav//li//text()")
    return found.groupBy("page_id").agg(XP.ordered_text(glue="|").alias("texts"))


@query(f"""WITH {LINKS} SELECT page_id, '//html[1]//body[1]//nav[1]//ul[1]//li[' || i || ']' AS element_path,
  '//html[1]//body[1]//nav[1]//ul[1]//li[' || i || ']//text()' AS text_path FROM links""")
def generalised_paths(spark, folder):
    """P1, D13"""
    nodes = dom.dom_nodes(pages(spark, folder), elements={"li"}, texts_in=set(), columns=("path",))
    general = S.generalise(dom.full_path(F.col("path")))
    return nodes.select("page_id", general.alias("text_path")).withColumn(
        "element_path", XP.strip_text_step(F.col("text_path"))
    )


@query(f"SELECT page_id, h1 AS heading FROM (SELECT page_id, {H1} AS h1 FROM pages) t WHERE contains(h1, 'th')")
def element_lookup(spark, folder):
    """Elements that hold a text."""
    nodes = dom.dom_nodes(pages(spark, folder), elements={"h1"}, texts_in={"h1"}, path_attrs=())
    return XP.select_nodes(nodes, "//h1", text="th").select("page_id", F.col("string_value").alias("heading"))


@query(f"""WITH {PARAGRAPHS}, marked AS (
    SELECT page_id, n, CASE WHEN body LIKE '<b>%' THEN {tidied(decoded("regexp_extract(body, '^<b>([^<]*)', 1)"))} END AS lead,
           CASE WHEN contains(body, '<br>') THEN '' END AS line_break FROM paragraphs)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n)::BIGINT AS cell, lead, line_break
  FROM marked WHERE lead IS NOT NULL OR line_break IS NOT NULL""")
def cell_shells(spark, folder):
    """An empty cell is '', no cell is NULL."""
    cells = E.extract_fields(
        pages(spark, folder), "//article/p", {"lead": "//b//text()", "line_break": "//br//text()"}, shells=True
    )
    order = W.partitionBy("page_id").orderBy("container_pre")
    return cells.select("page_id", F.row_number().over(order).cast("long").alias("cell"), "lead", "line_break")


@query(f"""WITH {LINKS}, {PARAGRAPHS} SELECT page_id, 'links' AS selector, count(*)::BIGINT AS n_matches FROM links GROUP BY ALL
  UNION ALL SELECT page_id, 'paragraphs', count(*) FROM paragraphs GROUP BY ALL
  UNION ALL SELECT page_id, 'edges', 2 FROM pages""")
def nav_link_counts(spark, folder):
    """D16"""
    nodes = dom.dom_nodes(
        pages(spark, folder), elements={"a", "p", "h1", "footer"}, texts_in=set(), path_attrs=(), columns=("kind", "path")
    )
    return XP.match_counts(nodes, {"links": "//nav//a", "paragraphs": "//article/p", "edges": "//h1 | //footer"})


@query("""SELECT page_id, count(*)::BIGINT AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<(p|h1|li|a|div)[ >]', 1)) FROM pages) t GROUP BY ALL""")
def clickable_elements(spark, folder):
    """P10: elements a user can pick an example from."""
    nodes = dom.dom_nodes(pages(spark, folder), texts_in=set(), path_attrs=(), columns=("tag", "attrs"))
    return _counted(nodes.filter(induce.is_clickable(F.col("tag"), F.try_element_at("attrs", F.lit("type")))))


@query(f"""WITH {LINKS} SELECT page_id, 'the' AS selector, count(*)::BIGINT AS n_matches FROM links WHERE raw = 'the' GROUP BY page_id
  UNION ALL SELECT page_id, 'all', count(*) FROM links GROUP BY page_id
  UNION ALL SELECT page_id, 'second', 1 FROM links WHERE i = 2""")
def tested_link_counts(spark, folder):
    """Counts of selectors that test other nodes, and of one that does not."""
    nodes = dom.dom_nodes(pages(spark, folder), elements={"li", "a", "ul"}, texts_in={"a"})
    return XP.match_counts(nodes, {"the": '//nav//a[text()="the"]', "all": "//nav//li", "second": "//nav/ul/*[2]"})


@query(f"""SELECT page_id, 'h1' AS tag, {H1} AS text FROM pages UNION ALL SELECT page_id, 'footer', {FOOTER} FROM pages""")
def tight_union(spark, folder):
    """Alternatives without blanks around the bar."""
    found = _selected(spark, folder, "//h1//text()|//body/footer/text()")
    return found.select("page_id", dom.step_tag(F.element_at(dom.path_steps(F.col("path")), -1)).alias("tag"), "text")


@query(f"WITH {LINKS} SELECT page_id, {tidied('raw')} AS link FROM links WHERE contains(href, 'e')")
def stored_node_table(spark, folder):
    """records out of a node table that another job wrote, by an attribute that it was not told of."""
    path = scratch_path(spark, "nodes")
    dom.dom_nodes(pages(spark, folder)).write.parquet(path)
    nodes = spark.read.parquet(path)
    return E.extract_fields(pages(spark, folder), "//nav//li", {"link": './/a[contains(@href, "e")]//text()'}, nodes=nodes).select("page_id", "link")


@query(f"""WITH {LINKS}, counts AS (SELECT page_id, count(*)::BIGINT AS n_links FROM links GROUP BY page_id)
  SELECT page_id, {DOMAIN} AS domain, {SITE} AS site, n_links FROM pages JOIN counts USING (page_id)""")
def sql_functions(spark, folder):
    """The table function and scalar functions from SQL."""
    register(spark)
    return spark.sql(
        """SELECT p.page_id, url_domain(first(p.url)) AS domain, registrable_domain(first(p.url)) AS site, count(*) AS n_links
           FROM {pages} p, LATERAL dom_nodes(p.html, 'a') n WHERE n.tag = 'a' GROUP BY p.page_id""",
        pages=pages(spark, folder),
    )
