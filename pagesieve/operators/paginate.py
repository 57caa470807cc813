"""Following next-page links inside the page table."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import selectors as S
from ..functions import urls as U
from ..session import written
from . import dom, rules
from . import xpath as XP
from .joins import is_small_written, lookup_join


def address_key(url):
    """Addresses that name the same page: the fragment is not part of it."""
    return F.substring_index(url, "#", 1)


def next_links(pages: DataFrame, next_xpath: str) -> DataFrame:
    """(page_id, url, href): target of the first match of `next_xpath` on each page that has one.

    `url` is what the link is relative to: the page's address, or that of its first base element.
    """
    locations = XP.read_alternatives(next_xpath)
    tags, text_tags, attrs = XP.needs(locations)
    far = any(s.far_tests for loc in locations for s in loc.steps)
    nodes = dom.dom_nodes(
        pages, elements=tags | {"base"}, texts_in=text_tags, path_attrs=attrs, keep=("page_id", "url"),
        columns=dom.NODE_COLUMNS if far else ("pre", "kind", "tag", "path", "attrs"),
    )
    href = F.try_element_at("attrs", F.lit("href"))
    is_base = F.coalesce(F.col("tag") == "base", F.lit(False)) & href.isNotNull()
    found = XP.select_nodes(nodes, next_xpath)
    marked = found.select("page_id", "url", "pre", href.alias("href"), F.lit(False).alias("base"))
    marked = marked.unionByName(nodes.filter(is_base).select("page_id", "url", "pre", href.alias("href"), F.lit(True).alias("base")))

    def first(base: bool):
        return F.min_by("href", F.when(F.col("base") == F.lit(base), F.col("pre")))

    grouped = marked.groupBy("page_id").agg(
        F.first("url").alias("page_url"), first(True).alias("given"), first(False).alias("href"), F.bool_or(~F.col("base")).alias("linked"),
    )
    against = F.coalesce(U.resolve(F.col("given"), F.col("page_url")), F.col("page_url"))
    return grouped.filter(F.col("linked") & F.col("href").isNotNull()).select("page_id", against.alias("url"), "href")


def page_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, next_id): links whose target is in the page table; of pages with one address the first."""
    targets = pages.groupBy(address_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("next_id"))
    aimed = written(links.select("page_id", U.resolve(F.col("href"), F.col("url")).alias("key")), "links")
    return lookup_join(aimed, targets, "key", spread=F.col("page_id"), unique_right=True).select("page_id", "next_id")


def follow(seeds: DataFrame, edges: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(seed_id, page_seq, page_id): pages visited from each seed, the seed first.

    A chain ends at a page without link, at a page it has been to, or at `max_pages`, which `seeds` may also
    hold as a column (null: no limit). Chains grow by doubling: the pages of the first n steps and the jump
    over n steps give those of the first 2n, so the rounds follow the logarithm of the longest chain. Every
    round is written out.
    """
    limits = [F.lit(max_pages).cast("long")] + ([F.col("max_pages").cast("long")] if "max_pages" in seeds.columns else [])
    limit = F.coalesce(F.least(*limits) if len(limits) > 1 else limits[0], F.lit(1 << 62))
    jumps = written(edges, "jumps")
    start = seeds.select(F.col("page_id").alias("seed_id"), F.lit(1).cast("long").alias("page_seq"), "page_id", limit.alias("most"))
    visits = written(start, "visits")
    n, longest = visits.agg(F.count(F.lit(1)), F.max("most")).first()
    steps = 1
    while steps < (longest or 0):
        small = is_small_written(jumps)
        ahead = lookup_join(visits, jumps, "page_id", spread=F.col("seed_id"), small=small, unique_right=True)
        ahead = ahead.select("seed_id", (F.col("page_seq") + steps).alias("page_seq"), F.col("next_id").alias("page_id"), "most")
        ahead = ahead.filter(F.col("page_seq") <= F.col("most"))
        # what comes up again lies on a circle and has been visited before
        all_visits = visits.unionByName(ahead).groupBy("seed_id", "page_id").agg(F.min("page_seq").alias("page_seq"), F.first("most").alias("most"))
        visits = written(all_visits.select("seed_id", "page_seq", "page_id", "most"), "visits")
        before, n = n, visits.count()
        steps *= 2
        if n == before or steps >= longest:
            break
        far = jumps.select("page_id", F.col("next_id").alias("mid"))
        over = jumps.select(F.col("page_id").alias("mid"), "next_id")
        jumps = written(lookup_join(far, over, "mid", spread=F.col("page_id"), small=small, unique_right=True).select("page_id", "next_id"), "jumps")
    return visits.select("seed_id", F.col("page_seq").cast("int").alias("page_seq"), "page_id")


def follow_lists(seeds: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(seed_id, page_seq, page_id) along `n` links one after the other, where `edges(entry, page_id, next_id)` has them.

    A page without the link of an entry stays where it is. An entry is a partial function of pages; those
    of neighbours are composed into one for both, level by level, and the positions are then told from
    the whole list down to its entries: rounds by the logarithm of n instead of n.
    """
    levels = ceil(log2(n)) if n > 1 else 0
    maps = [written(edges.select(F.col("entry").cast("long").alias("block"), "page_id", "next_id"), "entries")]
    small: list[bool] = []
    for _ in range(levels - 1):
        pairs = maps[-1].withColumn("left", F.col("block") % 2 == 0).withColumn("block", F.floor(F.col("block") / 2).cast("long"))
        over = pairs.filter(~F.col("left")).select(F.struct("block", F.col("page_id").alias("page")).alias("at"), F.col("next_id").alias("further"))
        small.append(is_small_written(maps[-1]))
        through = lookup_join(pairs.withColumn("at", F.when(F.col("left"), F.struct("block", F.col("next_id").alias("page")))), over, "at", "left", spread=F.xxhash64("page_id"), small=small[-1], unique_right=True)
        # where the first of two says nothing, the second does alone
        both = through.groupBy("block", "page_id").agg(F.max_by(F.coalesce("further", "next_id"), "left").alias("next_id"))
        maps.append(written(both, "composed"))
    small.append(is_small_written(maps[-1]))
    here = seeds.select(F.col("page_id").alias("seed_id"), F.lit(0).cast("long").alias("block"), "page_id")
    for level in range(levels - 1, -1, -1):
        step = maps[level].select(F.struct("block", F.col("page_id").alias("page")).alias("at"), "next_id")
        first = here.withColumn("block", F.col("block") * 2)
        met = lookup_join(first.withColumn("at", F.struct("block", F.col("page_id").alias("page"))), step, "at", "left", spread=F.xxhash64("seed_id"), small=small[level], unique_right=True)
        ends = F.array(F.struct("block", "page_id"), F.struct((F.col("block") + 1).alias("block"), F.coalesce("next_id", "page_id").alias("page_id")))
        split = met.select("seed_id", F.explode(ends).alias("e")).select("seed_id", "e.block", "e.page_id")
        here = written(split.filter(F.col("block") * (1 << level) < n), "positions")
    step = maps[0].select(F.struct("block", F.col("page_id").alias("page")).alias("at"), "next_id")
    gone = lookup_join(here.withColumn("at", F.struct("block", F.col("page_id").alias("page"))), step, "at", "inner", spread=F.xxhash64("seed_id"), small=small[0], unique_right=True)
    moves = gone.select("seed_id", F.col("block").alias("entry"), F.col("next_id").alias("page_id"))
    starts = seeds.select(F.col("page_id").alias("seed_id"), F.lit(-1).cast("long").alias("entry"), "page_id")
    # at most n + 1 rows to a seed
    order = W.partitionBy("seed_id").orderBy("entry")
    return moves.unionByName(starts).select("seed_id", F.row_number().over(order).alias("page_seq"), "page_id")


def page_chain(
    pages: DataFrame, seeds: DataFrame, pagination: str | None, max_pages: int | None = None
) -> DataFrame:
    """Visits of a paginated run.

    `pagination` is a path, a newline-separated list of paths, or empty / `fake` for one page.
    `max_pages` None or 0 means unlimited; a list sets its own budget of one page more than paths.
    """
    paths = [p.strip() for p in (pagination or "").split("\n") if p.strip()]
    if not paths or paths == ["fake"] or max_pages == 1 and len(paths) == 1:
        return seeds.select(F.col("page_id").alias("seed_id"), F.lit(1).alias("page_seq"), "page_id")
    if len(paths) > 1:
        one = pages.sparkSession.createDataFrame([("", "", "\n".join(paths))], "id string, url string, pagination_xpath string")
        return follow_lists(seeds, template_edges(pages, one, F.lit("")), len(paths))
    return follow(seeds, page_edges(pages, next_links(pages, paths[0])), max_pages or None)


# --- the pagination of stored templates ----------------------------------------------------------


def _link(path: str, entry: int) -> dict:
    return rules.link_rules(XP.parse(path), int(entry))


def compile_pagination(templates: DataFrame) -> DataFrame:
    """template_id, domain, n_entries, rules, tags, text_tags, attrs, problem of templates with a pagination path.

    Blank lines of a list do not count. Without a path, or with `fake`, a template has no row: it is one page.
    """
    lines = F.filter(F.split(F.coalesce("pagination_xpath", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    listed = templates.select(F.col("id").alias("template_id"), U.domain(F.col("url")).alias("domain"), lines.alias("paths"))
    shaped = (
        listed.filter((F.size("paths") > 0) & ~((F.size("paths") == 1) & (F.trim(F.col("paths")[0]) == "fake")))
        .select("template_id", "domain", F.size("paths").alias("n_entries"), F.posexplode("paths").alias("entry", "union"))
        .withColumn("path", F.explode(S.alternatives(F.trim("union"))))
        .withColumn("r", rules.compiled(_link, F.col("path"), F.col("entry")))
    )
    return rules.gathered(shaped, "domain", "n_entries")


def _href(attrs: Column) -> Column:
    return F.try_element_at(attrs, F.lit("href"))


def template_edges(pages: DataFrame, templates: DataFrame, domain: Column | None = None) -> DataFrame:
    """(template_id, n_entries, entry, page_id, next_id): where each pagination path of a template leads, of all templates in one pass.

    A page's link is the first element that the path selects; it counts if its target is in the page table, of pages
    with one address the first. `domain` is what pages have in common with the templates' domain, if not their own.
    """
    bases = F.array(F.from_json(F.lit('{"kind": "base", "on_text": false, "full": "\\\\x1ebase\\\\[\\\\d+\\\\]@\\\\d+[^\\\\x1e]*\\\\z"}'), rules.RULE))
    compiled = compile_pagination(templates)
    plan = rules.Plan(compiled.withColumn("rules", F.concat("rules", bases)).withColumn("tags", F.array_append("tags", F.lit("base"))))
    found = written(plan.matched(pages, ("n_entries",), domain), "matched-nodes")
    chosen = plan.passing(found).filter(F.col("own.entry").isNotNull())
    links = chosen.groupBy("template_id", "page_id", F.col("own.entry").alias("entry")).agg(F.min_by(_href(F.col("own.attrs")), "pre").alias("href"))
    based = found.filter((F.col("rule.kind") == "base") & _href(F.col("attrs")).isNotNull()).groupBy("template_id", "page_id").agg(F.min_by(_href(F.col("attrs")), "pre").alias("given"))
    sizes = plan.table.select("template_id", "n_entries")
    addressed = links.filter(F.col("href").isNotNull()).join(based, ["template_id", "page_id"], "left").join(sizes, "template_id")
    placed = lookup_join(addressed, pages.select("page_id", "url"), "page_id", spread=F.col("template_id"), probe_left=False, unique_right=True)
    # a column of its own: the address is read at many places of the next expression
    against = placed.withColumn("against", F.when(F.col("given").isNull(), F.col("url")).otherwise(U.resolve(F.col("given"), F.col("url"))))
    aimed = written(against.select("template_id", "n_entries", "entry", "page_id", U.resolve(F.col("href"), F.col("against")).alias("key")), "links")
    targets = pages.groupBy(address_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("next_id"))
    return lookup_join(aimed, targets, "key", spread=F.col("page_id"), unique_right=True).drop("key")


def template_visits(pages: DataFrame, templates: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """(template_id, page_seq, page_id): the pages that a run of every template visits, from the template's own address on.

    One path is followed until a page has no such link, the chain comes to a page it has been to, or the
    template's `max_pages` in `budgets(template_id, max_pages)` is reached (0 or none: no limit). A list of paths
    is followed one after the other, a missing link is skipped. A template without pagination is its start page.
    The chains of all templates grow together, in rounds by the logarithm of the longest.
    """
    starts = templates.select(F.col("id").alias("template_id"), address_key(F.col("url")).alias("key"))
    addresses = pages.groupBy(address_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"))
    seeds = lookup_join(starts, addresses, "key", spread=F.col("template_id"), unique_right=True).select("template_id", "page_id")
    edges = written(template_edges(pages, templates), "template-edges")
    limit = F.lit(None).cast("long")
    if budgets is not None:
        limit = F.nullif(F.col("max_pages").cast("long"), F.lit(0))
        seeds = seeds.join(budgets.select("template_id", "max_pages"), "template_id", "left")
    kinds = compile_kinds(templates)
    seeds = written(seeds.withColumn("most", limit).join(kinds, "template_id").select("template_id", "page_id", "most", "n_entries"), "seeds")

    # a vertex is a page in the run of one template
    def vertex(page: str) -> Column:
        return F.struct("template_id", F.col(page).alias("page"))

    single = edges.filter(F.col("n_entries") == 1).select(vertex("page_id").alias("page_id"), vertex("next_id").alias("next_id"))
    chains = follow(seeds.filter("n_entries <= 1").select(vertex("page_id").alias("page_id"), F.when(F.col("n_entries") == 0, F.lit(1)).otherwise(F.col("most")).alias("max_pages")), single)
    several = edges.filter(F.col("n_entries") > 1).select("entry", vertex("page_id").alias("page_id"), vertex("next_id").alias("next_id"))
    most = seeds.agg(F.max("n_entries")).first()[0] or 0
    if most > 1:
        lists = follow_lists(seeds.filter("n_entries > 1").select(vertex("page_id").alias("page_id")), several, most)
        chains = chains.unionByName(lists)
    return chains.select("page_id.template_id", "page_seq", F.col("page_id.page").alias("page_id"))


def compile_kinds(templates: DataFrame) -> DataFrame:
    """(template_id, n_entries): 0 without pagination, 1 with one path, else the length of the list."""
    lines = F.filter(F.split(F.coalesce("pagination_xpath", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    one_page = (F.size(lines) == 1) & (F.trim(F.get(lines, F.lit(0))) == "fake")
    return templates.select(F.col("id").alias("template_id"), F.when(one_page, 0).otherwise(F.size(lines)).alias("n_entries"))
