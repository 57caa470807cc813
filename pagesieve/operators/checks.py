"""Page checks (Q1-Q5)."""

from __future__ import annotations

import html
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import selectors as S
from ..functions import text as X
from ..functions import urls as U
from ..session import written
from . import dom, rules
from . import xpath as XP
from .joins import lookup_join


def example_failures(pages: DataFrame, examples: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Q1: (page_id, title) for which no selected element contains the example text, both as they are shown.

    `examples` maps titles to (path, example text). Paths without tests on other nodes share one pass;
    each of the rest takes one of its own.
    """
    locations = {t: XP.read_alternatives(path) for t, (path, _) in examples.items()}
    far = {t for t, locs in locations.items() if any(s.far_tests for loc in locs for s in loc.steps)}
    near = {t: e for t, e in examples.items() if t not in far}
    found = [_shown_by_tests(pages, t, *examples[t]) for t in examples if t in far]
    if near:
        found.append(_shown(pages, near, {t: locations[t] for t in near}))
    expected = pages.select("page_id", F.explode(F.array(*map(F.lit, examples))).alias("title"))
    return expected.join(reduce(DataFrame.unionByName, found), ["page_id", "title"], "left_anti")


def _holds(value: Column, wanted: Column) -> Column:
    decoded = F.coalesce(X.html_unescape(F.when(F.contains(value, F.lit("&")), value)), value)
    return F.contains(X.collapse(decoded), wanted)


def _wanted(text: str) -> Column:
    return X.collapse(F.lit(html.unescape(text)))


def _shown_by_tests(pages: DataFrame, title: str, path: str, text: str) -> DataFrame:
    locations = XP.read_alternatives(path)
    if any(loc.text for loc in locations):
        raise XP.UnsupportedXPath(f"an example check selects elements, not texts: {path!r}")
    nodes = dom.dom_nodes(pages, path_attrs=XP.needs(locations)[2])
    values = XP.selected_texts(nodes, path).filter(_holds(F.col("string_value"), _wanted(text)))
    chosen = XP.select_nodes(nodes, path).select("page_id", "pre")
    return values.join(chosen, ["page_id", "pre"], "left_semi").select("page_id", F.lit(title).alias("title")).distinct()


def _shown(pages: DataFrame, examples: Mapping[str, tuple[str, str]], locations: dict) -> DataFrame:
    titles = list(examples)
    leaves = [loc for locs in locations.values() for loc in locs]
    _, _, attrs = XP.needs(leaves)
    below = {loc.steps[-1].tag for loc in leaves}
    nodes = dom.dom_nodes(pages, elements=set(), texts_in=below, path_attrs=attrs, columns=("pre", "text", "path"))
    path = F.col("path")
    owned, inside = [], []
    for i, title in enumerate(titles):
        hit = XP.any_of([path.rlike(XP.steps_regex(loc.steps, "descendant")) for loc in locations[title]])
        pres = XP.owners_of_any(path, locations[title])
        inside.append(hit)
        owned.append(XP._marked(F.when(hit, pres).otherwise(F.array().cast("array<int>")), i))
    values = (
        nodes.filter(XP.any_of(inside))
        .select("page_id", F.col("pre").alias("__at"), "text", F.explode(F.flatten(F.array(*owned))).alias("o"))
        .groupBy("page_id", F.col("o.vote").alias("n"), F.col("o.pre").alias("pre"))
        .agg(XP.ordered_text("text", "__at").alias("value"))
    )
    wanted = F.element_at(F.array(*[_wanted(text) for _, text in examples.values()]), F.col("n") + 1)
    return (
        values.filter(_holds(F.col("value"), wanted))
        .select("page_id", F.element_at(F.array(*map(F.lit, titles)), F.col("n") + 1).alias("title"))
        .distinct()
    )


def _example_rules(path: str, field: int) -> dict:
    """The rule of one path whose selected elements are to be read whole."""
    location = XP.parse(path)
    if location.text:
        raise XP.UnsupportedXPath(f"an example check selects elements, not texts: {path!r}")
    return rules.field_rules(location, XP.Location(()), int(field))


def example_failures_by_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Q1 of stored templates: (template_id, page_id, title) where no selected element contains the column's `first_text`.

    Every page of a template's domain is checked, all templates in one tokenising pass; a column whose
    example is null or blank is not checked. Texts are compared as they are shown. A path that is not
    supported raises, with the template's id. Groups hold the text of one element.
    """
    shown = F.col("c.first_text")
    shown = X.collapse(F.coalesce(X.html_unescape(F.when(F.contains(shown, F.lit("&")), shown)), shown))
    examples = (
        templates.withColumn("titles", S.column_titles(F.col("columns")))
        .select(F.col("id").alias("template_id"), U.domain(F.col("url")).alias("domain"), "titles", F.posexplode("columns").alias("field", "c"))
        .select("template_id", "domain", "field", F.get("titles", F.col("field")).alias("title"), F.col("c.xpath").alias("xpath"), shown.alias("wanted"))
        .filter(F.trim("wanted") != "")
    )
    examples = written(examples, "template-examples")
    paths = examples.withColumn("path", F.explode(S.alternatives(F.col("xpath"))))
    plan = rules.Plan(rules.gathered(paths.withColumn("r", rules.compiled(_example_rules, F.col("path"), F.col("field"))), "domain"))
    found = plan.matched(pages)
    if plan.gated:
        found = written(found, "matched-nodes")
    cells = found.filter(F.col("rule.kind") == "cell").withColumn("container_pre", F.explode(rules.above(F.col("path"), F.col("rule.split"))))
    if plan.gated:
        cells = rules.behind_gates(cells, plan.passing(found))
    # alternatives of a path may select one element twice
    texts = F.array_sort(F.array_distinct(F.collect_list(F.struct("pre", "text"))))
    values = cells.groupBy("template_id", "page_id", F.col("rule.field").alias("field"), "container_pre").agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), "").alias("value")
    )
    at = F.struct("template_id", "field").alias("at")
    held = lookup_join(values.select("page_id", "value", at), examples.select(at, "wanted"), "at", spread=F.xxhash64("page_id"), unique_right=True)
    held = held.filter(_holds(F.col("value"), F.col("wanted"))).select("at.*", "page_id").distinct()
    sited = pages.select("page_id", U.domain(F.col("url")).alias("domain"))
    expected = lookup_join(sited, examples.select("domain", "template_id", "field", "title"), "domain", spread=F.col("page_id"))
    return expected.join(held, ["template_id", "page_id", "field"], "left_anti").select("template_id", "page_id", "title")


def regroup_check(fragments: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """Q2: T5 over an array column `fragments`; NULL in `out` marks a page whose example is gone."""
    return fragments.withColumn(out, X.find_text(F.col("fragments"), F.col(text)))


def page_fragments(pages: DataFrame, xpath: str) -> DataFrame:
    """(page_id, fragments): cleaned texts of the selected elements, in document order."""
    nodes = dom.dom_nodes(pages, path_attrs=XP.needs(XP.read_alternatives(xpath))[2], columns=("pre", "kind", "text", "path"))
    values = XP.selected_texts(nodes, xpath).withColumn("value", X.clean_text(F.col("string_value")))
    ordered = F.array_sort(F.collect_list(F.struct("pre", "value")))
    return values.groupBy("page_id").agg(F.transform(ordered, lambda x: x["value"]).alias("fragments"))


def page_flags(pages: DataFrame) -> DataFrame:
    """Q3, Q4: (page_id, is_challenge, is_login) for every page."""
    nodes = dom.dom_nodes(
        pages, elements={"iframe", "input"}, texts_in=set(), path_attrs=(), columns=("tag", "attrs")
    )
    kind = F.lower(F.try_element_at("attrs", F.lit("type")))
    title = F.try_element_at("attrs", F.lit("title"))
    is_input = F.col("tag") == "input"
    signs = nodes.select(
        "page_id",
        ((F.col("tag") == "iframe") & (title == "reCAPTCHA")).alias("challenge"),
        (is_input & kind.isin("text", "email")).alias("name"),
        (is_input & (kind == "password")).alias("password"),
    )
    # pages without any such element have no node here: each page votes with three negatives
    silent = pages.select("page_id", *[F.lit(False).alias(c) for c in ("challenge", "name", "password")])
    none = F.lit(False)
    return (
        signs.unionByName(silent)
        .groupBy("page_id")
        .agg(
            F.coalesce(F.bool_or("challenge"), none).alias("is_challenge"),
            (F.coalesce(F.bool_or("name"), none) & F.coalesce(F.bool_or("password"), none)).alias("is_login"),
        )
    )


def without_challenges(pages: DataFrame) -> DataFrame:
    """Pages that are not challenge pages."""
    nodes = dom.dom_nodes(pages, elements={"iframe"}, texts_in=set(), path_attrs=(), columns=("attrs",))
    challenged = nodes.filter(F.try_element_at("attrs", F.lit("title")) == "reCAPTCHA").select("page_id").distinct()
    # one row per page on either side: nothing is hot, and what is kept is decided at run time
    return pages.join(challenged, "page_id", "left_anti")


def page_growth(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Q5: (page_id, n_rows, grew): a page counts only if it added rows to the output."""
    votes = records.select("page_id", F.lit(1).alias("n")).unionByName(pages.select("page_id", F.lit(0).alias("n")))
    return (
        votes.groupBy("page_id")
        .agg(F.sum("n").alias("n_rows"))
        .withColumn("grew", F.col("n_rows") > 0)
    )
