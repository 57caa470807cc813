"""Stored templates applied in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import selectors as S
from ..functions import text as X
from ..functions import urls as U
from ..session import written
from . import rules
from . import xpath as XP
from .xpath import UnsupportedXPath


def _field(container: str, relative: str, field: int) -> dict:
    if XP.SLASH_IN_LITERAL.search(container) or XP.SLASH_IN_LITERAL.search(relative):
        raise UnsupportedXPath(f"'/' inside a literal: {container!r} {relative!r}")
    return rules.field_rules(XP.parse(container), XP.parse(relative), int(field))


def compile_templates(templates: DataFrame) -> DataFrame:
    """template_id, domain, titles, rules, tags, text_tags, attrs, problem: the column paths of every template."""
    shaped = (
        templates.select(
            F.col("id").alias("template_id"),
            U.domain(F.col("url")).alias("domain"),
            S.column_titles(F.col("columns")).alias("titles"),
            S.column_data(F.col("columns"), "xpath").alias("xpaths"),
        )
        .withColumn("container", S.common_container(S.all_alternatives(F.col("xpaths"))))
        .withColumn("suffixes", S.field_suffixes(F.col("container"), F.col("xpaths")))
        .select("template_id", "domain", "titles", "container", F.posexplode("suffixes").alias("field", "union"))
        .withColumn("path", F.explode(S.alternatives(F.col("union"))))
        .withColumn("r", rules.compiled(_field, F.col("container"), F.col("path"), F.col("field")))
    )
    return rules.gathered(shaped, "domain", "titles")


def extract_by_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Every page of a domain through every template of that domain, in one pass.

    A template with a path that is not supported here raises, with its id and the reason: none is left out.

    Rows (template_id, page_id, container_pre, record MAP<title, text>). Rules that pass a size check
    are broadcast and a page is tokenised once for all its templates. Beyond that pages are joined
    with their templates first and the rules travel with the nodes. With tests on other nodes, the
    nodes that fit a rule are written, since votes and cells are read from them.
    """
    plan = rules.Plan(compile_templates(templates))
    found = plan.matched(pages, ("titles",))
    if plan.gated:
        found = written(found, "matched-nodes")
    cells = found.filter(F.col("rule.kind") == "cell").withColumn("container_pre", F.explode(rules.above(F.col("path"), F.col("rule.split"))))
    if plan.gated:
        cells = rules.behind_gates(cells, plan.passing(found))
    entries = F.array_sort(F.array_distinct(F.collect_list(F.struct("rule.field", "pre", "text"))))
    grouped = cells.groupBy("template_id", "page_id", "container_pre").agg(F.first("titles").alias("titles"), entries.alias("entries"))
    values = F.transform(
        F.sequence(F.lit(0), F.size("titles") - 1),
        lambda i: F.array_join(F.transform(F.filter(F.col("entries"), lambda e: e["field"] == i), lambda e: e["text"]), " "),
    )
    return grouped.withColumn("__v", values).select(
        "template_id", "page_id", "container_pre", F.map_from_arrays("titles", X.clean_list(F.col("__v"))).alias("record")
    )
