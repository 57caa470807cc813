"""the functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.dom import NODE_COLUMNS, SPARK_FIELDS, page_rows
from .text import html_unescape
from .urls import SEARCH_PREFIX

_NODE_DDL = ", ".join(f"{name} {SPARK_FIELDS[name].simpleString()}" for name in NODE_COLUMNS)


@F.udtf(returnType=_NODE_DDL, useArrow=True)
class DomNodes:
    """`dom_nodes(html)`: node rows of one page, for LATERAL.

    `dom_nodes(html, 'a li')` gives the elements of these tags and the texts below them alone.
    """

    def eval(self, html: str, tags: str = ""):
        only = frozenset(tags.split()) if tags else None
        for row in page_rows(html or "", only, only, None):
            values = dict(zip(NODE_COLUMNS, row))
            values["attrs"] = dict(values["attrs"]) if values["attrs"] is not None else None
            yield tuple(values[name] for name in NODE_COLUMNS)


def register(spark: SparkSession) -> None:
    """Table function `dom_nodes`, and the scalar functions that SQL users need."""
    spark.udtf.register("dom_nodes", DomNodes)
    spark.udf.register("html_unescape", html_unescape)
    bodies = {
        "url_authority(url STRING)": r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)",
        "url_domain(url STRING)": r"regexp_replace(url_authority(url), '^www\\.', '')",
        "registrable_domain(url STRING)":
            "CASE WHEN contains(url_authority(url), '.') THEN substring_index(url_authority(url), '.', -2) END",
        "normalise_address(typed STRING)":
            f"CASE WHEN contains(typed, ' ') OR NOT contains(typed, '.') THEN concat('{SEARCH_PREFIX}', replace(typed, ' ', '+')) "
            "WHEN startswith(typed, 'http://') OR startswith(typed, 'https://') THEN typed ELSE concat('https://', typed) END",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
