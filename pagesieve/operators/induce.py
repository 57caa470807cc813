"""Selectors out of examples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import selectors as S
from ..functions import text as X
from ..session import written
from . import dom
from .joins import lookup_join

# Elements on which a click gives an example; inputs only of these types.
CLICKABLE = (
    "p h1 h2 h3 h4 h5 h6 span li a td th div button img label area summary svg path circle rect"
).split()
CLICKABLE_INPUTS = ("button", "submit", "image")

_BELOW_CLICKABLE = r"\x1e(?:" + "|".join([*CLICKABLE, "input"]) + r")\["


def is_clickable(tag: Column, input_type: Column) -> Column:
    """P10: the tag whitelist."""
    button = (tag == "input") & F.coalesce(input_type, F.lit("")).isin(*CLICKABLE_INPUTS)
    return tag.isin(*CLICKABLE) | button


def clickable_pres(path: Column) -> Column:
    """`pre` of each ancestor-or-self from the first clickable one on."""
    return dom.ancestor_pres(F.regexp_extract(path, rf"{_BELOW_CLICKABLE}[\s\S]*\z", 0))


def capture_examples(
    clicks: DataFrame, session: str = "session", order: tuple[str, ...] = ("ts", "click_id"),
    text: str = "text", bucket: Column | None = None,
) -> DataFrame:
    """P10: clicks with a text that differs from the previous text of the session.

    A session of any length is worked on in pieces: within a piece by `lag`, across pieces through the last
    text of the piece before. Without `bucket` the pieces are sampled ranges of (session, order), which are
    written so that a repeated task meets the same ones; at most one session enters a range from the one
    before, so no more rows are carried, and broadcast, than there are ranges. With `bucket`, a coarse step
    of the order (an hour, say), nothing is written, but every bucket of a session carries a row.
    Clicks without a session are one session, blank texts are no examples, and rows that tie in the whole
    order are in any order.
    """
    shown = clicks.withColumn("__t", F.trim(F.col(text))).filter(F.col("__t") != "")
    if bucket is None:
        pieces = written(shown.repartitionByRange(session, *order).withColumn("__b", F.spark_partition_id()), "clicks")
    else:
        pieces = shown.withColumn("__b", bucket)
    last = pieces.groupBy(session, "__b").agg(F.max_by("__t", F.struct(*order)).alias("__last"))
    before = F.lag("__last").over(W.partitionBy(session).orderBy("__b"))
    carried = last.select(F.col(session).alias("__s"), F.col("__b").alias("__c"), before.alias("__before"))
    carried = carried.filter("__before IS NOT NULL")
    inner = F.lag("__t").over(W.partitionBy(session, "__b").orderBy(*order))
    same_piece = F.col(session).eqNullSafe(F.col("__s")) & F.col("__b").eqNullSafe(F.col("__c"))
    return (
        pieces.withColumn("__p", inner)
        .join(carried if bucket is not None else F.broadcast(carried), same_piece, "left")
        .filter(~F.col("__t").eqNullSafe(F.coalesce("__p", "__before")))
        .drop("__t", "__p", "__b", "__s", "__c", "__before")
    )


PAGE_EXAMPLES = 1000  # examples that one row of a page carries, on average
_SPACES = re.compile(f"[{X.WHITE_SPACE}]+")
_CLICKABLE_ABOVE = re.compile(_BELOW_CLICKABLE)
_AT = {name: i for i, name in enumerate(dom.NODE_COLUMNS)}


def _shown(rows: list[list]) -> tuple[str, list[int]]:
    """Text of a page as it is shown, and how much of it has come by the end of each node, by `pre`.

    The text of any element is the part between two of these places: nothing is handed to ancestors.
    """
    parts, ends, length, blank = [], [0], 0, True
    for row in rows:
        if row[_AT["kind"]] == "text":
            text = _SPACES.sub(" ", row[_AT["text"]])
            if blank and text.startswith(" "):
                text = text[1:]
            if text:
                parts.append(text)
                length += len(text)
                blank = text.endswith(" ")
        ends.append(length)
    return "".join(parts), ends


def _deepest(rows: list[list], wanted: dict[str, list[int]]) -> dict[int, list]:
    """For each wanted text's numbers, the deepest element that shows it and can be clicked; of several the first."""
    text, ends = _shown(rows)
    lengths = {len(w) for w in wanted}
    best: dict[int, list] = {}
    for row in rows:
        if row[_AT["kind"]] != "element":
            continue
        a, b = ends[row[_AT["pre"]]], ends[row[_AT["last"]]]
        a += text.startswith(" ", a, b)
        b -= text.endswith(" ", a, b)
        if b - a in lengths and (numbers := wanted.get(text[a:b])) and _CLICKABLE_ABOVE.search(row[_AT["path"]]):
            for i in numbers:
                if i not in best or row[_AT["depth"]] > best[i][_AT["depth"]]:
                    best[i] = row
    return best


def _around(rows: list[list], chosen: list) -> tuple[str, str, list[dict]]:
    """Text of an element, text of its first child, and the classes of its children and theirs."""
    pre, last = chosen[_AT["pre"]], chosen[_AT["last"]]
    inside = rows[pre:last]
    children = [r for r in inside if r[_AT["parent_pre"]] == pre and r[_AT["kind"]] == "element"]

    def text(within: list[list]) -> str:
        return "".join(r[_AT["text"]] for r in within if r[_AT["kind"]] == "text")

    def named(r: list) -> dict:
        return {"tag": r[_AT["tag"]], "cls": r[_AT["cls"]]}

    kin = [
        named(c) | {"inner": [named(g) for g in rows[c[_AT["pre"]] : c[_AT["last"]]] if g[_AT["parent_pre"]] == c[_AT["pre"]] and g[_AT["cls"]]]}
        for c in children if c[_AT["cls"]]
    ]
    first = text(rows[children[0][_AT["pre"]] : children[0][_AT["last"]]]) if children else ""
    return text(inside), first, kin


FOUND = "pre int, depth int, path string, attrs map<string,string>, string_value string, first_text string, kin array<struct<tag:string,cls:string,inner:array<struct<tag:string,cls:string>>>>"


def locate_examples(pages: DataFrame, examples: DataFrame) -> DataFrame:
    """Elements that `examples(page_id, column_title, text)` point at: deepest match, first in the page.

    Texts are compared as they are shown, with white space collapsed. Rows (page_id, column_title, text) and FOUND.

    A page's examples travel with its row, some PAGE_EXAMPLES at a time, and are looked up while it is tokenised:
    one pass, and no node leaves its task but those found. Pages are shuffled only where the examples are too many
    to be broadcast.
    """
    asked = examples.withColumn("want", X.collapse(F.col("text"))).filter(F.col("want") != "").dropDuplicates(["page_id", "column_title", "text"])
    listed = written(asked.select("page_id", "column_title", "text", "want"), "examples")
    n = F.count(F.lit(1)).over(W.partitionBy("page_id"))
    part = F.pmod(F.xxhash64("column_title", "text"), F.ceil(n / PAGE_EXAMPLES))
    by_page = listed.withColumn("part", part).groupBy("page_id", "part").agg(F.collect_list(F.struct("column_title", "text", "want")).alias("asked"))
    source = lookup_join(pages.select("page_id", "html"), by_page.drop("part"), "page_id", spread=F.xxhash64("html"), probe_left=False)
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, column_title string, text string, {FOUND}"
    fields = [pa.field(f.name, t) for f, t in zip(T._parse_datatype_string(schema).fields, [None, pa.string(), pa.string(), *_FOUND_TYPES], strict=True) if t is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, out = [], []
            for i, (html, wanted) in enumerate(zip(batch.column("html").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                if not html:
                    continue
                rows = dom.page_rows(html, None, None, None)
                numbers: dict[str, list[int]] = {}
                for k, example in enumerate(wanted):
                    numbers.setdefault(example["want"], []).append(k)
                for k, row in _deepest(rows, numbers).items():
                    value, first, kin = _around(rows, row)
                    owners.append(i)
                    out.append([wanted[k]["column_title"], wanted[k]["text"], row[_AT["pre"]], row[_AT["depth"]], row[_AT["path"]], row[_AT["attrs"]], value, first, kin])
            columns = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(owners, pa.int32())), *columns], names=["page_id", *(f.name for f in fields)])

    return source.select("page_id", "html", "asked").mapInArrow(run, schema)


_NAMED = [("tag", pa.string()), ("cls", pa.string())]
_FOUND_TYPES = [
    pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(),
    pa.list_(pa.struct([*_NAMED, ("inner", pa.list_(pa.struct(_NAMED)))])),
]


def data_selector(path: Column) -> Column:
    """`//tag` per ancestor, class test on every div and on the leaf, index on the leaf."""

    def step(s: Column, i: Column, n: Column) -> Column:
        tag, leaf = dom.step_tag(s), i == n - 1
        classes = F.when(leaf | (tag == "div"), S.stable_classes(dom.step_attribute(s, "class"))).otherwise(F.lit(""))
        index = F.when(leaf, F.concat(F.lit("["), dom.step_index(s), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.lit("//"), tag, index, classes)

    return S.let(
        dom.path_steps(path),
        lambda steps: F.array_join(F.transform(steps, lambda s, i: step(s, i, F.size(steps))), ""),
    )


def induce_selectors(pages: DataFrame, examples: DataFrame) -> DataFrame:
    """(page_id, column_title, text, pre, xpath, full_path) per example found."""
    return locate_examples(pages, examples).select(
        "page_id", "column_title", "text", "pre",
        data_selector(F.col("path")).alias("xpath"),
        dom.full_path(F.col("path")).alias("full_path"),
    )


def _test(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'[@{name}="'), value, F.lit('"]'))


def induce_next_selector(pages: DataFrame, examples: DataFrame) -> DataFrame:
    """Absolute selector of the pagination link shown by an example.

    Every step but html and body gets the first that applies of: id; on the leaf rel=next, text,
    label, aria-label; else its classes (on the leaf with those of its children and grandchildren).
    """
    told = locate_examples(pages, examples)
    first_text = X.strip(F.col("first_text"))

    def has(path: Column, cls: Column) -> Column:
        return F.concat(F.lit("[.//"), path, F.lit('[contains(@class,"'), cls, F.lit('")]]'))

    def child_classes(child: Column) -> Column:
        inner = F.transform(child["inner"], lambda g: has(F.concat(child["tag"], F.lit("/"), g["tag"]), g["cls"]))
        return F.concat(has(child["tag"], child["cls"]), F.array_join(inner, ""))

    kin_classes = F.array_join(F.transform("kin", child_classes), "")

    def attr(name: str) -> Column:
        return F.nullif(F.try_element_at("attrs", F.lit(name)), F.lit(""))

    by_text = F.when(
        F.coalesce(first_text, F.lit("")) != "", F.concat(F.lit('[.//span[text()="'), first_text, F.lit('"]]'))
    ).otherwise(F.concat(F.lit('[text()="'), X.strip(F.col("string_value")), F.lit('"]')))
    leaf_test = F.coalesce(
        F.when(attr("id").isNotNull(), _test("id", attr("id"))),
        F.when(attr("rel") == "next", F.lit('[@rel="next"]')),
        F.when(F.col("string_value") != "", by_text),
        F.when(attr("label").isNotNull(), _test("label", attr("label"))),
        F.when(attr("aria-label").isNotNull(), _test("aria-label", attr("aria-label"))),
        F.concat(S.stable_classes(attr("class")), kin_classes),
    )

    def step(s: Column, leaf: Column) -> Column:
        tag, ident = dom.step_tag(s), dom.step_attribute(s, "id")
        inner = F.when(ident != "", _test("id", ident)).otherwise(S.stable_classes(dom.step_attribute(s, "class")))
        test = F.when(tag.isin("html", "body"), F.lit("")).when(leaf, F.col("__leaf")).otherwise(inner)
        return F.concat(F.lit("/"), tag, test)

    told = told.withColumn("__leaf", leaf_test)
    xpath = S.let(
        dom.path_steps(F.col("path")),
        lambda steps: F.array_join(F.transform(steps, lambda s, i: step(s, i == F.size(steps) - 1)), ""),
    )
    return told.select("page_id", "column_title", "text", "pre", xpath.alias("xpath"))
