"""Records out of pages (E1-E12, E14, E15): one row per matching container, one column per title.

    scan -> tokenise -> filter on `path` -> one shuffle of the matching text -> records

The shuffle key is (page, container), so neither a large page nor a large site makes one task heavy,
and only text that belongs to a field is moved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import selectors as S
from ..functions import text as X
from . import dom
from . import xpath as XP
from .joins import lookup_join
from .xpath import UnsupportedXPath, steps_regex


def record_schema(titles: list[str]) -> T.StructType:
    """Schema of the records of a template: text columns named by the titles."""
    if len(set(titles)) != len(titles):
        raise ValueError(f"duplicate titles: {titles}")
    return T.StructType([T.StructField(t, T.StringType()) for t in titles])


_compiled: dict[tuple[str, ...], tuple[str, list[str]]] = {}


def compile_selectors(spark: SparkSession, xpaths: list[str]) -> tuple[str, list[str]]:
    """P1-P4 for the columns of one template: (container path, relative path per column).

    The expressions of `functions.selectors` on a single row; what was asked before is remembered.
    """
    for x in xpaths:
        if XP.SLASH_IN_LITERAL.search(x):
            raise UnsupportedXPath(f"'/' inside a literal: {x!r}")
    asked = tuple(xpaths)
    if asked not in _compiled:
        _compiled[asked] = _compile(spark, xpaths)
    container, relative = _compiled[asked]
    return container, list(relative)


def _compile(spark: SparkSession, xpaths: list[str]) -> tuple[str, list[str]]:
    one = spark.sql("SELECT :xpaths AS xpaths", args={"xpaths": F.array(*[F.lit(x) for x in xpaths])})
    row = (
        one.withColumn("container", S.common_container(S.all_alternatives(F.col("xpaths"))))
        .select("container", S.field_suffixes(F.col("container"), F.col("xpaths")).alias("suffixes"))
        .first()
    )
    return row["container"], row["suffixes"]


def _near(locations: list[XP.Location]) -> bool:
    return not any(step.far_tests for loc in locations for step in loc.steps)


def _owned(pres: Column, field: int) -> Column:
    return F.transform(pres, lambda p: F.struct(p.alias("container_pre"), F.lit(field).alias("field")))


def _near_cells(nodes, containers, fields, keep, cells_too):
    """(container, field, text) for every text node of a field, straight from its path."""
    path = F.col("path")
    owned, inside = [], []
    for i, branches in enumerate(fields):
        for outer in containers:
            for branch in branches:
                modes = [("text", branch.text or "descendant")]
                if cells_too:
                    modes.append(("element", None))
                for kind, text in modes:
                    hit = path.rlike(steps_regex((*outer.steps, *branch.steps), text))
                    if cells_too:
                        hit = hit & (F.col("kind") == kind)
                    inside.append(hit)
                    owned.append((hit, _owned(XP.owners(path, outer.steps, branch.steps, text), i)))
    carried = [*keep, "pre", "text"]
    matching = nodes.filter(XP.any_of(inside))
    if len(owned) == 1:
        claims = owned[0][1]
    else:
        claims = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(hit, own) for hit, own in owned]))))
    cells = matching.select(*carried, F.explode(claims).alias("__c"))
    return cells.select(*carried, "__c.container_pre", "__c.field")


def _far_cells(nodes, containers, branches, field, keep):
    """Cells of a field whose path, or whose container, has tests on other nodes."""
    parts = []
    path = F.col("path")
    for outer in containers:
        for branch in branches:
            steps = (*outer.steps, *branch.steps)
            marks = [i for i, step in enumerate(steps) if step.far_tests]
            n_outer = len(outer.steps)
            if len([i for i in marks if i >= n_outer]) > 1:
                raise UnsupportedXPath("a column path may test other nodes at one step only")
            text = branch.text or "descendant"
            pairs = XP.owners(path, outer.steps, branch.steps, text)
            cells = (
                nodes.filter((F.col("kind") == "text") & path.rlike(steps_regex(steps, text)))
                .select(*keep, "pre", "text", "path", F.explode(pairs).alias("container_pre"))
            )
            if any(i < n_outer for i in marks):
                chosen = XP._select_far(nodes, XP.Location(outer.steps)).select(
                    "page_id", F.col("pre").alias("container_pre")
                )
                cells = cells.join(chosen, ["page_id", "container_pre"], "left_semi")
            if marks and marks[-1] >= n_outer:
                upto = marks[-1] - n_outer + 1
                middle, rest = branch.steps[:upto], branch.steps[upto:]
                owners = XP.owners(path, (*outer.steps, *middle), rest, text)
                tested = XP._with_far_tests(nodes, steps[: marks[-1] + 1]).select("page_id", F.col("pre").alias("__o"))
                cells = (
                    cells.withColumn("__o", F.explode(owners))
                    .filter(F.col("__o") > F.col("container_pre"))
                    .join(tested, ["page_id", "__o"], "left_semi")
                    .drop("__o")
                )
            parts.append(cells.select(*keep, "pre", "text", "container_pre", F.lit(field).alias("field")))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.dropDuplicates([*keep, "pre", "container_pre"])


def extract_fields(
    pages: DataFrame,
    container: str,
    fields: Mapping[str, str],
    *,
    keep: tuple[str, ...] = ("page_id",),
    clean: bool = True,
    fill: bool = True,
    shells: bool = False,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Rows (keep..., container_pre, title...) for each container that holds a field.

    `fields` maps titles to paths relative to the container. A missing field is '' (`fill`) or NULL.
    With `shells` (D15) a cell without text is '' and a missing cell NULL. Containers without any
    field yield no row. `nodes` is an existing node table to read instead of `pages`.
    """
    titles = list(fields)
    record_schema(titles)
    containers = XP.read_alternatives(container)
    branches = [XP.read_alternatives(path) for path in fields.values()]
    near = _near(containers) and all(map(_near, branches))
    if nodes is None:
        leaves = [
            XP.Location((*c.steps, *b.steps), b.text or "descendant", c.attrs | b.attrs)
            for c in containers for bs in branches for b in bs
        ]
        tags, text_tags, attrs = XP.needs(leaves)
        if near:
            tags = {loc.steps[-1].tag for loc in leaves} if shells else set()
            columns = ("pre", "text", "path") + (("kind",) if shells else ())
            nodes = dom.dom_nodes(
                pages, elements=tags, texts_in=text_tags, path_attrs=attrs, columns=columns, keep=keep
            )
        else:
            nodes = dom.dom_nodes(pages, path_attrs=attrs, keep=keep)
    elif not shells:
        nodes = nodes.filter(F.col("kind") == "text") if near else nodes
    if near:
        cells = _near_cells(nodes, containers, branches, keep, shells)
    else:
        parts = [_far_cells(nodes, containers, bs, i, keep) for i, bs in enumerate(branches)]
        cells = parts[0]
        for more in parts[1:]:
            cells = cells.unionByName(more)
    is_text = F.col("text").isNotNull()
    values = []
    for i, title in enumerate(titles):
        mine = F.when((F.col("field") == i) & is_text, F.struct("pre", "text"))
        ordered = F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["text"])
        value = F.array_join(ordered, " ")
        if shells:
            value = F.when(F.max(F.col("field") == i), value)
        elif not fill:
            value = F.when(F.size(ordered) > 0, value)
        values.append(value.alias(title))
    records = cells.groupBy(*keep, "container_pre").agg(*values)
    if clean:
        records = records.withColumns({t: X.clean_text(F.col(f"`{t}`")) for t in titles})
    return records


def extract(
    pages: DataFrame, columns: Mapping[str, str], *, nodes: DataFrame | None = None, **options
) -> DataFrame:
    """Absolute path per title -> records, as `extract_fields` after P1-P4."""
    container, suffixes = compile_selectors(pages.sparkSession, list(columns.values()))
    fields = dict(zip(columns, suffixes))
    return extract_fields(pages, container, fields, nodes=nodes, **options)


def drop_empty(records: DataFrame, titles: list[str]) -> DataFrame:
    """E5 for records from elsewhere: rows without any value."""
    return records.dropna(how="all", subset=titles)


def fill_missing(records: DataFrame, titles: list[str]) -> DataFrame:
    """A missing field of a record is ''."""
    return records.fillna("", subset=titles)


def preview(records: DataFrame, rows: int = 5, by: str = "page_id") -> DataFrame:
    """The first records of every page, numbered `row`."""
    order = W.partitionBy(by).orderBy("container_pre")
    return records.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= rows)


def preview_fallback(previewed: DataFrame, examples: Mapping[str, str], by: str = "page_id") -> DataFrame:
    """A column that is empty on the whole page shows its example text in the first row."""
    page = W.partitionBy(by)
    shown = {}
    for title, example in examples.items():
        value = F.col(f"`{title}`")
        any_value = F.max(F.coalesce(value, F.lit("")) != "").over(page)
        shown[title] = F.when(any_value, value).otherwise(F.when(F.col("row") == 1, F.lit(example)).otherwise(F.lit("")))
    return previewed.withColumns(shown)


def missing_by_page(records: DataFrame, titles: list[str]) -> DataFrame:
    """Pages and titles with records that lack the title."""
    absent = F.array_compact(
        F.array(*[F.when(F.coalesce(F.col(f"`{t}`"), F.lit("")) == "", F.lit(t)) for t in titles])
    )
    return (
        records.select("page_id", F.explode(absent).alias("title"))
        .groupBy("page_id", "title")
        .agg(F.count(F.lit(1)).alias("n_missing"))
    )


def in_visit_order(records: DataFrame, visits: DataFrame) -> DataFrame:
    """Records with the position of their page in a visit (`seed_id, page_seq, page_id`)."""
    return lookup_join(records, visits, "page_id", spread=F.col("container_pre"), probe_left=False)


def concat_runs(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Records of several runs, columns matched by name."""
    for other in others:
        first = first.unionByName(other)
    return first


# --- editing the columns of a template (E14, E15) -----------------------------------------------

COLUMN_TYPE = T.StructType(
    [
        T.StructField("xpath", T.StringType()),
        T.StructField("visual_index", T.IntegerType()),
        T.StructField("first_text", T.StringType()),
        T.StructField("num_elements", T.LongType()),
        T.StructField("column_title", T.StringType()),
    ]
)
TEMPLATE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("pagination_xpath", T.StringType()),
        T.StructField("columns", T.ArrayType(COLUMN_TYPE)),
    ]
)


def _column(xpath: Column, index: Column, first_text: Column, n: Column, title: Column) -> Column:
    return F.struct(
        xpath.alias("xpath"), index.cast("int").alias("visual_index"), first_text.cast("string").alias("first_text"),
        n.cast("long").alias("num_elements"), title.cast("string").alias("column_title"),
    )


def add_column(columns: Column, xpath: Column, first_text: Column | None = None) -> Column:
    """A new column at the end; its default title is its position."""
    none = F.lit(None)
    first_text = none if first_text is None else first_text
    new = _column(xpath, F.size(columns) + 1, first_text, none, none)
    return F.concat(columns, F.array(new))


def remove_column(columns: Column, index: Column) -> Column:
    """Drop the column at position `index` (from 1); later ones move up."""
    kept = F.filter(columns, lambda c: c["visual_index"] != index)
    return F.transform(
        kept,
        lambda c: c.withField(
            "visual_index", F.when(c["visual_index"] > index, c["visual_index"] - 1).otherwise(c["visual_index"])
        ),
    )


def rename_column(columns: Column, index: Column, title: Column) -> Column:
    """An empty title leaves the column as it was."""
    return F.transform(
        columns,
        lambda c: c.withField(
            "column_title", F.when((c["visual_index"] == index) & (title != ""), title).otherwise(c["column_title"])
        ),
    )


def combine_columns(columns: Column, first: Column, second: Column) -> Column:
    """The earlier column gets the merged selector, the later one goes."""
    low, high = F.least(first, second), F.greatest(first, second)

    def at(index):
        return F.element_at(F.filter(columns, lambda c: c["visual_index"] == index), 1)["xpath"]

    merged = S.merge_selectors(at(first), at(second))
    return F.transform(
        remove_column(columns, high),
        lambda c: c.withField("xpath", F.when(c["visual_index"] == low, merged).otherwise(c["xpath"])),
    )
