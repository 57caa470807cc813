"""Selector functions (P1-P5, P7, S12, G2, G4) as Column expressions over template tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE_PAGE = "/html/body"
TEXT_STEP = "//text()"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once: keeps nested expressions small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _drop_last(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)


def _before_last_step(xpath: Column) -> Column:
    """The path up to its last `//`."""
    return F.substring(xpath, F.lit(1), F.length(xpath) - F.length(F.substring_index(xpath, "//", -1)) - 2)


def generalise(xpath: Column) -> Column:
    """Every step becomes a descendant step, and the text below the last one is taken."""
    parts = F.split(xpath, "/")
    kept = F.filter(parts, lambda part: part != "")
    ending = F.when(F.element_at(parts, -1) != "", F.lit(TEXT_STEP)).otherwise(F.lit(""))
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(F.lit("//"), F.array_join(kept, "//"), ending))


def shared_start(xpaths: Column) -> Column:
    """Longest common prefix, character by character: that of the smallest and the largest."""

    def common(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        shorter = F.least(F.length(low), F.length(high))
        places = F.sequence(F.lit(1), F.greatest(shorter, F.lit(1)))
        differing = F.filter(places, lambda i: F.substring(low, i, F.lit(1)) != F.substring(high, i, F.lit(1)))
        return F.substring(low, F.lit(1), F.coalesce(F.try_element_at(differing, F.lit(1)) - 1, shorter))

    return let(F.struct(F.array_min(xpaths).alias("low"), F.array_max(xpaths).alias("high")), common)


def suffix(prefix: Column, xpath: Column) -> Column:
    """Path relative to the container; the whole-page container leaves it as it is."""
    return F.when(prefix == WHOLE_PAGE, xpath).otherwise(F.substring(xpath, F.length(prefix) + 1, F.length(xpath)))


def suffixes(prefix: Column, xpaths: Column) -> Column:
    """P3"""
    inside = F.filter(xpaths, lambda x: (prefix == WHOLE_PAGE) | F.startswith(x, prefix))
    return F.transform(inside, lambda x: suffix(prefix, x))


def common_container(xpaths: Column) -> Column:
    """The container that all generalised paths share."""

    def whole_steps(start: Column) -> Column:
        return (
            F.when(F.endswith(start, F.lit("//")), _drop_last(start, 2))
            .when(F.endswith(start, F.lit("[")), _before_last_step(start))
            .otherwise(start)
        )

    def found(xs: Column) -> Column:
        def cut(start: Column) -> Column:
            inside_a_step = F.exists(suffixes(start, xs), lambda s: ~F.startswith(s, F.lit("//")))
            return F.when(inside_a_step, _before_last_step(start)).otherwise(start)

        several = let(let(shared_start(xs), whole_steps), cut)
        only = F.element_at(xs, 1)
        return F.when(
            (F.size(xs) == 1) & F.endswith(only, F.lit(TEXT_STEP)), _drop_last(only, len(TEXT_STEP))
        ).otherwise(let(several, lambda c: F.when((F.size(xs) > 1) & (c == ""), F.lit(WHOLE_PAGE)).otherwise(c)))

    return let(xpaths, found)


def alternatives(xpath: Column) -> Column:
    """The parts of `a | b` or `a|b`; a bar inside a literal does not split."""
    return F.split(xpath, r"""\s*\|\s*(?=(?:[^"']|"[^"]*"|'[^']*')*\z)""")


def all_alternatives(xpaths: Column) -> Column:
    return F.flatten(F.transform(xpaths, lambda x: F.transform(alternatives(x), generalise)))


def field_suffixes(container: Column, xpaths: Column) -> Column:
    """Per field, the relative paths of its alternatives joined for evaluation inside the container."""
    return F.transform(
        xpaths,
        lambda x: F.array_join(F.transform(alternatives(x), lambda a: suffix(container, generalise(a))), " | ."),
    )


def merge_selectors(first: Column, second: Column) -> Column:
    """P5: one path that covers both, or their union."""
    def base(step):
        return F.substring_index(step, "[", 1)

    def merged(sides: Column) -> Column:
        steps = F.zip_with(
            sides["a"], sides["b"], lambda x, y: F.when(x == y, x).when(base(x) == base(y), base(x))
        )
        return F.when(F.size(sides["a"]) == F.size(sides["b"]), steps)

    def joined(steps: Column) -> Column:
        return F.when(F.forall(steps, lambda s: s.isNotNull()), F.array_join(steps, "//"))

    sides = F.struct(F.split(first, "//").alias("a"), F.split(second, "//").alias("b"))
    return F.coalesce(let(let(sides, merged), joined), F.concat(first, F.lit(" | "), second))


def stable_classes(cls: Column) -> Column:
    """Class tokens before the first one with a digit or equal to `selected`, as a test; '' if none."""
    tokens = F.split(cls, " ")
    unstable = F.transform(tokens, lambda t: t.rlike("[0-9]") | (t == "selected"))
    at = F.array_position(unstable, True)
    n = F.when(at == 0, F.size(tokens)).otherwise((at - 1).cast("int"))
    test = F.concat(F.lit('[contains(@class, "'), F.array_join(F.slice(tokens, 1, n), " "), F.lit('")]'))
    return F.when(cls.isNull() | (cls == "") | (n == 0), F.lit("")).otherwise(test)


def add_selector(existing: Column, new: Column) -> Column:
    """Newline-separated list with `new` appended unless it is already part of it."""
    return (
        F.when(F.coalesce(existing, F.lit("")).isin("", "fake"), new)
        .when(F.contains(existing, new), existing)
        .otherwise(F.concat(existing, F.lit("\n"), new))
    )


def selector_list(pagination: Column) -> Column:
    """The selectors of a newline-separated list, blank ones dropped."""
    return F.filter(F.split(pagination, "\n"), lambda s: F.trim(s) != "")


def page_budget(pagination: Column, max_pages: Column) -> Column:
    """NULL means unlimited."""
    listed = F.size(selector_list(pagination))
    return (
        F.when(F.coalesce(F.trim(pagination), F.lit("")) == "", F.lit(1))
        .when(pagination == "fake", F.lit(1))
        .when(F.contains(pagination, F.lit("\n")) & (listed > 1), listed + 1)
        .when(max_pages == 0, F.lit(None).cast("int"))
        .otherwise(max_pages)
    )


def column_data(columns: Column, key: str) -> Column:
    """One property of every column of a template."""
    return F.transform(columns, lambda c: c[key])


def column_titles(columns: Column) -> Column:
    """Titles; a column without one is named by its position."""
    return F.transform(
        columns, lambda c: F.coalesce(F.nullif(c["column_title"], F.lit("")), c["visual_index"].cast("string"))
    )
