"""Text functions (T1-T9) as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .selectors import let
from ..operators.statuses import ERROR, LABELS, RUNNING

# The characters that Python's str.strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """decode character references."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_unescape_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: [x if x is None else html.unescape(x) for x in xs], na_action="ignore")


def strip(text: Column) -> Column:
    """Unicode-aware trim (`trim` would leave a no-break space in place)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    """Text as it is shown: runs of white space are one blank, none at the ends."""
    return strip(F.regexp_replace(text, f"[{WHITE_SPACE}]+", " "))


def tidy(text: Column) -> Column:
    """T1 without the decoding step: all inside the JVM."""
    flat = F.replace(F.translate(text, "\r\t\n", ""), F.lit("  "), F.lit(" "))
    flat = F.replace(flat, F.lit("\u00a0"), F.lit(" "))
    return F.when(flat == " ", flat).otherwise(strip(flat))


def clean_text(text: Column) -> Column:
    """Decode references, drop line breaks and tabs, halve double spaces once, strip.

    Only values that hold an `&` carry text to the Python worker; all others travel as NULL.
    """
    decoded = html_unescape(F.when(F.contains(text, F.lit("&")), text))
    return tidy(F.coalesce(decoded, text))


def clean_list(texts: Column) -> Column:
    """T1 on every element; only lists that hold an `&` travel to the Python worker."""
    held = F.exists(texts, lambda t: F.contains(t, F.lit("&")))
    return F.transform(F.coalesce(html_unescape_each(F.when(held, texts)), texts), tidy)


def first_fragment(fragments: Column, text: Column) -> Column:
    """Index of the first fragment that `text` starts with, else -1."""
    return (F.array_position(F.transform(fragments, lambda e: F.startswith(text, e)), True) - 1).cast("int")


def run_length(fragments: Column, text: Column, first: Column) -> Column:
    """How many fragments from `first` on concatenate to `text`; NULL if no run does."""
    start = F.struct(F.lit("").alias("seen"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("hit"))

    def step(state, fragment):
        seen = F.when(state["hit"].isNull() & F.startswith(text, state["seen"]), F.concat(state["seen"], fragment))
        n = state["n"] + 1
        return F.struct(
            seen.alias("seen"), n.alias("n"), F.when(seen == text, n).otherwise(state["hit"]).alias("hit")
        )

    rest = F.slice(fragments, first + 1, F.greatest(F.size(fragments) - first, F.lit(0)))
    return F.aggregate(rest, start, step, lambda state: state["hit"])


def regroup(fragments: Column, text: Column, first: Column) -> Column:
    """T4: the whole list, from its start, in chunks as long as the run that gives `text`."""

    def chunks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v["xs"]) - 1, v["k"])
        return F.when(
            v["k"].isNotNull(), F.transform(starts, lambda s: F.array_join(F.slice(v["xs"], s + 1, v["k"]), ""))
        )

    def measured(v: Column) -> Column:
        return let(F.struct(v["xs"].alias("xs"), run_length(v["xs"], v["t"], v["i"]).alias("k")), chunks)

    return let(F.struct(fragments.alias("xs"), text.alias("t"), first.alias("i")), measured)


def find_text(fragments: Column, text: Column) -> Column:
    """T5: the list if it holds `text`, the regrouped list if a run of it does, else NULL."""

    def found(v: Column) -> Column:
        first = first_fragment(v["xs"], v["t"])
        grouped = let(first, lambda i: F.when(i >= 0, regroup(v["xs"], v["t"], i)))
        return F.when(F.array_contains(v["xs"], v["t"]), v["xs"]).when(F.size(v["xs"]) > 1, grouped)

    # bound once: inside the lambdas an expression would be evaluated again for every element
    return let(F.struct(fragments.alias("xs"), text.alias("t")), found)


def join_titles(titles: Column) -> Column:
    """T6"""
    return F.concat_ws(", ", titles)


def date_text(ts: Column) -> Column:
    """T7"""
    return F.date_format(ts, "dd/MM/yyyy")


def time_text(ts: Column) -> Column:
    """T7"""
    return F.date_format(ts, "HH:mm:ss")


def percent(status: Column) -> Column:
    """The number in "NN%", else NULL."""
    return F.regexp_extract(status, r"^(\d+)%$", 1).try_cast("int")


def status_code(status: Column) -> Column:
    """Progress means running, blank means error, anything else is its number."""
    return (
        F.when(percent(status).isNotNull(), F.lit(RUNNING))
        .when(F.coalesce(F.trim(status), F.lit("")) == "", F.lit(ERROR))
        .otherwise(status.try_cast("int"))
    )


def status_label(code: Column) -> Column:
    """T9"""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("Unknown"))
