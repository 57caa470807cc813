"""Text, address and selector functions: worked cases, and plain Python as a second opinion."""

import html
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve.functions import selectors as S
from pagesieve.functions import text as X
from pagesieve.functions import urls as U
from pagesieve.operators import extract as E
from pagesieve.operators import runs as R


def lits(items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("\r\n This is \t a test \n text.  ", "This is a test text."),
        ("a&amp;b", "a&b"),
        (" ", " "),
        ("  ", " "),
        ("a    b", "a  b"),
        ("one\ntwo", "onetwo"),
        (" x ", "x"),
        ("&amp;amp; &eacute;&#233;&copy", "&amp; éé©"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(value, text, expected):
    assert value(X.clean_text(F.lit(text).cast("string"))) == expected


def plain_clean(text):
    text = html.unescape(text)
    for gone in "\r\t\n":
        text = text.replace(gone, "")
    text = text.replace("  ", " ").replace(" ", " ")
    return text if text == " " else text.strip()


def test_clean_text_on_any_text(spark):
    samples = []

    @settings(max_examples=300, database=None)
    @given(st.lists(st.sampled_from(list("ab &;#xé  　\x85\x1c\t\n\r\v") + ["&amp;", "&lt", "&#65;"]), max_size=12))
    def draw(parts):
        samples.append("".join(parts))

    draw()
    df = spark.createDataFrame(list(enumerate(samples)), "i int, t string").select("i", X.clean_text(F.col("t")).alias("c"))
    assert {r.i: r.c for r in df.collect()} == {i: plain_clean(t) for i, t in enumerate(samples)}


@pytest.mark.parametrize(
    "fragments, text, first, found",
    [
        (["$", "10", "$", "12"], "$10", 0, ["$10", "$12"]),
        (["a"], "ab", 0, None),
        (["a", "b"], "b", 1, ["a", "b"]),
        (["x", "y"], "ab", -1, None),
        (["x", "a", "b", "c", "d"], "abc", 1, ["xab", "cd"]),
        (["a", "c"], "ab", 0, None),
        ([], "a", -1, None),
    ],
)
def test_fragments(value, fragments, text, first, found):
    assert value(X.first_fragment(lits(fragments), F.lit(text))) == first
    assert value(X.find_text(lits(fragments), F.lit(text))) == found


def test_status_text(value):
    got = value(F.transform(lits(["37%", "3", "", " ", "x%"]), lambda s: F.struct(X.status_code(s), X.percent(s))))
    assert [tuple(g) for g in got] == [(1, 37), (3, None), (4, None), (4, None), (None, None)]
    assert value(X.status_label(F.lit(5))) == "Requires interaction"
    assert value(X.status_label(F.lit(77))) == "Unknown"
    codes = F.array(*[F.lit(c).cast("int") for c in (1, 2, 5, 6, 3, None)])
    assert value(F.transform(codes, R.after_restart)) == [7, 7, 7, 7, 3, 4]


def test_dates(value):
    at = F.lit(datetime(2024, 2, 3, 4, 5, 6))
    assert value(X.date_text(at)) == "03/02/2024"
    assert value(X.time_text(at)) == "04:05:06"
    assert value(X.join_titles(lits(["a", "b"]))) == "a, b"


@pytest.mark.parametrize(
    "url, domain, site",
    [
        ("https://www.shop.example.com/x", "shop.example.com", "example.com"),
        ("https://a.b.example.com/x", "a.b.example.com", "example.com"),
        ("http://localhost/", "localhost", None),
        ("http://user@h.org:80?q", "user@h.org:80", "user@h.org:80"),
        ("example.com/x", "", None),
    ],
)
def test_hosts(value, url, domain, site):
    assert value(U.domain(F.lit(url))) == domain
    assert value(U.registrable(F.lit(url))) == site


def test_addresses(value):
    typed = lits(["red shoes", "shoes", "example.com", "http://x.y", "https://x.y", "httpx.y"])
    search = "https://www.google.com/search?q="
    assert value(F.transform(typed, lambda t: U.normalise_address(t))) == [
        search + "red+shoes", search + "shoes", "https://example.com", "http://x.y", "https://x.y", "https://httpx.y",
    ]


@pytest.mark.parametrize(
    "href, expected",
    [
        ("/b", "https://h.org/b"), ("c?x=1", "https://h.org/a/c?x=1"), ("./c", "https://h.org/a/c"), ("?p=2", "https://h.org/a/p?p=2"),
        ("//o.org/z", "https://o.org/z"), ("http://o.org/", "http://o.org/"), ("#top", "https://h.org/a/p?q=/r"), ("", "https://h.org/a/p?q=/r"),
    ],
)
def test_resolve(value, href, expected):
    assert value(U.resolve(F.lit(href), F.lit("https://h.org/a/p?q=/r#f"))) == expected


@pytest.mark.parametrize(
    "xpath, expected",
    [
        ("/html[1]/body[1]//p", "//html[1]//body[1]//p//text()"),
        ("//div/", "//div"),
        ('//li[.//a[text()="x"]]', '//li[.//a[text()="x"]]//text()'),
        ("", ""),
    ],
)
def test_generalise(value, xpath, expected):
    assert value(S.generalise(F.lit(xpath))) == expected


BASE = '//html//body//div[contains(@class, "thumbnail")]//div[contains(@class, "caption")]'


@pytest.mark.parametrize(
    "xpaths, container, suffixes",
    [
        (["//tr//td[2]", "//tr//td[3]"], "//tr", ["//td[2]//text()", "//td[3]//text()"]),
        (["//div//h4//a[1]", "//div//h4[1]"], "//div", ["//h4//a[1]//text()", "//h4[1]//text()"]),
        (["//ul//li"], "//ul//li", ["//text()"]),
        (["//a", "//b"], "/html/body", ["//a//text()", "//b//text()"]),
        (["//ul//li", "//ul//li"], "//ul//li", ["//text()", "//text()"]),
        ([f"{BASE}//h4//a[1]", f"{BASE}//p[1]"], BASE, ["//h4//a[1]//text()", "//p[1]//text()"]),
        ([f"{BASE}//h4//a[1]", f"{BASE}//h4[1]"], BASE, ["//h4//a[1]//text()", "//h4[1]//text()"]),
        (
            [f"{BASE}//a[1]", BASE.replace("caption", "ratings") + "//p[1]"],
            '//html//body//div[contains(@class, "thumbnail")]',
            ['//div[contains(@class, "caption")]//a[1]//text()', '//div[contains(@class, "ratings")]//p[1]//text()'],
        ),
        (["//tr//td[2] | //tr//td[4]", "//tr//td[3]"], "//tr", ["//td[2]//text() | .//td[4]//text()", "//td[3]//text()"]),
    ],
)
def test_compile(spark, xpaths, container, suffixes):
    assert E.compile_selectors(spark, xpaths) == (container, suffixes)


def test_slash_in_a_literal_is_rejected(spark):
    with pytest.raises(ValueError, match="literal"):
        E.compile_selectors(spark, ['//a[@href="/x/y"]'])


@pytest.mark.parametrize(
    "first, second, expected",
    [
        ("//div//a[1]", "//div//a[2]", "//div//a"),
        ("//div//a", "//div//b", "//div//a | //div//b"),
        ("//div//a", "//div", "//div//a | //div"),
        ("//div[1]//a", "//div[1]//a", "//div[1]//a"),
    ],
)
def test_merge(value, first, second, expected):
    assert value(S.merge_selectors(F.lit(first), F.lit(second))) == expected


@pytest.mark.parametrize(
    "cls, expected",
    [
        ("card big col-4 wide", '[contains(@class, "card big")]'),
        ("selected item", ""),
        ("item selected", '[contains(@class, "item")]'),
        ("a  b", '[contains(@class, "a  b")]'),
        ("x1", ""), ("", ""), (None, ""),
    ],
)
def test_stable_classes(value, cls, expected):
    assert value(S.stable_classes(F.lit(cls).cast("string"))) == expected


def test_selector_lists(value):
    assert value(S.selector_list(F.lit("//a\n\n //b\n "))) == ["//a", " //b"]
    assert value(S.add_selector(F.lit(None).cast("string"), F.lit("//a"))) == "//a"
    assert value(S.add_selector(F.lit("fake"), F.lit("//a"))) == "//a"
    assert value(S.add_selector(F.lit("//a"), F.lit("//b"))) == "//a\n//b"
    assert value(S.add_selector(F.lit("//a[1]"), F.lit("//a"))) == "//a[1]"


@pytest.mark.parametrize(
    "pagination, most, budget", [(None, 5, 1), ("fake", 5, 1), ("//a", 0, None), ("//a", 5, 5), ("//a\n//b", 9, 3), ("//a\n", 4, 4)]
)
def test_page_budget(value, pagination, most, budget):
    assert value(S.page_budget(F.lit(pagination).cast("string"), F.lit(most))) == budget


def test_shared_start_is_that_of_python(spark):
    import os.path

    samples = []

    @settings(max_examples=150, database=None, suppress_health_check=[HealthCheck.too_slow])
    @given(st.lists(st.text(alphabet="ab/é[", max_size=6), min_size=1, max_size=4))
    def draw(texts):
        samples.append(texts)

    draw()
    df = spark.createDataFrame(list(enumerate(samples)), "i int, x array<string>").select("i", S.shared_start(F.col("x")).alias("s"))
    assert {r.i: r.s for r in df.collect()} == {i: os.path.commonprefix(x) for i, x in enumerate(samples)}


@pytest.mark.parametrize(("href", "base", "want"), [
    ("../p2.html", "http://s/a/b/p1.html", "http://s/a/p2.html"), ("./x/../y?q=../z#f", "http://s/a/", "http://s/a/y?q=../z"),
    ("../../../up", "http://s/a/b", "http://s/up"), ("/a/./b/..", "http://s/c", "http://s/a/"), ("..", "http://s/a/b/c", "http://s/a/"),
    ("http://t/a/../b", "http://s/", "http://t/b"), ("x..y/.z", "http://s/a/", "http://s/a/x..y/.z"), ("?p=1", "http://s/a/b?q", "http://s/a/b?p=1"),
    ("mailto:a@b", "http://s/", "mailto:a@b"),
])
def test_links_with_dots(value, href, base, want):
    assert value(U.resolve(F.lit(href), F.lit(base))) == want


def test_texts_as_shown(value):
    assert value(X.collapse(F.lit(" a\n\t b  c "))) == "a b c"
