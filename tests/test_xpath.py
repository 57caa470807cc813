"""Location paths against a small evaluator that walks the tree."""

import random

import re

import pytest

from pagesieve.operators import dom
from pagesieve.operators import xpath as XP
from tests.test_dom import AT, random_page


def walk(rows, xpath):
    """Evaluate a path step by step on the rows of one page (brute force)."""
    elements = [r for r in rows if r[AT["kind"]] == "element"]
    texts = [r for r in rows if r[AT["kind"]] == "text"]

    def inside(outer, r):
        return outer is None or outer[AT["pre"]] < r[AT["pre"]] <= outer[AT["last"]]

    def child(outer, r):
        return r[AT["parent_pre"]] == (outer[AT["pre"]] if outer else 0)

    def passes(r, step):
        attrs = dict(r[AT["attrs"]])
        return (
            step.tag in ("*", r[AT["tag"]])
            and step.index in (None, r[AT["idx"]])
            and all((v in attrs.get(n, "")) if t == "has" else attrs.get(n) == v for n, t, v in step.attr_tests)
        )

    def far(r, test):
        if test[0] == "text":
            return any(child(r, t) and t[AT["text"]] == test[1] for t in texts)
        return bool(follow([r], test[1]))

    def follow(contexts, steps):
        for step in steps:
            found = {}
            for context in contexts:
                axis = inside if step.descendant else child
                for r in elements:
                    if axis(context, r) and passes(r, step):
                        found[r[AT["pre"]]] = r
            contexts = [found[k] for k in sorted(found)]
            for test in step.far_tests:
                if test[0] == "nth":
                    ranks, kept = {}, []
                    for r in contexts:
                        ranks[r[AT["parent_pre"]]] = ranks.get(r[AT["parent_pre"]], 0) + 1
                        if ranks[r[AT["parent_pre"]]] == test[1]:
                            kept.append(r)
                    contexts = kept
                else:
                    contexts = [r for r in contexts if far(r, test)]
        return contexts

    found = set()
    for loc in XP.read_alternatives(xpath):
        contexts = follow([None], loc.steps)
        if loc.text:
            axis = inside if loc.text == "descendant" else child
            found |= {t[AT["pre"]] for t in texts for c in contexts if axis(c, t)}
        else:
            found |= {c[AT["pre"]] for c in contexts}
    return found


PATHS = [
    "//div", "//ul/li", "//div//p", "/html/body/div", "//div//div//b", "//p//text()", "//li/text()", "//*", "//div/*",
    "//li[2]", "//tr//td[1]", '//div[contains(@class, "1")]//a', '//p[@class="c2"]', "//b[1][contains(@class, 'c')]",
    "//div//ul/li//b", "/html/body//a/text()", "//h1 | //td//text() | //a", '//p[text()="x"]', '//li[text()="x"]//b',
    "//div[.//b]", '//div[.//p[text()="x"]]', '//ul[.//li/b]//li', '//div[.//b]//p[text()="x"]//text()',
    "//div[contains(@class, 'c')][2]", '//p[text()="x"][1]', "//table//tr/td", "//div//p/b", '//div[contains(@class, "")]',
]


@pytest.fixture(scope="module")
def corpus(spark):
    from pagesieve.sources.pages import pages_from_html

    rng = random.Random(11)
    htmls = ["".join(random_page(rng) for _ in range(rng.randint(1, 8))) for _ in range(250)]
    nodes = dom.dom_nodes(pages_from_html(spark, htmls).repartition(8)).cache()
    return htmls, nodes


@pytest.mark.parametrize("xpath", PATHS)
def test_against_tree_walk(corpus, xpath):
    htmls, nodes = corpus
    found = [(r.page_id, r.pre) for r in XP.select_nodes(nodes, xpath).select("page_id", "pre").collect()]
    assert len(found) == len(set(found))
    expected = set()
    for i, html in enumerate(htmls):
        expected |= {(i, pre) for pre in walk(dom.page_rows(html, None, None), xpath)}
    assert set(found) == expected
    assert expected, "the corpus should exercise every path"


def test_element_text(corpus):
    htmls, nodes = corpus
    found = {(r.page_id, r.pre): r.string_value for r in XP.select_nodes(nodes, "//div | //li", text="x").collect()}
    expected = {}
    for i, html in enumerate(htmls):
        rows = dom.page_rows(html, None, None)
        for r in rows:
            if r[AT["tag"]] in ("div", "li"):
                text = "".join(t[AT["text"]] for t in rows if t[AT["kind"]] == "text" and r[0] < t[0] <= r[AT["last"]])
                if "x" in text:
                    expected[i, r[0]] = text
    assert found == expected


def test_counts(corpus):
    _, nodes = corpus
    counts = XP.match_counts(nodes, {"a": "//div//a", "b": "//p//text() | //li"})
    per = {(r.page_id, r.selector): r.n_matches for r in counts.collect()}
    assert sum(v for (_, s), v in per.items() if s == "a") == XP.select_nodes(nodes, "//div//a").count()
    assert sum(v for (_, s), v in per.items() if s == "b") == XP.select_nodes(nodes, "//p//text() | //li").count()


@pytest.mark.parametrize(
    "xpath", ["//a[last()]", "a", "//a[position()<3]", "//a/@href", "//a/../b", '//a[@x="1"', "", "//text()//a", "//a[.//b[.//c]]"]
)
def test_unsupported_paths_are_named(xpath):
    with pytest.raises(XP.UnsupportedXPath):
        XP.parse(xpath)


@pytest.mark.parametrize("axis", "ancestor ancestor-or-self attribute child descendant descendant-or-self following following-sibling namespace parent preceding preceding-sibling self".split())
def test_axes_are_named(axis):
    for xpath, step in ((f"//li/{axis}::li", f"{axis}::li"), (f"//{axis}::*[1]", f"{axis}::*[1]"), (f"//p[.//{axis}::a]//b", f"{axis}::a")):
        with pytest.raises(XP.UnsupportedXPath, match=re.escape(step)):
            XP.parse(xpath)
    assert XP.parse("//svg:rect").steps[0].tag == "svg:rect"


def test_special_characters_are_literal(spark, pages):
    nodes = dom.dom_nodes(pages('<div class="a.b (c) [d] $ \\e / f|g">x</div>'), path_attrs=("class",))
    for part in ("a.b", "(c)", "[d]", "$", "\\e", "/ f", "f|g"):
        assert XP.select_nodes(nodes, f'//div[contains(@class, "{part}")]').count() == 1, part
    assert XP.select_nodes(nodes, '//div[contains(@class, "a-b")]').count() == 0


def test_plain_path_is_a_filter(spark, pages):
    nodes = dom.dom_nodes(pages("<p>x"))
    plan = XP.select_nodes(nodes, '//div[contains(@class, "a")]//ul/li[2]//a')._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_deep_path_does_not_backtrack(spark, pages):
    import time

    nodes = dom.dom_nodes(pages("<div>" * 500 + "x"))
    start = time.time()
    assert XP.select_nodes(nodes, "//div" * 12 + "//p//text()").count() == 0
    assert time.time() - start < 30
