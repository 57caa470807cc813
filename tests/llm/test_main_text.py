import html as H
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import main_text as M
from pagesieve.llm.queries import op12_tag_ratio_text
from tests.llm import common as C

LONG = "A paragraph that says a good deal more than a menu would, and in a whole sentence."
SHORT = "So it is."


def brute(page):
    """Main text of the test tables' pages, by what is known of how they are made."""
    inside = page.split("<article>", 1)[1].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", inside))
    texts = [" ".join(H.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark):
    pages = C.rows(spark.read.parquet(f"{C.FOLDER}/pages.parquet"), "page_id", "url", "html")
    want = sorted((i, u, t, len(t)) for i, u, h in pages for t in [brute(h)])
    assert sorted(C.rows(op12_tag_ratio_text(spark, C.FOLDER), "page_id", "url", "text", "n_chars")) == want


def test_odd_rows(spark):
    odd = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "no tags &amp; a\n\tline"), (None, "u", f"<p>{LONG}<p>{LONG}"), (None, "u", f"<p>{LONG}<p>{LONG}"), (5, "u", "<nav>only a menu</nav>"), (6, "u", f"<p>{'word ' * 100_000}</p>"), (7, "u", "<div>" * 5000 + LONG)]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("x")).withColumn("key", F.lit("x"))
    got = C.rows(M.extract(pages), "page_id", "url", "text", "n_chars")
    want = [(1, "u", ""), (2, None, ""), (3, "u", ""), (4, "u", "no tags & a line"), (None, "u", f"{LONG}\n{LONG}"), (None, "u", f"{LONG}\n{LONG}"), (5, "u", ""), (6, "u", ("word " * 100_000).strip()), (7, "u", LONG)]
    assert sorted(got, key=str) == sorted([(*w, len(w[2])) for w in want], key=str)
    assert C.rows(M.extract(pages.limit(0)), "page_id") == []


ASIDE = [
    f'<nav><ul><li><a href="/">{SHORT}</a></li></ul></nav>', f"<header><h1>{LONG}</h1></header>", f"<aside>{LONG}</aside>", f'<div class="ad">{LONG}</div>',
    f'<div class="sidebar-left"><p>{LONG}</p><p>{SHORT}</p></div>', f'<div id="cookieNotice"><p>{LONG}</p><button>Yes</button></div>', f"<form><p>{LONG}</p><input name=a></form>",
    f"<script>var a = '<p>{LONG}</p>';</script>", f"<style>p {{ }} /* {LONG} */</style>", f'<section class="post-comments"><article><p>{LONG}</p></article></section>',
    f'<div role="complementary">{LONG}</div>', f"<!-- {LONG} -->", f"<p hidden>{LONG}</p>", f"<footer><p>{LONG}</p></footer>", f'<p class="advert">{LONG}',
]
BODY = f"<h1>{SHORT}</h1><p>{LONG}</p><p>{SHORT}</p><h2>More</h2><ul><li>{SHORT}<li>{LONG}</ul><blockquote>{LONG}</blockquote><p>a<b>b</b> c<br>d&nbsp;&eacute;&lt;p&gt;</p><pre>x\n  y</pre>"
TEXT = "\n".join([SHORT, LONG, SHORT, "More", SHORT, LONG, LONG, "ab c d é<p>", "x y"])


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<main><article class=post>{}</article></main>", '<div class="page-with-sidebar"><div>{}</div></div>', "<body>{}</body>", '<div class="promo">{}</div>'])
@pytest.mark.parametrize("aside", range(-1, len(ASIDE)))
def test_what_stands_beside(around, aside):
    beside = ASIDE[aside] if aside >= 0 else ""
    page = f"<!DOCTYPE html><html><head><title>{LONG}</title></head>{beside}{around.format(BODY)}{beside}</html>"
    assert M.main_text(page) == TEXT
    if "div" not in around and "body" not in around and "<header>" not in beside:  # an article's own heading is kept
        assert M.main_text(f"<html>{around.format(BODY.replace('<h2>', beside + '<h2>'))}</html>") == TEXT


def test_lists_of_links_beside_bare_paragraphs():
    menu = "".join(f'<div><a href="/{i}">{w}</a></div>' for i, w in enumerate(["Home", "News", "Sport", "Help"]))
    assert M.main_text(f"<body>{menu}<h1>{SHORT}</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p>{menu}</body>") == "\n".join([SHORT, LONG, SHORT, LONG])


def test_missing_tags():
    assert M.main_text(f"<head><title>{LONG}</title><meta charset=utf-8><article>{BODY}") == TEXT
    assert M.main_text(f"<html><head><title>{LONG}</title><body><article>{BODY}</article>") == TEXT
    assert M.main_text(f"</div></article><article>{BODY}</p></span></div>") == TEXT


def test_pages_cut_anywhere():
    page = f"<html><body><article>{BODY}</article><footer>{LONG}</footer></body></html>"
    start = page.index("<article>") + 9
    for end in range(start, len(page)):
        assert TEXT.startswith(M.main_text(page[:end]).split("&")[0].rstrip()) or end < page.index("</article>")
    assert M.main_text(page[: page.index("</article>") + 2]) == TEXT
    assert M.main_text(page[: page.index("</footer>")]) == TEXT


def test_smoothing_and_clusters():
    ratios = np.array([1.0, 1, 30, 2, 40, 1, 1, 1, 1])
    plain = []
    for i in range(len(ratios)):
        near = [(np.exp(-((j - i) ** 2) / 2), ratios[j]) for j in range(max(0, i - 2), min(len(ratios), i + 3))]
        plain.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    assert np.allclose(M.smoothed(ratios), plain)
    lines = [M.Line(0, "x" * int(r), 1, False, 0) for r in ratios]
    assert list(np.flatnonzero(M.clustered(lines))) == [2, 3, 4, 5]
