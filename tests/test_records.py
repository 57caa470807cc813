"""Extraction on small sites of the shapes the tool is made for."""

import random

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import checks as C
from pagesieve.operators import dom
from pagesieve.operators import extract as E
from pagesieve.operators import induce as I
from pagesieve.operators import paginate as P
from pagesieve.operators import rules
from pagesieve.operators import templates as TP
from pagesieve.operators import xpath as XP
from pagesieve.sources.pages import PAGE_SCHEMA


def rows(df, *columns):
    found = df.orderBy("page_id", "container_pre").select(*columns).collect()
    return [tuple(r) for r in found]


def table_page(*people):
    body = "".join(f"<tr><td>{i}</td>" + "".join(f"<td>{v}</td>" for v in p) + "</tr>" for i, p in enumerate(people))
    return f"<table><thead><tr><th>#</th></tr></thead><tbody>{body}</tbody></table>"


def card(name, rating, classes="thumbnail"):
    return (
        f'<div class="{classes}"><div class="caption"><h4 class="price">$1</h4><h4><a href="#">{name}</a></h4>'
        f'<p class="description">about {name}</p></div><div class="ratings"><p class="pull-right">{rating}</p></div></div>'
    )


def test_static_tables(pages):
    people = [(f"F{i}", f"L{i}", f"@u{i}") for i in range(3)]
    site = pages(table_page(*people) + table_page(*people))
    columns = {f: f"//html//body//table//tbody//tr//td[{i}]" for i, f in ((2, "First Name"), (3, "Last Name"), (4, "Username"))}
    assert rows(E.extract(site, columns), *columns) == people * 2


def test_cards(pages):
    site = pages("".join(card(f"T{i}", f"{i} reviews") for i in range(6)))
    base = '//html//body//div[contains(@class, "thumbnail")]'
    columns = {
        "Tablet": base + '//div[contains(@class, "caption")]//h4//a[1]',
        "Reviews": base + '//div[contains(@class, "ratings")]//p[1][contains(@class, "pull-right")]',
    }
    assert rows(E.extract(site, columns), "Tablet", "Reviews") == [(f"T{i}", f"{i} reviews") for i in range(6)]


def test_one_cell_page(pages):
    site = pages('<div class="example"><h4>Welcome</h4></div>')
    columns = {"Message": '//html//body//div[contains(@class, "example")]//h4[1]'}
    assert rows(E.extract(site, columns), "Message") == [("Welcome",)]


def test_linked_pages(spark):
    sizes = [6] * 19 + [3]
    htmls = []
    for n, size in enumerate(sizes):
        following = f'<ul class="pagination"><li><a rel="next" href="?page={n + 2}">&raquo;</a></li></ul>' if n < 19 else ""
        htmls.append("".join(card(f"C{n}-{i}", i) for i in range(size)) + following)
    data = [(i + 100, "http://shop.test/list" + (f"?page={i + 1}" if i else ""), h) for i, h in enumerate(htmls)]
    site = spark.createDataFrame(data, PAGE_SCHEMA)
    visits = P.page_chain(site, site.filter("page_id = 100").select("page_id"), '/html/body/ul[contains(@class, "pagination")]/li/a[@rel="next"]')
    assert [(r.page_seq, r.page_id) for r in visits.orderBy("page_seq").collect()] == [(i + 1, 100 + i) for i in range(20)]
    base = '//html//body//div[contains(@class, "thumbnail")]//div[contains(@class, "caption")]'
    records = E.extract(site, {"Computer": base + "//h4//a[1]", "Description": base + "//p[1]"})
    placed = E.in_visit_order(records, visits).orderBy("page_seq", "container_pre").collect()
    assert [r.Computer for r in placed] == [f"C{n}-{i}" for n, size in enumerate(sizes) for i in range(size)]
    assert len(placed) == 117 and placed[0].Description == "about C0-0"


def test_missing_fields(pages):
    site = pages('<ul><li><b>1</b><i>a</i></li><li><i>b</i></li><li><b>3</b></li><li></li></ul>')
    fields = {"n": "//b//text()", "t": "//i//text()"}
    assert rows(E.extract_fields(site, "//ul//li", fields), "n", "t") == [("1", "a"), ("", "b"), ("3", "")]
    assert rows(E.extract_fields(site, "//ul//li", fields, fill=False), "n", "t") == [("1", "a"), (None, "b"), ("3", None)]
    records = E.extract_fields(site, "//ul//li", fields, fill=False)
    assert rows(E.fill_missing(records, ["n", "t"]), "n", "t") == [("1", "a"), ("", "b"), ("3", "")]
    assert E.drop_empty(records.withColumn("n", F.lit(None).cast("string")), ["n", "t"]).count() == 2
    lacking = E.missing_by_page(records, ["n", "t"]).collect()
    assert {(r.title, r.n_missing) for r in lacking} == {("n", 1), ("t", 1)}


def test_shells(pages):
    site = pages("<ul><li><b>1</b></li><li><b></b></li><li><b> </b></li><li>x</li></ul>")
    fields = {"n": "//b//text()", "t": "//text()"}
    got = rows(E.extract_fields(site, "//ul//li", fields, shells=True, clean=False), "n", "t")
    assert got == [("1", "1"), ("", ""), (" ", " "), (None, "x")]


def test_nested_containers_both_hold_the_text(pages):
    site = pages('<div class="c">a<div class="c">b</div></div>')
    got = rows(E.extract_fields(site, '//div[contains(@class, "c")]', {"t": "//text()"}), "container_pre", "t")
    assert got == [(3, "a b"), (5, "b")]


def test_text_is_joined_and_cleaned(pages):
    site = pages("<p>a <b>b</b>\n c&amp;amp;d</p>", "<p><br></p>")
    assert rows(E.extract(site, {"t": "//p"}), "page_id", "t") == [(0, "a b c&d")]


def test_unions_and_children(pages):
    site = pages("<dl><dt>a<dd>b</dl><dl><dd>c</dl>")
    assert rows(E.extract_fields(site, "//dl", {"t": "/dt/text() | ./dd/text()"}), "t") == [("a b",), ("c",)]
    both = rows(E.extract_fields(site, "//dt | //dd", {"t": "//text()"}), "t")
    assert both == [("a",), ("b",), ("c",)]


def test_tests_on_other_nodes(pages):
    html = "".join(f'<div class="r"><span>{k}</span><p><i>{v}</i></p></div>' for k, v in (("x", 1), ("y", 2), ("x", 3)))
    site = pages(html)
    got = E.extract_fields(site, '//div[.//span[text()="x"]]', {"v": "//p//i//text()", "none": "//u//text()"})
    assert rows(got, "v", "none") == [("1", ""), ("3", "")]
    got = E.extract_fields(site, "//div", {"k": "//span//text()", "v": '//p[.//i[text()="2"]]//text()'})
    assert rows(got, "k", "v") == [("x", ""), ("y", "2"), ("x", "")]


def test_preview(pages):
    site = pages("".join(f"<li>{i}</li>" for i in range(9)), "<li>z</li>")
    records = E.extract_fields(site, "//li", {"t": "//text()", "u": "//u"})
    shown = E.preview_fallback(E.preview(records), {"t": "T", "u": "U"}).orderBy("page_id", "row")
    assert [(r.t, r.u) for r in shown.collect()] == [("0", "U"), ("1", ""), ("2", ""), ("3", ""), ("4", ""), ("z", "U")]


def test_duplicate_titles_are_rejected():
    with pytest.raises(ValueError, match="duplicate"):
        E.record_schema(["a", "a"])


def test_path_without_a_container(pages):
    with pytest.raises(E.UnsupportedXPath, match="empty"):
        E.extract(pages("<div>x"), {"a": "//div/"})


def test_same_path_in_two_columns(pages):
    assert rows(E.extract(pages("<li>x</li>"), {"a": "//li", "b": "//li"}), "a", "b") == [("x", "x")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_templates_of_many_sites(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(rules, "fits_broadcast", lambda n, size: False)
    data = [
        (1, "https://www.a.com/1", '<ul class="p1"><li id="k">x<li>y</ul>'), (2, "http://a.com/2", "<ul><li>z&amp;amp;</ul>"),
        (3, "https://b.org/", "<table><tr><td>1<td>2</table>"), (4, "https://c.org/", "<ul><li>no template</ul>"),
    ]
    site = spark.createDataFrame(data, PAGE_SCHEMA)
    templates = spark.createDataFrame(
        [
            ("A", "https://a.com/", None, [("//ul//li", 1, None, None, "item")]),
            ("A2", "https://a.com/", None, [('//ul//li[@id="k"]', 1, None, None, "item")]),
            ("B", "https://www.b.org/x", None, [("//tr//td[1]", 1, None, None, None), ("//tr//td[2]", 2, None, None, "two")]),
            ("bad", "https://b.org/", None, [("//tr//td[last()]", 1, None, None, "t")]),
        ],
        E.TEMPLATE_SCHEMA,
    )
    with pytest.raises(E.UnsupportedXPath, match="template bad: .*last"):  # no template is left out in silence
        TP.extract_by_template(site, templates)
    fine = templates.filter("id <> 'bad'")
    got = TP.extract_by_template(site, fine).orderBy("template_id", "page_id", "container_pre").collect()
    assert [(r.template_id, r.page_id, r.record) for r in got] == [
        ("A", 1, {"item": "x"}), ("A", 1, {"item": "y"}), ("A", 2, {"item": "z&"}), ("A2", 1, {"item": "x"}),
        ("B", 3, {"1": "1", "two": "2"}),
    ]
    problems = {r.template_id: r.problem for r in TP.compile_templates(templates).collect()}
    assert "last()" in problems["bad"] and not problems["A"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_templates_with_tests_on_other_nodes(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(rules, "fits_broadcast", lambda n, size: False)
    html = (
        '<div class="c"><h2>Phones</h2><ul><li><b>new</b><a>one</a><i>1</i><li><a>two</a><i>2</i><li><b>new</b><a>three</a><i>3</i></ul></div>'
        '<div class="c"><h2>Books</h2><ul><li><b>new</b><a>four</a><i>4</i><li><b>old</b><a>five</a><i>5</i></ul></div><div><h2>Phones</h2><ul><li><b>new</b><a>six</a></ul></div>'
    )
    site = spark.createDataFrame([(1, "https://a.com/", html), (2, "https://b.com/", html)], PAGE_SCHEMA)
    paths = {
        "exists": ["//li[.//b]//a"], "text": ['//li//b[text()="new"]'], "inner text": ['//li[.//b[text()="old"]]//a'], "two": ["//li[.//b]//a", "//li[.//b]//i"],
        "rank": ["//li[.//b][2]//a"], "near": ['//div[@class="c"][2]//a'], "chain": ['//div[.//h2[text()="Phones"]]//li[.//b][1]//a'],
        "late class": ['//div[.//h2[text()="Phones"]][contains(@class, "c")]//a'], "union": ['//li[.//b[text()="old"]]//a | //li//a[text()="two"]'],
        "deep": ['//div[.//h2[text()="Books"]]//ul//li//a', '//div[.//h2[text()="Books"]]//ul//li//i'], "plain": ["//h2"], "none": ['//h2[text()="Cars"]'],
        "container and field": ['//div[.//h2[text()="Phones"]]//li//a[text()="one"]', '//div[.//h2[text()="Phones"]]//li//i'],
    }
    templates = spark.createDataFrame(
        [(name, "https://a.com/", None, [(x, i + 1, None, None, None) for i, x in enumerate(xs)]) for name, xs in paths.items()], E.TEMPLATE_SCHEMA
    )
    got = {}
    for r in TP.extract_by_template(site, templates).collect():
        assert r.page_id == 1
        got.setdefault(r.template_id, []).append((r.container_pre, r.record))
    for name, xs in paths.items():
        one = E.extract(site.filter("page_id = 1"), {str(i + 1): x for i, x in enumerate(xs)}).collect()
        want = sorted((r.container_pre, {str(i + 1): r[str(i + 1)] for i in range(len(xs))}) for r in one)
        assert sorted(got.get(name, []), key=lambda x: x[0]) == want, name
    assert len(got) == len(paths) - 1


def test_pagination_of_many_templates(spark):
    def page(n, *links):
        return f"<h1>{n}</h1>" + "".join(f'<div><a href="{h}" class="{c}"><span>{t}</span>{t}</a></div>' for t, h, c in links)

    data = [(i, f"https://a.com/{i}", page(i, ("First", "/0", ""), ("Next", f"/{i + 1}", "go"))) for i in range(9)]
    data += [(20 + i, f"https://b.com/{i}", f'<base href="/x/"><a rel=next href="../{(i + 1) % 3}#t">on</a>') for i in range(3)]
    data += [(30 + i, f"https://c.com/{i}", page(i, *([("L", "/3", "l")] if i != 1 else []), ("R", f"/{i + 1}", "r"))) for i in range(5)]
    site = spark.createDataFrame(data, PAGE_SCHEMA)
    column = [("//h1", 1, None, None, None)]
    rows = [
        ("text", "https://a.com/2", '/html/body/div/a[text()="Next"]'), ("inner", "https://a.com/0", '//a[.//span[text()="Next"]]'), ("cut", "https://a.com/0", '//a[@class="go"]'),
        ("below", "https://a.com/5", '//div[.//span[text()="Next"]]/a'), ("ring", "https://b.com/1", '//a[@rel="next"]'), ("one", "https://a.com/1", None), ("fake", "https://a.com/1", "fake"),
        ("list", "https://c.com/0", '//a[@class="r"]\n\n//a[@class="l"] \n//a[text()="R"]'), ("long list", "https://c.com/0", "\n".join(['//a[@class="r"]'] * 7)), ("nowhere", "https://z.com/", "//a"),
    ]
    templates = spark.createDataFrame([(n, u, p, column) for n, u, p in rows], E.TEMPLATE_SCHEMA)
    budgets = spark.createDataFrame([("cut", 3), ("inner", 0), ("list", 1)], "template_id string, max_pages int")
    got = {}
    for r in P.template_visits(site, templates, budgets).orderBy("template_id", "page_seq").collect():
        got.setdefault(r.template_id, []).append(r.page_id)
    assert got == {
        "text": [2, 3, 4, 5, 6, 7, 8], "inner": list(range(9)), "cut": [0, 1, 2], "below": [5, 6, 7, 8], "ring": [21, 22, 20], "one": [1], "fake": [1],
        "list": [30, 31, 32], "long list": [30, 31, 32, 33, 34],
    }
    bad = spark.createDataFrame([("t", "https://a.com/", "//a[last()]", column)], E.TEMPLATE_SCHEMA)
    with pytest.raises(E.UnsupportedXPath, match="template t: .*last"):
        P.template_visits(site, bad)


@pytest.mark.parametrize("n", [2, 3, 5, 8])
def test_lists_of_links_by_composition(spark, n):
    import random
    rng = random.Random(n)
    links = {(e, p): rng.randrange(6) for e in range(n) for p in range(6) if rng.random() < 0.5}
    edges = spark.createDataFrame([(e, p, q) for (e, p), q in links.items()], "entry int, page_id long, next_id long")
    want = []
    for seed in range(6):
        at, trail = seed, [seed]
        for e in range(n):
            if (e, at) in links:
                at = links[e, at]
                trail.append(at)
        want += [(seed, i + 1, p) for i, p in enumerate(trail)]
    assert visits(P.follow_lists(spark.range(6).select(F.col("id").alias("page_id")), edges, n)) == sorted(want)


def test_template_editing(spark):
    start = spark.createDataFrame(
        [("t", "u", None, [("//div//a[1]", 1, "x", 3, "a"), ("//div//a[2]", 2, "y", 4, None), ("//p", 3, "z", 5, "p")])], E.TEMPLATE_SCHEMA
    )
    columns = F.col("columns")
    got = start.select(
        E.combine_columns(columns, F.lit(3 - 1), F.lit(1)).alias("combined"),
        E.remove_column(columns, F.lit(1)).alias("removed"),
        E.rename_column(columns, F.lit(2), F.lit("b")).alias("renamed"),
        E.add_column(columns, F.lit("//q"), F.lit("w")).alias("added"),
    ).first()
    assert [(c.xpath, c.visual_index) for c in got.combined] == [("//div//a", 1), ("//p", 2)]
    assert [(c.xpath, c.visual_index) for c in got.removed] == [("//div//a[2]", 1), ("//p", 2)]
    assert [c.column_title for c in got.renamed] == ["a", "b", "p"]
    assert (got.added[3].xpath, got.added[3].visual_index, got.added[3].first_text) == ("//q", 4, "w")


# --- checks -----------------------------------------------------------------------------------------


def test_flags(pages):
    site = pages(
        '<iframe title="reCAPTCHA"></iframe>', '<input type=text><input type=PASSWORD>', '<input type="email">', "<iframe></iframe>", ""
    )
    flags = [(r.is_challenge, r.is_login) for r in C.page_flags(site).orderBy("page_id").collect()]
    assert flags == [(True, False), (False, True), (False, False), (False, False), (False, False)]
    assert sorted(r.page_id for r in C.without_challenges(site).collect()) == [1, 2, 3, 4]


def test_example_failures(pages):
    site = pages("<p>one <b>two</b></p>", "<p>one</p><p>two</p>", "<i>one two</i>")
    got = C.example_failures(site, {"a": ("//p", " one two\n"), "b": ("//body", "one")}).collect()
    assert {(r.page_id, r.title) for r in got} == {(1, "a"), (2, "a")}


def test_example_failures_by_template(spark):
    site = spark.createDataFrame([
        (0, "http://a.com/0", "<p>one <b>two</b></p><i>x</i>"), (1, "http://a.com/1", "<p>one</p><p>two</p><i>y</i>"),
        (2, "http://a.com/2", "<b>no</b>"), (3, "http://b.com/3", "<p>one &amp; two</p>"), (4, None, "<p>one two</p>"), (5, "http://c.com", "<p>q</p>"),
    ], PAGE_SCHEMA)
    none = [("//i", 4, None, None, "blank"), ("//i", 5, " ", None, "blank too")]
    templates = spark.createDataFrame([
        ("a", "http://a.com", None, [("//p", 1, " one  two\n", None, "all"), ("//p | //i", 2, "y", None, None), *none]),
        ("a2", "http://a.com/x", None, [("//p[.//b]", 1, "two", None, "tested")]),
        ("b", "http://b.com", None, [("//p", 1, "one &amp; two", None, "escaped"), ("//p", 2, "two one", None, "not")]),
    ], E.TEMPLATE_SCHEMA)
    got = {tuple(r) for r in C.example_failures_by_template(site, templates).collect()}
    assert got == {
        ("a", 1, "all"), ("a", 2, "all"), ("a", 0, "2"), ("a", 2, "2"), ("a2", 1, "tested"), ("a2", 2, "tested"), ("b", 3, "not"),
    }
    with pytest.raises(XP.UnsupportedXPath, match="template c"):
        C.example_failures_by_template(site, spark.createDataFrame([("c", "http://c.com", None, [("//p//text()", 1, "q", None, "t")])], E.TEMPLATE_SCHEMA))
    assert C.example_failures_by_template(site, templates.limit(0)).count() == 0


def test_regrouped_examples(pages):
    site = pages("<i>$</i><i>10</i><i>$</i><i>12</i>", "<i>$10</i><i>x</i>", "<i>y</i>")
    fragments = C.page_fragments(site, "//i").withColumn("text", F.lit("$10"))
    got = {r.page_id: r.found for r in C.regroup_check(fragments).collect()}
    assert got == {0: ["$10", "$12"], 1: ["$10", "x"], 2: None}


def test_growth(pages):
    site = pages("<p>a<p>b", "x")
    grown = C.page_growth(site, E.extract_fields(site, "//p", {"t": "//text()"})).orderBy("page_id").collect()
    assert [(r.n_rows, r.grew) for r in grown] == [(2, True), (0, False)]


# --- induction --------------------------------------------------------------------------------------

CLICKS = (
    '<div class="main col-2" id="m"><div class="card big">'
    '<p class="t">one</p><p class="t">two <b>three</b></p></div>'
    '<span> four </span><article>five</article></div>'
    '<ul class="pager"><li class="prev"><a href="/0">Prev</a></li><li class="next x9"><a href="/2" rel="next">More</a></li></ul>'
    '<button class="go"><em>Go</em></button><a class="k" aria-label="Skip"><span>Skip it</span></a>'
    '<a label="L"></a>'
)


def examples(spark, *texts):
    return spark.createDataFrame([(0, t, t) for t in texts], "page_id long, column_title string, text string")


def test_data_selectors(spark, pages):
    got = {r.text: r.xpath for r in I.induce_selectors(pages(CLICKS), examples(spark, "one", "two three", "three", " four", "five", "gone")).collect()}
    card_path = '//html//body//div[contains(@class, "main")]//div[contains(@class, "card big")]'
    assert got == {
        "one": card_path + '//p[1][contains(@class, "t")]',
        "two three": card_path + '//p[2][contains(@class, "t")]',
        "three": card_path + "//p//b[1]",
        " four": '//html//body//div[contains(@class, "main")]//span[1]',
        # a div is clickable, so a click on the article in it counts as well
        "five": '//html//body//div[contains(@class, "main")]//article[1]',
    }


def test_next_selectors(spark, pages):
    got = {r.text: r.xpath for r in I.induce_next_selector(pages(CLICKS), examples(spark, "More", "Prev", "Go", "Skip it", "one")).collect()}
    assert got == {
        "More": '/html/body/ul[contains(@class, "pager")]/li[contains(@class, "next")]/a[@rel="next"]',
        "Prev": '/html/body/ul[contains(@class, "pager")]/li[contains(@class, "prev")]/a[text()="Prev"]',
        "Go": '/html/body/button[contains(@class, "go")]/em[text()="Go"]',
        "Skip it": '/html/body/a[contains(@class, "k")]/span[text()="Skip it"]',
        "one": '/html/body/div[@id="m"]/div[contains(@class, "card big")]/p[text()="one"]',
    }


def test_next_selector_by_child(spark, pages):
    got = I.induce_next_selector(pages('<a href="/2"><span class="ic">Next <u class="q"></u></span> page</a>'), examples(spark, "Next  page")).collect()
    assert [r.xpath for r in got] == ['/html/body/a[.//span[text()="Next"]]']


def test_next_selector_by_text_of_first_child(spark, pages):
    page = '<p class="x">a</p><p><a><i class="big icon"><b class="t 1">?</b><u>!</u></i><em class="e"></em></a></p>'
    got = I.induce_next_selector(pages(page), examples(spark, "? !", "?!")).collect()
    assert [(r.text, r.xpath) for r in got] == [("?!", '/html/body/p/a/i[.//span[text()="?"]]')]


def test_shown_texts_of_random_pages(spark, monkeypatch):
    import random

    from tests.test_dom import AT, random_page
    rng = random.Random(3)
    for _ in range(60):
        rows = dom.page_rows(random_page(rng), None, None, None)
        text, ends = I._shown(rows)
        for row in rows:
            a, b = row[AT["pre"]], row[AT["last"]]
            own = "".join(r[AT["text"]] for r in rows if a <= r[AT["pre"]] <= b and r[AT["kind"]] == "text")
            assert " ".join(own.split()) == text[ends[a if row[AT["kind"]] == "element" else a - 1] : ends[b]].strip(" ")


def test_many_examples_of_one_page(spark, pages, monkeypatch):
    monkeypatch.setattr(I, "PAGE_EXAMPLES", 7)
    page = "".join(f"<ul><li>item {i}</ul>" for i in range(60))
    got = {r.text: r.xpath for r in I.induce_selectors(pages(page), examples(spark, *(f" item  {i} " for i in range(60)), "item 5")).collect()}
    assert len(got) == 61 and set(got.values()) == {"//html//body//ul//li[1]"}


def test_captured_examples(spark):
    clicks = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "a"), (1, 3, " "), (1, 4, "a"), (1, 5, "b"), (1, 6, "a"), (2, 1, "a")], "session long, ts long, text string"
    )
    for bucket in (None, F.floor(F.col("ts") / 2), F.col("ts")):
        got = I.capture_examples(clicks, order=("ts",), bucket=bucket)
        assert sorted((r.session, r.ts) for r in got.collect()) == [(1, 1), (1, 5), (1, 6), (2, 1)]


def test_sessions_in_ranges(spark):
    """Long sessions lie in many ranges; clicks without a session, ties of the first column and empty tables."""
    rng = random.Random(3)
    rows = [(rng.choice([None, "x", "x", "x", "y", f"s{i}"]), i // 2, i, rng.choice(["a", "a", "b", " ", None])) for i in range(600)]
    clicks = spark.createDataFrame(rows, "session string, ts long, click_id long, text string").repartition(7)
    want, previous = [], {}
    for session, _, click, text in rows:
        if text and text.strip():
            if previous.get(session) != text:
                want.append(click)
            previous[session] = text
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for bucket in (None, F.when(F.col("ts") > 9, F.floor(F.col("ts") / 9))):
            assert sorted(r.click_id for r in I.capture_examples(clicks, bucket=bucket).collect()) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert I.capture_examples(clicks.limit(0)).count() == 0


# --- pagination -------------------------------------------------------------------------------------


def ring(spark, n):
    data = [(i, f"http://s/{i}", f'<a class="n" href="/{(i + 1) % n}#x">next</a>' + ("<i>go</i>" if i else '<a id="j" href="4">j</a>')) for i in range(n)]
    return spark.createDataFrame(data, PAGE_SCHEMA)


def visits(df):
    return sorted((r.seed_id, r.page_seq, r.page_id) for r in df.collect())


def test_cycles_end(spark):
    site = ring(spark, 5)
    got = visits(P.page_chain(site, site.filter("page_id in (0, 3)").select("page_id"), '//a[@class="n"]'))
    assert got == [(s, k + 1, (s + k) % 5) for s in (0, 3) for k in range(5)]


def test_budget_and_single_pages(spark):
    site = ring(spark, 5)
    seeds = site.filter("page_id = 1").select("page_id")
    assert visits(P.page_chain(site, seeds, '//a[text()="next"]', 3)) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    for pagination, most in ((None, 9), ("fake", 9), ("", 9), ("//a", 1)):
        assert visits(P.page_chain(site, seeds, pagination, most)) == [(1, 1, 1)]


def test_link_list(spark):
    site = ring(spark, 5)
    seeds = site.filter("page_id in (0, 1)").select("page_id")
    got = visits(P.page_chain(site, seeds, '//a[@id="j"]\n \n//a[@class="n"]'))
    assert got == [(0, 1, 0), (0, 2, 4), (0, 3, 0), (1, 1, 1), (1, 2, 2)]


def test_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "page_id long, next_id long")
    seeds = spark.createDataFrame([(0,)], "page_id long")
    assert visits(P.follow(seeds, edges)) == [(0, i + 1, i) for i in range(n + 1)]
