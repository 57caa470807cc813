"""The tokeniser on hand-made pages, and the invariants of the node table."""

import random

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import dom
from pagesieve.operators.dom import NODE_COLUMNS, page_rows

AT = {name: i for i, name in enumerate(NODE_COLUMNS)}


def tree(html, **options):
    """The page as nested text: tag(children) with texts quoted."""
    rows = page_rows(html, None, None, **options)
    children = {}
    for row in rows:
        children.setdefault(row[AT["parent_pre"]], []).append(row)

    def show(row):
        if row[AT["kind"]] == "text":
            return repr(row[AT["text"]])
        inner = " ".join(show(c) for c in children.get(row[AT["pre"]], []))
        return f"{row[AT['tag']]}({inner})" if inner else row[AT["tag"]]

    return " ".join(show(r) for r in children.get(0, []))


def body(html, **options):
    whole = tree(html, **options)
    start = whole.index("body(") + 5
    return whole[start:-2]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<html><body><h1>Hello, world!</h1></body></html>", "html(body(h1('Hello, world!')))"),
        ("<h1>x</h1>", "html(body(h1('x')))"),
        ("plain", "html(body('plain'))"),
        ("<title>a &amp; b</title><p>c", "html(head(title('a & b')) body(p('c')))"),
        ("<html><head><title>t</title></head><body>x</body></html>", "html(head(title('t')) body('x'))"),
        ("", ""),
    ],
)
def test_whole_pages(html, expected):
    assert tree(html) == expected


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a<br>b<img src=x>c", "p('a' br 'b' img 'c')"),
        ("<p>a<p>b<div>c</div>", "p('a') p('b') div('c')"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "ul(li('a') li('b' ul(li('c'))) li('d'))"),
        ("<p><b>x<br><p>y</p>", "p(b('x' br)) p('y')"),
        ("<b>x<p>y</b>z", "b('x' p('y')) 'z'"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt('a') dd('b') dt('c'))"),
        ("<select><option>a<option>b</select>", "select(option('a') option('b'))"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "table(tbody(tr(td('a') td('b')) tr(td('c'))))"),
        ("<table><tbody><tr><td><p>a</td></tr></tbody></table>", "table(tbody(tr(td(p('a')))))"),
        ("<table><tr><td><table><tr><td>a</table>b</table>", "table(tbody(tr(td(table(tbody(tr(td('a')))) 'b'))))"),
        ("<script>if (a<b) {'</p>'}</script>x", "script(\"if (a<b) {'</p>'}\") 'x'"),
        ("<textarea><b>&lt;</textarea>x", "textarea('<b><') 'x'"),
        ("a<!-- <p> -->b", "'a' 'b'"),
        ("a</i>b", "'ab'"),
        ("<div>1 < 2</div>", "div('1 < 2')"),
        ("&amp; &copy &nbsp;&#65; &x", "'& © \\xa0A &x'"),
        ("<div> <p>a</p> </div>", "div(' ' p('a') ' ')"),
        ("<div><div>a</div><div>b", "div(div('a') div('b'))"),
        ("</p>x", "p 'x'"),
        ("<p>a</p><a href=\"/cut", "p('a')"),
        ("<h1>a<h2>b</h1>c", "h1('a') h2('b') 'c'"),
        ("<a href=x>a<a href=y>b</a>", "a('a') a('b')"),
        ("<P CLASS=big>a</P>", "p('a')"),
        ("a </ x>b<? c >d<![CDATA[e]]>f", "'a ' 'b' 'd' 'f'"),
        ("a <", "'a <'"),
        ("a</", "'a'"),
        ("<3 & <a", "'<3 & '"),
        ("<a title=\"x>y</a> \"z\">w", "a('w')"),
    ],
)
def test_bodies(html, expected):
    assert body("<body>" + html) == expected


def test_table_body_is_optional():
    assert body("<body><table><tr><td>a</table>", implied_tbody=False) == "table(tr(td('a')))"


def test_attributes():
    rows = page_rows("""<div ID='a' class="b &amp; c" data-x=1 checked x = "y>z" id=second>""", frozenset(["div"]), frozenset())
    assert dict(rows[0][AT["attrs"]]) == {"id": "a", "class": "b & c", "data-x": "1", "checked": "", "x": "y>z"}
    assert rows[0][AT["cls"]] == "b & c"
    assert rows[0][AT["path"]] == "\x1ehtml[1]@1\x1ebody[1]@2\x1ediv[1]@3\x1fclass=b & c\x1fid=a"


def test_deep_pages_keep_their_text():
    rows = page_rows("<div>x" * 3000, frozenset(["div"]), None)
    assert max(r[AT["depth"]] for r in rows if r[AT["kind"]] == "element") == 3002
    assert sum(r[AT["kind"]] == "text" for r in rows) == 3000


def test_text_behind_deep_nesting_stays_where_it_is():
    rows = page_rows('<div id="outer">' + "<div>" * 600 + "</div>" * 600 + "<p>after</p></div><p>out</p>", frozenset(["p"]), None, ("id",))
    inside, outside = [r[AT["path"]] for r in rows if r[AT["kind"]] == "element"]
    assert "id=outer" in inside and "id=outer" not in outside


def test_batches_end_within_a_page(spark, pages, monkeypatch):
    monkeypatch.setattr(dom, "BATCH_CHARS", 5000)
    site = pages("<div>x" * 200, "<p>y</p>" * 50)
    assert dom.dom_nodes(site).count() == 200 * 2 + 2 + 50 * 2 + 2


def random_page(rng):
    tags = ["div", "p", "b", "ul", "li", "table", "tr", "td", "a", "br", "h1", "span", "option", "select", "head", "body"]
    parts = []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        tag = rng.choice(tags)
        if kind < 0.45:
            parts.append(f"<{tag} class='c{rng.randint(0, 3)}'>")
        elif kind < 0.75:
            parts.append(f"</{tag}>")
        else:
            parts.append(rng.choice(["x", " ", "y &amp; z", "<!-- c -->", "<"]))
    return "".join(parts)


def check_invariants(rows):
    last_at = {}
    open_until, siblings = {0: 10**9}, {}
    for row in rows:
        pre, last, parent = row[AT["pre"]], row[AT["last"]], row[AT["parent_pre"]]
        assert pre not in last_at and pre <= last <= open_until[parent]
        last_at[pre] = open_until[pre] = last
        if row[AT["kind"]] == "element":
            key = (parent, row[AT["tag"]])
            siblings[key] = siblings.get(key, 0) + 1
            assert row[AT["idx"]] == siblings[key]
            assert row[AT["path"]].count("\x1e") == row[AT["depth"]]
            inside = [r for r in rows if r[AT["kind"]] == "text" and pre < r[AT["pre"]] <= last]
            assert row[AT["n_text"]] == len(inside)
        else:
            assert row[AT["path"]].count("\x1e") == row[AT["depth"]] - 1
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)


def test_invariants_on_random_pages():
    rng = random.Random(7)
    for _ in range(400):
        page = random_page(rng)
        rows = page_rows(page, None, None)
        check_invariants(rows)
        # a limited emission is a part of the whole one, with the same numbers
        some = page_rows(page, frozenset(["li", "a"]), frozenset(["li"]))
        whole = {r[0]: r for r in rows}
        assert all(whole[r[0]] == r for r in some)
        assert {r[0] for r in some if r[AT["kind"]] == "element"} == {
            r[0] for r in rows if r[AT["tag"]] in ("li", "a")
        }
        assert {r[0] for r in some if r[AT["kind"]] == "text"} == {
            r[0] for r in rows if r[AT["kind"]] == "text" and "\x1eli[" in r[AT["path"]]
        }


def test_node_table(spark, pages):
    nodes = dom.dom_nodes(pages("<div id=a><p>x</p><p>y</p></div>", "", None))
    assert nodes.columns == ["page_id", *NODE_COLUMNS]
    chosen = nodes.filter("tag = 'p' and idx = 2").select(
        "page_id", "parent_pre", "attrs", dom.full_path(F.col("path")).alias("f"), dom.ancestor_pres(F.col("path")).alias("a")
    )
    assert [tuple(r) for r in chosen.collect()] == [(0, 3, {}, "/html[1]/body[1]/div[1]/p[2]", [1, 2, 3, 6])]
    assert nodes.select("page_id").distinct().count() == 1
    wrong = dom.sibling_rank(nodes).filter("rank <> idx").count()
    assert wrong == 0


def test_one_pass_without_shuffle(pages):
    plan = dom.dom_nodes(pages("<p>x"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
