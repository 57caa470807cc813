"""Pages to a relational node table.

One row per element or text node, in document order (`pre`). Each row carries `path`, the chain of
its ancestors-or-self written as text, so a location path is a regular expression on one column and
needs neither a join nor a shuffle. A step of `path` is

    SEP tag[idx]@pre (ATT name=value)*

A text node has the `path` of its parent element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SEP = "\x1e"
ATT = "\x1f"

# attributes that the induction of selectors reads off `path`
PATH_ATTRS = ("class", "id")

# HTML element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW_TEXT = frozenset("textarea title".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
SCOPE = frozenset("applet body button caption html marquee object table td template th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split()
)
# start tag -> (open elements it ends, elements it never looks past)
AUTO_CLOSE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"optgroup", "select", "datalist"}),
    "optgroup": ({"optgroup"}, {"select"}),
    "a": ({"a"}, SCOPE),
}
# start tags that may end other elements or open missing ones; all others just open
_STRUCTURAL = CLOSES_P | frozenset(AUTO_CLOSE) | {"html", "head", "body", "frameset"}
# an Arrow batch ends after so many nodes or characters of their paths and texts, also within a page
BATCH_NODES, BATCH_CHARS = 16_384, 1 << 26

# text up to a tag, and the tag if it is one: text, slash, name, attributes
_TOKEN = re.compile(
    r"""([^<]*+)(?:<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>)?+"""
)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_UNSAFE = re.compile(r"[\[\]@\x1e\x1f]")

NODE_FIELDS = {
    "pre": pa.int32(),
    "last": pa.int32(),
    "depth": pa.int32(),
    "parent_pre": pa.int32(),
    "kind": pa.string(),
    "tag": pa.string(),
    "idx": pa.int32(),
    "cls": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()),
    "text": pa.string(),
    "n_text": pa.int32(),
    "path": pa.string(),
}
SPARK_FIELDS = {
    "pre": T.IntegerType(),
    "last": T.IntegerType(),
    "depth": T.IntegerType(),
    "parent_pre": T.IntegerType(),
    "kind": T.StringType(),
    "tag": T.StringType(),
    "idx": T.IntegerType(),
    "cls": T.StringType(),
    "attrs": T.MapType(T.StringType(), T.StringType()),
    "text": T.StringType(),
    "n_text": T.IntegerType(),
    "path": T.StringType(),
}
NODE_COLUMNS = tuple(NODE_FIELDS)
_AT = {name: i for i, name in enumerate(NODE_COLUMNS)}


def _read_attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(raw):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class _Open:
    """An element that is still open."""

    __slots__ = ("tag", "pre", "parent", "idx", "attrs", "texts_before", "in_wanted", "seen", "row", "_path")

    def __init__(self, tag, pre, parent, idx, attrs, texts_before, in_wanted):
        self.tag, self.pre, self.parent, self.idx, self.attrs = tag, pre, parent, idx, attrs
        self.texts_before, self.in_wanted = texts_before, in_wanted
        self.seen: dict[str, int] = {}
        self._path = self.row = None

    def path(self, names: tuple[str, ...] | None) -> str:
        """Written only for elements that something is emitted from; from the outermost new one inwards, at any depth."""
        new, element = [], self
        while element is not None and element._path is None:
            new.append(element)
            element = element.parent
        above = element._path if element is not None else ""
        for element in reversed(new):
            above = element._path = above + element.step(names)
        return above

    def step(self, names: tuple[str, ...] | None) -> str:
        step = f"{SEP}{self.tag}[{self.idx}]@{self.pre}"
        if self.attrs:
            for name in self.attrs if names is None else names:
                if name in self.attrs:
                    step += f"{ATT}{name}={self.attrs[name].replace(SEP, ' ').replace(ATT, ' ')}"
        return step


def page_rows(
    html: str,
    elements: frozenset[str] | None,
    texts_in: frozenset[str] | None,
    path_attrs: tuple[str, ...] | None = PATH_ATTRS,
    implied_tbody: bool = True,
) -> list[list]:
    """Node rows of one page. `None` means "all"; an empty set means "none"."""
    rows: list[list] = []
    stack: list[_Open] = []
    pending: list[str] = []
    pre = texts = 0
    body_seen = False
    n_open: dict[str, int] = {}

    def flush() -> None:
        nonlocal pre, texts
        if not pending:
            return
        text = "".join(pending)
        pending.clear()
        if not text or not stack:
            return
        top = stack[-1]
        pre += 1
        texts += 1
        if texts_in is None or top.in_wanted:
            rows.append([pre, pre, len(stack) + 1, top.pre, "text", None, None, None, None, text, 1,
                         top.path(path_attrs)])

    def push(tag: str, attrs: dict[str, str]) -> None:
        nonlocal pre
        parent = stack[-1] if stack else None
        pre += 1
        idx = 1
        if parent is not None:
            idx = parent.seen.get(tag, 0) + 1
            parent.seen[tag] = idx
        wanted = texts_in is None or (parent is not None and parent.in_wanted) or tag in texts_in
        element = _Open(tag, pre, parent, idx, attrs, texts, wanted)
        if elements is None or tag in elements:
            parent_pre = parent.pre if parent else 0
            element.row = [pre, pre, len(stack) + 1, parent_pre, "element", tag, idx, attrs.get("class"),
                           list(attrs.items()), None, 0, element.path(path_attrs)]
            rows.append(element.row)
        stack.append(element)
        n_open[tag] = n_open.get(tag, 0) + 1

    def pop() -> None:
        if pending:
            flush()
        gone = stack.pop()
        n_open[gone.tag] -= 1
        if gone.row is not None:
            gone.row[_AT["last"]] = pre
            gone.row[_AT["n_text"]] = texts - gone.texts_before

    def pop_to(closed, barrier) -> bool:
        if not any(n_open.get(tag) for tag in closed):
            return False
        for i in range(len(stack) - 1, -1, -1):
            tag = stack[i].tag
            if tag in closed:
                flush()
                while len(stack) > i:
                    pop()
                return True
            if tag in barrier:
                return False
        return False

    def ensure_place(tag: str) -> None:
        """Open the html, head or body element that the page left out."""
        nonlocal body_seen
        if not stack:
            push("html", {})
        if len(stack) == 2 and stack[1].tag == "head" and tag not in HEAD_ONLY:
            pop()
        if len(stack) == 1 and tag not in ("head", "body", "frameset"):
            if tag in HEAD_ONLY and not body_seen and not stack[0].seen.get("head"):
                push("head", {})
            elif tag not in HEAD_ONLY:
                body_seen = True
                push("body", {})

    def start(tag: str, raw_attrs: str) -> None:
        nonlocal body_seen
        attrs = _read_attributes(raw_attrs) if raw_attrs else {}
        if pending and tag != "html":
            flush()
        if len(stack) < 3 and tag != "html":
            ensure_place(tag)
        if tag in _STRUCTURAL:
            if tag == "html":  # a second one is ignored
                if not stack:
                    push(tag, attrs)
                return
            if tag in ("head", "body"):
                if len(stack) == 1 and not stack[0].seen.get(tag):
                    body_seen = body_seen or tag == "body"
                    push(tag, attrs)
                return
            if tag in CLOSES_P and n_open.get("p"):
                pop_to(("p",), SCOPE)
            if tag in AUTO_CLOSE:
                pop_to(*AUTO_CLOSE[tag])
                if tag == "optgroup" and stack[-1].tag == "option":
                    pop()
                if implied_tbody and tag in ("tr", "td", "th") and stack[-1].tag == "table":
                    push("tbody", {})
                if tag in ("td", "th") and stack[-1].tag in ("tbody", "thead", "tfoot"):
                    push("tr", {})
            elif tag in HEADINGS and stack[-1].tag in HEADINGS:
                pop()
        push(tag, attrs)
        if tag in VOID:
            pop()

    def end(tag: str) -> None:
        if tag in ("html", "body"):
            return
        if stack and stack[-1].tag == tag:
            pop()
        elif tag in HEADINGS:
            pop_to(HEADINGS, SCOPE)
        elif tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot"):
            pop_to((tag,), {"table"} - {tag})
        elif not pop_to((tag,), SCOPE) and tag == "p":
            start("p", "")
            pop()

    def text(chunk: str) -> None:
        if "&" in chunk:
            chunk = unescape(chunk)
        if not chunk.isspace():
            if len(stack) < 2 or stack[-1].tag == "head":
                flush()
                ensure_place("")
            pending.append(chunk)
        elif stack:
            pending.append(chunk)

    at, size, token = 0, len(html), _TOKEN.match
    while at < size:
        found = token(html, at)
        chunk, slash, name, raw_attrs = found.groups()
        at = found.end()
        if chunk:
            text(chunk)
        if name is None and at < size:  # a `<` that begins no tag
            first, second = html[at + 1 : at + 2], html[at + 2 : at + 3]
            letter = second if first == "/" else first
            if letter.isascii() and letter.isalpha() or first == "/" and not second:
                break  # the page ends inside a tag
            if first in ("!", "?", "/"):  # a comment, a declaration, or what browsers read as a comment
                flush()
                closing, skip = ("-->", 3) if html.startswith("<!--", at) else (">", 1)
                stop = html.find(closing, at + 2)
                at = size if stop < 0 else stop + skip
            else:
                text("<")
                at += 1
        if name is None:
            continue
        tag = name.lower()
        if not tag.isalnum():
            tag = _UNSAFE.sub("_", tag)
        if slash:
            end(tag)
            continue
        start(tag, raw_attrs)
        if tag in RAW_TEXT or tag in ESCAPABLE_RAW_TEXT:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            stop = close.start() if close else size
            if stop > at:
                inner = html[at:stop]
                pending.append(unescape(inner) if tag in ESCAPABLE_RAW_TEXT else inner)
            at = stop
    while stack:
        pop()
    return rows


def dom_nodes(
    pages: DataFrame,
    *,
    elements: set[str] | None = None,
    texts_in: set[str] | None = None,
    path_attrs: tuple[str, ...] | None = None,
    columns: tuple[str, ...] = NODE_COLUMNS,
    keep: tuple[str, ...] = ("page_id",),
    html: str = "html",
    implied_tbody: bool = True,
) -> DataFrame:
    """Node table of `pages`, one narrow stage.

    `elements` limits the element rows to these tags, `texts_in` the text rows to those below one of
    these tags, `columns` and `path_attrs` the payload: column pruning cannot see into a Python
    stage, so callers name what they read. Without `path_attrs` a path has all attributes, so any test
    can be made on a table that is kept. Numbering (`pre`, `idx`, ...) is unaffected. `keep` are
    page columns repeated on every node.
    """
    wanted = [name for name in NODE_COLUMNS if name in columns]
    at = [_AT[name] for name in wanted]
    types = [NODE_FIELDS[name] for name in wanted]
    only = frozenset(elements) if elements is not None else None
    below = frozenset(texts_in) if texts_in is not None else None
    if below is not None and "*" in below:
        below = None
    if only is not None and "*" in only:
        only = None
    source = pages.select(*keep, F.col(html).alias("__html"))
    names = [*keep, *wanted]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(list(keep))
            owners: list[int] = []
            rows: list[list] = []
            chars = 0

            def pack() -> pa.RecordBatch:
                arrays = kept.take(pa.array(owners, pa.int32())).columns
                arrays += [pa.array([row[i] for row in rows], kind) for i, kind in zip(at, types)]
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for i, text in enumerate(batch.column("__html")):
                page = text.as_py()
                if not page:
                    continue
                for row in page_rows(page, only, below, path_attrs, implied_tbody):
                    rows.append(row)
                    owners.append(i)
                    chars += len(row[_AT["path"]]) + len(row[_AT["text"]] or "")
                    if len(rows) >= BATCH_NODES or chars >= BATCH_CHARS:
                        yield pack()
                        rows, owners, chars = [], [], 0
            if rows:
                yield pack()

    schema = T.StructType(
        [source.schema[name] for name in keep] + [T.StructField(name, SPARK_FIELDS[name]) for name in wanted]
    )
    return source.mapInArrow(tokenise, schema)


# Column expressions on `path`. A step ends at the next SEP or at the end of the text.
STEP_PRE = r"@(\d+)[^\x1e]*\z"
_STEP = r"\x1e([^\x1e\x1f\[]+)\[(\d+)\]@(\d+)[^\x1e]*"


def path_depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit(SEP), F.lit("")))


def path_head(path: Column, steps: Column) -> Column:
    """The first `steps` steps of a path."""
    return F.call_function("substring_index", path, F.lit(SEP), steps + F.lit(1))


def path_tail(path: Column, head: Column) -> Column:
    return F.substring(path, F.length(head) + F.lit(1), F.length(path))


def last_pre(path: Column) -> Column:
    """`pre` of the last step."""
    return F.regexp_extract(path, STEP_PRE, 1).cast("int")


def ancestor_pres(path: Column) -> Column:
    """D3: `pre` of every ancestor-or-self, root first."""
    return F.transform(F.regexp_extract_all(path, F.lit(_STEP), F.lit(3)), lambda x: x.cast("int"))


def path_steps(path: Column) -> Column:
    """The steps of a path, without the leading separator."""
    return F.filter(F.split(path, SEP), lambda step: step != "")


def full_path(path: Column) -> Column:
    """Absolute path with the index of every step; the last step names its class instead, if it has one."""
    indexed = F.regexp_replace(path, r"\x1e([^\x1e\x1f\[]+)(\[\d+\])@\d+[^\x1e]*", "/$1$2")
    cls = step_attribute(F.element_at(path_steps(path), -1), "class")
    leaf_class = F.concat(
        F.regexp_replace(indexed, r"\[\d+\]$", ""), F.lit('[contains(@class, "'), cls, F.lit('")]')
    )
    return F.when(cls != "", leaf_class).otherwise(indexed)


def step_tag(step: Column) -> Column:
    return F.substring_index(step, "[", 1)


def step_index(step: Column) -> Column:
    return F.regexp_extract(step, r"^[^\[]+\[(\d+)\]", 1)


def step_attribute(step: Column, name: str) -> Column:
    """Attribute of a step, or '' where it has none."""
    return F.regexp_extract(step, rf"\x1f{name}=([^\x1f]*)", 1)


def sibling_rank(nodes: DataFrame, name: str = "rank") -> DataFrame:
    """`idx` recomputed from the table. Keys are (page, parent, tag), so groups are sibling lists."""
    order = W.partitionBy("page_id", "parent_pre", "tag").orderBy("pre")
    return nodes.filter(F.col("kind") == "element").withColumn(name, F.row_number().over(order))
