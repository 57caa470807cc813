"""Main text of a page by text-to-tag ratios (Weninger, Hsu & Han, 2010).

Events of the standard library's streaming parser are cut into lines, one for each block of the page.
A line's ratio is its characters of text over its tags. The ratios are smoothed by a Gaussian, and
lines at or above a share of their standard deviation are clustered as content. The content region
is then the smallest container that holds nearly all of the clustered text, so that short blocks
between long ones stay. Elements that are never main text by tag or role leave no lines; those named
like menus, notices, adverts or comments leave none either, unless the page has nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dom import AUTO_CLOSE, CLOSES_P, HEAD_ONLY, HEADINGS, VOID

SIGMA = 1.0  # of the smoothing, in lines
RADIUS = 2  # lines that it reaches to either side
THRESHOLD = 0.7  # standard deviations from which a line is content
SHARE = 0.8  # of the clustered text, that the content region holds

#: tags whose content is no main text
NEVER = frozenset(
    "head script style noscript template nav header footer aside form button select textarea input label fieldset datalist "
    "dialog menu iframe object embed svg canvas audio video map noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: words of a class or id that name something beside the main text
NAMES = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead banner cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe signup ad ads adv advert adverts advertisement advertising sponsor sponsored "
    "promo promotion comment comments disqus reply replies respond share sharing social related recommended pagination pager "
    "form login search widget toolbar".split()
)
#: elements that begin and end a line
BLOCKS = CLOSES_P | frozenset(AUTO_CLOSE) | frozenset("html body td th caption colgroup legend optgroup option noscript".split())
#: elements that may be the content region
CONTAINERS = frozenset("html body main article section div td center".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def named_aside(attrs: dict[str, str | None]) -> bool:
    """Whether class or id has a word of NAMES; `has-sidebar` and the like say something else."""
    for name in ("class", "id"):
        for token in (attrs.get(name) or "").split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if not NAMES.isdisjoint(words) and not {"has", "with", "no", "without"} & set(words):
                return True
    return False


@dataclass
class Line:
    owner: int  # element it lies in
    text: str
    tags: int
    heading: bool
    links: int  # characters within links


@dataclass
class Page:
    """Elements by number: tag (`!` before one that is never main text), parent, the nearest element around or at it that is named aside (-1: none)."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    asides: list[int] = field(default_factory=lambda: [-1])
    lines: list[Line] = field(default_factory=list)


class _Lines(HTMLParser):
    """Parser events to lines. White space within a line is one space; `br` is white space."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open = [0]
        self.never = 0  # open elements of NEVER
        self.heads = 0  # open headers of an article
        self.links = 0
        self.pieces: list[str] = []
        self.tags = self.linked = 0
        self.heading = False

    def _end_line(self) -> None:
        if text := " ".join("".join(self.pieces).split()):
            self.page.lines.append(Line(self.open[-1], text, self.tags, self.heading, self.linked))
            self.tags = 0
        self.pieces, self.linked, self.heading = [], 0, False

    def _pop(self, upto: int) -> None:
        """Closes open elements from place `upto` on."""
        for number in self.open[upto:]:
            tag = self.page.tags[number]
            self.never -= tag.startswith("!")
            self.heads -= tag == "header"
            self.links -= tag == "a"
        del self.open[upto:]

    def _close(self, tags, stop) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.page.tags[self.open[at]].lstrip("!")
            if tag in tags:
                self._pop(at)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in BLOCKS:
            self._end_line()
            if tag in CLOSES_P:
                self._close({"p"}, CONTAINERS | {"table", "button"})
            if tag in AUTO_CLOSE:
                self._close(*AUTO_CLOSE[tag])
        elif tag == "br":
            self.pieces.append(" ")
        if tag == "a":
            self._close({"a"}, BLOCKS)
        elif tag == "body":
            self._close({"html"}, ())
        if self.page.tags[self.open[-1]] == "!head" and tag not in HEAD_ONLY:
            self._pop(len(self.open) - 1)  # the head ends without its end tag
        self.tags += not self.never
        if tag in VOID:
            return
        page = self.page
        above = self.open[-1]
        number = len(page.tags)
        head = tag == "header" and any(page.tags[n] in ("article", "main") for n in self.open)
        never = (tag in NEVER and not head) or values.get("role", "") in ROLES or "hidden" in values
        if tag in ("html", "body"):
            never = False
        aside = number if tag not in ("html", "body", "main") and named_aside(values) else page.asides[above]
        page.tags.append(f"!{tag}" if never else tag)
        page.parents.append(above)
        page.asides.append(aside)
        self.open.append(number)
        self.never += never
        self.heads += head and not never
        self.links += tag == "a" and not never
        if tag in HEADINGS:
            self.heading = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers read `<div/>`

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        elif tag == "br":
            self.pieces.append(" ")
        self.tags += not self.never
        # an inline end tag does not close the blocks around it
        self._close({tag}, frozenset() if tag in BLOCKS or tag in NEVER else BLOCKS)

    def handle_data(self, data):
        if self.never or (self.heads and not self.heading):
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(data.strip())


def parse(html: str) -> Page:
    """Lines of a page and the elements around them. An unfinished tag or comment at the end is no text."""
    reader = _Lines()
    reader.feed(html)
    if re.match(r"<(?:[a-zA-Z/!?]|$)", reader.rawdata):
        reader.rawdata = ""
    reader.close()
    reader._end_line()
    return reader.page


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian over the lines around; at the ends, over those that are there."""
    reach = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-0.5 * (reach / SIGMA) ** 2)
    mass = np.convolve(np.ones(len(ratios)), kernel)[RADIUS:len(ratios) + RADIUS]
    return np.convolve(ratios, kernel)[RADIUS:len(ratios) + RADIUS] / mass


def clustered(lines: list[Line]) -> np.ndarray:
    """Which lines are content by their smoothed ratio."""
    ratios = np.array([len(x.text) / max(1, x.tags) for x in lines], float)
    return smoothed(ratios) >= THRESHOLD * ratios.std()


def _inside(page: Page, weights: dict[int, int]) -> list[int]:
    """Characters in each element, those of its own and of all below it."""
    mass = [0] * len(page.tags)
    for number, n in weights.items():
        mass[number] += n
    for number in range(len(mass) - 1, 0, -1):
        mass[page.parents[number]] += mass[number]
    return mass


def _mass(page: Page, lines: list[Line]) -> list[int]:
    weights: dict[int, int] = {}
    for x in lines:
        weights[x.owner] = weights.get(x.owner, 0) + len(x.text)
    return _inside(page, weights)


def _without_asides(page: Page) -> list[Line]:
    """Lines outside of what is named aside.

    A name on the larger part of a page's text, in several lines, is not believed where no article or main stands beside it.
    """
    mass, several = _mass(page, page.lines), _inside(page, _counts(page.lines))
    prose = [False] * len(page.tags)
    for number in range(1, len(page.tags)):
        prose[number] = prose[page.parents[number]] or (page.tags[number] in ("article", "main") and page.asides[number] < 0)
    articles = _mass(page, [x for x in page.lines if prose[x.owner]])
    believed = [False] * len(page.tags)
    for number in range(1, len(page.tags)):
        whole = mass[number] * 2 > mass[0] and several[number] >= 3 and articles[0] == articles[number]
        believed[number] = (page.asides[number] == number and not whole) or believed[page.parents[number]]
    return [x for x in page.lines if not believed[x.owner]]


def _region(page: Page, lines: list[Line], content: np.ndarray) -> int:
    """Element that is the content region: an article or main, else the smallest container of two lines."""
    chosen = [x for x, good in zip(lines, content, strict=True) if good]
    mass = _mass(page, chosen)
    need = SHARE * sum(len(x.text) for x in chosen)
    chain = [n for n in range(len(mass)) if mass[n] >= need and page.tags[n] in CONTAINERS]
    for tags in (("article",), ("main",)):
        if found := [n for n in chain if page.tags[n] in tags]:
            return found[-1]
    several = _inside(page, _counts(chosen))
    wide = [n for n in chain if several[n] > 1 or page.tags[n] in ("html", "body")]
    return wide[-1] if wide else 0


def _counts(lines: list[Line]) -> dict[int, int]:
    n: dict[int, int] = {}
    for x in lines:
        n[x.owner] = n.get(x.owner, 0) + 1
    return n


def _spanned(lines: list[Line], content: list[bool]) -> list[Line]:
    """Without a container of its own: from the first content line to the last, and lines without links right beside them; no lists of links."""
    at = [i for i, good in enumerate(content) if good]
    if not at:
        return []
    first, last = at[0], at[-1]
    while first and not lines[first - 1].links:
        first -= 1
    while last + 1 < len(lines) and not lines[last + 1].links:
        last += 1
    return [x for x in lines[first:last + 1] if x.links * 2 <= len(x.text)]


def main_text(html: str | None) -> str:
    """Blocks of the main text, in page order, joined by line feeds; empty if there are none."""
    if not html:
        return ""
    page = parse(html)
    lines = _without_asides(page)
    if not lines:
        return ""
    content = clustered(lines)
    region = _region(page, lines, content)
    within = [False] * len(page.tags)
    for number in range(len(page.tags)):
        within[number] = number == region or (number > 0 and within[page.parents[number]])
    kept = [(x, good) for x, good in zip(lines, content, strict=True) if within[x.owner]]
    if page.tags[region] in ("", "html", "body"):
        return "\n".join(x.text for x in _spanned([x for x, _ in kept], [bool(good) for _, good in kept]))
    return "\n".join(x.text for x, _ in kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`key`, `url`, text, n_chars (code points) for every page.

    Null and empty html, and pages without main text: empty text, 0. Repeated rows each give a row, nulls in
    other columns stay; other columns are ignored. An empty table gives no rows. Pages are read whole, one at a
    time, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kind, address = (pages.schema[c].dataType.simpleString() for c in (key, url))
    return rows.mapInArrow(run, f"key {kind}, url {address}, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})


#: The same for pages whose article is marked as such, with paragraphs and one heading as its blocks.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*$', '') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS blocks FROM a),
c AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
