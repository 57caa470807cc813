"""Location paths over the node table.

A path made of child and descendant steps, positions and attribute tests is one regular expression on
`path`: a filter, no join. Tests that look at other nodes (`text()=`, `.//x` existence, a position
after another test) are grouped or ranked on the element they belong to, never on a whole page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import dom


class UnsupportedXPath(ValueError):
    """The path uses something outside the supported subset."""


@dataclass(frozen=True)
class Step:
    descendant: bool
    tag: str
    index: int | None = None
    attr_tests: tuple[tuple[str, str, str], ...] = ()  # (name, 'has' | 'is', value)
    far_tests: tuple[tuple, ...] = ()  # as written: ('text', value) | ('exists', steps) | ('nth', n) | ('near', attr_test)


@dataclass(frozen=True)
class Location:
    steps: tuple[Step, ...]
    text: str | None = None  # None | 'child' | 'descendant'
    attrs: frozenset[str] = field(default_factory=frozenset)


_STEP_HEAD = re.compile(r"(//?)(text\(\)|\*|[A-Za-z_][\w:.\-]*)")
_LITERAL = r"""(?:"([^"]*)"|'([^']*)')"""
_HAS = re.compile(rf"contains\(\s*@([\w:\-]+)\s*,\s*{_LITERAL}\s*\)\Z")
_IS = re.compile(rf"@([\w:\-]+)\s*=\s*{_LITERAL}\Z")
_TEXT = re.compile(rf"text\(\)\s*=\s*{_LITERAL}\Z")
SLASH_IN_LITERAL = re.compile(r"""="[^"]*/[^"]*"|='[^']*/[^']*'|,\s*"[^"]*/[^"]*"|,\s*'[^']*/[^']*'""")
_BAR = re.compile(r"""\|(?=(?:[^"']|"[^"]*"|'[^']*')*\Z)""")


def _tests(text: str, at: int) -> tuple[list[str], int]:
    """The bracketed tests that start at `at`."""
    found = []
    while text.startswith("[", at):
        depth, quote, i = 0, "", at
        while i < len(text):
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        if depth:
            raise UnsupportedXPath(f"unclosed test in {text!r}")
        found.append(text[at + 1 : i].strip())
        at = i + 1
    return found, at


def parse(xpath: str) -> Location:
    """Read one path of the subset; a leading '.' (relative path) is accepted."""
    text = xpath.strip().removeprefix(".")
    steps: list[Step] = []
    attrs: set[str] = set()
    at, ends_in = 0, None
    while at < len(text):
        head = _STEP_HEAD.match(text, at)
        if head is None or ends_in:
            raise UnsupportedXPath(f"cannot read {text[at:]!r} in {xpath!r}")
        axis, tag = head.groups()
        if "::" in tag or text.startswith("::", head.end()):
            raise UnsupportedXPath(f"axis in step {text[at:].split('/', 2 if axis == '/' else 3)[-1]!r} of {xpath!r}")
        at = head.end()
        if tag == "text()":
            ends_in = "descendant" if axis == "//" else "child"
            continue
        raw, at = _tests(text, at)
        index, near, far = None, [], []
        for test in raw:
            if test.isdigit():
                # an element knows its rank among those of its tag; any other rank is taken later
                if tag != "*" and index is None and not near and not far:
                    index = int(test)
                else:
                    far.append(("nth", int(test)))
            elif m := _HAS.match(test) or _IS.match(test):
                value = m[2] or m[3] or ""
                found = (m[1].lower(), "has" if m.re is _HAS else "is", value)
                if found[1] == "has" and not value:  # every text contains the empty one
                    continue
                attrs.add(found[0])
                if any(t[0] == "nth" for t in far):  # tests count in the order they are written
                    far.append(("near", found))
                else:
                    near.append(found)
            elif m := _TEXT.match(test):
                far.append(("text", m[1] or m[2] or ""))
            elif test.startswith(".//"):
                inner = parse(test)
                if inner.text or any(t[0] != "text" for s in inner.steps for t in s.far_tests):  # no rank inside a test
                    raise UnsupportedXPath(f"test [{test}] in {xpath!r}")
                if any(s.far_tests for s in inner.steps[:-1]):
                    raise UnsupportedXPath(f"test [{test}] in {xpath!r}")
                attrs |= inner.attrs
                far.append(("exists", inner.steps))
            else:
                raise UnsupportedXPath(f"test [{test}] in {xpath!r}")
        steps.append(Step(axis == "//", tag.lower(), index, tuple(near), tuple(far)))
    if not steps and not ends_in:
        raise UnsupportedXPath(f"empty path {xpath!r}")
    return Location(tuple(steps), ends_in, frozenset(attrs))


def split_union(xpath: str) -> list[str]:
    """The alternatives of `a | b` or `a|b`; a bar inside a literal does not split."""
    return [part for part in (p.strip() for p in _BAR.split(xpath)) if part]


def _quote(value: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", value)


def _step_regex(step: Step, capture: bool = False) -> str:
    tag = r"[^\x1e\x1f\[]+" if step.tag == "*" else _quote(step.tag)
    index = r"\d+" if step.index is None else str(step.index)
    looks = ""
    for name, test, value in step.attr_tests:
        tail = "" if test == "has" else r"(?=[\x1e\x1f]|\z)"
        any_text = r"[^\x1e\x1f]*" if test == "has" else ""
        looks += rf"(?=[^\x1e]*\x1f{_quote(name)}={any_text}{_quote(value)}{tail})"
    pre = r"(\d+)" if capture else r"\d+"
    return rf"\x1e{tag}\[{index}\]@{pre}{looks}[^\x1e]*+"


_GAP = r"(?:\x1e[^\x1e]*+)*?"


def _blocks(steps: tuple[Step, ...]) -> list[tuple[Step, ...]]:
    """Runs of child steps; each but a leading absolute one starts with `//`."""
    blocks: list[list[Step]] = []
    for step in steps:
        if step.descendant or not blocks:
            blocks.append([])
        blocks[-1].append(step)
    return [tuple(block) for block in blocks]


def _chain(blocks: list[tuple[Step, ...]], last_is_open: bool) -> str:
    """Between two `//` the earliest match is always enough, so every block but the last is atomic:
    matching stays linear in the depth for any number of `//`."""
    parts = []
    for i, block in enumerate(blocks):
        body = ("" if not block[0].descendant else _GAP) + "".join(map(_step_regex, block))
        parts.append(f"(?>{body})" if i < len(blocks) - 1 or last_is_open else body)
    return "".join(parts)


def steps_regex(steps: tuple[Step, ...], text: str | None = None) -> str:
    """Regular expression for a `path` (or the rest of one) that the steps select."""
    end = "" if text == "descendant" else r"\z"
    return r"\A" + _chain(_blocks(steps), text == "descendant") + end


def split_regex(outer: tuple[Step, ...], inner: tuple[Step, ...], text: str | None, last: bool) -> str:
    """Captures `pre` of the first (or last) step at which a path splits into `outer` and `inner`."""
    blocks = _blocks(outer)
    block = blocks[-1]
    gap = "" if not block[0].descendant else (_GAP[:-1] if last else _GAP)
    middle = gap + "".join(_step_regex(s, capture=i == len(block) - 1) for i, s in enumerate(block))
    end = "" if text == "descendant" else r"\z"
    rest = _chain(_blocks(inner), text == "descendant")
    return r"\A" + _chain(blocks[:-1], True) + middle + rest + end


def read_alternatives(xpath: str) -> list[Location]:
    parts = split_union(xpath)
    if not parts:
        raise UnsupportedXPath("empty path")
    return [parse(part) for part in parts]


def needs(locations: list[Location]) -> tuple[set[str], set[str], tuple[str, ...]]:
    """Element tags, text-bearing tags and attributes the tokeniser has to emit for these paths."""
    tags: set[str] = set()
    text_tags: set[str] = set()
    attrs: set[str] = set()
    for loc in locations:
        attrs |= loc.attrs
        for step in loc.steps:
            if step.far_tests:
                tags.add(step.tag)
            for test in step.far_tests:
                if test[0] == "text":
                    text_tags.add(step.tag)
                if test[0] == "exists":
                    tags.add(test[1][-1].tag)
                    if test[1][-1].far_tests:
                        text_tags.add(test[1][-1].tag)
        if loc.text:
            text_tags.add(loc.steps[-1].tag if loc.steps else "*")
        else:
            tags.add(loc.steps[-1].tag)
    return tags, text_tags, tuple(sorted(attrs))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def heads_where(path: Column, test) -> Column:
    """`pre` of each ancestor-or-self at which `test(head, tail)` splits the path."""
    heads = F.transform(F.sequence(F.lit(1), dom.path_depth(path)), lambda d: dom.path_head(path, d))
    return F.transform(F.filter(heads, lambda head: test(head, dom.path_tail(path, head))), dom.last_pre)


def owners_by(path: Column, first: Column, last: Column, test) -> Column:
    """`heads_where` for paths that split somewhere: mostly the first split is the last one, too."""
    low = F.call_function("regexp_extract", path, first, F.lit(1))
    high = F.call_function("regexp_extract", path, last, F.lit(1))
    return F.when(low == high, F.array(low.cast("int"))).otherwise(heads_where(path, test))


def owners(path: Column, outer: tuple[Step, ...], inner: tuple[Step, ...] = (), text: str | None = "descendant") -> Column:
    """`pre` of every ancestor-or-self that `outer` selects and from which `inner` leads to the path."""
    head, tail = steps_regex(outer), steps_regex(inner, text)
    return owners_by(
        path, F.lit(split_regex(outer, inner, text, False)), F.lit(split_regex(outer, inner, text, True)),
        lambda h, t: h.rlike(head) & t.rlike(tail),
    )


def owners_of_any(path: Column, locations: list[Location]) -> Column:
    """Ancestors-or-self that any of the locations selects."""
    if len(locations) == 1:
        return owners(path, locations[0].steps)
    regexes = [steps_regex(loc.steps) for loc in locations]
    return heads_where(path, lambda head, _: any_of([head.rlike(r) for r in regexes]))


def _marked(pres: Column, vote: int) -> Column:
    return F.transform(pres, lambda p: F.struct(p.alias("pre"), F.lit(vote).alias("vote")))


def _payload(nodes: DataFrame) -> list[str]:
    return [c for c in nodes.columns if c not in ("page_id", "pre")]


def _with_far_tests(nodes: DataFrame, run: tuple[Step, ...]) -> DataFrame:
    """Elements selected by `run`, whose last step has tests on other nodes.

    One pass: an element row votes for itself, a witness row (text node or inner element) votes for
    the element it proves; both meet in one group per element.
    """
    last = run[-1]
    regex = steps_regex(run)
    path, is_element = F.col("path"), F.col("kind") == "element"
    none = F.array().cast("array<int>")
    votes = [F.when(is_element & path.rlike(regex), F.array("pre")).otherwise(none)]
    later: list = []  # in the order written: a vote's number, a rank, or a test of the element's own attributes
    for test in last.far_tests:
        if test[0] == "text":
            hit = (F.col("kind") == "text") & (F.col("text") == test[1]) & path.rlike(regex)
            later.append(("vote", len(votes)))
            votes.append(F.when(hit, F.array("parent_pre")).otherwise(none))
        elif test[0] == "exists":
            inner = test[1]
            if inner[-1].far_tests:
                witness = (F.col("kind") == "text") & reduce(
                    lambda a, b: a & b, [F.col("text") == value for _, value in inner[-1].far_tests]
                )
            else:
                witness = is_element
            witness = witness & path.rlike(steps_regex((*run, *inner)))
            found = owners(path, run, inner, None)
            later.append(("vote", len(votes)))
            votes.append(F.when(witness, found).otherwise(none))
        else:
            later.append(test)
    carried = _payload(nodes)
    ballots = F.flatten(F.array(*[_marked(v, i) for i, v in enumerate(votes)]))
    cast = nodes.withColumn("__b", F.explode(ballots)).select(
        "page_id", F.col("__b.pre").alias("pre"), F.col("__b.vote").alias("__vote"),
        F.when(F.col("__b.vote") == 0, F.struct(*carried)).alias("__row"),
    )
    counted = cast.groupBy("page_id", "pre").agg(
        F.first("__row", ignorenulls=True).alias("__row"),
        *[F.max(F.col("__vote") == i).alias(f"__v{i}") for i in range(len(votes))],
    )
    given = [f"__v{i}" for i in range(1, len(votes))]
    chosen = counted.filter("__v0").select("page_id", "pre", *given, *[F.col(f"__row.{c}").alias(c) for c in carried])
    for kind, value in later:
        if kind == "vote":
            chosen = chosen.filter(f"__v{value}")
        elif kind == "near":
            own = _step_regex(Step(False, "*", attr_tests=(value,))) + r"\z"
            chosen = chosen.filter(F.col("path").rlike(own))
        else:  # the n-th of those that passed so far, among the children of one parent
            order = W.partitionBy("page_id", "parent_pre").orderBy("pre")
            chosen = chosen.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == value).drop("__n")
    return chosen.drop(*given)


def select_nodes(nodes: DataFrame, xpath: str, text: str | None = None) -> DataFrame:
    """Rows of `nodes` selected by `xpath`, once each.

    With `text` only elements whose own string value contains it are kept (D14, Q1).
    `nodes` must hold all node columns; tests on other nodes read it again for every further run.
    """
    locations = read_alternatives(xpath)
    near = [loc for loc in locations if not any(s.far_tests for s in loc.steps)]
    far = [loc for loc in locations if loc not in near]
    parts = []
    if near:
        tests = []
        for loc in near:
            kind = "text" if loc.text else "element"
            tests.append((F.col("kind") == kind) & F.col("path").rlike(steps_regex(loc.steps, loc.text)))
        parts.append(nodes.filter(any_of(tests)))
    parts += [_select_far(nodes, loc) for loc in far]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    if len(parts) > 1:
        found = found.dropDuplicates(["page_id", "pre"])
    if text is not None:
        return _holding(nodes, xpath, found, text, one_pass=not far)
    return found


def _holding(nodes: DataFrame, xpath: str, found: DataFrame, text: str, one_pass: bool) -> DataFrame:
    """Elements of `found` with their `string_value`, where that contains `text`."""
    if not one_pass:
        values = selected_texts(nodes, xpath).filter(F.contains("string_value", F.lit(text)))
        return found.join(values, ["page_id", "pre"])
    # elements and the texts inside them meet in one group per element, out of one scan
    carried = _payload(nodes)
    locations = read_alternatives(xpath)
    path, is_text = F.col("path"), F.col("kind") == "text"
    inside = any_of([path.rlike(steps_regex(loc.steps, "descendant")) for loc in locations])
    itself = any_of([path.rlike(steps_regex(loc.steps)) for loc in locations])
    return (
        nodes.filter(F.when(is_text, inside).otherwise(itself))
        .select(
            "page_id", F.explode(F.when(is_text, owners_of_any(path, locations)).otherwise(F.array("pre"))).alias("__owner"),
            F.when(is_text, F.struct("pre", "text")).alias("__part"),
            F.when(~is_text, F.struct(*carried)).alias("__row"),
        )
        .groupBy("page_id", F.col("__owner").alias("pre"))
        .agg(F.first("__row", ignorenulls=True).alias("__row"), F.array_sort(F.collect_list("__part")).alias("__parts"))
        .withColumn("string_value", F.array_join(F.transform("__parts", lambda x: x["text"]), ""))
        .filter(F.contains("string_value", F.lit(text)))
        .select("page_id", "pre", *[F.col(f"__row.{c}").alias(c) for c in carried], "string_value")
    )


def _select_far(nodes: DataFrame, loc: Location) -> DataFrame:
    done: DataFrame | None = None
    run: list[Step] = []
    runs: list[list[Step]] = []
    for step in loc.steps:
        run.append(step)
        if step.far_tests:
            runs.append(run)
            run = []
    if run or loc.text:
        runs.append(run)
    walked: list[Step] = []
    for i, run in enumerate(runs):
        final_text = loc.text if i == len(runs) - 1 else None
        bare = tuple([*walked, *run])
        if run and run[-1].far_tests:
            found = _with_far_tests(nodes, bare)
        else:
            kind = "text" if final_text else "element"
            found = nodes.filter((F.col("kind") == kind) & F.col("path").rlike(steps_regex(bare, final_text)))
        if done is not None:
            above = owners(F.col("path"), tuple(walked), tuple(run), final_text)
            context = done.select("page_id", F.col("pre").alias("__owner"))
            found = (
                found.withColumn("__owner", F.explode(above))
                .join(context, ["page_id", "__owner"], "left_semi")
                .drop("__owner")
                .dropDuplicates(["page_id", "pre"])
            )
        done = found
        walked += run
    return done


def ordered_text(value: str = "text", order: str = "pre", glue: str = "") -> Column:
    """Text nodes of a group in document order, as one string."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return F.array_join(F.transform(ordered, lambda x: x[value]), glue)


def selected_texts(nodes: DataFrame, xpath: str) -> DataFrame:
    """(page_id, pre, string_value) of each element selected by `xpath` that holds text.

    A text node goes only to the ancestors the path selects, not to all of them. Tests on other
    nodes are left out here; join with `select_nodes` to apply them.
    """
    locations = read_alternatives(xpath)
    path = F.col("path")
    inside = any_of([path.rlike(steps_regex(loc.steps, "descendant")) for loc in locations])
    return (
        nodes.filter((F.col("kind") == "text") & inside)
        .select("page_id", F.col("pre").alias("__at"), "text", F.explode(owners_of_any(path, locations)).alias("pre"))
        .groupBy("page_id", "pre")
        .agg(ordered_text("text", "__at").alias("string_value"))
    )


def match_counts(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Matches per page and selector, in one pass for selectors without tests on other nodes.

    A selector with such tests is counted in a pass of its own, on `nodes` with all columns.
    """
    hits, parts = [], []
    for name, xpath in selectors.items():
        locations = read_alternatives(xpath)
        if any(s.far_tests for loc in locations for s in loc.steps):
            parts.append(select_nodes(nodes, xpath).select("page_id", F.lit(name).alias("selector")))
            continue
        tests = []
        for loc in locations:
            kind = "text" if loc.text else "element"
            tests.append((F.col("kind") == kind) & F.col("path").rlike(steps_regex(loc.steps, loc.text)))
        hits.append(F.when(any_of(tests), F.lit(name)))
    if hits:
        parts.append(nodes.select("page_id", F.explode(F.array_compact(F.array(*hits))).alias("selector")))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("page_id", "selector").agg(F.count(F.lit(1)).alias("n_matches"))


def strip_text_step(xpath: Column) -> Column:
    """Element path of a text path."""
    return F.regexp_replace(xpath, r"//text\(\)$", "")
