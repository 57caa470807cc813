"""Paths of many templates as data: rows that meet the node table in one join.

A path without tests on other nodes is one regular expression. Where a step has such tests, it is a
*gate*: elements that pass are found by votes. An element votes for itself (vote 0), a witness (a text
node or an inner element) for the element it proves. The votes of all templates meet in one group per
(template, page, gate, element) as a bit mask; ranks are taken among those that pass so far. A gate may
stand below another one.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import urls as U
from ..session import written
from . import dom
from . import xpath as XP
from .joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join
from .xpath import Location, Step, UnsupportedXPath, split_regex, steps_regex


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_TEXT, _INT, _BOOL = T.StringType(), T.IntegerType(), T.BooleanType()
#: where a path splits into what leads to an element above and what leads on from it
SPLIT = _struct(("gate", _TEXT), ("first", _TEXT), ("last", _TEXT), ("head", _TEXT), ("tail", _TEXT))
#: one test of a gate, in the order written: a vote, a test of the element's own attributes, or a rank
TEST = _struct(("kind", _TEXT), ("vote", _INT), ("regex", _TEXT), ("n", _INT))
RULE = _struct(
    ("kind", _TEXT),  # cell | vote | base
    ("full", _TEXT), ("on_text", _BOOL), ("value", _TEXT),  # which nodes
    ("split", SPLIT),  # container of a cell, or element that an inner witness proves
    ("field", _INT), ("outer_gate", SPLIT), ("inner_gate", SPLIT),  # of a cell
    ("gate", _TEXT), ("vote", _INT), ("owner", _TEXT),  # of a vote; owner: self | parent | split
    ("tests", T.ArrayType(TEST)), ("level", _INT), ("above", SPLIT), ("entry", _INT),  # of vote 0
)
COMPILED = _struct(
    ("rules", T.ArrayType(RULE)), ("tags", T.ArrayType(_TEXT)), ("text_tags", T.ArrayType(_TEXT)), ("attrs", T.ArrayType(_TEXT)), ("problem", _TEXT)
)


def _split(outer: tuple[Step, ...], inner: tuple[Step, ...], text: str | None, gate: str | None = None) -> dict:
    return {
        "gate": gate, "first": split_regex(outer, inner, text, False), "last": split_regex(outer, inner, text, True),
        "head": steps_regex(outer), "tail": steps_regex(inner, text),
    }


def _key(steps: tuple[Step, ...], entry: int | None = None) -> str:
    return hashlib.md5(repr((steps, entry)).encode()).hexdigest()[:16]


def gate_votes(steps: tuple[Step, ...], ends: tuple[int, ...]) -> list[dict]:
    """Votes for the gates at the steps `ends` of a path, each below the one before."""
    rules = []
    for level, end in enumerate(ends):
        run = steps[: end + 1]
        gate, tests, votes = _key(run), [], []
        for test in run[-1].far_tests:
            kind = test[0]
            if kind == "nth":
                tests.append({"kind": "nth", "n": test[1]})
            elif kind == "near":
                tests.append({"kind": "near", "regex": XP._step_regex(Step(False, "*", attr_tests=(test[1],))) + r"\z"})
            else:
                number = len(votes) + 1
                tests.append({"kind": "vote", "vote": number})
                vote = {"kind": "vote", "gate": gate, "vote": number}
                if kind == "text":
                    votes.append(vote | {"full": steps_regex(run), "on_text": True, "value": test[1], "owner": "parent"})
                    continue
                inner = test[1]
                values = {value for _, value in inner[-1].far_tests}
                if len(values) > 1:
                    raise UnsupportedXPath(f"more than one text of one node: {sorted(values)}")
                found = {"on_text": bool(values), "value": min(values, default=None), "owner": "split", "split": _split(run, inner, None)}
                votes.append(vote | {"full": steps_regex((*run, *inner))} | found)
        if len(votes) > 30:
            raise UnsupportedXPath("more than 30 tests on other nodes at one step")
        above = _split(steps[: ends[level - 1] + 1], steps[ends[level - 1] + 1 : end + 1], None, _key(steps[: ends[level - 1] + 1])) if level else None
        itself = {"kind": "vote", "gate": gate, "vote": 0, "full": steps_regex(run), "on_text": False, "owner": "self", "tests": tests, "level": level, "above": above}
        rules += [itself, *votes]
    return rules


def _marks(steps: tuple[Step, ...]) -> list[int]:
    return [i for i, step in enumerate(steps) if step.far_tests]


def field_rules(outer: Location, inner: Location, field: int) -> dict:
    """The cell rule of one field path below its container, with the votes for its gates."""
    steps, n = (*outer.steps, *inner.steps), len(outer.steps)
    text = inner.text or "descendant"
    marks = _marks(steps)
    above, below = [m for m in marks if m < n], [m for m in marks if m >= n]
    if len(below) > 1:
        raise UnsupportedXPath("a column path may test other nodes at one step only")
    cell = {"kind": "cell", "field": field, "full": steps_regex(steps, text), "on_text": True, "split": _split(outer.steps, inner.steps, text)}
    if above:
        m = above[-1] + 1
        cell["outer_gate"] = _split(steps[:m], steps[m:n], None, _key(steps[:m]))
    if below:
        m = below[-1] + 1
        cell["inner_gate"] = _split(steps[:m], steps[m:], text, _key(steps[:m]))
    tags, text_tags, attrs = XP.needs([Location(steps, text, outer.attrs | inner.attrs)])
    return {"rules": [cell, *gate_votes(steps, tuple(marks))], "tags": sorted(tags), "text_tags": sorted(text_tags), "attrs": sorted(attrs)}


def link_rules(path: Location, entry: int) -> dict:
    """The votes for the elements a pagination path selects; the last gate is the path's own."""
    if path.text:
        raise UnsupportedXPath("a pagination path selects elements, not texts")
    ends = sorted({*_marks(path.steps), len(path.steps) - 1})
    rules = gate_votes(path.steps, tuple(ends))
    # gates on the way are shared; the last says which entry of the list it serves
    last = _key(path.steps)
    mine = _key(path.steps, entry)
    for rule in rules:
        if rule["gate"] == last:
            rule["gate"] = mine
            if rule["vote"] == 0:
                rule["entry"] = entry
    tags, text_tags, attrs = XP.needs([path])
    return {"rules": rules, "tags": sorted(tags), "text_tags": sorted(text_tags), "attrs": sorted(attrs)}


def compiled(kind, *columns: Column) -> Column:
    """COMPILED for each row: `kind(*values)` gives its parts or raises UnsupportedXPath, which is noted as the problem."""

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for values in rows.itertuples(index=False):
            try:
                out.append(json.dumps(kind(*values)))
            except UnsupportedXPath as error:
                out.append(json.dumps({"rules": [], "tags": [], "text_tags": [], "attrs": [], "problem": str(error)}))
        return pd.Series(out)

    return F.from_json(run(F.struct(*columns)), COMPILED)


def matched(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes of a domain with every rule of its templates that they fit; `rules` is broadcast: its size is the caller's to check."""
    rule = "single.rule"
    fits = F.expr(f"nodes.domain = single.domain AND {rule}.on_text = (nodes.kind = 'text') AND rlike(nodes.path, {rule}.full) AND ({rule}.value IS NULL OR nodes.text = {rule}.value)")
    return nodes.alias("nodes").join(F.broadcast(rules.alias("single")), fits).drop("domain")


def fits(rule: Column) -> Column:
    """The same for rules that travel with the nodes."""
    value = rule["value"].isNull() | (F.col("text") == rule["value"])
    return (rule["on_text"] == (F.col("kind") == "text")) & F.rlike(F.col("path"), rule["full"]) & value


def above(path: Column, split: Column) -> Column:
    """`pre` of each element at which a path splits as it should."""
    return XP.owners_by(path, split["first"], split["last"], lambda h, t: F.rlike(h, split["head"]) & F.rlike(t, split["tail"]))


def container_path(path: Column, pre: Column) -> Column:
    """The part of a path down to the element `pre`."""
    step = F.concat(F.lit(r"\A[\s\S]*?\x1e[^\x1e\x1f]*@"), pre.cast("string"), F.lit(r"(?:\x1f[^\x1e]*)?(?=\x1e|\z)"))
    return F.call_function("regexp_extract", path, step, F.lit(0))


GATED = ["template_id", "page_id", "gate", "pre"]


def passing(found: DataFrame, ranks: list[int], most: int, levels: int) -> DataFrame:
    """Elements that pass their gate: template_id, page_id, gate, pre, entry and what vote 0 carries in `own`.

    found: matched rows, read once per level of gates below gates, so written where that is costly. ranks: places
    in the order of tests at which some gate takes a rank; most: the largest number of tests of a gate; levels:
    how deep gates stand below gates.
    """
    rule = F.col("rule")
    owner = F.when(rule["owner"] == "self", F.array("pre")).when(rule["owner"] == "parent", F.array("parent_pre")).otherwise(above(F.col("path"), rule["split"]))
    own = F.when(rule["vote"] == 0, F.struct("parent_pre", "path", "attrs", rule["tests"].alias("tests"), rule["level"].alias("level"), rule["above"].alias("above"), rule["entry"].alias("entry")))
    votes = found.filter(rule["kind"] == "vote").select("template_id", "page_id", rule["gate"].alias("gate"), rule["vote"].alias("vote"), own.alias("own"), F.explode(owner).alias("pre"))
    counted = votes.groupBy(*GATED).agg(
        F.first("own", ignorenulls=True).alias("own"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("vote"))).alias("given")
    )
    left = counted.filter(F.col("own").isNotNull())
    for place in range(most):
        test = F.get(F.col("own.tests"), F.lit(place))
        voted = F.call_function("shiftright", F.col("given"), test["vote"]).bitwiseAND(F.lit(1)) == 1
        good = F.when(test.isNull(), True).when(test["kind"] == "vote", voted).when(test["kind"] == "near", F.rlike(F.col("own.path"), test["regex"]))
        if place in ranks:
            order = W.partitionBy("template_id", "page_id", "gate", "own.parent_pre").orderBy("pre")
            left = left.withColumn("rank", F.row_number().over(order))
            good = good.otherwise(F.col("rank") == test["n"])
        left = left.filter(F.coalesce(good, F.lit(False))).drop("rank")
    passed = left.filter(F.col("own.level") == 0) if levels else left
    every = passed
    for level in range(1, levels + 1):
        lower = left.filter(F.col("own.level") == level)
        seen = passed.select("template_id", "page_id", F.col("gate").alias("over"), F.col("pre").alias("at"))
        asked = lower.withColumn("over", F.col("own.above.gate")).withColumn("at", F.explode(above(F.col("own.path"), F.col("own.above"))))
        kept = asked.join(seen, ["template_id", "page_id", "over", "at"], "left_semi").drop("over", "at").dropDuplicates(GATED)
        every, passed = every.unionByName(kept), kept
    return every


def behind_gates(cells: DataFrame, passed: DataFrame) -> DataFrame:
    """Cells (with `path`, `container_pre` and `rule`) whose gates some element passes."""
    keys = passed.select(*GATED)
    for name in ("outer_gate", "inner_gate"):
        gate = F.col("rule")[name]
        if name == "outer_gate":
            places = above(container_path(F.col("path"), F.col("container_pre")), gate)
        else:
            places = F.filter(above(F.col("path"), gate), lambda p: p > F.col("container_pre"))
        asked = cells.filter(gate.isNotNull()).withColumn("gate", gate["gate"]).withColumn("__at", F.explode(places))
        good = asked.join(keys.withColumnRenamed("pre", "__at"), ["template_id", "page_id", "gate", "__at"], "left_semi").drop("gate", "__at")
        cells = cells.filter(gate.isNull()).unionByName(good)
    return cells


def gathered(parts: DataFrame, *first: str) -> DataFrame:
    """One row per template: what its paths compile to, and the problems, by `r`."""
    flat = {c: F.array_distinct(F.flatten(F.collect_list(f"r.{c}"))).alias(c) for c in ("rules", "tags", "text_tags", "attrs")}
    return parts.groupBy("template_id").agg(
        *[F.first(c).alias(c) for c in first], *flat.values(), F.array_join(F.array_sort(F.collect_set("r.problem")), "; ").alias("problem")
    )


def fits_broadcast(n: int, size: int) -> bool:
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


class Plan:
    """Compiled templates, written once, with what has to be known of all of them before pages are read."""

    def __init__(self, compiled: DataFrame) -> None:
        self.table = written(compiled, "compiled-templates")
        tests = F.transform("rules", lambda r: F.coalesce(F.size(r["tests"]), F.lit(0)))
        levels = F.transform("rules", lambda r: F.coalesce(r["level"], F.lit(-1)))
        broken = F.when(F.col("problem") != "", F.struct("template_id", "problem"))
        facts = self.table.agg(
            F.min(broken).alias("broken"), F.sum(F.size("rules")).alias("n"), F.sum(F.octet_length(F.to_json("rules"))).alias("size"),
            F.max(F.array_max(tests)).alias("most"), F.max(F.array_max(levels)).alias("levels"),
        ).first()
        if facts["broken"]:
            raise UnsupportedXPath("template {}: {}".format(*facts["broken"]))
        self.small = fits_broadcast(facts["n"] or 0, facts["size"] or 0)
        self.most, self.levels = facts["most"] or 0, facts["levels"] if facts["levels"] is not None else -1
        names = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("names")) for c in ("tags", "text_tags", "attrs")])
        places = F.filter(F.sequence(F.lit(0), F.lit(max(self.most - 1, 0))), lambda i: F.exists("rules", lambda r: F.get(r["tests"], i)["kind"] == "nth"))
        ranked = F.struct(F.lit("ranks").alias("kind"), F.transform(places, lambda i: i.cast("string")).alias("names"))
        rows = self.table.select(F.explode(F.concat(names, F.array(ranked))).alias("x")).select("x.kind", F.explode("x.names").alias("name")).distinct().collect()
        self.names = {kind: {r.name for r in rows if r.kind == kind} for kind in ("tags", "text_tags", "attrs", "ranks")}

    @property
    def gated(self) -> bool:
        return self.levels >= 0

    def matched(self, pages: DataFrame, carried: tuple[str, ...] = (), domain: Column | None = None) -> DataFrame:
        """Nodes with the rules they fit, from one pass over the pages of the templates' domains."""
        sited = pages.select("page_id", "html", (U.domain(F.col("url")) if domain is None else domain).alias("domain"))
        payload = {
            "elements": self.names["tags"], "texts_in": self.names["text_tags"], "path_attrs": tuple(sorted(self.names["attrs"])),
            "columns": ("pre", "parent_pre", "kind", "attrs", "text", "path"),
        }
        if self.small:
            single = self.table.select("template_id", "domain", *carried, F.explode("rules").alias("rule"))
            asked = sited.join(F.broadcast(self.table.select("domain")), "domain", "left_semi")
            found = matched(dom.dom_nodes(asked, keep=("page_id", "domain"), **payload), single)
        else:
            planned = lookup_join(sited, self.table.select("template_id", "domain", *carried, "rules"), "domain", spread=F.col("page_id"), small=False)
            nodes = dom.dom_nodes(planned, keep=("page_id", "template_id", *carried, "rules"), **payload)
            found = nodes.withColumn("rule", F.explode(F.filter("rules", fits))).drop("rules")
        return found

    def passing(self, found: DataFrame) -> DataFrame:
        return passing(found, sorted(map(int, self.names["ranks"])), self.most, self.levels)
