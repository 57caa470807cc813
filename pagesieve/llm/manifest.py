"""Merkle manifest of a dataset by butterfly exchange.

Leaves are ordered within their tree and cut into aligned blocks of FANOUT ** LEVELS, each hashed up
on its own. Then blocks swap subtree roots in rounds: in round r, the blocks whose places differ in
digit r alone (base FANOUT) form a group, learn each other's subtree root, note the others as a piece
of their proof and all hash the parent. After the last round every block knows the root and its whole
upper proof, with no way down. Where the last subtree is not full, stand-ins beyond the last block
take part with no root of their own and come to know their ancestors like the rest.

Roots of the trees are the leaves of an upper tree, built the same way. Everything is SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import is_small, lookup_join
from .common import fold, stored

FANOUT = 3
LEVELS = 6  # of a block
BLOCK = FANOUT ** LEVELS
#: Rounds after which the exchange is written: a lost executor repeats at most so many.
ROUNDS_KEPT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a text."""
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def tree_key(value: Column) -> Column:
    """Text of a tree's name that is never null and sorts as the names do, null first."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value.cast("string")))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds place (from 0) and total, by tree. `order` must tell the rows of a tree apart.

    Rows are sorted in ranges of (tree, order) over the whole table, so a tree with a third of the
    rows takes a third of the ranges; one slim row per range and tree brings its start.
    """
    by = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    # the id is the range in its upper 31 bits and the place in the range below
    ids = nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id())
    ranged = stored(ids.select("*", F.shiftright("id", 33).cast("int").alias("range")), "ranged")
    parts = ranged.groupBy("range", "tree").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(parts.select("range", "tree", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total")), "starts")
    # a key of this join is one range at most, which one task has sorted
    met = ranged.join(F.broadcast(starts) if is_small(starts) else starts, ["range", "tree"])
    return met.withColumn("place", F.col("id") + F.col("shift")).drop("range", "id", "shift")


def runs(nodes: Column) -> Column:
    """One level up: the digest of each run of FANOUT nodes, the last run may be shorter."""
    heads = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.transform(heads, lambda i: digest(F.array_join(F.slice(nodes, i, FANOUT), "")))


def levels(leaves: Column, whole: Column) -> Column:
    """All levels of a block: LEVELS times up, or in a tree of its own (`whole`) until one node remains."""

    def climb(up: Column, _: Column) -> Column:
        top = F.element_at(up, -1)
        return F.when(whole & (F.size(top) == 1), up).otherwise(F.concat(up, F.array(runs(top))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(leaves), climb)


def path(up: Column, i: Column) -> Column:
    """Siblings of leaf i of a block, level by level: what stands left and right of it in its run."""

    def step(level: Column) -> Column:
        nodes = F.get(up, level)
        at = F.floor(i / F.pow(F.lit(float(FANOUT)), level)).cast("int")
        first = at - at % FANOUT
        left, right = F.slice(nodes, first + 1, at - first), F.slice(nodes, at + 2, first + FANOUT - 1 - at)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    top = F.size(up) - 2
    return F.when(top >= 0, F.transform(F.sequence(F.lit(0), F.greatest(top, F.lit(0))), step)).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def folded(start: Column, steps: Column) -> Column:
    """Root that a leaf and its siblings lead to."""
    return F.aggregate(steps, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof(steps: Column) -> Column:
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def blocks(nodes: DataFrame, *payload: str) -> DataFrame:
    """tree, block, total, nodes (by place: digest and payload), up (their levels). At most BLOCK nodes to a row."""
    each = F.sort_array(F.collect_list(F.struct("place", "digest", *payload))).alias("nodes")
    rows = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).cast("long").alias("block")).agg(F.max("total").alias("total"), each)
    return rows.withColumn("up", levels(F.col("nodes.digest"), F.col("total") <= BLOCK))


def exchanged(rows: DataFrame) -> DataFrame:
    """Every block's upper proof and its tree's root: tree, block, upper, root.

    rows: tree, block, total and the block's root as `digest`; read again for the number of rounds, so written.
    """
    count = F.ceil(F.col("total") / BLOCK).cast("long")
    powers = F.transform(F.sequence(F.lit(0), F.lit(38)), lambda r: F.pow(F.lit(float(FANOUT)), r))
    sized = rows.select("tree", "block", "digest", count.alias("count")).withColumn("rounds", F.size(F.filter(powers, lambda p: p < F.col("count"))))
    last = sized.agg(F.max("rounds")).first()[0] or 0
    # a tree of `count` blocks is filled up to a power of FANOUT, each block with fewer than FANOUT stand-ins
    full = F.pow(F.lit(float(FANOUT)), F.col("rounds"))
    seats = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda k: F.col("block") + k * F.col("count")), lambda x: x < full)
    own = F.when(F.col("at") == F.col("block"), F.col("digest"))
    state = sized.withColumn("at", F.explode(seats)).withColumn("digest", own)
    state = state.withColumn("upper", F.array().cast("array<struct<left:string,right:string>>"))
    for r in range(last):
        low = FANOUT ** r
        digit = F.floor(F.col("at") / low).cast("long") % FANOUT
        group = Window.partitionBy("tree", F.floor(F.col("at") / (low * FANOUT)), F.col("at") % low)
        state = state.withColumn("digit", digit).withColumn("met", F.sort_array(F.collect_list(F.struct("digit", "digest")).over(group)))

        def known(nodes: Column) -> Column:
            return F.array_join(F.array_compact(nodes["digest"]), "")

        left = known(F.filter("met", lambda m: m["digit"] < F.col("digit")))
        right = known(F.filter("met", lambda m: m["digit"] > F.col("digit")))
        everyone = known(F.col("met"))
        climbs = F.col("rounds") > r
        state = state.select(
            "tree", "block", "at", "count", "rounds",
            F.when(climbs & (everyone != ""), digest(everyone)).when(climbs, F.lit(None)).otherwise(F.col("digest")).alias("digest"),
            F.when(climbs, F.concat("upper", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("upper")).alias("upper"),
        )
        if r % ROUNDS_KEPT == ROUNDS_KEPT - 1:
            state = stored(state, "exchanged")
    return state.filter(F.col("at") == F.col("block")).select("tree", "block", "upper", F.col("digest").alias("root"))


def grown(nodes: DataFrame, order: list[str], *payload: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of all trees, and what every block knows after the exchange; both written.

    nodes: tree (never null), digest, the columns to order by, and payload.
    """
    rows = stored(blocks(placed(nodes, order), *payload), "blocks")
    tops = rows.select("tree", "block", "total", F.element_at(F.element_at("up", -1), 1).alias("digest"))
    return rows, stored(exchanged(tops), "tops")


def trees(tops: DataFrame) -> DataFrame:
    """Every tree's root, the siblings above it, and the root of all: tree, above, root."""
    roots = tops.filter(F.col("block") == 0).select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("name"))
    rows, over = grown(roots, ["name"], "name")
    met = rows.join(over, ["tree", "block"])
    each = F.transform("nodes", lambda x, i: F.struct(x["name"].alias("tree"), F.concat(path(F.col("up"), i), F.col("upper")).alias("above"), F.col("root").alias("all")))
    return met.select(F.explode(each).alias("t")).select("t.*")


def manifest(docs: DataFrame, tree: str = "source", key: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """`key`, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest and a check of every row.

    A row is a leaf of the tree of its source. Checked is the row as found, or without its line feeds where the
    key has an even crc32; `verified` says whether it still leads to the root. Missing keys come first, then
    ascending, rows of one key by leaf; equal rows each are a leaf. A missing source is a tree of its own. Nulls and
    empty texts differ. Columns not in `fields` are ignored; an empty table gives no rows.
    """
    plain = [F.col(c) for c in fields]
    cut = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text else F.col(c) for c in fields]
    tampers = (fold(F.col(key), 2) == 0) & F.contains(F.col(text), F.lit("\n"))
    nodes = stored(docs.select(
        tree_key(F.col(tree)).alias("tree"), F.col(key).alias("key"), leaf(*plain).alias("digest"),
        F.when(tampers, leaf(*cut)).alias("tampered"), F.monotonically_increasing_id().alias("row"),
    ), "leaves")
    rows, tops = grown(nodes, ["key", "digest", "row"], "key", "tampered")
    # one slim row per block meets its tree, then the block itself
    known = lookup_join(tops, stored(trees(tops), "trees"), "tree", unique_right=True, spread=F.col("block"))
    met = rows.join(known, ["tree", "block"])

    def checked(x: Column, i: Column) -> Column:
        steps = F.concat(path(F.col("up"), i), F.col("upper"), F.col("above"))
        return F.struct(x["key"].alias("key"), x["digest"].alias("leaf"), steps.alias("steps"), F.coalesce(x["tampered"], x["digest"]).alias("found"))

    each = met.select(F.col("root").alias("subroot"), F.col("all").alias("root"), F.explode(F.transform("nodes", checked)).alias("x"))
    out = each.select(
        F.col("x.key").alias(key), "x.leaf", "subroot", "root", proof(F.col("x.steps")).alias("proof_sha256"),
        folded(F.col("x.found"), F.col("x.steps")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    def run(value: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    plain = " || ".join(run(c) for c in FIELDS)
    cut = " || ".join(run("replace(text, chr(10), '')" if c == "text" else c) for c in FIELDS)
    # bits of the decimal digits, lowest first, through the shift register of crc32
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda k: CAST((ascii(ch) >> k) & 1 AS BIGINT))))"
    crc = f"list_reduce(list_prepend(4294967295, {bits}), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, sha256({plain}) AS leaf,
           CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN sha256({cut}) ELSE sha256({plain}) END AS found,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM documents),
low AS (
    SELECT 0 AS level, source, pos, leaf AS h, n FROM leaves
    UNION ALL
    SELECT level + 1, source, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY level, source, pos // 3, n),
tops AS (SELECT source, h, level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, pos, h, n FROM tops
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (
    SELECT source, level, pos, h FROM low WHERE n > 1
    UNION ALL
    SELECT t.source, t.level + g.level, g.pos, g.h FROM high g CROSS JOIN tops t WHERE g.n > 1),
places AS (
    SELECT l.source, l.doc_id, x.level, l.pos // CAST(power(3, x.level) AS BIGINT) AS pos FROM leaves l JOIN (SELECT DISTINCT source, level FROM low WHERE n > 1) x ON l.source IS NOT DISTINCT FROM x.source
    UNION ALL
    SELECT l.source, l.doc_id, t.level + x.level, t.pos // CAST(power(3, x.level) AS BIGINT) FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) x),
steps AS (
    SELECT p.source, p.doc_id, p.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < p.pos), '') AS before,
           coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > p.pos), '') AS after
    FROM places p JOIN nodes s ON s.source IS NOT DISTINCT FROM p.source AND s.level = p.level AND s.pos // 3 = p.pos // 3
    GROUP BY p.source, p.doc_id, p.level, p.pos),
folds AS (
    SELECT source, doc_id, 0 AS level, found AS h FROM leaves
    UNION ALL
    SELECT f.source, f.doc_id, f.level + 1, sha256(s.before || f.h || s.after) FROM folds f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.doc_id = f.doc_id AND s.level = f.level),
ends AS (SELECT source, doc_id, arg_max(h, level) AS folded FROM folds GROUP BY source, doc_id),
proofs AS (SELECT source, doc_id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM steps GROUP BY source, doc_id)
SELECT l.doc_id, l.leaf, t.h AS subroot, g.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = g.h AS verified
FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source JOIN ends e ON e.doc_id = l.doc_id AND e.source IS NOT DISTINCT FROM l.source
LEFT JOIN proofs p ON p.doc_id = l.doc_id AND p.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT h FROM high WHERE n = 1) g
"""


#: The same manifest and check of `documents`, whose ids differ, level by level.
SQL = _sql()
