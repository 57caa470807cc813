"""Join of near-duplicate texts by the Jaccard similarity of their word n-grams, with Bayesian pruning.

Equal texts form a class, and one text of each goes on. MinHash bands find classes that may be alike;
classes connected by bands are compared in tiles: a pair that shares a band has its MinHash values
compared step by step and is dropped once the posterior probability that its similarity reaches the
threshold falls below a tolerance (BayesLSH). What remains is verified exactly on the n-gram sets.
Rows stay in proportion to the documents: tiles return counts and spanning edges, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text
from .components import components
from .words import mixed, word_hashes

WORDS = 5
THRESHOLD = 0.8
#: 32 bands of 5 values: a pair at 0.8 shares none with odds of 3e-6, one at 0.3 any with 8 %
BANDS, BAND = 32, 5
HASHES = BANDS * BAND
STEP = 16  # values compared before each look at the posterior
TOLERANCE = 1e-7
TILE = 256  # classes compared at once with as many others
WHOLE = 4096  # members up to which all tiles of a component are paired; beyond it, those of each band

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return seeds[:HASHES].astype(np.uint32) | np.uint32(1), seeds[HASHES:].astype(np.uint32)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted set of hashes of a text's word n-grams. Fewer words than n make one n-gram; none, none."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        total = mixed(total + w[i:len(w) - n + 1 + i])
    return np.unique(total)


def signature(grams: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    small = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small), 1024):
        np.minimum(out, (small[at:at + 1024, None] * a + b).min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and signature (the last axis)."""
    parts = sig.reshape(*sig.shape[:-1], BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:-1]).copy()
    for i in range(BAND):
        key = mixed(key * _ODD + parts[..., i] + np.uint64(1))
    return key


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP values: the matches needed for the posterior to reach the tolerance.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        needed.append(m)
    return needed


def surviving(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature tables that no look at the posterior drops."""
    p, q = pairs
    matches = np.zeros(len(p), np.int64)
    for k, least in enumerate(needed):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (a[p, part] == b[q, part]).sum(1)
        keep = matches >= least
        p, q, matches = p[keep], q[keep], matches[keep]
    return p, q


def linked(grams: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose exact Jaccard similarity reaches the threshold."""
    sizes = np.array([len(g) for g in grams])
    p, q = pairs
    fit = np.minimum(sizes[p], sizes[q]) >= threshold * np.maximum(sizes[p], sizes[q]) - 1e-9
    p, q = p[fit], q[fit]
    if not len(p):
        return p, q
    used = np.unique(np.concatenate([p, q]))
    if len(p) <= 4 * len(used):
        common = np.array([len(np.intersect1d(grams[i], grams[j], assume_unique=True)) for i, j in zip(p.tolist(), q.tolist(), strict=True)])
    else:
        # many pairs among few texts: count shared n-grams by products of incidence matrices, some columns at a time
        place = np.full(len(grams), -1)
        place[used] = np.arange(len(used))
        row = np.repeat(np.arange(len(used)), sizes[used])
        values, column, counts = np.unique(np.concatenate([grams[i] for i in used.tolist()]), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(counts > 1)
        renumbered = np.full(len(values), -1)
        renumbered[shared] = np.arange(len(shared))
        column = renumbered[column]
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(used), len(used)), np.float32)
        width = 4096
        for first in range(0, len(shared), width):
            lo, hi = np.searchsorted(column, [first, first + width])
            there = np.zeros((len(used), width), np.float32)
            there[row[lo:hi], column[lo:hi] - first] = 1
            total += there @ there.T
        common = total[place[p], place[q]].astype(np.int64)
    good = common >= threshold * (sizes[p] + sizes[q] - common) - 1e-9
    return p[good], q[good]


def _described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: a number of its own, key, two hashes of the text, and the keys of its bands (none without a word)."""
    body = whole_text(F.col(text))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"), body.cast("binary").alias("data"))

    def run(batches):
        family = _hash_family()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys = []
                for data in batch.column(3).to_pylist():
                    grams = shingles(data)
                    keys.append(band_keys(signature(grams, family)).view(np.int64).tolist() if len(grams) else [])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.list_(pa.int64()))], names=["key", "h1", "h2", "bands"])

    return rows.mapInArrow(run, f"key {kind}, h1 long, h2 long, bands array<long>").withColumn("row", F.monotonically_increasing_id())


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first `width` columns; rows equal in the next one count once."""
    now, rows, seen = None, [], set()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                if rows:
                    yield now, rows
                now, rows, seen = row[:width], [], set()
            if row[width] not in seen:
                seen.add(row[width])
                rows.append(row[width:])
    if rows:
        yield now, rows


def _compared(groups, threshold: float):
    """Per group: (node, links, anchor) for its linked nodes; anchors span what is connected in the group."""
    needed, family = least_matches(threshold), _hash_family()
    for (_, band, i, j), rows in groups:
        if len(rows) < 2:
            continue
        nodes = [r[0] for r in rows]
        tile = np.array([r[1] for r in rows])
        grams = [np.frombuffer(r[2], np.uint64) for r in rows]
        sigs = np.stack([signature(g, family) for g in grams])
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        keys = band_keys(sigs)
        meet = np.zeros((len(left), len(right)), bool)
        if band < 0:
            for b in range(BANDS):
                meet |= keys[left, b][:, None] == keys[right, b][None, :]
        else:  # a pair is compared in the first band that it shares
            meet = keys[left, band][:, None] == keys[right, band][None, :]
            for b in range(band):
                meet &= keys[left, b][:, None] != keys[right, b][None, :]
        p, q = np.nonzero(np.triu(meet, 1) if i == j else meet)
        p, q = surviving(sigs, sigs, (left[p], right[q]), needed)
        p, q = linked(grams, (p, q), threshold)
        if not len(p):
            continue
        links = np.bincount(np.concatenate([p, q]), minlength=len(nodes))
        root = list(range(len(nodes)))

        def top(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(p.tolist(), q.tolist(), strict=True):
            root[top(x)] = top(y)
        for x in np.flatnonzero(links).tolist():
            yield nodes[x], int(links[x]), nodes[top(x)]


def _grouped(docs: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows of the documents (key, h1, h2), and one row per class (h1, h2): class_id, n_copies, n_links, component, group_id."""
    rows = stored(_described(docs, key, text), "bands")
    classes = stored(
        rows.groupBy("h1", "h2").agg(F.min("key").alias("class_id"), F.min("row").alias("node"), F.count(F.lit(1)).alias("n_copies")), "classes"
    )
    # one row per class: where its text stands, and the keys of its bands
    firsts = rows.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).filter(F.col("row") == F.col("node"))
    bands = firsts.select("node", F.posexplode("bands").alias("band", "bucket"))
    together = Window.partitionBy("bucket", "band")
    met = bands.withColumn("first", F.min("node").over(together)).filter(F.col("node") != F.col("first"))
    parts = stored(components(met.select(F.col("node").alias("a"), F.col("first").alias("b")), "candidates"), "members")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = parts.join(sizes, "component")

    tiles = F.ceil(F.col("size") / TILE).cast("int")
    small = placed.filter(F.col("size") <= WHOLE).select("node", F.col("component").alias("group"), F.lit(-1).alias("band"), tiles.alias("tiles"))
    # beyond that, a component is a chain of loosely alike texts: only those that share a band meet
    large = placed.filter(F.col("size") > WHOLE).select("node").join(bands, "node")
    counted = large.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    by_band = large.join(counted, ["bucket", "band"]).select("node", F.col("bucket").alias("group"), "band", tiles.alias("tiles"))
    tile = F.pmod(F.xxhash64("node", "group"), F.col("tiles")).cast("int")
    meetings = small.unionByName(by_band).withColumn("tile", tile)

    body = whole_text(F.col(text))
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"), body.cast("binary").alias("data"))
    wanted = parts.join(firsts.select("node", "key", "h1", "h2"), "node")
    found = texts.join(
        wanted.select("node", F.col("key").alias("k"), F.col("h1").alias("g1"), F.col("h2").alias("g2")),
        F.col("key").eqNullSafe(F.col("k")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")),
    ).select("node", "data")

    def as_grams(batches):
        for batch in batches:
            grams = [shingles(d).tobytes() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["node", "grams"])

    loaded = found.mapInArrow(as_grams, "node long, grams binary").join(meetings, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = loaded.withColumn("other", other).select(
        "group", "band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "tile", "grams",
    )
    groups = dealt.repartition("group", "band", "i", "j").sortWithinPartitions("group", "band", "i", "j", "node")

    def compare(batches):
        out = []
        for row in _compared(_groups(batches, 4), threshold):
            out.append(row)
            if len(out) >= 10_000:
                yield _as_batch(out)
                out = []
        if out:
            yield _as_batch(out)

    links = stored(groups.mapInArrow(compare, "node long, links long, anchor long"), "links")
    n_links = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    same = components(links.select(F.col("node").alias("a"), F.col("anchor").alias("b")), "groups")
    named = classes.join(n_links, "node", "left").join(same, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    full = named.join(least, "component").select("h1", "h2", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component", "group_id")
    return rows.select("key", "h1", "h2"), full


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: `key`, class_id, n_copies, n_links, group_id.

    class_id: least key among equal texts, n_copies their number. n_links: how many other classes reach
    the threshold. group_id: least class_id among classes connected by links. Null and empty texts, and
    texts of blanks, have no n-grams: equal ones share a class and have no links. Missing keys are passed
    on. A key that recurs gives a row each time. Words are runs without ASCII white space, as they stand.
    """
    rows, full = _grouped(docs, key, text, threshold)
    return rows.join(full, ["h1", "h2"]).select(F.col("key").alias(key), "class_id", "n_copies", "n_links", "group_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, with all its columns: that with the group's least key.

    Where one key stands on several texts of a group, the text with the least hash; a missing key comes
    after all others. Rows equal in key and text count as one document. Rows with neither key nor text
    are equal to each other only, so one of them stays.
    """
    nothing = F.col(key).isNull() & F.col(text).isNull()
    some = docs.filter(~nothing)
    _, classes = _grouped(some, key, text, threshold)
    leader = F.min(F.struct(F.col("class_id").isNull().alias("missing"), "class_id", "h1", "h2")).alias("leader")
    chosen = classes.groupBy("component").agg(leader).select(F.col("leader.class_id").alias("__key"), F.col("leader.h1").alias("__g1"), F.col("leader.h2").alias("__g2"))
    body = whole_text(F.col(text))
    hashed = some.withColumns({"__h1": F.xxhash64(body), "__h2": F.xxhash64(F.lit(7), body)})
    named = hashed.join(chosen, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2")), "left_semi")
    return named.dropDuplicates([key, "__h1", "__h2"]).drop("__h1", "__h2").unionByName(docs.filter(nothing).limit(1))


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["node", "links", "anchor"])
