"""Homomorphic multiset fingerprints.

A text's paragraphs, long ones cut into runs of four words, are hashed to wide vectors of small
numbers, and the vectors are added modulo 2^32 lane by lane. The order of paragraphs does not matter,
equal multisets give equal sums, and a paragraph is added to or taken from a stored sum without
reading the rest. Lanes count the ones of 128 hash bits. Read as +1 and -1 they are also random
projections, so two sums tell how much of two texts agrees. Everything is a SQL expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

#: A run of up to four words inside a line. Possessive, so its time is linear.
RUN = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,4}+"
SEEDS = (1, 2)  # of two hashes of 64 bits
PAIRS = 32  # words per hash; each holds two lanes of 32 bits
LANES = len(SEEDS) * PAIRS * 2
HALF = 0x0000000100000001
LOW = 0xFFFFFFFF
#: rows of one range of ids, on average, and the most ranges
RANGE_ROWS, MOST_RANGES = 500, 1 << 16


def runs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.rtrim(r))


def total(pieces: Column) -> Column:
    """Sum of the pieces' vectors: their number, then LANES lanes, two to a word. array<long>."""
    words = F.sequence(F.lit(0), F.lit(PAIRS - 1))

    def lanes(hashes: Column) -> Column:
        return F.transform(words, lambda s: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftright", h, s).bitwiseAND(F.lit(HALF))))

    def hashes_of(seed: int) -> Column:
        return F.transform(pieces, lambda p: F.xxhash64(F.lit(seed), p))

    return F.concat(F.array(F.size(pieces).cast("long")), *(lanes(hashes_of(seed)) for seed in SEEDS))


def fingerprint(text: Column) -> Column:
    """Vector of a whole text; null counts as empty, which has zeros. For whole tables `summed` is faster."""
    return total(runs(whole_text(text)))


def summed(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and `vector`, the same sums by grouping: for texts that `keys` tell apart, in compiled code.

    The pieces of a text stand together, so they are added up before any shuffle.
    """
    pieces = rows.select(*keys, F.explode_outer(runs(F.col(text))).alias("__piece"))
    hashes = [F.when(F.col("__piece").isNotNull(), F.xxhash64(F.lit(seed), "__piece")).otherwise(F.lit(0)).alias(f"__h{seed}") for seed in SEEDS]
    hashed = pieces.select(*keys, "__piece", *hashes)
    lanes = [F.sum(F.shiftright(f"__h{seed}", s).bitwiseAND(F.lit(HALF))).alias(f"__l{seed}_{s}") for seed in SEEDS for s in range(PAIRS)]
    added = hashed.groupBy(*keys).agg(F.count("__piece").alias("__n"), *lanes)
    return added.select(*keys, F.array("__n", *(f"__l{seed}_{s}" for seed in SEEDS for s in range(PAIRS))).alias("vector"))


def _by_halves(a: Column, b: Column, sign: int) -> Column:
    """Lane by lane, modulo 2^32, without a carry between the halves of a word."""
    high = lambda x: F.shiftrightunsigned(x, 32)
    low = lambda x: x.bitwiseAND(F.lit(LOW))
    return F.zip_with(a, b, lambda x, y: F.shiftleft(low(high(x) + high(y) * sign), 32).bitwiseOR(low(low(x) + low(y) * sign)))


def inserted(stored: Column, text: Column) -> Column:
    """A stored vector after the paragraphs of `text` have come in."""
    return _by_halves(stored, fingerprint(text), 1)


def deleted(stored: Column, text: Column) -> Column:
    """A stored vector after the paragraphs of `text` have gone."""
    return _by_halves(stored, fingerprint(text), -1)


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: how much of two multisets agrees, from their vectors. Equal vectors: 1.

    Twice the inner product over the sum of squares, which for sets is estimated to about 1 / sqrt(LANES).
    """
    def signs(v: Column) -> Column:
        n = F.element_at(v, 1)
        return F.transform(F.slice(v, 2, LANES // 2), lambda x: F.struct(
            (F.shiftrightunsigned(x, 32) * 2 - n).cast("double").alias("h"), (x.bitwiseAND(F.lit(LOW)) * 2 - n).cast("double").alias("l")))

    zero = F.lit(0.0)
    square = lambda v: F.aggregate(signs(v), zero, lambda s, x: s + x["h"] * x["h"] + x["l"] * x["l"])
    inner = F.aggregate(F.zip_with(signs(a), signs(b), lambda x, y: x["h"] * y["h"] + x["l"] * y["l"]), zero, lambda s, x: s + x)
    size = square(a) + square(b)
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(inner * 2, size))), F.lit(0.0)))


def _range_of(value: Column, bounds: list[float]) -> Column:
    """How many bounds, in ascending order, are at most the value: a binary search as one expression."""
    if not bounds:
        return F.lit(0)
    listed = F.lit(bounds)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).when(F.get(listed, mid) <= value, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

    return F.aggregate(steps, start, halve, lambda s: s["low"])


def in_ranges(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """Adds range, copy and rank: the order by (key, low half of tie, tie) within ranges of it, each in one task.

    The first row of a range also stands, as a copy, behind the last of the range before it, and the
    first of all behind the last of all: every row's next row is in its own range. A missing key comes
    first. Rows with the same key are spread by `tie`, a hash.
    """
    within = _low(F.col(tie)) / F.lit(float(1 << 32))
    # without decimals from 2^53 on, but never falling in the order of (key, low half of tie)
    place = F.coalesce(F.col(key).cast("double"), F.lit(-1e19)) + within
    spread = rows.withColumn("place", place)
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / RANGE_ROWS)))
    bounds: list[float] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(spread.agg(F.percentile_approx("place", shares, max(10_000, 8 * ranges))).first()[0]))
    dealt = spread.withColumn("range", _range_of(F.col("place"), bounds)).drop("place")
    order = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"), _low(F.col(tie)).alias("low"), F.col(tie).alias("tie"))
    # one slim row per range, of which there are at most MOST_RANGES; no partition is meant
    firsts = dealt.groupBy("range").agg(F.min(order).alias("first"))
    before, last = F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy())
    heads = firsts.select(F.col("range").alias("own"), "first", F.coalesce(before, last).alias("to"))
    copies = dealt.join(F.broadcast(heads), (F.col("range") == F.col("own")) & order.eqNullSafe(F.col("first")))
    copies = copies.dropDuplicates(["own"]).select(*rows.columns, F.col("to").alias("range"), F.lit(True).alias("copy"))
    both = dealt.withColumn("copy", F.lit(False)).unionByName(copies)
    return both.withColumn("rank", F.row_number().over(_within()))


def _within(*more: str):
    return Window.partitionBy("range").orderBy("copy", F.col("key").asc_nulls_first(), _low(F.col("tie")), "tie", *more)


def _low(tie: Column) -> Column:
    """Low half of a hash: what cuts the ranges within a key, so it also comes first in the order of a key's rows."""
    return F.pmod(tie, F.lit(1 << 32))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next text.

    Edited: the last floor(n_chars / 4) code points give way to as many from the start of the next
    document by ascending key. Null text: empty. A single document is its own next. Equal keys are in
    order of the low halves of their texts' hashes, then of the whole ones. Other columns are ignored; empty input gives no rows. Texts are
    shuffled once, by range; sums and neighbours are found within the ranges.
    """
    body = whole_text(F.col(text))
    ranged = in_ranges(docs.select(F.col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("tie")), "key", "tie")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    after = F.coalesce(F.lead("text").over(_within()), F.lit(""))
    paired = ranged.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(after, F.lit(1), cut)))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))
    keys = ["range", "copy", "rank", "key", "n_chars", "edited_sha256"]
    both = paired.select("range", "copy", "rank", "key", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(sides).alias("s"))
    vectors = summed(both.select(*keys, "s.side", "s.body"), [*keys, "side"], "body")
    # a row's own vector is followed by that of its edited text, then by the next row's own
    line = Window.partitionBy("range").orderBy("copy", "rank", "side")
    met = vectors.select(*keys, "side", "vector", F.lead("vector").over(line).alias("changed"), F.lead("vector", 2).over(line).alias("after"))
    return met.filter((F.col("side") == 0) & ~F.col("copy")).select(
        F.col("key").alias(key), "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("changed")).alias("near_edited"), likeness(F.col("vector"), F.col("after")).alias("near_next"),
    )
