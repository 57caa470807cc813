"""Sharding by jump consistent hashing (Lamping & Veach, 2014).

The shard follows from the key and the number of shards alone: there is no ring table, and when a
shard is appended only the rows that it takes move. Everything is a SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

#: A walk over n shards takes ln(n) + 1 jumps on average; more than this for fewer than 2^31 shards has odds below 1e-30.
MOST_JUMPS = 128
#: Ranges that the rows of a shard are numbered by; each is one group of a window.
RANGES = 4096
#: Copies of one row that are numbered, and written, together.
COPIES = 100_000


def jump_hash(key: Column, shards: int) -> Column:
    """Shard from 0 to shards - 1 for a key given as an unsigned 64-bit number, decimal(20,0).

    The generator's products, below 2^127, are exact in decimal(38,0).
    """
    if not 1 <= shards < 1 << 31:
        raise ValueError("between 1 and 2^31 - 1 shards")
    state = F.struct(key.cast("decimal(20,0)").alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    steps = F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS)))

    def number(n: int, digits: int) -> Column:
        return F.lit(str(n)).cast(f"decimal({digits},0)")

    def jump(s: Column, _: Column) -> Column:
        word = ((s["key"] * number(2862933555777941757, 19) + 1) % number(1 << 64, 20)).cast("decimal(20,0)")
        high = (word.cast("decimal(38,0)") - word % number(1 << 33, 20)).cast("double") / F.lit(float(1 << 33))
        landed = ((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1))).cast("long")
        moved = F.struct(word.alias("key"), s["next"].alias("at"), landed.alias("next"))
        return F.when(s["next"] < shards, moved).otherwise(s)

    return F.aggregate(steps, state, jump, lambda s: s["at"].cast("int"))


def stable_key(value: Column) -> Column:
    """Unsigned 64-bit number of a value's text, the same in every engine. Null counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, size, text_crc32, law, shard, slot, grown_shard for every row.

    Null text: no bytes, so size 1. Null key: the key of the empty text. Rows equal in key and text are
    counted before they are numbered, so that a key of any number of copies is one row for some COPIES
    of them in the shuffle, dealt to ranges of their own; each copy still gets a slot of its own. Other columns are ignored. Empty input: no rows.
    Slots of a shard run from 0 without gaps, by range of the key's hash, then key, checksum and size.
    """
    body = whole_text(F.col(text)).cast("binary")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"))
    merged = rows.groupBy("key", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    parts = merged.select("key", "size", "crc", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    counted = parts.withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES))
    number = stable_key(F.col("key"))
    placed = counted.withColumn("number", number).select(
        "key", "size", "crc", "part", "n",
        jump_hash(F.col("number"), shards).alias("shard"),
        jump_hash(F.col("number"), shards + 1).alias("grown"),
        # a third of the rows may share a key, with different texts: the checksum spreads them
        F.pmod(F.xxhash64("key", "crc", "part"), F.lit(RANGES)).cast("int").alias("range"),
    )
    totals = placed.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "range").orderBy("key", "crc", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "range"])
    first = F.col("start") + F.col("ahead")
    return numbered.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), F.col("grown").alias("grown_shard"),
    )
