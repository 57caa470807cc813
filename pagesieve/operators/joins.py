"""Joins that stay whole and balanced when one key holds a large share of the rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
TASK_ROWS = 1_000_000  # rows of one key that one task may hold


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Counts, and stops counting one row past the bound."""
    width = F.octet_length(F.to_json(F.struct(*table.columns)))
    n, total = table.limit(rows + 1).select(width.alias("w")).agg(F.count(F.lit(1)), F.sum("w")).first()
    return n <= rows and (total or 0) <= size


def is_small_written(table: DataFrame) -> bool:
    """The same in one job, for a slim table that is written: all of it is counted."""
    n, total = table.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()
    return n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES


def hot_keys(table: DataFrame, key: str) -> DataFrame:
    """(key, n): keys with more than TASK_ROWS rows; at most one for every TASK_ROWS rows of the table."""
    counts = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > TASK_ROWS)


def _parts(table: DataFrame, key: str, probe: bool) -> dict:
    """Hot keys and the tasks that each needs, by absolute count."""
    return {r[key]: ceil(r["n"] / TASK_ROWS) for r in hot_keys(table.select(key), key).collect()} if probe else {}


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", spread: Column | None = None,
    probe_left: bool = True, small: bool | None = None, unique_right: bool = False,
) -> DataFrame:
    """Join a long `left` to a shorter `right`.

    `right` is broadcast only after a check of its size. Beyond that both sides are shuffled. A key with
    more than TASK_ROWS rows is cut into as many parts as that bound asks for, on either side or both,
    and the matching rows of the other side are repeated for each part, which leaves the result the
    same. Rows without a key meet no row: they do not travel. `spread` varies within a hot key of
    `left`. For joins other than inner, and with `unique_right`, `right` has one row per key, so only
    `left` is probed. Finding hot keys reads the keys of a side once more; `probe_left=False` leaves that
    out where `left` is costly to compute, and adaptive execution splits its skewed partitions.
    `small` is the outcome of the size check where the caller has made it.
    """
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), key, how)
    a, b = _parts(left, key, probe_left), _parts(right, key, how == "inner" and not unique_right)
    keyed = left.filter(F.col(key).isNotNull())
    if a or b:
        joined = _cut_join(keyed, right, key, how, F.xxhash64(*left.columns) if spread is None else spread, a, b)
    else:
        joined = keyed.join(right, key, how)
    if how == "inner" or how == "left_semi":
        return joined
    bare = left.filter(F.col(key).isNull())
    return joined.unionByName(bare, allowMissingColumns=True).select(*joined.columns)


def _cut_join(left, right, key, how, spread, a: dict, b: dict) -> DataFrame:
    """Rows of a hot key get one part of their own side and all parts of the other."""
    hot = left.sparkSession.createDataFrame(
        [(k, a.get(k, 1), b.get(k, 1)) for k in {*a, *b}], f"`{key}` {left.schema[key].dataType.simpleString()}, __a int, __b int"
    )

    def every(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    def one(by: Column, n: str) -> Column:
        return F.array(F.pmod(F.xxhash64(by), F.col(n)).cast("int"))

    def cut(table: DataFrame, i: Column, j: Column) -> DataFrame:
        # bounded: one row for every TASK_ROWS rows of the two sides
        parts = table.join(F.broadcast(hot), key, "left").fillna(1, ["__a", "__b"])
        both = parts.withColumn("__i", F.explode(i)).withColumn("__j", F.explode(j))
        return both.drop("__a", "__b")

    mine = cut(left, one(spread, "__a"), every("__b"))
    theirs = cut(right, every("__a"), one(F.xxhash64(*right.columns), "__b"))
    return mine.join(theirs, [key, "__i", "__j"], how).drop("__i", "__j")
