"""Lookup joins give the same rows on every way, also with a hot key."""

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import joins as J


@pytest.fixture
def sides(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") < 1500, F.lit("hot")).when(F.col("id") < 1600, F.lit(None)).otherwise((F.col("id") % 700).cast("string")).alias("k"),
        F.col("id").alias("v"),
    )
    right = spark.range(600).select(
        F.when(F.col("id") < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("w")
    )
    return left, right


def listed(df):
    return sorted(map(repr, df.select("k", "v", "w").collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_all_ways_agree(sides, monkeypatch, how):
    left, right = sides
    want = listed(left.join(right, "k", how))
    small = J.lookup_join(left, right, "k", how)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert listed(small) == want
    monkeypatch.setattr(J.is_small, "__defaults__", (10, 1 << 30))
    assert listed(J.lookup_join(left, right, "k", how)) == want
    monkeypatch.setattr(J, "TASK_ROWS", 100)
    cut = J.lookup_join(left, right, "k", how, spread=F.col("v"))
    assert "__i" in cut._jdf.queryExecution().analyzed().toString()
    assert listed(cut) == want


def test_hot_on_the_other_or_both_sides(spark, monkeypatch):
    def side(n, hot, name):
        key = F.when(F.col("id") < hot, F.lit("x")).when(F.col("id") < 30, F.lit("y")).otherwise((F.col("id") % 40).cast("string"))
        return spark.range(n).select(key.alias("k"), F.col("id").alias(name))

    monkeypatch.setattr(J.is_small, "__defaults__", (10, 1 << 30))
    monkeypatch.setattr(J, "TASK_ROWS", 20)
    for hot_left, hot_right in ((0, 150), (150, 150), (150, 0)):
        left, right = side(400, hot_left, "v"), side(300, hot_right, "w")
        assert listed(J.lookup_join(left, right, "k", spread=F.col("v"))) == listed(left.join(right, "k"))


def test_hot_keys_by_absolute_count(sides, monkeypatch):
    left, _ = sides
    assert J.hot_keys(left, "k").count() == 0
    monkeypatch.setattr(J, "TASK_ROWS", 400)
    assert J._parts(left, "k", True) == {"hot": 4}


def test_rows_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(J.is_small, "__defaults__", (1, 1 << 30))
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v long")
    right = spark.createDataFrame([("a", 7), (None, 8)], "k string, w long")
    for how in ("inner", "left"):
        assert listed(J.lookup_join(left, right, "k", how)) == listed(left.join(right, "k", how))
    assert J.lookup_join(left, right, "k", "left_anti").count() == left.join(right, "k", "left_anti").count()


def test_size_check(sides):
    _, right = sides
    assert J.is_small(right) and not J.is_small(right, rows=599) and J.is_small(right, rows=600)
    assert not J.is_small(right, size=1000)
