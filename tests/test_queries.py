"""Every registered query against its SQL on the smallest tables, and the plans of the main ones."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagesieve.plans import QUERIES
from pagesieve.operators import extract as E
from pagesieve.sources.pages import read_pages
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    sql = entry.oracle_sql()
    assert name in sql
    problem = difference(spark, entry.queries()[name], sql[name], FOLDER)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    site = spark.read.parquet(f"{FOLDER}/pages.parquet").filter(F.col("page_id") > 10)
    text = plan(E.extract_fields(site, "//nav//li", {"link": "//a//text()"}, clean=False))
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,10)]" in text
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_records_take_one_shuffle(spark):
    site = spark.read.parquet(f"{FOLDER}/pages.parquet")
    text = plan(E.extract_fields(site, "//nav//li", {"link": "//a//text()", "all": "//text()"}))
    initial = text[text.index("Initial Plan"):] if "Initial Plan" in text else text
    assert initial.count("Exchange") == 1 and "Join" not in initial and initial.count("MapInArrow") == 1


def test_small_files_are_spread(spark):
    assert read_pages(spark, f"{FOLDER}/pages.parquet").rdd.getNumPartitions() == 8
