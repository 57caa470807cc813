"""Corpus pipeline: keep good documents in a language that can be told, one of each group of near copies, and pack them.

Stages run one after the other; each reads all that the one before kept. All but the last return the
columns of `documents`. Counts as part of the subpackage llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm import jaccard_join, language_id, packing, quality_classifier
from pagesieve.llm.common import stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score at 0.3 or more."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stands out by more than a narrow margin."""
    return language_id.keep_named(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts: that with the least id."""
    return jaccard_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(docs, TOKENIZER))


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_copies), ("best-fit packing", packed)]

#: Boosted trees, compression, MinHash and a tokenizer are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
