"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard_join, language_id, lm_scoring, main_text, manifest, packing, quality_classifier, quality_rules, ranked_search, segmentation, sharding, url_filter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_trie_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score under the bigram model of the training folds, and under word counts alone."""
    return lm_scoring.score_held_out(table(spark, folder, "documents"))


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


@query
def op2_url_likelihood_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's address under the rules, else under two character models."""
    return url_filter.judge(table(spark, folder, "pages"), RULES)


@query
def op3_compression_language(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language by compressed size, and whether the margin is wide enough."""
    return language_id.label(table(spark, folder, "documents"))


@query
def op4_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next one are."""
    return fingerprints.compare_edited(table(spark, folder, "documents"))


@query
def op5_boosted_tree_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score from boosted trees."""
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of equal texts, its links to other classes and its group."""
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


@query
def op7_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query
def op8_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids under merge-dropout, and whether they decode to it."""
    return segmentation.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of 16, its slot there, and its shard if there were 17."""
    return sharding.shard(table(spark, folder, "documents"), 16)


@query
def op10_risk_controlled_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the base verdict and that of the calibrated rules."""
    return quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, its proof up to the root of all sources, and whether it still leads there."""
    return manifest.manifest(table(spark, folder, "documents"))


SQL["op11_merkle_manifest"] = manifest.SQL


@query
def op12_tag_ratio_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    return main_text.extract(table(spark, folder, "pages"))


SQL["op12_tag_ratio_text"] = main_text.SQL


@query
def op13_hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents for every item of `benchmark`."""
    return ranked_search.search_all(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op13_hybrid_search"] = ranked_search.SQL
