import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import ranked_search as R
from pagesieve.llm.queries import op13_hybrid_search
from tests.llm import common as C

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=50):
    texts = [(key, TERM.findall((text or "").translate(LOWER))) for key, text in docs]
    texts = [(key, ts) for key, ts in texts if ts]
    n, total = len(texts), sum(len(ts) for _, ts in texts)
    df = {}
    for _, ts in texts:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for key, ts in texts:
            m, score = 100 - 50 + (50 * len(ts) * n) // total, 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if tf := ts.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, -math.inf if key is None else key, key))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(C.rows(df, "item_id", "rank", "doc_id", "score"), key=str)


def test_against_every_score(spark):
    docs = spark.read.parquet(f"{C.FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{C.FOLDER}/benchmark.parquet")
    want = brute(C.rows(docs, "doc_id", "text"), C.rows(items, "item_id", "text"))
    assert got(op13_hybrid_search(spark, C.FOLDER).repartition(3)) == want and len(want) > 40 * 45


def test_odd_rows_and_items(spark):
    items = [(1, "Alpha WORD"), (2, None), (3, ""), (4, "ÜN ïcode one two"), (5, "nothing here"), (5, "nothing here"), (None, "word #end")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("doc_id", F.lit("x"))
    assert got(R.search_all(C.odd_documents(spark), asked)) == brute([r[:2] for r in C.ODD_ROWS], items)
    assert got(R.search_all(C.no_documents(spark), asked)) == []
    assert got(R.search_all(C.odd_documents(spark), asked.limit(0))) == []


def test_blocks_windows_and_passes_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(1, 40)))) for i in range(700)]
    docs += [(i, docs[3][1]) for i in range(900, 960)]  # ties beyond k
    items = [(i, " ".join(rng.sample(words, 9))) for i in range(25)] + [(99, docs[3][1])]
    for block, window, items_at_once, short in ((64, 16, 7, 4), (1 << 14, 1 << 11, 2000, 32), (100, 1 << 11, 2000, 1)):
        monkeypatch.setattr(R, "BLOCK_DOCS", block)
        monkeypatch.setattr(R, "WINDOW", window)
        monkeypatch.setattr(R, "ITEMS", items_at_once)
        monkeypatch.setattr(R, "SHORT", short)
        a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
        assert got(R.search_all(a, b, k=20)) == brute(docs, items, 20)


def test_skipping_leaves_documents_unscored():
    rng = np.random.default_rng(1)
    lists = {t: R.Postings(d := np.flatnonzero(rng.random(20_000) < share), rng.integers(1, top, len(d)), top) for t, (share, top) in enumerate([(0.002, 1000), (0.01, 800), (0.5, 40), (0.9, 5)])}
    scores = np.zeros(20_000, np.int64)
    for x in lists.values():
        scores[x.docs] += x.gains
    best = R.Best(10)
    offered = []
    best_offer = best.offer
    best.offer = lambda s, k: (offered.append(len(k)), best_offer(s, k))
    R.search(lists, np.arange(20_000), [0, 1, 2, 3], best)
    order = np.lexsort((np.arange(20_000), -scores))[:10]
    assert list(best.keys) == list(order) and list(best.scores) == list(scores[order])
    assert sum(offered) < 2000


@pytest.mark.parametrize("text, want", [("Ab-c ÄB1_x", [b"ab", b"c", "Äb1".encode(), b"x"]), (" ", []), (None, [])])
def test_terms(text, want):
    assert R.terms(text and text.encode()) == want


def test_long_documents_beyond_64_bits():
    corpus = R.Corpus(1 << 50, 1 << 60, np.ones(1, np.int64))
    assert corpus.lengths(np.array([1 << 20], np.int64))[0] == 50 + 50 * (1 << 20) * (1 << 50) // (1 << 60)
