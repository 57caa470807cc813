import numpy as np

from pagesieve.llm import quality_classifier as Q
from tests.llm import common as C


def walked(trees, row):
    """Score of one row, node by node."""
    total = trees.start
    for feature, above, leaf in zip(trees.feature, trees.above, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > above[node])
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_trees_learn_and_walk():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = Q.grow(x[:2000], y[:2000])
    p = trees.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(p[:50], [walked(trees, r) for r in x[2000:2050]])


def test_without_labels_or_with_one():
    x = np.zeros((4, len(Q.FEATURES)))
    assert np.allclose(Q.grow(x[:0], np.zeros(0)).score(x), 0.5)
    assert (Q.grow(x, np.ones(4)).score(x) > 0.8).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    marks = dict(C.rows(labels, "doc_id", "quality"))
    held = [(got[k]["predicted"], q) for k, q in marks.items() if C.fold(k, 5) == 0]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert all(r["held_out"] == (C.fold(k, 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for k, r in got.items())


def test_odd_rows(spark):
    odd = C.odd_documents(spark)
    labels = spark.createDataFrame([(5, 1), (8, 0), (8, 1), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    got = Q.score(odd, Q.learn(odd, labels)).collect()
    assert len(got) == len(C.ODD_ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    kept = Q.keep_good(odd, labels, cut=0.0)
    assert kept.columns == odd.columns and kept.count() == len(C.ODD_ROWS)
    assert Q.classify(C.no_documents(spark), labels.limit(0)).count() == 0
