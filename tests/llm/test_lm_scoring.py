from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import lm_scoring as L
from pagesieve.llm.trie import EliasFano, Quantised, Trie
from pagesieve.llm.words import word_hashes
from tests.llm import common as C


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def counted(rows, trained):
    words, pairs = Counter(), Counter()
    for k, t in rows:
        if trained(k):
            w = tokens(t)
            words.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    return words, pairs


def check(got, rows, trained):
    words, _ = counted(rows, trained)
    n, v = sum(words.values()), len(words)
    want = Counter()
    for k, t in rows:
        w = tokens(t)
        base = sum(log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[k, len(w), sum(words[x] > 0 for x in w), n, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want


def test_whole_table(spark):
    docs = C.documents(spark)
    rows = C.rows(docs, "doc_id", "text")
    got = L.score_held_out(docs).collect()
    check(got, rows, lambda k: C.fold(k, 10) != 0)
    assert all(r["held_out"] == (C.fold(r["doc_id"], 10) == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_blocks_and_shards_do_not_matter(spark, monkeypatch):
    """Small blocks and many shards give the counts of one block, and scores that differ by quantising alone."""
    docs = C.documents(spark)
    one = {r["doc_id"]: r for r in L.score(docs).collect()}
    monkeypatch.setattr(L, "BLOCK", 3000)
    monkeypatch.setattr(L, "SHARD", 2000)
    many = L.score(docs).collect()
    check(many, C.rows(docs, "doc_id", "text"), lambda k: True)
    for r in many:
        assert r["score"] == pytest.approx(one[r["doc_id"]]["score"], rel=0.02, abs=0.5)


def test_equal_texts_score_alike_in_any_block(spark, monkeypatch):
    """Steps of the quantised logs are those of the corpus, not of the block a text falls in."""
    docs = C.documents(spark)
    one = dict(C.rows(L.score(docs), "doc_id", "score"))
    monkeypatch.setattr(L, "BLOCK", 3000)
    many = dict(C.rows(L.score(docs), "doc_id", "score"))
    assert many == {k: pytest.approx(v, rel=1e-9) for k, v in one.items()}


def test_against_plain_probabilities(spark):
    """The model's logs are those of the mixture, up to quantising; words sum to one in every context."""
    rows = C.rows(C.documents(spark), "doc_id", "text")[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trained = docs.doc_id % 3 != 0
    blocks = L.encoded(docs, "doc_id", "text", trained)
    words, pairs = counted(rows, lambda k: k % 3 != 0)
    counts = L.Counts(len(words), sum(n == 1 for n in words.values()), sum(words.values()))
    weights = np.full(L.CLASSES, 0.4)
    by_hash = {int(word_hashes(w)[0]) if w is not None else int(L.END): w for k, t in rows for w in tokens(t)}
    off = min(counts.once / counts.types, 0.9)
    assert sum(10 ** counts.word_logs(np.array(list(words.values())))) + off * counts.types / counts.tokens == pytest.approx(1)
    for row in blocks.drop("entries").collect():
        block = L._block({k: (bytes(v) if isinstance(v, bytearray) else v) for k, v in row.asDict().items()})
        names = [by_hash[int(h)] for h in block.words]
        own = np.array([words[w] for w in names])
        both = np.array([pairs[names[u], names[w]] for u, w in zip(block.context, block.word, strict=True)])
        logs = L.model_of(block, own, both, counts, weights).log(block.context, block.word)
        for u, w, got in list(zip(block.context, block.word, logs, strict=True))[:3000]:
            p = (words[names[w]] - off if words[names[w]] else off * counts.types) / counts.tokens
            if words[names[u]]:
                p = 0.4 * pairs[names[u], names[w]] / words[names[u]] + 0.6 * p
            assert got == pytest.approx(log10(p), abs=0.1)


def test_odd_rows(spark):
    odd = C.odd_documents(spark)
    got = L.score(odd).collect()
    check(got, C.ODD_ROWS, lambda k: True)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    untrained = L.score(odd, trained=F.lit(False)).collect()
    assert len(untrained) == len(C.ODD_ROWS) and all(r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in untrained)
    assert L.score(C.no_documents(spark)).count() == 0
    nobody = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(C.rows(L.score(nobody), "doc_id", "n_tokens")) == [(None, 1), (None, 3)]


def test_word_hashes():
    texts = ["a bb a\tccc\na", "", "   ", "x", "日本 語\x0b日本\x0c" + "y" * 100_000 + " x"]
    seen = defaultdict(set)
    for text in texts:
        words = text.encode().split()
        hashes = word_hashes(text.encode()).tolist()
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes, strict=True):
            seen[w].add(h)
    assert all(len(h) == 1 for h in seen.values()) and len(set.union(*seen.values())) == len(seen)


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (5, 3), (64, 2), (1000, 50), (1000, 10**9), (20_000, 10**12)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    code = EliasFano.of(values)
    assert (code.get(np.arange(n)) == values).all()
    wanted = np.concatenate([rng.integers(0, top + 5, 300), values[:300]])
    assert (code.find(wanted) == np.searchsorted(values, wanted)).all()


def test_trie_of_three_levels(tmp_path):
    rng = np.random.default_rng(7)
    words = 60
    two = np.unique(rng.integers(0, words * words, 700))
    a, b = np.divmod(two, words)
    three = np.unique(rng.integers(0, len(two) * words, 3000))
    c, d = np.divmod(three, words)
    trie = Trie.of(-rng.random(words), -rng.random(words), (a, b, -rng.random(len(two))), (c, d, -rng.random(len(three))))
    trie.save(tmp_path / "model")
    for t in (trie, Trie.open(tmp_path / "model")):
        for level, keys, above in ((0, two, words), (1, three, len(two))):
            every = np.arange(above * words)
            at = np.searchsorted(keys, every)
            want = np.where(keys[np.minimum(at, len(keys) - 1)] == every, at, -1)
            assert (t.successor(level, *np.divmod(every, words)) == want).all()
    assert trie.nbytes() < 8 * 8 * len(three)


def test_quantised():
    values = -np.random.default_rng(1).random(5000) * 9
    q = Quantised.of(values)
    assert abs(q.get(np.arange(5000)) - values).max() < 0.05
    assert q.get(np.arange(5000)).mean() == pytest.approx(values.mean())
