import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagesieve.llm import quality_rules as Q
from tests.llm import common as C


def plain(text):
    w = C.words(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if C.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts(spark):
    docs = C.documents(spark)
    got = {r[0]: r[1:] for r in C.rows(Q.word_stats(docs), "doc_id", *NAMES)}
    assert got == {k: plain(t) for k, t in C.rows(docs, "doc_id", "text")}


def test_odd_rows(spark):
    extra = [(20, "a b c a b c"), (21, "a a a a"), (22, "x\nx\n \n\nx"), (23, "a b c d b c d e"), (24, "a b")]
    df = C.odd_documents(spark).select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*e, "x") for e in extra], "doc_id long, text string, n string"))
    got = Counter(C.rows(Q.word_stats(df), "doc_id", *NAMES))
    assert got == Counter((k, *plain(t)) for k, t in C.ODD_ROWS + extra)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_rules(C.no_documents(spark), none).count() == 0
    kept = dict(C.rows(Q.quality_rules(df, none), "doc_id", "kept"))
    assert not any(kept.values())  # too short, or one word over and over


def test_windows_that_only_seem_to_recur(spark, monkeypatch):
    """With eleven bits of the first hash left, nearly all of 20,000 windows meet another one."""
    monkeypatch.setattr(Q, "number_bits", lambda n: F.lit(53))
    rows = [(1, " ".join(f"w{i}" for i in range(20_000))), (2, " ".join(f"w{i % 9_000}" for i in range(9_100))), (3, "a b c a b c"), (4, None)]
    got = {r[0]: r[1:] for r in C.rows(Q.word_stats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", *NAMES)}
    assert got == {k: plain(t) for k, t in rows} and got[1][-1] == 0


def test_bound_is_exact():
    assert Q.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert Q.upper_bound(5, 5, 0.05) == 1.0
    p = Q.upper_bound(3, 50, 0.01)
    assert sum(math.comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4)) == pytest.approx(0.01, rel=1e-6)


def test_cutoffs_stop_at_the_first_that_fails():
    good, bad = [0, 0, 1, 500, 0, 1000], [0, 10, 20, 90, 100, 100]
    assert Q.choose(good, bad, 0.01, 0.01) == 2  # not step 4, which lies behind one that fails
    assert Q.choose([0, 0, 5], [0, 5, 5], 0.01, 0.01) is None  # five texts prove nothing


def test_rejects_what_the_labels_show(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(1500)]
    bad = [(i, " ".join(f"w{i}x{j}###" for j in range(60))) for i in range(1500, 1700)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1500)) for i in range(1700)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, quality int")
    got = C.rows(Q.quality_rules(docs, labels), "doc_id", "kept")
    assert len(got) == 1700 and all(kept == (i < 1500) for i, kept in got)
