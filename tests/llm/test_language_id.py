import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagesieve.llm import language_id as L
from tests.llm import common as C


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in L.label(docs).collect()}
    want = dict(C.rows(docs, "doc_id", "lang"))
    held = [k for k in want if C.fold(k, 4) == 2]
    assert all(got[k]["held_out"] == (C.fold(k, 4) == 2) for k in want) and len(got) == len(want)
    assert sum(got[k]["lang_pred"] == want[k] for k in held) / len(held) > 0.97
    accepted = [k for k in held if got[k]["accepted"]]
    assert len(accepted) > 0.95 * len(held) and sum(got[k]["lang_pred"] == want[k] for k in accepted) / len(accepted) > 0.98


def test_labels_do_not_reach_the_prediction(spark):
    docs = C.documents(spark)
    model = L.learn(docs)
    swapped = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    assert sorted(C.rows(L.identify(docs, model), "doc_id", "lang_pred")) == sorted(C.rows(L.identify(swapped, model), "doc_id", "lang_pred"))


def test_odd_rows(spark):
    odd = C.odd_documents(spark)
    got = L.identify(odd, L.learn(C.documents(spark))).collect()
    assert len(got) == len(C.ODD_ROWS)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 and not by_id[k]["accepted"] for k in (1, 2, 3, 4))
    assert by_id[5]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got)
    kept = L.keep_named(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (1, 2, 3, 4)").count() == 0
    assert L.label(C.no_documents(spark)).count() == 0


def test_nothing_or_one_language_learned(spark):
    odd = C.odd_documents(spark)
    none = L.learn(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in L.identify(odd, none).collect()} == {"und"}
    one = L.learn(odd)
    assert {r["lang_pred"] for r in L.identify(odd, one).collect()} == {"und", "en"}


def test_copies_do_not_shrink_the_sample(spark):
    """A language of one text copied thousands of times beside a few others teaches all of them."""
    other = [("en", f"the house number {i} of the street") for i in range(40)]
    copied = [("xx", "zumi kalo bera")] * 3000
    few = [("xx", f"zumi kalo {w}") for w in ("dano", "miru", "pelo", "sako")]
    docs = spark.createDataFrame(other + copied + few, "lang string, text string")
    model = L.learn(docs, sample=10)
    assert model.names == ("xx", "en")
    taught = model.samples[0].decode()
    assert sum(w in taught for w in ("bera", "dano", "miru", "pelo", "sako")) == 3  # every second of five
    assert model.samples[1].decode().count("house") == 5  # of a sample of ten


def brute(rows):
    """Model of (lang, text) rows, with the hash and the choice of texts done anew."""
    distinct = {}
    for lang, text in rows:
        distinct.setdefault(lang, {})[xxhash.xxh64(text.encode(), seed=42).intdigest() >> 1] = text
    n = {k: sum(lang == k for lang, _ in rows) for k in distinct}
    names = sorted(distinct, key=lambda k: (-n[k], k))
    samples, margin_texts = [], []
    for k in names:
        offer = L.SPARE * L.DICTIONARY // ((min(L.SAMPLE, len(distinct[k])) + 1) // 2)
        able = [(o, t) for o, t in sorted(distinct[k].items()) if any(c.isalpha() for c in t)][: L.SAMPLE]
        samples.append(L.shared([L.piece_of(L.plain(t), o, offer) for o, t in able[::2]], L.DICTIONARY))
        margin_texts += [(k, t) for _, t in able[1::2]]
    model = L.Languages(tuple(names), tuple(samples))
    coders = model.coders()
    right = [m for k, t in margin_texts for told, m in [model.name(t, coders)] if told == k]
    return L.Languages(model.names, model.samples, float(np.quantile(right, L.LOST)))


def test_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in L.label(docs).collect()}
    rows = C.rows(docs, "doc_id", "lang", "text")
    model = brute([(lang, t) for k, lang, t in rows if C.fold(k, 4) != 2 and lang is not None and t is not None])
    coders = model.coders()
    for k, _, text in rows:
        name, margin = model.name(text, coders)
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["accepted"]) == (name, pytest.approx(margin), name != "und" and margin >= model.narrow)


def test_words_far_into_a_text_teach(spark):
    """Texts of one language begin with thousands of digits: what comes behind them is learned."""
    other = [("en", f"the house number {i} of the street where they lived") for i in range(40)]
    late = [("xx", f"{i:06d} " * 600 + f"zumi kalo bera dano {w} miru pelo sako") for i, w in enumerate("abcdefghij" * 4)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(other + late)], "doc_id long, lang string, text string")
    model = L.learn(docs)
    assert set(model.names) == {"en", "xx"}
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs, model).collect()}
    assert all(got[i] == ("en" if i < 40 else "xx") for i in got)


def test_numerals_are_no_letters():
    assert not any(map(L.has_letter, ["½ ² Ⅷ ①", "12 _ ٣", "", None])) and all(map(L.has_letter, ["1 é", "日", "ª", "ß"]))


def test_dictionary_is_shared_evenly():
    assert L.shared([b"a" * 10, b"b" * 100, b"c" * 100], 61) == b"a" * 10 + b" " + b"b" * 25 + b" " + b"c" * 25
    assert L.shared([b"aa", b"bb"], 100) == b"aa bb   "
    data = b" ".join(b"w%d" % i for i in range(1000))
    for order in (0, 1, 999, 123456789):
        piece = L.piece_of(data, order, 50)
        assert len(piece) <= 50 and set(piece.split()) <= set(data.split()) and piece in data


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError, match="lang"):
        L.learn(spark.createDataFrame([(f"l{i}", "text") for i in range(5)], "lang string, text string"))
