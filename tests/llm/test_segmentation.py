import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from pagesieve.llm import segmentation as S
from tests.llm import common as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["  Hello  wörld\n\nfoo\t bar  日本 ", "▁ a▁b ▁", "\n", " ", "<0x0A><s></s><unk>", "x\x00y​𝒳🙂", "a\r\nb c", "  \n  \n", "lonely\ud800x".encode("utf-8", "replace").decode()]


def test_without_dropout_as_the_library(spark):
    """Same ids, but where the text has the blank's own sign, which the library reads as a blank."""
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), S.Pieces.load(PATH)
    texts = [t for _, t in C.rows(C.documents(spark), "doc_id", "text")][:60] + [t for t in HARD if S.META not in t]
    for text in texts:
        ids = [i for cut in S._CUT.findall(" " + text) for i in pieces.segment(cut, 0, 0)]
        assert ids == model.encode(text), text[:50]


def test_cuts_cover_the_text():
    for text in HARD:
        assert "".join(S._CUT.findall(" " + text)) == " " + text


def test_whole_table_is_lossless_and_varied(spark):
    docs = C.documents(spark)
    got = S.encode(docs, PATH).cache()
    assert got.filter(~F.col("lossless")).count() == 0 and got.count() == docs.count()
    back = S.decode(got.select("doc_id", "ids"), PATH)
    assert sorted(C.rows(back, "doc_id", "text")) == sorted(C.rows(docs, "doc_id", "text"))
    plain = S.encode(docs, PATH, drop=0.0)
    n, m = (df.agg(F.sum("n_ids")).first()[0] for df in (got, plain))
    assert 1.02 * m < n < 2 * m
    again, other = S.encode(docs, PATH), S.encode(docs, PATH, seed=1)
    assert sorted(C.rows(got, "doc_id", "ids")) == sorted(C.rows(again, "doc_id", "ids")) != sorted(C.rows(other, "doc_id", "ids"))


def test_share_of_skipped_merges():
    """One pair of symbols has one candidate, skipped in about a tenth of the keys."""
    pieces = S.Pieces.load(PATH)
    skipped = sum(len(pieces.segment("in", key * 7919, round(S.DROP * 2**32))) == 2 for key in range(5000))
    assert 400 < skipped < 600
    assert len({tuple(pieces.segment(" international", key * 7919, round(S.DROP * 2**32))) for key in range(50)}) > 3


def test_list_and_heap_agree(monkeypatch):
    pieces = S.Pieces.load(PATH)
    cuts = [" internationalisation.", "   ", " aaaaaaaaaaaa", "xyzzy" * 7, " ÉÉéé日本", "a"]
    for drop in (0, round(0.3 * 2**32)):
        by_list = [pieces.segment(c, key, drop) for c in cuts for key in range(40)]
        monkeypatch.setattr(S, "SHORT", 0)
        assert [pieces.segment(c, key, drop) for c in cuts for key in range(40)] == by_list
        monkeypatch.undo()


def test_every_occurrence_has_its_own_skips(spark):
    """A word that recurs is cut in many ways, within one text and over the texts of many ids."""
    one = spark.createDataFrame([(1, "internationalisation " * 2000)], "doc_id long, text string")
    many = spark.createDataFrame([(i, "internationalisation") for i in range(2000)], "doc_id long, text string")
    pieces = S.Pieces.load(PATH)
    plain = tuple(pieces.segment(" internationalisation", 0, 0))
    within, now = Counter(), []
    for i in S.encode(one, PATH).first()["ids"]:
        if now and pieces.spelled[i].startswith(b" "):
            within[tuple(now)] += 1
            now = []
        now.append(i)
    over = Counter(tuple(r["ids"]) for r in S.encode(many, PATH).collect())
    rng = random.Random(1)
    alike = sum(tuple(pieces.segment_by(" internationalisation", lambda left, size: rng.random() < S.DROP)) == plain for _ in range(4000)) / 4000
    for ways in (within, over):
        assert len(ways) > 100 and abs(ways[plain] / 2000 - alike) < 0.05


def test_remembered_outcomes_are_those_of_each_cut(monkeypatch):
    """States give the ids that cutting every occurrence by itself gives, also when the memory starts anew."""
    pieces, drop = S.Pieces.load(PATH), round(0.3 * 2**32)
    text = " ".join(["internationally known words, and", "the the of a xyzzy 日本 𝒳 ▁", "x" * 50, "\n \n  "] * 60)
    cuts, keys = S._CUT.findall(" " + text), S.spots(-5, len(S._CUT.findall(" " + text)))
    want = [pieces.segment(c, k, drop) for c, k in zip(cuts, keys.tolist(), strict=True)]
    for states, at_once in ((400_000, 1 << 16), (10, 7)):
        monkeypatch.setattr(S, "STATES", states)
        monkeypatch.setattr(S, "CUTS", at_once)
        ids, sizes = S.Outcomes(pieces, drop).of(cuts, keys)
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    assert S.Outcomes(pieces, 0).of(cuts, keys)[0].tolist() == [i for c in cuts for i in pieces.segment(c, 0, 0)]
    assert len(set(S.spots(1, 1000).tolist()) | set(S.spots(2, 1000).tolist())) > 1990


def test_short_cuts_go_side_by_side(monkeypatch):
    """No short cut goes through an agenda of its own, and the ids are those that it would give."""
    pieces, rng = S.Pieces.load(PATH), random.Random(7)
    signs = ["a", "e", "n", "t", "é", "日", "𝒳", "🙂", "▁", " ", "\0", "\ud800", "international", "the"]
    cuts = ["".join(rng.choices(signs, k=rng.randint(1, 30)))[:rng.randint(1, S.WIDEST)] for _ in range(3000)] * 2
    cuts += [" " * n for n in (1, 2, S.WIDEST)] + ["a" * S.WIDEST, "the " * 8, " of"] * 50
    keys = S.spots(11, len(cuts))
    for drop in (0, round(S.DROP * 2**32), round(0.6 * 2**32), 2**32 - 1):
        want = [pieces.segment(c, k, drop) for c, k in zip(cuts, keys.tolist(), strict=True)]
        with monkeypatch.context() as m:
            m.setattr(S.Pieces, "segment_by", None)
            ids, sizes = S.Outcomes(pieces, drop).of(cuts, keys)
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    beyond = ["x" * (S.WIDEST + 1), "é" * 500]
    assert S.Outcomes(pieces, drop).of(beyond, keys[:2])[0].tolist() == [i for c, k in zip(beyond, keys.tolist()) for i in pieces.segment(c, k, drop)]


def test_odd_rows(spark):
    odd = C.odd_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(HARD, 50)), "doc_id long, text string"))
    got = S.encode(odd, PATH).collect()
    assert len(got) == len(C.ODD_ROWS) + len(HARD) and all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in got)
    assert all(r["ids"] == [] for r in got if r["doc_id"] in (1, 2))
    clashing = S.encode(C.odd_documents(spark), PATH)
    assert clashing.columns == ["doc_id", "draw", "ids", "n_ids", "lossless"] and clashing.count() == len(C.ODD_ROWS)
    assert S.encode(C.no_documents(spark), PATH).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(C.rows(S.decode(none, PATH), "doc_id", "text")) == [(1, None), (2, "")]
