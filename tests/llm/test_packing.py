import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagesieve.llm import packing as P
from tests.llm import common as C

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, size):
    """Best-two-fit over single documents, the plain way."""
    left, bins = sorted(lengths), []
    while left:
        bin_, gap = [], size
        while fit := [x for x in left if x <= gap]:
            bin_.append(max(fit))
            left.remove(max(fit))
            gap -= max(fit)
        if gap and len(bin_) > 1:
            small, room = min(bin_), gap + min(bin_)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[:i] if a + b <= room]
            if pairs and max(pairs)[0] > small:
                _, a, b = max(pairs)
                bin_.remove(small)
                left = sorted([*left, small])
                for x in (a, b):
                    bin_.append(x)
                    left.remove(x)
        bins.append(tuple(sorted(bin_)))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_histogram_gives_the_bins_of_single_documents(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 37, 100])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 120))]
    ours = Counter()
    for used, times in P.best_two_fit(Counter(lengths), size):
        ours[tuple(sorted(Counter(used).elements()))] += times
    assert sum(len(b) * n for b, n in ours.items()) == len(lengths)
    assert Counter(x for b, n in ours.items() for _ in range(n) for x in b) == Counter(lengths)
    theirs = one_by_one(lengths, size)
    assert all(sum(b) <= size for b in ours)
    assert sum(ours.values()) == len(theirs)


def test_second_fit_replaces_the_smallest():
    # 6 + 3 leaves 1; 2 + 2 in place of 3 fills the bin
    assert P.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]
    assert P.best_two_fit({}, 10) == []


def check(rows, size):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_ids_of_whole_texts(spark):
    texts = [t for _, t in C.rows(C.documents(spark), "doc_id", "text")]
    texts += ["It's we'll 'S o'clock don''t", "ǅ ΑΣ ΑΣ. İx ｆｕｌｌ", "a\x1cb c\x85d e f", "<|startoftext|> a<|endoftext|>b", "x1y2 12.5% (a,b) [c]_d a-b é É́", "!?.. ,,a &amp; <b>", "日本 語。x ©2020 naïve"]
    coder = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, P.Words(PATH).ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*coder.encode(text, add_special_tokens=False).ids, P.END], text[:60]


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 5)
    words = P.Words(PATH)
    first = words.ids([b"one two three Four, five. six"])
    words.ids([b"seven eight nine ten eleven twelve"])
    assert words.ids([b"one two three Four, five. six"]) == first and len(words.known) <= 6


def test_whole_table(spark):
    docs = C.documents(spark)
    coder = Tokenizer.from_file(PATH)
    got = P.pack(P.pieces(docs, PATH, size=512), 512).collect()
    want = {}
    for k, t in C.rows(docs, "doc_id", "text"):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for i in range(0, len(ids), 512):
            want[k, i // 512] = (i, len(ids[i:i + 512]), zlib.crc32(ids[i:i + 512].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert check(got, 512) <= 1.02 * sum(r["length"] for r in got) / 512 + 1


def test_odd_rows(spark):
    got = P.pack(P.pieces(C.odd_documents(spark), PATH)).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(k for k, _ in C.ODD_ROWS)
    assert {r["length"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert sum(r["doc_id"] == 7 for r in got) > 5
    check(got, P.SIZE)
    assert P.pack(P.pieces(C.no_documents(spark), PATH)).count() == 0


def test_many_of_one_length(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'a b c d e') AS text")
    got = P.pack(P.pieces(df, PATH, size=7), 7).collect()
    assert check(got, 7) == 2666 + 445  # one of six to a sequence, or three of two
