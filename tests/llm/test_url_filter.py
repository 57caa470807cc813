import zlib
from collections import Counter, defaultdict
from math import ceil, log

import numpy as np
import pytest

from pagesieve.llm import url_filter as U
from pagesieve.llm.queries import RULES, op2_url_likelihood_ratio
from tests.llm import common as C


def test_parts_and_rules(spark):
    cases = [
        ("http://A.Example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        ("http://x.org/q", "x.org", "/q", "org/"), ("http://xorg/q", "xorg", "/q", None), ("http://org/q", "org", "/q", "org/"),
        ("http://a.com/fr/", "a.com", "/fr/", "com/fr/"), ("http://a.com/de/://b.org/", "a.com", "/de/://b.org/", "com/de/"), ("http://a.com?x/fr/", "a.com", "", None),
        ("no address", "", "", None), (None, "", "", None), ("", "", "", None), ("://", "", "", None), ("http://É.ORG/", "É.org", "/", "org/"), ("http://x.net/a\nb", "x.net", "/a\nb", None),
    ]
    df = spark.createDataFrame([(i, c[0], "x", "x", "x") for i, c in enumerate(cases)], "page_id long, url string, host string, key string, gain string")
    got = {r["page_id"]: r for r in U.judge(df, RULES).collect()}
    assert len(got) == len(cases)
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), cases[i]
        if rule:
            assert got[i]["verdict"] == RULES[rule]
        assert got[i]["verdict"] in ("allow", "block")
    assert U.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in U.judge(df, {}).collect()} == {"allow"}


def plain_counts(texts):
    after = defaultdict(Counter)
    for t in texts:
        s = bytes([U.START]) * U.ORDER + t + bytes([U.END])
        for i in range(U.ORDER, len(s)):
            for k in range(U.ORDER + 1):
                after[s[i - k:i]][s[i]] += 1
    return after


def plain_log(after, text):
    """Witten-Bell over dictionaries, for the whole of `text` and its end."""
    s, total = bytes([U.START]) * U.ORDER + text + bytes([U.END]), 0.0
    for i in range(U.ORDER, len(s)):
        p = 1 / 256
        for k in range(U.ORDER + 1):
            seen = after.get(s[i - k:i])
            if seen and (k == 0 or sum(seen.values()) >= 2):
                n = sum(seen.values())
                p = (seen[s[i]] + len(seen) * p) / (n + len(seen))
        total += log(p)
    return total


def test_model_against_dictionaries(spark):
    good, bad = [b"a.org/one", b"a.org/two", b"b.org/one"], [b"spam.com/x", b"spam.com/xx", b""]
    rows = [(bytearray(t), True) for t in good] + [(bytearray(t), False) for t in bad]
    models = U.learn(spark.createDataFrame(rows, "url binary, accepted boolean"))
    for text in (b"a.org/one", b"spam.com/x", b"", "ü?".encode(), b"c.net/zz"):
        contexts, byte = U.grams([text])
        assert models[True].logs(contexts, byte).sum() == pytest.approx(plain_log(plain_counts(good), text))
        assert models[False].logs(contexts, byte).sum() == pytest.approx(plain_log(plain_counts(bad), text))


def test_grams_of_several_texts():
    texts = [b"abc", b"", b"xyzxyz"]
    contexts, byte = U.grams(texts)
    apart = [U.grams([t]) for t in texts]
    assert (contexts == np.concatenate([c for c, _ in apart], 1)).all() and (byte == np.concatenate([b for _, b in apart])).all()


def test_whole_table_against_dictionaries(spark):
    """Every gain and verdict, from counts in plain dictionaries and a plain cut."""
    pages = {i: u.split("://", 1)[1].encode() for i, u in C.rows(spark.read.parquet(f"{C.FOLDER}/pages.parquet"), "page_id", "url")}
    got = {r["page_id"]: r for r in op2_url_likelihood_ratio(spark, C.FOLDER).collect()}
    assert got.keys() == pages.keys()
    said = {i: RULES[r["rule"]] for i, r in got.items() if r["rule"]}
    held_out = {i for i in said if zlib.crc32(pages[i]) % 5 == 0}
    models = {v: plain_counts([pages[i] for i in said if said[i] == v and i not in held_out]) for v in ("allow", "block")}
    gains = {i: (plain_log(models["allow"], t) - plain_log(models["block"], t)) / (len(t) + 1) for i, t in pages.items()}
    assert all(got[i]["gain"] == pytest.approx(g) for i, g in gains.items())
    shown = sorted(gains[i] for i in held_out if said[i] == "allow")
    cut = min(0.0, shown[max(0, ceil(U.FALSE_BLOCKS * len(shown)) - 1)]) if shown else 0.0
    assert {i: r["verdict"] for i, r in got.items()} == {i: said.get(i, "allow" if g >= cut - 1e-9 else "block") for i, g in gains.items()}


def test_models_agree_with_the_rules_that_taught_them(spark):
    got = op2_url_likelihood_ratio(spark, "/root/testdata/sf0.01")
    ruled = [r for r in got.collect() if r["rule"]]
    assert sum((r["gain"] >= 0) == (r["verdict"] == "allow") for r in ruled) > 0.9 * len(ruled)
