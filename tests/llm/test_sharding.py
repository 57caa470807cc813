import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from pagesieve.llm import sharding
from tests.llm import common as C


def jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int(float(at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def number(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def expected(doc_id, text):
    data = (text or "").encode()
    return doc_id, len(data) + 1, zlib.crc32(data), jump(number(doc_id), 16), jump(number(doc_id), 17)


@pytest.mark.parametrize("shards", [1, 2, 17, 1000, 2_000_000])
def test_jump_hash(spark, shards):
    keys = [0, 1, 2**63, 2**64 - 1, 10**19, 123456789]
    df = spark.createDataFrame([(str(k),) for k in keys], "k string")
    got = [r[0] for r in df.select(sharding.jump_hash(df.k.cast("decimal(20,0)"), shards)).collect()]
    assert got == [jump(k, shards) for k in keys]


def test_whole_table(spark):
    docs = C.documents(spark)
    got = C.rows(sharding.shard(docs), "doc_id", "size", "text_crc32", "shard", "grown_shard", "slot", "law")
    assert Counter(g[:5] for g in got) == Counter(expected(*r) for r in C.rows(docs, "doc_id", "text"))
    slots = defaultdict(list)
    for g in got:
        slots[g[3]].append(g[5])
        assert g[6] == "key" and g[4] in (g[3], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark):
    got = C.rows(sharding.shard(C.odd_documents(spark)), "doc_id", "size", "text_crc32", "shard", "grown_shard", "slot")
    assert Counter(g[:5] for g in got) == Counter(expected(*r) for r in C.ODD_ROWS)
    assert len({(g[3], g[5]) for g in got}) == len(got)
    assert sharding.shard(C.no_documents(spark)).count() == 0


def test_one_key_of_many_rows(spark):
    df = spark.range(5000).selectExpr("7L AS doc_id", "if(id % 2 = 0, 'same', string(id)) AS text")
    got = C.rows(sharding.shard(df), "shard", "slot")
    assert len({g[0] for g in got}) == 1 and sorted(g[1] for g in got) == list(range(5000))


def test_copies_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = spark.createDataFrame([(1, "copy")] * 50 + [(1, "other"), (2, "x")] + [(3, "y")] * 7, "doc_id long, text string")
    got = C.rows(sharding.shard(docs, 4), "doc_id", "size", "shard", "slot")
    assert len(got) == 59 and sorted(r[:2] for r in got) == sorted([(1, 5)] * 50 + [(1, 6), (2, 2)] + [(3, 2)] * 7)
    for shard in {r[2] for r in got}:
        slots = sorted(r[3] for r in got if r[2] == shard)
        assert slots == list(range(len(slots)))
