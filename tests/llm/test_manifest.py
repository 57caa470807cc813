import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagesieve.llm import manifest as M
from pagesieve.llm.queries import op11_merkle_manifest
from tests.llm import common as C

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Root and, per node, its siblings level by level as (left, right)."""
    steps, at, of = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(of) > 1:
        for i, a in enumerate(at):
            first = a - a % 3
            steps[i].append(("".join(of[first:a]), "".join(of[a + 1:first + 3])))
        of = [h(*of[i:i + 3]) for i in range(0, len(of), 3)]
        at = [a // 3 for a in at]
    return of[0], steps


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    trees = {}
    for row in rows:
        tampered = row[4] is not None and zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0
        found = leaf((*row[:4], row[4].replace("\n", ""))) if tampered else leaf(row)
        trees.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0, leaf(row)), row[0], leaf(row), found))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[0])]) for s in names}
    root, above = climb([low[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, key, own, found), mine in zip(sorted(trees[s], key=lambda x: x[0]), low[s][1], strict=True):
            fold = found
            for left, right in mine + up:
                fold = h(left, fold, right)
            out.append((key, own, low[s][0], root, h(*(a + b for a, b in mine + up)), fold, fold == root))
    return sorted(out, key=str)


def got(df):
    return sorted(C.rows(df, *NAMES), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_whole_table(spark):
    rows = C.rows(C.documents(spark), "doc_id", "source", "lang", "n_chars", "text")
    found = got(op11_merkle_manifest(spark, C.FOLDER))
    assert found == brute(rows)
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_odd_rows(spark):
    docs = C.odd_documents(spark).withColumn("source", F.when(F.col("doc_id") > 5, F.lit("zé")).when(F.col("doc_id") > 1, F.lit("")))
    docs = docs.withColumn("n_chars", F.when(F.col("doc_id") != 8, F.lit(4)))
    for n in ("tree", "digest", "leaf", "root", "place", "block", "total", "at"):
        docs = docs.withColumn(n, F.lit("x"))
    assert got(M.manifest(docs)) == brute(C.rows(docs, "doc_id", "source", "lang", "n_chars", "text"))
    assert got(M.manifest(docs.limit(0))) == []
    one = docs.filter("doc_id = 8")
    assert got(M.manifest(one)) == brute(C.rows(one, "doc_id", "source", "lang", "n_chars", "text"))


@pytest.mark.parametrize("levels, sizes", [(1, (1, 2, 3, 4, 9, 10, 28, 55, 100)), (2, (9, 10, 81, 82, 85))])
def test_exchange_over_many_blocks(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 3 ** levels)
    monkeypatch.setattr(M, "ROUNDS_KEPT", 2)
    rng = random.Random(7)
    rows = [(rng.randint(0, 10 ** 6), f"s{n}", None, i, rng.choice(["a\nb", "", None, "c"])) for n in sizes for i in range(n)]
    rows += [(5, "s100", "en", 1, "same\nrow")] * 40
    assert got(M.manifest(table(spark, rows).repartition(5))) == brute(rows)


def test_one_bit_less_is_found(spark):
    rows = [(i, "s", "en", 3, f"t{i}\n") for i in range(40)]
    assert {r[0] for r in got(M.manifest(table(spark, rows))) if not r[-1]} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 2 == 0}
