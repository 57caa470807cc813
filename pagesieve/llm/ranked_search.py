"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time.

Documents stay where they are: a task indexes its own in blocks, asks every item of each block in
turn and keeps the best so far, so what it found early prunes what comes later. Within a block, the
short posting lists of an item are added up term by term into accumulators. These then act as one
more list, with the largest accumulator as its bound, beside the long lists. Windows of documents are
scored from the lists that a newcomer must be in (MaxScore); the others are only searched at the
documents that can still reach the threshold. Only each task's best leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 21  # occurrences of asked terms after which a block ends; a document is never cut
WINDOW = 1 << 11  # documents scored at once
SHORT = 32  # a list is short if it has at most one document in so many of the block
ITEMS = 2000  # items asked in one pass over the documents, on average
MERGERS = 256  # groups per item in which the tasks' best meet first
NO_KEY = np.iinfo(np.int64).min

#: bytes of a term, A-Z lower-cased; all others end it
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and anything beyond ASCII, in UTF-8."""
    return text.translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Corpus:
    """What scores depend on beyond a document: N, L, and the weight of every asked term."""

    documents: int
    length: int
    weights: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        if len(n) and int(n.max()) * 50 * self.documents >= 1 << 63:
            return np.array([50 + 50 * int(x) * self.documents // self.length for x in n], np.int64)
        return 50 + (50 * n * self.documents) // self.length


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Postings:
    docs: np.ndarray  # ascending places in the block
    gains: np.ndarray  # what the term adds to their scores
    bound: int


class Best:
    """The k best of what was offered: score downwards, then key upwards."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.keys = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document must reach this."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores, self.keys = scores[order], keys[order]


def index(ids: np.ndarray, lens: np.ndarray, n_terms: np.ndarray, corpus: Corpus) -> dict[int, Postings]:
    """Posting lists of a block. ids: asked terms of all documents in turn; lens: how many of each."""
    docs = len(lens)
    pairs, tf = np.unique(ids * np.int64(docs) + np.repeat(np.arange(docs), lens), return_counts=True)
    term, doc = pairs // docs, pairs % docs
    m = corpus.lengths(n_terms)
    gains = corpus.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    asked, starts = np.unique(term, return_index=True)
    ends = np.append(starts[1:], len(term))
    return {int(t): Postings(doc[a:b], gains[a:b], int(gains[a:b].max())) for t, a, b in zip(asked, starts, ends, strict=True)}


def accumulated(lists: list[Postings]) -> Postings:
    """Term at a time: the sums of several lists, as one list."""
    docs, gains = np.concatenate([x.docs for x in lists]), np.concatenate([x.gains for x in lists])
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    starts = np.flatnonzero(np.diff(docs, prepend=-1))
    sums = np.add.reduceat(gains[order], starts)
    return Postings(docs[starts], sums, int(sums.max()))


def search(block: dict[int, Postings], keys: np.ndarray, asked: list[int], best: Best) -> None:
    """Offers to `best` all documents of the block that can be among the best."""
    n = len(keys)
    lists = [block[t] for t in asked if t in block]
    short = [x for x in lists if len(x.docs) * SHORT <= n]
    rest = [x for x in lists if len(x.docs) * SHORT > n]
    least = best.least
    if short:
        summed = accumulated(short)
        rest.append(summed)
        if len(summed.gains) >= best.k:
            # so many documents reach this already
            least = max(least, int(np.partition(summed.gains, -best.k)[-best.k]))
    rest.sort(key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in rest])  # the most that the first lists give together
    scores = np.zeros(WINDOW, np.int64)
    for low in range(0, n, WINDOW):
        free = int(np.searchsorted(reach, least))  # lists that alone cannot reach it
        if free == len(rest):
            return
        scores[:] = 0
        for x in rest[free:]:
            a, b = np.searchsorted(x.docs, (low, low + WINDOW))
            scores[x.docs[a:b] - low] += x.gains[a:b]
        found = np.flatnonzero(scores)
        total = scores[found]
        for i in range(free - 1, -1, -1):
            alive = total + reach[i] >= least
            found, total = found[alive], total[alive]
            if not len(found):
                break
            x = rest[i]
            at = np.minimum(np.searchsorted(x.docs, found + low), len(x.docs) - 1)
            total = total + np.where(x.docs[at] == found + low, x.gains[at], 0)
        good = total >= least
        if good.any():
            best.offer(total[good], keys[found[good] + low])
            least = max(least, best.least)


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int], corpus: Corpus):
    keys, ids, lens, n_terms, waiting = [], [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = terms(text)
            mine = [vocabulary[t] for t in found if t in vocabulary]
            if not mine:
                continue
            keys.append(NO_KEY if key is None else key)
            ids.append(np.array(mine, np.int64))
            lens.append(len(mine))
            n_terms.append(len(found))
            waiting += len(mine)
            if len(keys) >= BLOCK_DOCS or waiting >= BLOCK_POSTINGS:
                yield index(np.concatenate(ids), np.array(lens), np.array(n_terms, np.int64), corpus), np.array(keys, np.int64)
                keys, ids, lens, n_terms, waiting = [], [], [], [], 0
    if keys:
        yield index(np.concatenate(ids), np.array(lens), np.array(n_terms, np.int64), corpus), np.array(keys, np.int64)


def statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> Corpus:
    """N, L and document frequencies over all documents. Each task sends at most one row per asked term."""

    def run(batches: Iterator[pa.RecordBatch]):
        df = np.zeros(len(vocabulary) + 2, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if found := terms(text):
                    df[-2] += 1
                    df[-1] += len(found)
                    df[[vocabulary[t] for t in set(found) if t in vocabulary]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    counts = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r["term"]: r["n"] for r in counts}
    documents = n.get(len(vocabulary), 0)
    return Corpus(documents, n.get(len(vocabulary) + 1, 0), np.array([weight(documents, n.get(t, 0)) for t in range(len(vocabulary))], np.int64))


def _asked(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The best of every task for some items: row, doc, score."""
    lists = [(r["row"], sorted(set(terms(r["text"])))) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in lists for t in ts}))}
    asked = [(row, [vocabulary[t] for t in ts]) for row, ts in lists if ts]
    corpus = statistics(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        pools = [Best(k) for _ in asked]
        for block, keys in _blocks(batches, vocabulary, corpus):
            for (_, ts), best in zip(asked, pools, strict=True):
                search(block, keys, ts, best)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        for (row, _), best in zip(asked, pools, strict=True):
            if n := len(best.keys):
                doc = pa.array(best.keys, mask=best.keys == NO_KEY)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([part] * n, pa.int32()), doc, pa.array(best.scores)], names=["row", "part", "doc", "score"])

    return docs.mapInArrow(run, "row long, part int, doc long, score long")


def _first(rows: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.col("doc").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_all(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`item`, rank, doc_id, score: the k highest-scoring documents of every item.

    Equal scores go by ascending key, missing keys first; repeated rows are ranked each. Only scores
    above 0 count. Null texts have no terms, and items without terms no rows; repeated items are asked
    each. Other columns are ignored; empty tables give no rows. Whole texts are read twice per some ITEMS
    items: for the statistics of all documents, and to score. Keys must be whole numbers.
    """
    spark = docs.sparkSession
    bodies = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").cast("binary").alias("text"))
    # numbered and written: the same rows in every pass
    listed = stored(items.select(F.monotonically_increasing_id().alias("row"), F.col(item).alias("item"), F.col(item_text).cast("string").cast("binary").alias("text")), "items")
    passes = max(1, math.ceil(listed.count() / ITEMS))
    found = None
    for i in range(passes):
        asked = listed.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).select("row", "text").collect()
        best = _asked(bodies, asked, k)
        found = best if found is None else found.unionByName(best)
    near = _first(found.withColumn("part", F.col("part") % MERGERS), k, "row", "part").drop("rank")
    return _first(near, k, "row").join(listed.drop("text"), "row").select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same ranking of `documents` for `benchmark`, every score in full.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_all FROM d WHERE len(terms) > 0),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, c WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 50 + (50 * CAST(len(terms) AS BIGINT) * n_docs) // n_all AS m FROM d, c WHERE len(terms) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
