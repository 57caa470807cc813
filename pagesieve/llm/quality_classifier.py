"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees are grown level by level on binned features with the logistic loss, and flattened into arrays
of complete binary trees, so that a batch of texts walks all trees with one numpy step per level.
The model learns from a bounded sample of labelled texts; every text is then scored where it lies,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "symbol", "exclaim", "bar", "stop", "other", "wide",
    "distinct_words", "same_as_last", "lines", "dup_lines", "line_words", "top_pair",
)
KINDS = ("lower", "upper", "digit", "symbol", "exclaim", "bar", "stop", "other", "wide", "blank")
_KIND = np.full(256, KINDS.index("other"), np.uint8)
_KIND[128:] = KINDS.index("wide")
for _kind, _chars in {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "symbol": b"#*$%&<>@^~",
    "exclaim": b"!?", "bar": b"|", "stop": b".,;:", "blank": b" \t\n\x0b\x0c\r",
}.items():
    _KIND[np.frombuffer(_chars, np.uint8)] = KINDS.index(_kind)

SAMPLE = 20_000  # labelled texts to learn from, at most about so many
BINS, DEPTH, ROUNDS, RATE, LEAST = 64, 4, 80, 0.15, 10


def statistics(text: str | None) -> list[float]:
    """Features of one whole text; null counts as empty, and an empty text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=len(KINDS))
    solid = len(data) - kinds[-1]
    share = (kinds[:-1] / solid).tolist()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = len(words)
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), solid / n, *share,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        len(lines) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
    ]


def features(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass(frozen=True)
class Trees:
    """Complete binary trees side by side. Row t: inner nodes in level order, then leaves."""

    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # goes right when the feature is above this
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        trees = np.arange(len(self.leaf))
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(trees) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.above[trees, node])
        total = self.start + self.leaf[trees, node - self.feature.shape[1]].sum(1) if len(trees) else np.full(len(x), self.start)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows the score is 0.5; with one label only, near that label."""
    n, width = x.shape
    positive = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(positive / (1 - positive)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)], 1)  # bin b: above edge b - 1
    cell = np.arange(width) * BINS + binned
    feature, above, leaf = [], [], []
    total = np.full(n, start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        where = np.zeros(n, np.int64)
        chosen, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)  # a node that does not split sends all left
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            at = ((where - first)[:, None] * (width * BINS) + cell).ravel()
            sums = [np.bincount(at, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, cl), (ga, ha, ca) = sums, [s[:, :1, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(cl < LEAST) | (ca - cl < LEAST)] = 0
            flat = gain[:, :, :-1].reshape(nodes, -1)
            best = flat.argmax(1)
            for k in np.flatnonzero(flat[np.arange(nodes), best] > 1e-6):
                f, b = divmod(int(best[k]), BINS - 1)
                if b < len(edges[f]):
                    chosen[first + k], limit[first + k] = f, edges[f][b]
            where = 2 * where + 1 + (x[np.arange(n), chosen[where]] > limit[where])
        spot = where - inner
        value = rate * np.bincount(spot, g, leaves) / (np.bincount(spot, h, leaves) + ridge)
        total += value[spot]
        feature.append(chosen), above.append(limit), leaf.append(value)
    return Trees(np.array(feature), np.array(above), np.array(leaf), start)


def in_parts(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fits the trees on at most about `sample` labelled texts, chosen by a hash of the key.

    Missing keys and labels teach nothing. Of several labels of a key the largest counts, and of
    several texts one.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna().groupBy("key").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(1, marks.count()))
    chosen = marks.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def described(batches):
        for whole in batches:
            for batch in in_parts(whole):
                x = features(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["key", "label", "x"])

    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # the sample is bounded, so it may be sent to where the texts are
    rows = texts.join(F.broadcast(chosen), "key").select("key", "label", "text").mapInArrow(described, f"key {docs.schema[key].dataType.simpleString()}, label int, x array<double>")
    one = rows.groupBy("key").agg(F.min_by(F.struct("label", "x"), F.xxhash64("x")).alias("r")).select("key", "r.*").toPandas().sort_values("key")
    x = np.array(one["x"].tolist(), np.float64).reshape(len(one), len(FEATURES))
    return grow(x, one["label"].to_numpy(np.float64))


def score(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """`key`, score (0 to 1) and predicted (1 if score >= cut) for every row; null texts count as empty."""

    def scored(batches):
        for whole in batches:
            for batch in in_parts(whole):
                p = trees.score(features(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["key", "score", "predicted"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(scored, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, learned from labels outside fold 0 of 5."""
    trees = learn(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    return score(docs, trees).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """Documents whose score reaches the cut, with all their columns."""
    trees = learn(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    names = docs.columns

    def good(batches):
        for whole in batches:
            for batch in in_parts(whole):
                p = trees.score(features(batch.column(names.index("text")).to_pylist()))
                yield batch.filter(pa.array(p >= cut))

    return docs.mapInArrow(good, docs.schema)
