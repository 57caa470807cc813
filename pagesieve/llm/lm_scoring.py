"""Language-model scores from an Elias-Fano n-gram trie, with counts gathered over the whole corpus.

1. Documents are encoded into blocks of about a million tokens: per token its place among the
   block's own words, which are kept as 64-bit hashes. Blocks are written out.
2. Every block sends its distinct words and bigrams to shards of the hash space, packed into one row
   per block and shard; a shard adds up what all blocks counted and answers in the same order. A word
   or bigram comes at most once from a block, so no shard is hot, however frequent it is.
3. With these totals each block reports how well mixtures of bigram and word probabilities predict
   its training tokens, each left out of the counts; the best weights, by frequency of the context,
   are fixed over all blocks.
4. Each block builds the part of the model that it needs as a trie of quantised smoothed
   probabilities, looks its bigrams up, and adds up the documents.

No table of words or n-grams ever lies in one place; memory follows the size of a block and a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored
from .trie import Trie
from .words import mixed, word_hashes

BLOCK = 1 << 20  # tokens from which a block is closed
SHARD = 1 << 22  # entries of a shard, on average
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a document among word hashes
ODD = np.uint64(0x9E3779B97F4A7C15)
CLASSES = 32  # contexts by the binary logarithm of their count
WEIGHTS = np.concatenate([[0.001, 0.003], np.linspace(0.01, 0.1, 7), np.linspace(0.15, 0.95, 17), [0.98]])
WORDS, PAIRS, TOTALS = 0, 1, 2
ASKED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("totals", pa.binary())])


def packed(values: np.ndarray) -> bytes:
    """Numbers of one width as planes of bytes, compressed: high bytes are mostly zero, low ones uneven."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


@dataclass
class Block:
    """One block in the form that its work needs: pairs are (context, word) places in `words`."""

    words: np.ndarray  # hashes, ascending
    tokens: np.ndarray  # places of all tokens, document after document
    sizes: np.ndarray  # tokens per document
    train: np.ndarray  # whether a document is trained on

    def __post_init__(self) -> None:
        self.end = int(np.searchsorted(self.words, END))
        context = np.concatenate([[self.end], self.tokens[:-1]]).astype(np.int64)
        self.pairs, self.at = np.unique(context * len(self.words) + self.tokens, return_inverse=True)
        self.context, self.word = np.divmod(self.pairs, len(self.words))
        self.trained = np.repeat(self.train, self.sizes)
        self.pair_counts = np.bincount(self.at, self.trained, len(self.pairs)).astype(np.uint32)
        self.word_counts = np.bincount(self.tokens, self.trained, len(self.words)).astype(np.uint32)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pairs in ascending order, and which pairs they are."""
        keys = mixed(self.words[self.context] * ODD + self.words[self.word])
        order = np.argsort(keys)
        return keys[order], order


def encoded(docs: DataFrame, key: str, text: str, trained) -> DataFrame:
    """Blocks of documents. Null texts are empty; every document ends with END."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), trained.alias("train"), F.col(text).cast("string").cast("binary").alias("data"))

    def run(batches):
        keys, train, sizes, hashes, held = [], [], [], [], 0
        for whole in batches:
            for k, t, data in zip(whole.column(0), whole.column(1).to_pylist(), whole.column(2).to_pylist(), strict=True):
                words = word_hashes((data or b"").lower())
                keys.append(k)
                train.append(t)
                sizes.append(len(words) + 1)
                hashes += [words, np.array([END])]
                held += len(words) + 1
                if held >= BLOCK:
                    yield _as_block(keys, train, sizes, hashes)
                    keys, train, sizes, hashes, held = [], [], [], [], 0
        if keys:
            yield _as_block(keys, train, sizes, hashes)

    def _as_block(keys, train, sizes, hashes):
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        return pa.RecordBatch.from_pydict({
            "keys": [pa.array([k.as_py() for k in keys], keys[0].type)], "train": [train], "sizes": [sizes],
            "words": [packed_keys(words)], "tokens": [packed(tokens.astype(np.uint32))], "entries": [len(words) + len(tokens)],
        }, schema=pa.schema([("keys", pa.list_(keys[0].type)), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary()), ("entries", pa.int64())]))

    blocks = rows.mapInArrow(run, f"keys array<{kind}>, train array<boolean>, sizes array<int>, words binary, tokens binary, entries long")
    return blocks.withColumn("block", F.monotonically_increasing_id())


def _block(row: dict) -> Block:
    return Block(unpacked_keys(row["words"]), unpacked(row["tokens"], np.uint32).astype(np.int64), np.array(row["sizes"]), np.array(row["train"], bool))


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0] | {"keys_type": batch.schema.field("keys").type}


def gathered(blocks: DataFrame, shards: int) -> DataFrame:
    """Totals over all blocks: rows (block, kind, shard, totals) in the order of the block's sorted keys.

    Rows of kind TOTALS carry a shard's number of trained words, those trained once, and trained tokens.
    """
    def ask(batches):
        for row in _rows(batches):
            block = _block(row)
            pair_keys, order = block.keys()
            out: list[tuple] = []
            for kind, keys, counts in ((WORDS, block.words, block.word_counts), (PAIRS, pair_keys, block.pair_counts[order])):
                bounds = np.append(np.searchsorted(keys, _starts(shards)), len(keys))
                for shard in np.flatnonzero(np.diff(bounds)).tolist():
                    part = slice(bounds[shard], bounds[shard + 1])
                    out.append((shard, kind, row["block"], packed_keys(keys[part]), packed(counts[part])))
            yield _batch(out, ASKED)

    def together(batches):
        now, blocks_, keys, counts = None, [], [], []
        for batch in batches:
            for shard, kind, block, k, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (shard, kind) != now:
                    if now:
                        yield from answer(now, blocks_, keys, counts)
                    now, blocks_, keys, counts = (shard, kind), [], [], []
                blocks_.append(block)
                keys.append(unpacked_keys(k))
                counts.append(unpacked(c, np.uint32))
        if now:
            yield from answer(now, blocks_, keys, counts)

    def answer(now, blocks_, keys, counts):
        shard, kind = now
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        out: list[tuple] = []
        if kind == WORDS:
            out.append((-1, TOTALS, shard, packed(np.array([(total > 0).sum(), (total == 1).sum(), total.sum()], np.int64))))
        mine = total[at].astype(np.uint32)
        first = 0
        for block, k in zip(blocks_, keys, strict=True):
            out.append((block, kind, shard, packed(mine[first:first + len(k)])))
            first += len(k)
        yield _batch(out, ANSWERED)

    asked = blocks.drop("entries").mapInArrow(ask, "shard int, kind int, block long, keys binary, counts binary")
    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "block")
    return dealt.mapInArrow(together, "block long, kind int, shard int, totals binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _starts(shards: int) -> np.ndarray:
    """Where the shards of the hash space begin."""
    return np.array([i * ((1 << 64) // shards) for i in range(shards)], np.uint64)


@dataclass(frozen=True)
class Counts:
    """Trained words, those that occur once, and trained tokens, over the corpus."""

    types: int
    once: int
    tokens: int

    def word_logs(self, counts: np.ndarray) -> np.ndarray:
        """Log10 of word probabilities: counts less a discount, and all that it frees for the one unknown word.

        The freed share is that of words seen once (Good and Turing), at most 0.9 for each word.
        """
        if not self.tokens:
            return np.zeros(len(counts))
        off = min(max(self.once, 0.5) / self.types, 0.9)
        return np.log10(np.where(counts > 0, counts - off, off * self.types) / self.tokens)

    def least(self, weights: np.ndarray) -> tuple[float, float]:
        """Bounds of the model's logs and backoffs over the corpus: the rarest words, behind the heaviest context."""
        backoff = float(np.log10(1 - weights.max()))
        return (float(self.word_logs(np.array([0, 1])).min()) + backoff if self.tokens else 0.0), backoff


def _with_totals(row: dict) -> tuple[Block, np.ndarray, np.ndarray]:
    """A block with the corpus counts of its words and pairs."""
    block = _block(row)
    _, order = block.keys()
    answers: dict[int, list] = {WORDS: [], PAIRS: []}
    for a in sorted(row["answers"], key=lambda a: (a["kind"], a["shard"])):
        answers[a["kind"]].append(unpacked(a["totals"], np.uint32))
    words, pairs = (np.concatenate(answers[k]).astype(np.int64) for k in (WORDS, PAIRS))
    by_pair = np.empty(len(order), np.int64)
    by_pair[order] = pairs
    return block, words, by_pair


def _class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), CLASSES - 1)


def fitted(joined: DataFrame, counts: Counts) -> np.ndarray:
    """Weight of the bigram by class of its context: the best for training tokens, each left out of its own counts."""
    cells = CLASSES * len(WEIGHTS)

    def run(batches):
        total = np.zeros((CLASSES, len(WEIGHTS)))
        for row in _rows(batches):
            block, words, pairs = _with_totals(row)
            use = block.pair_counts > 0
            times, context = block.pair_counts[use], words[block.context[use]]
            own = 10 ** counts.word_logs(words)[block.word[use]]
            rest = (pairs[use] - 1) / np.maximum(context - 1, 1)
            where = _class(context)
            for i, w in enumerate(WEIGHTS):
                total[:, i] += np.bincount(where, times * np.log(w * rest + (1 - w) * own), CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    sums = joined.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("cell", "value"))
    flat = np.zeros(cells)
    # one number per class and weight, whatever the input
    for r in sums.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        flat[r["cell"]] = r["value"]
    return WEIGHTS[flat.reshape(CLASSES, -1).argmax(1)]


def model_of(block: Block, words: np.ndarray, pairs: np.ndarray, counts: Counts, weights: np.ndarray) -> Trie:
    """The model's slice over a block's words: p(w | u) = weight c(u w) / c(u) + (1 - weight) p(w).

    A context that was never trained leaves all weight to the word. All slices quantise in the same steps.
    """
    logs = counts.word_logs(words)
    weight = np.where(words > 0, weights[_class(words)], 0.0)
    known = pairs > 0
    u, w = block.context[known], block.word[known]
    mixed_ = weight[u] * pairs[known] / np.maximum(words[u], 1) + (1 - weight[u]) * 10 ** logs[w]
    return Trie.of(logs, np.log10(1 - weight), (u, w, np.log10(mixed_)), least=counts.least(weights))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", trained=None) -> DataFrame:
    """`key`, n_tokens, n_known, train_tokens, base_score, score for every document.

    trained: which documents are counted (a boolean column; all by default). Tokens are runs without
    ASCII white space, A-Z lower-cased, and one end; null and empty texts are the end alone. Equal rows
    and equal keys each give a row. Where nothing is trained all logs are 0. base_score: words alone,
    with 0.1 added to each count.
    """
    blocks = stored(encoded(docs, key, text, F.lit(True) if trained is None else trained), "lm-blocks")
    entries = blocks.agg(F.sum("entries")).first()[0] or 0
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = stored(gathered(blocks, max(parallel, entries // SHARD)), "lm-totals")
    sums = np.zeros(3, np.int64)
    for r in totals.filter(F.col("kind") == TOTALS).select("totals").toLocalIterator():  # three numbers per shard
        sums += unpacked(r["totals"], np.int64)
    counts = Counts(*sums.tolist())
    # as many answers as there are shards for a block: bounded by its own entries
    answers = totals.filter(F.col("kind") != TOTALS).groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "totals")).alias("answers"))
    joined = blocks.drop("entries").join(answers, "block")
    weights = fitted(joined, counts)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for row in _rows(batches):
            block, words, pairs = _with_totals(row)
            keys = pa.array(row["keys"], row["keys_type"].value_type)
            trie = model_of(block, words, pairs, counts, weights)
            starts = np.concatenate([[0], block.sizes.cumsum()[:-1]])
            base = np.log10((words + 0.1) / (counts.tokens + 0.1 * (counts.types + 1)))
            per_token = (trie.log(block.context, block.word)[block.at], base[block.tokens], (words > 0)[block.tokens].astype(np.int64))
            scores, bases, known = (np.add.reduceat(v, starts) for v in per_token)
            n = len(block.sizes)
            yield pa.RecordBatch.from_arrays([keys, pa.array(block.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(n, counts.tokens)), pa.array(bases), pa.array(scores)], names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(run, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)


def score_held_out(docs: DataFrame) -> DataFrame:
    """Every document's score by a model of the documents outside fold 0 of 10."""
    part = fold(F.col("doc_id"), 10)
    return score(docs, trained=part != 0).withColumn("held_out", part == 0)
