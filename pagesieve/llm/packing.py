"""Best-two-fit packing of token sequences.

Every text is tokenised where it lies; what the packing needs of it is its length alone, of which
there are at most as many as a sequence holds. So bins are formed from the histogram of lengths: a
bin is filled greedily, longest that fits first, and then its smallest document gives way to two
that fill the widened gap more tightly. A pattern so found is repeated until a length in it runs
out, which gives the bins that one-by-one packing would give. Documents find their place from their
rank among those of the same length: no task and no driver ever holds the documents.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SIZE = 4096
END = 1  # id behind every document
CACHED_WORDS = 600_000  # per task; beyond it the half that was learned first goes
GROUP = 1000  # rows numbered together, on average, of the most frequent length


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Bins as (how many of each length, how many such bins), for a histogram of lengths from 1 to size.

    Each pattern leaves some length with fewer than it takes, so their number follows the number of
    lengths, not of documents.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(left)
    patterns = []
    while lengths:
        used: dict[int, int] = {}
        gap, at = size, len(lengths) - 1
        while at >= 0:
            length = lengths[at]
            if length <= gap:
                used[length] = min(left[length], gap // length)
                gap -= used[length] * length
            # the next shorter one that fits
            at = min(at, bisect.bisect_right(lengths, gap)) - 1
        filled = dict(used)
        smallest = min(used)
        if gap and sum(used.values()) > 1:
            used[smallest] -= 1
            pair = _tightest_pair(lengths, left, filled, gap + smallest)
            if sum(pair) > smallest:
                for length in pair:
                    used[length] = used.get(length, 0) + 1
            else:
                used[smallest] += 1
        used = {length: n for length, n in used.items() if n}
        times = min((left[k] - max(filled.get(k, 0), n)) // n + 1 for k, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
                del lengths[bisect.bisect_left(lengths, length)]
        patterns.append((used, times))
    return patterns


def _tightest_pair(lengths: list[int], left: dict[int, int], taken: dict[int, int], room: int) -> tuple[int, ...]:
    """Two unpacked lengths whose sum comes closest to `room` from below, or nothing."""
    free = np.array([k for k in lengths if k < room and left[k] > taken.get(k, 0)], np.int64)
    if not len(free):
        return ()
    twice = np.array([left[k] - taken.get(k, 0) > 1 for k in free.tolist()])
    # the longest partner that is not longer; itself only if there are two of it
    most = np.minimum(room - free, free)
    partner = np.searchsorted(free, most, "right") - 1
    partner = np.where((partner == np.arange(len(free))) & ~twice, partner - 1, partner)
    total = np.where(partner >= 0, free + free[np.maximum(partner, 0)], -1)
    best = int(total.argmax())
    return (int(free[best]), int(free[partner[best]])) if total[best] > 0 else ()


@dataclass(frozen=True)
class Layout:
    """Runs of equally long documents, by rank over all lengths in ascending order."""

    first_of: np.ndarray  # rank of the first document of each length
    start: np.ndarray  # first rank of each run, ascending
    sequence: np.ndarray  # first sequence of the run
    times: np.ndarray  # sequences in it
    offset: np.ndarray  # place of the first copy in each of them

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first_of[length] + rank
        run = np.searchsorted(self.start, at, "right") - 1
        copy, which = np.divmod(at - self.start[run], self.times[run])
        return self.sequence[run] + which, self.offset[run] + copy * length


def layout(counts: dict[int, int], size: int = SIZE) -> Layout:
    histogram = np.zeros(size + 2, np.int64)
    for length, n in counts.items():
        histogram[length + 1] = n
    first_of = histogram.cumsum()
    taken = first_of.copy()
    runs, sequence = [], 0
    for used, times in best_two_fit(counts, size):
        offset = 0
        for length in sorted(used, reverse=True):
            runs.append((taken[length], sequence, times, offset))
            taken[length] += used[length] * times
            offset += used[length] * length
        sequence += times
    return Layout(first_of, *np.array(sorted(runs), np.int64).reshape(-1, 4).T)


#: Letters that lower-case one to one and are already composed, then marks that belong to no contraction; or any other word.
_PARTS = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)|(.*))$", re.M)


class Words:
    """Ids of words, as little-endian unsigned 32-bit numbers, looked up where a word has come before.

    The tokenizer drops white space and joins nothing across it, and takes letters and the marks behind
    them apart. So a run of letters is tokenised once for all its spellings with capitals and marks, many
    runs in one call; their ids are told apart by the pieces that end a word. All else goes word by word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.coder = Tokenizer.from_file(path)
        vocabulary = self.coder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {"": b""}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.coder.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4") for f in found]

    def learn(self, words: list[bytes]) -> None:
        self.runs = _newer_half(self.runs) if len(self.runs) > CACHED_WORDS else self.runs
        parts = _PARTS.findall(b"\n".join(words).decode()) if words else []
        letters = [a.lower() for a, _, _ in parts]
        marks = list({m for _, m, _ in parts}.difference(self.runs))
        self.runs.update(zip(marks, (ids.tobytes() for ids in self._encoded(marks)), strict=True))
        new = list(set(letters).difference(self.runs))
        if new:
            ids = np.concatenate(self._encoded([" ".join(new[i:i + 64]) for i in range(0, len(new), 64)]))
            data, bounds = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            self.runs.update(zip(new, [data[a:b] for a, b in pairwise(bounds)], strict=True))
        runs = self.runs
        self.known.update({word: runs[a] + runs[m] for word, a, (_, m, _) in zip(words, letters, parts, strict=True) if a})
        whole = [(word, rest) for word, (_, _, rest) in zip(words, parts, strict=True) if rest]
        self.known.update((word, ids.tobytes()) for (word, _), ids in zip(whole, self._encoded([t for _, t in whole]), strict=True))

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of whole texts, each with its end."""
        split = [t.split() if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if len(new) + len(self.known) > CACHED_WORDS:
            self.known = _newer_half(self.known) if len(new) < CACHED_WORDS // 2 else {}
            new = set().union(*split).difference(self.known)
        self.learn(list(new))
        end = np.array([END], "<u4").tobytes()
        return [b"".join([self.known[w] for w in words]) + end for words in split]


def _newer_half(cache: dict) -> dict:
    kept = dict(islice(cache.items(), len(cache) // 2, None))
    return {"": b"", **kept} if "" in cache else kept


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """`key`, piece, start, length, ids_crc32: every text as ids and an end, cut only when longer than size.

    Null texts are empty: their one piece is the end alone. Repeated rows each give their pieces.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        coder = Words(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: list[tuple] = []
                for row, ids in enumerate(coder.ids(batch.column(1).to_pylist())):
                    for n, start in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[start:start + 4 * size]
                        out.append((row, n, start // 4, len(part) // 4, zlib.crc32(part)))
                rows, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("data"))
    return rows.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to size; other columns stay.

    Empty input: no rows. Equal rows get places of their own. Within a sequence longer ones come first.
    """
    names = cut.columns
    rows = stored(cut.select(F.struct(*names).alias("r"), F.monotonically_increasing_id().alias("row")), "pieces")
    length = F.col("r.length")
    # at most `size` rows
    counts = {r["length"]: r["n"] for r in rows.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    places = layout(counts, size)
    groups = -(-max(counts.values(), default=1) // GROUP)
    dealt = rows.withColumn("length", length).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n")).select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "group").orderBy("row")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "group"])
    placed = ranked.select("r", "length", (F.col("rank") + F.col("ahead")).alias("rank"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        sequence, offset = places.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return placed.withColumn("at", place("length", "rank")).select("r.*", "at.sequence_id", "at.offset")
