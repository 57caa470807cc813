"""Language identification by compression.

Each language has a zstandard dictionary of raw content: a piece of each text of a sample, all of about
the same length, from a place in the whole text that its hash chooses. A text is compressed with every
dictionary, piece by piece so that the dictionary matters throughout, and the smallest total wins. The
margin is the gap to the second, relative to the second; a narrow one is rejected. The width comes from
whole labelled texts that are in no dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored

PIECE = 4096  # bytes compressed at once
DICTIONARY = 96 * 1024  # bytes of a language's dictionary, shared evenly by its sampled texts
SAMPLE = 800  # distinct labelled texts that teach a language, at most: half for the dictionary, half for the margin
SPARE = 8  # times its even share that one text offers, for what shorter ones leave
MOST_LANGUAGES = 1000  # more distinct labels are an error in the labels
LOST = 0.005  # share of rightly named texts that may be rejected
#: Matches of four bytes and more, well searched: short words tell languages apart. The window spans dictionary and piece.
SEARCH = dict(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=17, chain_log=17, search_log=4)
UNKNOWN = "und"

_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower case, with a blank for each ASCII character that is no letter; runs of blanks, and of one word, are one."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    return b" ".join([word for word, _ in groupby(words)])


def has_letter(text: str | None) -> bool:
    """Whether a character is of Unicode's letter categories; numerals such as ½ or Ⅷ are not."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Languages:
    """Names, the most frequent first, the sample of each, and the margin from which an answer is accepted."""

    names: tuple[str, ...]
    samples: tuple[bytes, ...]
    narrow: float = 0.0

    def coders(self) -> list[zstandard.ZstdCompressor]:
        made = []
        search = zstandard.ZstdCompressionParameters(**SEARCH, write_checksum=False, write_content_size=False, write_dict_id=False)
        for sample in self.samples:
            content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=search)
            made.append(zstandard.ZstdCompressor(compression_params=search, dict_data=content))
        return made

    def name(self, text: str | None, coders: list) -> tuple[str, float]:
        """Language and margin of a whole text. Ties go to the first name; without a letter: und, 0."""
        if not coders or not has_letter(text):
            return UNKNOWN, 0.0
        data = plain(text)
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.names[best], (second - sizes[best]) / second


def piece_of(data: bytes, order: int, room: int) -> bytes:
    """At most `room` bytes of a plain text, of whole words, from a place that `order` chooses."""
    if len(data) <= room:
        return data
    start = order % (len(data) - room + 1)
    start = data.find(b" ", start) + 1 if start else 0
    part = data[start:start + room]
    cut = part.rfind(b" ")
    return part if start + room >= len(data) or cut < 0 else part[:cut]


def shared(pieces: list[bytes], room: int) -> bytes:
    """A dictionary of about `room` bytes: every piece whole, or else up to one common length."""
    lengths = sorted(len(p) for p in pieces)
    even, left = 0, room
    for i, n in enumerate(lengths):
        even = max(0, left) // (len(lengths) - i)
        if n > even:
            break
        left -= n + 1
        even = n
    # what lies last in a dictionary is cheapest to point at; all of it is within reach of a piece
    return b" ".join(p[:even] for p in pieces).ljust(8)


def _drawn(docs: DataFrame, text: str, lang: str, sample: int) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """Sampled texts (lang, order, text), one row each and somewhat more than `sample`; distinct texts and rows by language."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # 63 bits: what is drawn from is one row per language and text
    hashed = known.withColumn("order", F.shiftrightunsigned(F.xxhash64("text"), 1))
    texts = hashed.groupBy("lang", "order").agg(F.count(F.lit(1)).alias("n"))
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: {lang!r} does not hold labels")
    most = (1 << 63) - 1
    limits = {r["lang"]: int(most * share) if (share := (1.3 * sample + 50) / r["texts"]) < 1 else most for r in sizes}
    if not limits:
        return hashed.limit(0), {}, {}
    limit = F.element_at(F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v).cast("long")))), F.col("lang"))
    drawn = hashed.filter(F.col("order") <= limit).groupBy("lang", "order").agg(F.max("text").alias("text"))
    return stored(drawn, "language-sample"), {r["lang"]: r["texts"] for r in sizes}, {r["lang"]: r["rows"] for r in sizes}


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Languages:
    """Dictionaries and margin from a bounded sample of labelled texts, chosen by a hash of the text.

    Every language gives min(sample, its distinct texts): equal texts count and are drawn once. Texts without a
    letter, missing texts and missing languages teach nothing; without any, every text is und. The driver gets
    one short piece of each text for the dictionaries and one number of each for the margin.
    """
    drawn, texts, rows = _drawn(docs, text, lang, sample)
    if not texts:
        return Languages((), ())
    offer = {k: SPARE * DICTIONARY // max(1, (min(sample, n) + 1) // 2) for k, n in texts.items()}

    def cut(batches):
        for batch in batches:
            k, order, body = (batch.column(i).to_pylist() for i in range(3))
            pieces = [piece_of(plain(t), o, offer[name]) if has_letter(t) else None for name, o, t in zip(k, order, body, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.binary())], names=["lang", "order", "piece"])

    found = drawn.mapInArrow(cut, "lang string, order long, piece binary").filter("piece IS NOT NULL").collect()
    by_name: dict[str, list] = {}
    for k, mine in groupby(sorted(found, key=lambda r: (r["lang"], r["order"])), key=lambda r: r["lang"]):
        by_name[k] = list(mine)[:sample]
    names = tuple(sorted(by_name, key=lambda k: (-rows[k], k)))  # ties go to the more frequent
    if not names:
        return Languages((), ())
    model = Languages(names, tuple(shared([bytes(r["piece"]) for r in by_name[k][::2]], DICTIONARY) for k in names))
    judges = {k: {r["order"] for r in by_name[k][1::2]} for k in names}

    def margins(batches):
        coders = model.coders()
        for batch in batches:
            out = []
            for name, order, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if order in judges.get(name, ()):
                    told, margin = model.name(body, coders)
                    out += [margin] if told == name else []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["margin"])

    right = [r["margin"] for r in drawn.mapInArrow(margins, "margin double").collect()]
    return Languages(model.names, model.samples, float(np.quantile(right, LOST)) if right else 0.0)


def _named(texts: list, model: Languages, coders: list) -> tuple[list[str], np.ndarray]:
    found = [model.name(t, coders) for t in texts]
    return [f[0] for f in found], np.array([f[1] for f in found], np.float64)


def identify(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, lang_pred, score (the margin), accepted for every row. Null or without a letter: und, 0, not accepted."""

    def run(batches):
        coders = model.coders()
        for batch in batches:
            names, margins = _named(batch.column(1).to_pylist(), model, coders)
            accepted = (margins >= model.narrow) & (np.array(names, object) != UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(margins), pa.array(accepted.astype(bool))], names=["key", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("key", key)


def label(docs: DataFrame) -> DataFrame:
    """Every document's language, learned outside fold 2 of 4."""
    held_out = fold(F.col("doc_id"), 4) == 2
    named = identify(docs, learn(docs.filter(~held_out)))
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def keep_named(docs: DataFrame) -> DataFrame:
    """Documents whose language is told with more than a narrow margin, with all their columns.

    Null texts and those without a letter go; of repeated rows each is judged. Where no language is learned, all go.
    """
    model = learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    at = docs.columns.index("text")

    def run(batches):
        coders = model.coders()
        for batch in batches:
            names, margins = _named(batch.column(at).to_pylist(), model, coders)
            yield batch.filter(pa.array([m >= model.narrow and n != UNKNOWN for n, m in zip(names, margins, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
