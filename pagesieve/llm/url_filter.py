"""URL filter: rules first, then a ratio of two character language models.

Addresses that the rules accept and those that they reject train one variable-order Markov model
each: contexts of up to five bytes, as long as they are frequent enough, smoothed by Witten and
Bell's interpolation. An address that no rule fits is judged by the difference of its two
log-likelihoods per byte, against a cut taken from accepted addresses held out of training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
CONTEXTS = 20_000  # per order and model: a context must hold at least this share of the bytes
FALSE_BLOCKS = 0.01  # share of held-out accepted addresses that may fall below the cut
START, END = 2, 3  # bytes that stand before and behind an address
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or without ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_for(rules: dict[str, str], host: Column, path: Column) -> Column:
    """Longest rule, written host/path, that fits the host or a domain above it and begins the path; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of all texts and their ends: the context of each order as a number, and the byte itself.

    A context carries its order in the top byte, so all orders live in one sorted list. Returned are
    an array (order + 1) x bytes, and the bytes.
    """
    padded = bytes([START]) * ORDER
    data = np.frombuffer(b"".join(padded + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # positions of the bytes that are predicted
    first = np.concatenate([[0], (sizes + ORDER).cumsum()[:-1]]) + ORDER if len(texts) else np.zeros(0, np.int64)
    at = np.repeat(first - np.concatenate([[0], sizes.cumsum()[:-1]]) if len(texts) else first, sizes) + np.arange(sizes.sum())
    contexts = np.zeros((ORDER + 1, len(at)), np.uint64)
    for k in range(1, ORDER + 1):
        contexts[k] = (contexts[k - 1] & np.uint64((1 << 48) - 1)) | (data[at - k].astype(np.uint64) << np.uint64(8 * (k - 1))) | (np.uint64(k) << np.uint64(48))
    return contexts, data[at]


@dataclass(frozen=True)
class Markov:
    """Counts of one model: contexts with totals and number of different successors; successions with counts."""

    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    steps: np.ndarray  # context << 8 | byte
    counts: np.ndarray

    def logs(self, contexts: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Natural log of each byte's probability given what stands before it."""
        p = np.full(len(byte), 1 / 256)
        for context in contexts:
            total, kinds = _look_up(self.contexts, context, self.totals, self.kinds)
            (n,) = _look_up(self.steps, (context << np.uint64(8)) | byte, self.counts)
            p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.log(p)


def _look_up(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return [np.where(hit, v[at], 0) for v in values]


def learn(urls: DataFrame) -> dict[bool, Markov]:
    """Models of accepted (True) and rejected (False) addresses; urls: url (binary), accepted (boolean).

    Counts cover all rows. A context is kept when it holds at least 1 / CONTEXTS of a model's bytes (and
    occurs twice), so each model has at most (ORDER + 1) x CONTEXTS contexts of at most 256 successors.
    """

    def count(batches):
        for batch in batches:
            accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = batch.column(0).to_pylist()
            for side in (False, True):
                mine = [t for t, a in zip(texts, accepted, strict=True) if a == side]
                if mine:
                    contexts, byte = grams(mine)
                    steps, n = np.unique((contexts << np.uint64(8)) | byte, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(steps), side)), pa.array(steps.astype(np.int64)), pa.array(n.astype(np.int64))], names=["accepted", "step", "n"])

    steps = urls.mapInArrow(count, "accepted boolean, step long, n long").groupBy("accepted", "step").agg(F.sum("n").alias("n"))
    steps = steps.withColumn("context", F.shiftright("step", 8))
    totals = steps.groupBy("accepted", "context").agg(F.sum("n").alias("total"))
    size = {r["accepted"]: r["total"] for r in totals.filter("context = 0").collect()}
    least = F.when(F.col("accepted"), F.lit(max(2, size.get(True, 0) // CONTEXTS))).otherwise(F.lit(max(2, size.get(False, 0) // CONTEXTS)))
    frequent = totals.filter((F.col("total") >= least) | (F.col("context") == 0)).drop("total")
    kept = steps.join(frequent, ["accepted", "context"]).toPandas().sort_values("step")
    models = {}
    for side in (True, False):
        own = kept[kept["accepted"] == side]
        by = own.groupby("context")["n"].agg(["sum", "count"])
        models[side] = Markov(by.index.to_numpy(np.uint64), by["sum"].to_numpy(np.float64), by["count"].to_numpy(np.float64), own["step"].to_numpy(np.uint64), own["n"].to_numpy(np.float64))
    return models


def gain(urls: Column, models: dict[bool, Markov]) -> Column:
    """How much more likely an address (binary) is as an accepted one: difference of logs per byte."""

    @F.pandas_udf("double")
    def ratio(urls: pd.Series) -> pd.Series:
        texts = [bytes(u) for u in urls]
        contexts, byte = grams(texts)
        difference = models[True].logs(contexts, byte) - models[False].logs(contexts, byte)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.concatenate([[0], sizes.cumsum()[:-1]])
        return pd.Series(np.add.reduceat(difference, starts) / sizes)

    return ratio(urls)


def judge(pages: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", false_blocks: float = FALSE_BLOCKS) -> DataFrame:
    """`key`, host, path, rule, verdict, gain for every row. rules: host/path to allow or block.

    Null addresses and those without :// have an empty host and path and are judged as empty texts.
    Where the rules accept or reject nothing there is nothing to compare: the rest is allowed. Other
    columns are ignored; repeated rows each get a row.
    """
    address = F.col(url).cast("string")
    read = pages.select(F.col(key).alias("key"), host(address).alias("host"), path(address).alias("path"), F.regexp_replace(F.coalesce(address, F.lit("")), r"(?s)^.*?://", "").cast("binary").alias("url"))
    ruled = read.withColumn("rule", rule_for(rules, F.col("host"), F.col("path")))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    ruled = ruled.withColumn("said", said)
    taught = ruled.filter(F.col("said").isNotNull()).select("url", (F.col("said") == "allow").alias("accepted"))
    held_out = F.crc32("url") % 5 == 0
    models = learn(taught.filter(~held_out))
    if len(models[True].contexts) and len(models[False].contexts):
        shown = taught.filter(held_out & F.col("accepted")).select(gain(F.col("url"), models).alias("gain"))
        cut = shown.agg(F.percentile_approx("gain", false_blocks, 10_000)).first()[0]
        scored, least = ruled.withColumn("gain", gain(F.col("url"), models)), 0.0 if cut is None else min(0.0, cut)
    else:
        scored, least = ruled.withColumn("gain", F.lit(0.0)), 0.0
    own = F.when(F.col("gain") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "gain")
