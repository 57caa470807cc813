"""Quality rules whose cutoffs limit false rejection, with exact binomial bounds.

A rule rejects a text when one of its measures exceeds a cutoff. Per stratum of length, labelled
texts tell how many good ones each cutoff would reject. A cutoff may be used only when the exact
(Clopper-Pearson) upper bound on its share of good texts rejected stays below the allowed share.
Cutoffs are tested from lenient to strict, stopping at the first that fails, which needs no
correction along the way; rules and strata share the error level (Bonferroni), and the rules of a
stratum share the allowed share. So with the stated confidence no stratum loses more good texts
than allowed. Everything over rows is SQL expressions; the driver sees one small table of counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, BLANKS, stored, whole_text

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STRATA = (200, 1000)  # words from which the next stratum begins
STEPS = 100  # cutoffs 1.00, 0.99 ... 0.00
#: measures in [0, 1]; the more, the worse
RULES = {
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeat_words": "n_repeat_words / n_words",
    "capitals": "n_capitals / word_chars",
}


def number_bits(n: Column) -> Column:
    """Bits that number the words of a text."""
    return F.length(F.bin(n))


def word_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text: words, their characters, symbols, repeated lines, repeated words.

    Null and empty texts have no words and counts of 0. Repeated rows each give a row. A word counts as
    repeated when it lies in a window of three words that occurs twice or more in the text. Windows are first
    compared by a hash with the position in its low bits, sorted as plain longs; those that seem to recur are
    compared again by another hash of 64 bits, so a text of any length has no false repeat to speak of.
    """
    body = whole_text(F.col(text))
    split = docs.select(
        F.col(key).alias("key"), body.alias("body"),
        F.filter(F.split(body, BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    n = F.size("words")
    sized = split.withColumn("n", n).withColumn("bits", number_bits(F.col("n")))
    words = F.col("words")

    def window(i: Column, *seed: Column) -> Column:
        return F.xxhash64(*seed, F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    starts = F.when(F.col("n") >= 3, F.sequence(F.lit(0), F.col("n") - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(starts, lambda i: F.call_function("shiftleft", window(i), F.col("bits")).bitwiseOR(i.cast("long")))
    hashed = sized.withColumn("packed", F.sort_array(packed))
    sorted_ = F.col("packed")

    def same(x: Column, i: Column) -> Column:
        shift = lambda v: F.call_function("shiftright", v, F.col("bits"))
        return F.coalesce(shift(x) == shift(F.get(sorted_, i)), F.lit(False))

    twice = F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    seeming = hashed.withColumn("seeming", F.transform(twice, lambda x: x.bitwiseAND(mask)))
    again = F.transform("seeming", lambda p: F.struct(window(p.cast("int"), F.lit(1)).alias("h"), p.alias("p")))
    sure = seeming.withColumn("sure", F.sort_array(again))

    def alike(x: Column, i: Column) -> Column:
        return F.coalesce(x["h"] == F.get(F.col("sure"), i)["h"], F.lit(False))

    told = F.filter("sure", lambda x, i: alike(x, i - 1) | alike(x, i + 1))
    at = sure.withColumn("at", F.sort_array(F.transform(told, lambda x: x["p"])))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n")),
        lambda s: s["n"],
    )
    chars = F.length("body")
    return at.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("body", BLANK, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (chars - F.length(F.translate("body", CAPITALS, ""))).cast("long").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def stratum() -> Column:
    n = F.lit(0)
    for bound in STRATA:
        n = n + (F.col("n_words") >= bound).cast("int")
    return n


def measure(rule: str) -> Column:
    return F.coalesce(F.try_divide(*(F.col(c) for c in RULES[rule].split(" / "))), F.lit(0.0))


def upper_bound(failures: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest share under which so few failures in n still have odds of `error`."""
    if failures >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(failures + 1)]

    def at_most(p: float) -> float:
        parts = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)]
        top = max(parts)
        return math.exp(min(0.0, top + math.log(sum(math.exp(x - top) for x in parts))))

    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        if at_most(mid) > error:
            low = mid
        else:
            high = mid
    return high


def choose(good: list[int], bad: list[int], allowed: float, error: float) -> int | None:
    """Step of the cutoff in use, or none. good, bad: how many texts each step rejects, from lenient to strict.

    Of the cutoffs that pass, the one that tells bad from good best; among equals the most lenient.
    """
    n_good, n_bad = max(good[-1], 1), max(bad[-1], 1)
    best, gain = None, 0.0
    for step in range(len(good) - 1):
        if upper_bound(good[step], good[-1], error) > allowed:
            break
        if (told := bad[step] / n_bad - good[step] / n_good) > gain:
            best, gain = step, told
    return best


def cutoffs(labelled: DataFrame, allowed: float = 0.02, error: float = 0.05) -> dict[int, dict[str, float]]:
    """Cutoff by stratum and rule. labelled: word_stats with `good` (boolean), base failures left out.

    Collected are at most strata x rules x steps x 2 counts, whatever the input.
    """
    cells = F.array(*(F.struct(F.lit(r).alias("rule"), F.ceil(F.least(measure(r), F.lit(1.0)) * STEPS).cast("int").alias("cell")) for r in RULES))
    counts = (
        labelled.select("good", stratum().alias("stratum"), F.explode(cells).alias("c"))
        .groupBy("good", "stratum", "c.rule", "c.cell").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    n_strata = len(STRATA) + 1
    found: dict[int, dict[str, float]] = {s: {} for s in range(n_strata)}
    for s in range(n_strata):
        for rule in RULES:
            rejected = {}
            for side in (True, False):
                cells = [0] * (STEPS + 1)
                for row in counts:
                    if (row["good"], row["stratum"], row["rule"]) == (side, s, rule):
                        cells[row["cell"]] += row["n"]
                # step k has the cutoff 1 - k / STEPS and rejects the cells above it; the last entry is all texts
                rejected[side] = [sum(cells[STEPS - k + 1:]) for k in range(STEPS + 1)] + [sum(cells)]
            step = choose(rejected[True], rejected[False], allowed / len(RULES), error / (len(RULES) * n_strata))
            if step is not None:
                found[s][rule] = 1 - step / STEPS
    return found


def apply_rules(stats: DataFrame, limits: dict[int, dict[str, float]]) -> DataFrame:
    """Adds base_failed, stratum, rejected_by (rules that reject, by name) and kept."""
    rules = [
        F.when((F.col("stratum") == s) & (F.ceil(F.least(measure(r), F.lit(1.0)) * STEPS) > round(limit * STEPS)), F.lit(r))
        for s, by_rule in limits.items() for r, limit in by_rule.items()
    ]
    rejected = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    judged = stats.withColumn("stratum", stratum()).withColumn("base_failed", base_failed()).withColumn("rejected_by", rejected)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", allowed: float = 0.02, error: float = 0.05) -> DataFrame:
    """Judges every text with cutoffs from the labelled ones (label 1: good, 0: bad).

    Unlabelled texts and labels without a text teach nothing; without labels, or with too few of them
    in a stratum, only the base rules hold there. Texts with several labels count once for each.
    """
    stats = stored(word_stats(docs, key, text), "word-stats")
    marks = labels.select(F.col(key), (F.col(label) == 1).alias("good")).dropna()
    labelled = stats.filter(~base_failed()).join(marks, key)
    return apply_rules(stats, cutoffs(labelled, allowed, error))
