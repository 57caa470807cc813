"""Elias-Fano n-gram trie (after Pibiri & Venturini, 2017), in numpy.

Level 1 holds the words. Every further level holds, for each node above it, the sorted ids of its
successors: one monotone sequence, made so by adding the last value before a node's range, next to
one monotone sequence of pointers to where the ranges begin. Both are Elias-Fano coded. A successor
is found relative to its context by searching the bucket of its high bits. Values are logarithms
quantised to 8 bits per level. Levels are flat arrays, saved as files that are mapped, not read.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import partial
from pathlib import Path

import numpy as np

U64 = np.uint64


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one bit (from 0) in 64-bit words. before: ones ahead of each word."""
    word = np.searchsorted(before, k, "right") - 1
    left = (k - before[word]).astype(np.int64)
    bits = words[word]
    at = np.zeros(len(k), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = bits & U64((1 << half) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = left >= ones
        left -= np.where(up, ones, 0)
        at += np.where(up, half, 0)
        bits = np.where(up, bits >> U64(half), low)
    return word * 64 + at


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of n numbers in about 2 + log2(universe / n) bits each."""

    size: np.ndarray  # n, number of low bits
    high: np.ndarray  # unary code of the high parts
    ones: np.ndarray  # one bits ahead of each word of `high`
    low: np.ndarray  # low parts, packed

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        v = np.asarray(values, U64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        place = (v >> U64(width)).astype(np.int64) + np.arange(n)
        length = (int(place[-1]) if n else 0) + 2  # a zero ends the last bucket
        bits = np.zeros(-(-length // 64) * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        ones = np.concatenate([[0], np.bitwise_count(high).astype(np.int64).cumsum()[:-1]])
        low = np.zeros(n * width // 64 + 2, U64)
        if width and n:
            part = v & U64((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at // 64, (at % 64).astype(U64)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift + U64(width) > U64(64)
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (U64(64) - shift[spill]))
        return EliasFano(np.array([n, width]), high, ones, low)

    def _low(self, i: np.ndarray) -> np.ndarray:
        width = int(self.size[1])
        if not width:
            return np.zeros(len(i), U64)
        at = i * width
        word, shift = at // 64, (at % 64).astype(U64)
        spill = np.where(shift > U64(0), self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((self.low[word] >> shift) | spill) & U64((1 << width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        high = _select(self.high, self.ones, i) - i
        return ((high.astype(U64) << U64(int(self.size[1]))) | self._low(i)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that is at least x, or n."""
        x = np.asarray(x, np.int64)
        n, width = int(self.size[0]), int(self.size[1])
        if not n or not len(x):
            return np.zeros(len(x), np.int64)
        bucket = x >> width
        zeros = np.arange(len(self.high), dtype=np.int64) * 64 - self.ones
        most = int(zeros[-1] + 64 - np.bitwise_count(self.high[-1:]).astype(np.int64)[0])
        inside = np.minimum(bucket, most - 1)
        flipped = ~self.high
        # elements ahead of a bucket: ones ahead of the zero that ends the bucket before it
        first = np.where(inside > 0, _select(flipped, zeros, np.maximum(inside - 1, 0)) + 1 - inside, 0)
        last = np.minimum(_select(flipped, zeros, inside) - inside, n)
        part = (x & ((1 << width) - 1)).astype(U64)
        lo, hi = first, last
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (self._low(np.minimum(mid, n - 1)) < part)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return np.where(bucket >= most, n, np.minimum(lo, n))


@dataclass(frozen=True)
class Quantised:
    """Numbers as one byte each: equal steps from least to most, so no error exceeds 1 / 256 of that, and the mean of each step."""

    codes: np.ndarray
    book: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Quantised:
        if not len(values):
            return Quantised(np.zeros(0, np.uint8), np.zeros(1))
        edges = np.linspace(values.min(), values.max(), 257)[1:-1]
        codes = np.searchsorted(edges, values).astype(np.uint8)
        n = np.bincount(codes, minlength=256)
        return Quantised(codes, np.bincount(codes, values, 256) / np.maximum(n, 1))

    @staticmethod
    def between(values: np.ndarray, least: float, most: float) -> Quantised:
        """Steps from least to most whatever the values, so a value has one code wherever it stands. Both ends are exact."""
        step = (most - least) / 255 or 1.0
        return Quantised(np.clip(np.rint((values - least) / step), 0, 255).astype(np.uint8), np.linspace(least, most, 256))

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.book[self.codes[i]]


@dataclass(frozen=True)
class Level:
    """Successors of all nodes one level up."""

    starts: EliasFano  # where each node's range begins, and the end of the last
    ids: EliasFano  # successor + value in front of the range
    logs: Quantised


@dataclass(frozen=True)
class Trie:
    logs: Quantised  # of single words
    backoffs: Quantised  # by word, as a context
    levels: tuple[Level, ...]

    @staticmethod
    def of(logs: np.ndarray, backoffs: np.ndarray, *grams: tuple[np.ndarray, np.ndarray, np.ndarray], least: tuple[float, float] | None = None) -> Trie:
        """grams, per level: parent node, word and log, sorted by parent and word. Nodes count from 0 per level.

        least: of all logs and of all backoffs that any slice of the model may hold; up to 0, they share
        their steps. By default steps are fitted to the values.
        """
        steps = [Quantised.of if least is None else partial(Quantised.between, least=x, most=0.0) for x in least or (0, 0)]
        above, levels = len(logs), []
        for parent, word, log in grams:
            starts = np.searchsorted(parent, np.arange(above + 1))
            # the value in front of a node's range: the sum of the last words of the ranges before
            filled = starts[1:] > starts[:-1]
            last = np.where(filled, word[np.maximum(starts[1:] - 1, 0)] if len(word) else 0, 0)
            base = np.concatenate([[0], last.cumsum()])
            levels.append(Level(EliasFano.of(starts), EliasFano.of(word + base[parent]), steps[0](log)))
            above = len(word)
        return Trie(steps[0](logs), steps[1](backoffs), tuple(levels))

    def successor(self, level: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Node of `word` below `node`, or -1."""
        here = self.levels[level]
        begin, end = here.starts.get(node), here.starts.get(node + 1)
        base = np.zeros(len(node), np.int64)
        later = begin > 0
        base[later] = here.ids.get(begin[later] - 1)
        # the search starts where the context's own values do, so an equal value just ahead of them cannot hit
        at = np.maximum(here.ids.find(word + base), begin)
        hit = at < end
        hit[hit] = here.ids.get(at[hit]) == (word + base)[hit]
        return np.where(hit, at, -1)

    def log(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log of a word's probability behind a context word: stored, or the word's own plus the backoff."""
        node = self.successor(0, context, word)
        out = self.backoffs.get(context) + self.logs.get(word)
        out[node >= 0] = self.levels[0].logs.get(node[node >= 0])
        return out

    def _arrays(self) -> dict[str, np.ndarray]:
        out = {"logs.codes": self.logs.codes, "logs.book": self.logs.book, "backoffs.codes": self.backoffs.codes, "backoffs.book": self.backoffs.book}
        for i, level in enumerate(self.levels):
            for part in fields(level):
                for f in fields(value := getattr(level, part.name)):
                    out[f"{i}.{part.name}.{f.name}"] = getattr(value, f.name)
        return out

    def nbytes(self) -> int:
        return sum(a.nbytes for a in self._arrays().values())

    def save(self, folder: str | Path) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for name, array in self._arrays().items():
            np.save(Path(folder) / f"{name}.npy", array)

    @staticmethod
    def open(folder: str | Path) -> Trie:
        """Maps a saved trie: pages are read as searches touch them."""
        got = {p.name.removesuffix(".npy"): np.load(p, mmap_mode="r") for p in Path(folder).glob("*.npy")}

        def part(kind, prefix):
            return kind(*(got[f"{prefix}.{f.name}"] for f in fields(kind)))

        n = len({k.split(".")[0] for k in got if k[0].isdigit()})
        levels = tuple(Level(part(EliasFano, f"{i}.starts"), part(EliasFano, f"{i}.ids"), part(Quantised, f"{i}.logs")) for i in range(n))
        return Trie(part(Quantised, "logs"), part(Quantised, "backoffs"), levels)
