"""64-bit hashes of the words of a text, in numpy."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_PIECE, _ODD, np.uint64)]))
_BACK = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_PIECE, _INVERSE, np.uint64)]))


def _powers(table: np.ndarray, step: np.uint64, n: int) -> np.ndarray:
    if n <= len(table):
        return table[:n]
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, step, np.uint64)]))


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every run without ASCII white space. Equal words have equal hashes wherever they stand."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    change = np.flatnonzero(np.diff(np.concatenate([[False], ~_BLANK[data], [False]]).view(np.int8)))
    starts, ends = change[::2], change[1::2]
    # sum over the word of (byte + 1) * odd^place, brought to place 0 by the inverse of odd^start
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(_POWERS, _ODD, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * _powers(_BACK, _INVERSE, len(data))[starts])
