"""The perfect binary Golay code of length 23 as a set of anchors: 4,096 code words, covering radius 3.

A word's distance to any code word depends on its syndrome alone (11 bits), so one small table lists, for each
syndrome, the error patterns up to a weight; word XOR pattern is then an anchor at that weight's distance.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np

LENGTH, RADIUS = 23, 3
#: The high bits of a code word, which tell it: what follows them is the rest of a division.
TELLING = 12
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
MASK = (1 << LENGTH) - 1


def _rest(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits of a word, to be XORed."""
    unit = [_rest(1 << i) for i in range(LENGTH)]

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), dtype=np.int64)
        for i, s in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ s
        return out

    return table(unit[:12]), table(unit[12:])


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[words & 0xFFF] ^ high[words >> 12]


@lru_cache(maxsize=4)
def error_table(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome the error patterns of weight <= RADIUS + reach and their excess over the radius.

    The first pattern is the only one of weight <= RADIUS (the code is perfect), so its excess is 0. Rows are filled
    up with excess ``reach + 1``.
    """
    rows: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for weight in range(RADIUS + reach + 1):
        sets = np.array(list(combinations(range(LENGTH), weight)), dtype=np.int64).reshape(comb(LENGTH, weight), weight)
        words = (np.int64(1) << sets).sum(axis=1)
        for s, w in zip(syndrome(words).tolist(), words.tolist()):
            rows[s].append((w, max(0, weight - RADIUS)))
    wide = max(map(len, rows))
    patterns = np.zeros((2048, wide), dtype=np.int64)
    excess = np.full((2048, wide), reach + 1, dtype=np.int64)
    for s, row in enumerate(rows):
        patterns[s, : len(row)] = [w for w, _ in row]
        excess[s, : len(row)] = [e for _, e in row]
    return patterns, excess


def home(words: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each word."""
    return words ^ error_table(0)[0][syndrome(words), 0]


def anchors(blocks: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row index, anchor) for words cut into blocks of 23 bits.

    An anchor joins one code word per block, each by its twelve telling bits, so that five blocks fit a long. A shorter
    last block is filled up with zeros, which changes no distance. Two words that differ in at most ``reach`` bits differ in at most e_i bits
    of block i, the e_i adding up to at most ``reach``; so the second lies within radius + e_i of the first's home in
    each block, and anchors whose excesses add up to at most ``reach`` are all that is needed.
    """
    patterns, excess = error_table(reach)
    rows = np.arange(len(blocks[0]))
    out, spent = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for block in blocks:
        words = block[rows]
        s = syndrome(words)
        total = spent[:, None] + excess[s]
        at, col = np.nonzero(total <= reach)
        out = (out[at] << TELLING) | ((words[at] ^ patterns[s[at], col]) >> (LENGTH - TELLING))
        rows, spent = rows[at], total[at, col]
    return rows, out
