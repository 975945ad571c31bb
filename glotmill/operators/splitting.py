"""Exact random draws over distributed rows, by splitting numbers down a tree of hash buckets.

Rows fall into 2^bits buckets by a hash of their id, so a row's place does not depend on partitions. How many of a
replicate's draws a bucket gets follows from the root on: at every node the number that goes left is drawn from the
conditional distribution given the sizes of both sides (binomial with replacement, hypergeometric without). Each bucket
walks its own path; nodes that paths share give the same numbers, as a hash of node and replicate is all their
randomness. So every replicate's draws add up exactly, and no task sees more than its buckets.

Numbers up to ``INVERTED`` are drawn by inverting the distribution at one hashed number in [0, 1), in a form that SQL can
repeat; larger ones by numpy's exact samplers, seeded by the same hash. These take up to 10^9 rows without replacement.
"""

from __future__ import annotations

import hashlib

import numpy as np

INVERTED, BLOCK = 4096, 256


def _digest(text: str, digits: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing function of 32 bits, with products that SQL's 64-bit integers hold."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) & 0xFFFFFFFF
    return x ^ (x >> 16)


def stream(name: str, count: int) -> np.ndarray:
    """The first ``count`` numbers of 32 bits of a named stream."""
    return mixed((_digest(name, 8) + np.arange(count, dtype=np.int64) * 2654435761) & 0xFFFFFFFF)


class Splitter:
    """Draws of one group of rows: ``sizes`` are its buckets' numbers of rows, ``draws`` those of every replicate."""

    def __init__(self, name: str, sizes: np.ndarray, draws: int, replicates: int, replace: bool):
        self.name, self.replace, self.replicates = name, replace, replicates
        self.bits = len(sizes).bit_length() - 1
        self.before = np.concatenate([[0], np.cumsum(sizes)])
        self.draws = draws
        self.path: dict[int, tuple[int, np.ndarray]] = {}  # the last node of each level, and what goes left there
        top = min(INVERTED, draws)
        self.logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(top, min(int(self.before[-1]), 4 * INVERTED)) + 2)))])

    def rows(self, level: int, prefix: int) -> int:
        """Rows below the node ``prefix`` of ``level`` bits."""
        width = self.bits - level
        return int(self.before[(prefix + 1) << width] - self.before[prefix << width])

    def counts(self, bucket: int) -> np.ndarray:
        """How many draws of each replicate fall into the bucket."""
        m = np.full(self.replicates, self.draws, dtype=np.int64)
        for level in range(self.bits):
            prefix = bucket >> (self.bits - level)
            if level not in self.path or self.path[level][0] != prefix:
                self.path[level] = prefix, self._left(level, prefix, m)
            left = self.path[level][1]
            m = m - left if (bucket >> (self.bits - level - 1)) & 1 else left
        return m

    def _left(self, level: int, prefix: int, m: np.ndarray) -> np.ndarray:
        left, right = self.rows(level + 1, 2 * prefix), self.rows(level + 1, 2 * prefix + 1)
        if not left or not right:
            return np.zeros_like(m) if not left else m.copy()
        names = [f"{self.name}:{r}:{level}:{prefix}" for r in range(self.replicates)]
        out = np.empty_like(m)
        small = (m <= INVERTED) & (self.replace or left + right < len(self.logs))
        for at in range(0, len(m), BLOCK):
            here = np.flatnonzero(small[at : at + BLOCK]) + at
            if len(here):
                u = np.array([_digest(names[r], 13) for r in here.tolist()]) / float(1 << 52)
                out[here] = self._inverted(m[here], left, right, u)
        for r in np.flatnonzero(~small).tolist():
            rng = np.random.default_rng(_digest(names[r], 16))
            out[r] = rng.binomial(m[r], left / (left + right)) if self.replace else rng.hypergeometric(left, right, m[r])
        return out

    def _inverted(self, m: np.ndarray, left: int, right: int, u: np.ndarray) -> np.ndarray:
        """The least k whose cumulative probability reaches u."""
        k, m = np.arange(m.max() + 1)[None, :], m[:, None]
        lf, rest = self.logs, np.maximum(m - k, 0)
        if self.replace:
            p = left / (left + right)
            possible = k <= m
            weight = lf[m] - lf[np.minimum(k, m)] - lf[rest] + k * np.log(p) + rest * np.log(1 - p)
        else:
            possible = (k <= m) & (k <= left) & (m - k <= right)
            choose = lambda n, j: lf[n] - lf[np.minimum(j, n)] - lf[np.maximum(n - j, 0)]
            weight = choose(left, k) + choose(right, rest) - choose(left + right, m)
        upto = np.cumsum(np.where(possible, np.exp(weight), 0.0), axis=1)
        return np.minimum((upto < u[:, None]).sum(axis=1), m[:, 0])


def picked(name: str, replicate: int, bucket: int, draws: int, size: int) -> np.ndarray:
    """How often each row of a bucket is drawn, with replacement."""
    return np.bincount(stream(f"{name}:{replicate}:{bucket}", draws) % size, minlength=size)


def chosen(name: str, replicate: int, bucket: int, draws: int, size: int) -> np.ndarray:
    """Which rows of a bucket are drawn, without replacement: those with the smallest numbers (no two are equal)."""
    out = np.zeros(size, dtype=np.int64)
    out[np.argpartition(stream(f"{name}:{replicate}:{bucket}", size), draws - 1)[:draws] if draws else []] = 1
    return out
