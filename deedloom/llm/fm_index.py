"""A full-text index over integer tokens: suffix order, wavelet matrix over the Burrows-Wheeler transform, sampled positions.

Small numpy helpers for one shard; the operators decide what a shard is.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 32


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling. The last token must be the only 0."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Rank of any symbol in any prefix, one bit plane per level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        now = symbols
        for level in reversed(range(bits)):
            ones = (now >> level) & 1
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(now) - int(before[-1])
            self.levels.append((level, before, zeros))
            now = np.concatenate((now[ones == 0], now[ones == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before position at[i]."""
        low, high = np.zeros_like(at), at
        for level, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = before[low], before[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols at the given positions."""
        out, pos = np.zeros(len(at), np.int64), at.copy()
        for level, before, zeros in self.levels:
            a = before[pos]
            one = before[pos + 1] > a
            out |= one.astype(np.int64) << level
            pos = np.where(one, zeros + a, pos - a)
        return out


class FMIndex:
    """Counts and locates token sequences. Token 0 is kept for the end; text tokens are 1 or more."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(np.asarray(text, np.int64), 0)
        self.sample, n = sample, len(text)
        order = suffix_order(text)
        top = int(text.max())
        self.top = top
        last = text[order - 1]
        self.matrix = WaveletMatrix(last, max(1, top.bit_length()))
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.first[1:])
        # rows whose suffix starts at a multiple of `sample` know their position; their number follows from a rank
        known = order % sample == 0
        self.known_before = np.concatenate(([0], np.cumsum(known)))
        self.positions = order[known]
        self.n = n

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase of a (phrases, length) array, by backward search over all phrases at once."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero((phrases >= 1).all(axis=1) & (phrases <= self.top).all(axis=1))
        high[np.setdiff1d(np.arange(len(phrases)), alive)] = 0
        for column in reversed(range(phrases.shape[1])):
            if not len(alive):
                break
            symbol = phrases[alive, column]
            low[alive] = self.first[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.matrix.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows, stepping back to the next sampled position."""
        out, rows = np.empty(len(rows), np.int64), np.asarray(rows, np.int64).copy()
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            now = rows[open_]
            known = self.known_before[now + 1] > self.known_before[now]
            done = open_[known]
            out[done] = self.positions[self.known_before[rows[done]]] + steps
            open_ = open_[~known]
            now = rows[open_]
            symbol = self.matrix.access(now)
            rows[open_] = self.first[symbol] + self.matrix.rank(symbol, now)
            steps += 1
        return out

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: (phrase number, text position)."""
        low, high = self.ranges(phrases)
        many = high - low
        which = np.repeat(np.arange(len(phrases)), many)
        rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[which]
        return which, self.locate(rows)
