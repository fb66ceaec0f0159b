"""FM-index over integer sequences in numpy: wavelet-matrix ranks, sampled suffix positions.

A text is a set of runs of symbols 1..sigma-1, given one after another, each closed by a 0. The
closing zeros count as distinct and ordered by place, so a suffix comparison never leaves its run.
All queries of a batch go through backward search together.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; zeros are distinct, so it ends with the longest run."""
    n = len(symbols)
    zeros = symbols == 0
    rank = symbols.astype(np.int64) + np.count_nonzero(zeros)
    rank[zeros] = np.arange(np.count_nonzero(zeros))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ranked = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        tail = np.zeros(n, np.int64)
        tail[:-step] = new[step:]
        rank = new * n + tail
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """rank and access over small integers, a bit vector with counts per level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.counts, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level & 1).astype(bool)
            self.counts.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.counts[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.counts, self.zeros)):
            bit = symbol >> (self.levels - 1 - k) & 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.counts, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.bwt = WaveletMatrix(symbols[order - 1].astype(np.int64), sigma)  # place 0 is preceded by the last zero
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))]).astype(np.int64)
        starts = np.ones(self.n, bool)
        starts[1:] = symbols[:-1] == 0
        sampled = starts | (np.arange(self.n) % SAMPLE == 0)
        at = sampled[order]
        self.marked = np.concatenate([[0], np.cumsum(at)])
        self.samples = order[at]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of equally long patterns, one a row."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            c = patterns[live, j]
            low[live] = self.before[c] + self.bwt.rank(c, low[live])
            high[live] = self.before[c] + self.bwt.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(self.marked[rows + 1] == self.marked[rows])
        while len(walking):
            c = self.bwt.access(rows[walking])
            rows[walking] = self.before[c] + self.bwt.rank(c, rows[walking])
            steps[walking] += 1
            walking = walking[self.marked[rows[walking] + 1] == self.marked[rows[walking]]]
        return self.samples[self.marked[rows]] + steps
