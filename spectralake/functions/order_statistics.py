"""Medians and median deviations of many windows of one series at a time, at a cost that does not depend on the windows' lengths."""

from __future__ import annotations

import numpy as np


class RankedSeries:
    """A series by the ranks of its values, bit by bit: for each bit from the highest, how many of the first values have it unset.

    From level to level values with the bit unset come first, else in the order they had, so that a stretch of the series is a stretch at each
    level, and its k-th smallest value is found in as many steps as ranks have bits, for many stretches side by side.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.values = np.sort(x, kind="stable")
        ranks = np.empty(n, np.int64)
        ranks[np.argsort(x, kind="stable")] = np.arange(n)
        self.bits = list(range(max(1, int(n - 1).bit_length()) - 1, -1, -1)) if n else []
        self.zeros: list[np.ndarray] = []
        for bit in self.bits:
            unset = (ranks >> bit & 1) == 0
            self.zeros.append(np.r_[0, np.cumsum(unset)].astype(np.int32))
            ranks = np.concatenate([ranks[unset], ranks[~unset]])

    def smallest(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values from ``start`` to before ``end``, of each stretch; 0 <= k < end - start."""
        start, end, k, rank = start.astype(np.int32), end.astype(np.int32), k.astype(np.int32), np.zeros(len(k), np.int32)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            a, b = zeros[start], zeros[end]
            few = b - a
            up = k >= few
            start, end = np.where(up, start - a + zeros[-1], a), np.where(up, end - b + zeros[-1], b)
            k = np.where(up, k - few, k)
            rank |= up.astype(np.int32) << bit
        return self.values[rank]

    def median_and_deviation(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Median of each stretch (none empty) and the median of the distances from it."""
        n = (end - start).astype(np.int64)
        odd = n % 2 == 1
        high = self.smallest(start, end, n // 2)
        low = high.copy()
        low[~odd] = self.smallest(start[~odd], end[~odd], n[~odd] // 2 - 1)
        middle = (low + high) / 2
        far = self._distance(start, end, middle, n // 2)
        near = far.copy()
        near[~odd] = self._distance(start[~odd], end[~odd], middle[~odd], n[~odd] // 2 - 1)
        return middle, (near + far) / 2

    def _distance(self, start: np.ndarray, end: np.ndarray, middle: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest distance from each stretch's median.

        Downwards and upwards from the middle, distances grow; how many of the k + 1 smallest lie below is found by halving.
        """
        n = (end - start).astype(np.int64)
        below, above = n // 2, n - n // 2
        down = lambda at, j: middle[at] - self.smallest(start[at], end[at], below[at] - 1 - j)
        up = lambda at, j: self.smallest(start[at], end[at], below[at] + j) - middle[at]
        low, high = np.maximum(0, k + 1 - above), np.minimum(k + 1, below)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            half = (low[open_] + high[open_]) // 2
            enough = down(open_, half) >= up(open_, k[open_] - half)
            high[open_] = np.where(enough, half, high[open_])
            low[open_] = np.where(enough, low[open_], half + 1)
            open_ = open_[low[open_] < high[open_]]
        out = np.full(len(n), -np.inf)
        some = np.flatnonzero(low > 0)
        out[some] = down(some, low[some] - 1)
        some = np.flatnonzero(low <= k)
        out[some] = np.maximum(out[some], up(some, k[some] - low[some]))
        return out


def rolling_median_and_deviation(idx: np.ndarray, x: np.ndarray, at: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Median, and median deviation from it, of the values whose idx (rising) is within ``half`` of each ``at``; NaN where there is none."""
    start, end = np.searchsorted(idx, at - half), np.searchsorted(idx, at + half, side="right")
    some = np.flatnonzero(end > start)
    middle, deviation = np.full(len(at), np.nan), np.full(len(at), np.nan)
    if len(some):
        middle[some], deviation[some] = RankedSeries(x).median_and_deviation(start[some], end[some])
    return middle, deviation
