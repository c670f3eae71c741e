"""Order statistics of sliding windows.

A window is kept sorted while rows come and go: finding a place takes a binary
search, moving what lies behind it a copy inside one bucket of at most
``2 * LOAD`` values.  So a row costs about the same in a window of 30 and of
30,000 rows; nothing is sorted anew.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np

LOAD = 512


class Ordered:
    """A multiset in order, in buckets."""

    def __init__(self, load: int = LOAD):
        self.load, self.buckets, self.tops, self.size = load, [], [], 0

    def add(self, v: float) -> None:
        self.size += 1
        if not self.buckets:
            self.buckets, self.tops = [[v]], [v]
            return
        k = min(bisect_left(self.tops, v), len(self.tops) - 1)
        bucket = self.buckets[k]
        insort(bucket, v)
        self.tops[k] = bucket[-1]
        if len(bucket) > 2 * self.load:
            self.buckets[k : k + 1] = [bucket[: self.load], bucket[self.load :]]
            self.tops[k : k + 1] = [bucket[self.load - 1], bucket[-1]]

    def drop(self, v: float) -> None:
        """One of the values equal to ``v``, which must be there."""
        self.size -= 1
        k = bisect_left(self.tops, v)
        bucket = self.buckets[k]
        del bucket[bisect_left(bucket, v)]
        if bucket:
            self.tops[k] = bucket[-1]
        else:
            del self.buckets[k], self.tops[k]

    def rank(self, v: float) -> tuple[int, int]:
        """How many values are less, and how many are not greater."""
        first, last = bisect_left(self.tops, v), bisect_right(self.tops, v)
        below = sum(map(len, self.buckets[:first]))
        less = below + (bisect_left(self.buckets[first], v) if first < len(self.buckets) else 0)
        upto = below + sum(map(len, self.buckets[first:last]))
        return less, upto + (bisect_right(self.buckets[last], v) if last < len(self.buckets) else 0)

    def at(self, k: int) -> float:
        for bucket in self.buckets:
            if k < len(bucket):
                return bucket[k]
            k -= len(bucket)
        raise IndexError(k)


def window_ranks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the least and the largest of the last ``n`` values, and the
    row's own rank among them as a share of their number (ties: the mean of
    their ranks).  NaN values do not count, and have no rank."""
    low, high, share = (np.full(len(x), np.nan) for _ in range(3))
    values = x.tolist()
    if n <= LOAD:  # a window of one bucket is a list
        one: list[float] = []
        for i, v in enumerate(values):
            if i >= n and (old := values[i - n]) == old:
                del one[bisect_left(one, old)]
            if v == v:
                less, upto = bisect_left(one, v), bisect_right(one, v) + 1
                one.insert(less, v)
                share[i] = (less + (upto - less + 1) / 2) / len(one)
            if one:
                low[i], high[i] = one[0], one[-1]
        return low, high, share
    held = Ordered()
    for i, v in enumerate(values):
        if i >= n and (old := values[i - n]) == old:
            held.drop(old)
        if v == v:
            held.add(v)
            less, upto = held.rank(v)
            share[i] = (less + (upto - less + 1) / 2) / held.size
        if held.size:
            low[i], high[i] = held.buckets[0][0], held.tops[-1]
    return low, high, share


def window_quantile(x: np.ndarray, n: int, share: float, least: int = 1) -> np.ndarray:
    """The quantile of the last ``n`` values, between two by their distance; NaN
    under ``least`` values that are not NaN."""
    out = np.full(len(x), np.nan)
    values, least = x.tolist(), max(1, least)
    if n <= LOAD:  # a window of one bucket is a list
        one: list[float] = []
        for i, v in enumerate(values):
            if i >= n and (old := values[i - n]) == old:
                del one[bisect_left(one, old)]
            if v == v:
                insort(one, v)
            if len(one) >= least:
                at = (len(one) - 1) * share
                below = int(at)
                a = one[below]
                out[i] = a if at == below else a + (one[below + 1] - a) * (at - below)
        return out
    held = Ordered()
    for i, v in enumerate(values):
        if i >= n and (old := values[i - n]) == old:
            held.drop(old)
        if v == v:
            held.add(v)
        if held.size >= max(1, least):
            at = (held.size - 1) * share
            below = int(at)
            a = held.at(below)
            out[i] = a if at == below else a + (held.at(below + 1) - a) * (at - below)
    return out
