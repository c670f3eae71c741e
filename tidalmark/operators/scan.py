"""Recursive scans: state carried along ordered rows of a key.

Rows are shuffled by key and sorted in their partitions; the kernel reads Arrow
batches in order and carries one small state a key, so a key of any length needs
no more memory than a batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .ordered import window_quantile


class Roll:
    """``how`` (sum, mean, std, median or a quantile) of the last ``n`` values of
    a column, the row's own among them unless ``past``; null under ``least`` values."""

    def __init__(self, name: str, how: str | float, column: str, n: int, least: int = 1, past: bool = False):
        self.name, self.how, self.column, self.n, self.least, self.past = name, how, column, n, least, past

    def of(self, x: np.ndarray, rows: int, most: int = 2048) -> np.ndarray:
        """For the last ``rows`` places of ``x``, NaN where there is no value."""
        if self.how not in ("sum", "mean", "std") and self.n > 64:
            # A long window is kept sorted; a short one is sorted anew with its neighbours at once.
            share = 0.5 if self.how == "median" else self.how
            found = window_quantile(x, self.n, share, self.least)
            return np.concatenate([[np.nan], found])[:-1][-rows:] if self.past else found[-rows:]
        end = len(x) - 1 if self.past else len(x)
        x = np.concatenate([np.full(self.n, np.nan), x[:end]])
        windows = sliding_window_view(x, self.n)[-rows:]
        return np.concatenate([self._part(windows[at : at + most]) for at in range(0, rows, most)])

    def _part(self, w: np.ndarray) -> np.ndarray:
        gone = np.isnan(w)
        count = self.n - gone.sum(1)
        out = np.full(len(w), np.nan)
        ok = count >= max(1, self.least)
        if self.how in ("sum", "mean", "std"):
            filled = np.where(gone, 0.0, w)
            total = filled.sum(1)
            if self.how == "sum":
                out[ok] = total[ok]
            else:
                mean = total / np.maximum(count, 1)
                if self.how == "std":
                    filled = np.where(gone, 0.0, w - mean[:, None])
                    mean = np.sqrt((filled * filled).sum(1) / np.maximum(count, 1))
                out[ok] = mean[ok]
            return out
        share = 0.5 if self.how == "median" else self.how
        full = ok & (count == self.n)
        if full.any():
            out[full] = np.quantile(w[full], share, axis=1)
        for i in np.flatnonzero(ok & ~full):
            out[i] = np.quantile(w[i][~gone[i]], share)
        return out


def scan(
    df: DataFrame,
    inputs: list[str] = (),
    schema: str = "",
    start: Callable[[], object] | None = None,
    step: Callable[..., tuple] | None = None,
    keys: tuple[str, ...] = ("symbol",),
    order: tuple[str, ...] = ("ts", "seq"),
    rolls: list[Roll] = (),
) -> DataFrame:
    """``df`` with the columns of ``schema`` and those of ``rolls``.

    ``step(state, *values)`` gets a row's ``inputs`` and returns the row's new
    values; it changes the state (made by ``start()`` for each key) in place.
    Rolls are computed for a batch at once, with as many rows before it as the
    longest needs; a window of rows in Spark's own frames is summed anew for
    every row, which costs more than the pass.
    """
    added = T.StructType.fromDDL(schema) if schema else T.StructType()
    rolled = T.StructType([T.StructField(r.name, T.DoubleType()) for r in rolls])
    kept = df.columns
    kinds = [to_arrow_type(f.dataType) for f in added]
    at_keys, at_inputs = [kept.index(k) for k in keys], [kept.index(c) for c in inputs]
    at_rolls = {r.column: kept.index(r.column) for r in rolls}
    reach = max([r.n for r in rolls], default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, before = object(), None, {}
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in at_keys], strict=True))
            values = list(zip(*[batch.column(i).to_pylist() for i in at_inputs], strict=True))
            numbers = {c: batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for c, i in at_rolls.items()}
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            out, windows = [], [[] for _ in rolls]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first == last:
                    continue
                if names[first] != key:
                    key, before = names[first], {c: np.empty(0) for c in at_rolls}
                    state = start() if start else None
                if step:
                    out += [step(state, *v) for v in values[first:last]]
                whole = {c: np.concatenate([before[c], x[first:last]]) for c, x in numbers.items()}
                for r, parts in zip(rolls, windows, strict=True):
                    parts.append(r.of(whole[r.column], last - first))
                before = {c: x[-reach:] for c, x in whole.items()}
            made = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            arrays = [pa.array(v, t) for v, t in zip(made, kinds, strict=True)]
            arrays += [pa.array(np.concatenate(p) if p else [], pa.float64(), from_pandas=True) for p in windows]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*kept, *added.names, *rolled.names])

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields, *rolled.fields]))


class Ewm:
    """y = a x + (1 - a) y', seeded with the first value; a null row repeats y,
    and a gap of g rows weighs the old value with (1 - a) ** g."""

    def __init__(self, alpha: float):
        self.a, self.y, self.gap, self.n = alpha, None, 1, 0

    def __call__(self, x: float | None) -> float | None:
        if x is None:
            self.gap += self.y is not None
            return self.y
        self.n += 1
        if self.y is None:
            self.y = x
        else:
            old = (1 - self.a) ** self.gap
            self.y = (old * self.y + self.a * x) / (old + self.a)
        self.gap = 1
        return self.y


def span(n: float) -> Ewm:
    return Ewm(2.0 / (n + 1.0))


def wilder(n: float) -> Ewm:
    return Ewm(1.0 / n)


class Hysteresis:
    """0 -> +-1 beyond ``enter``, back to 0 when the side's value is under
    ``leave`` (or at it, unless ``strict``); no direct flip."""

    def __init__(self, enter: float, leave: float, strict: bool = False):
        self.enter, self.leave, self.strict, self.state = enter, leave, strict, 0

    def __call__(self, x: float | None) -> int:
        if x is not None:
            if self.state == 0:
                self.state = 1 if x >= self.enter else -1 if x <= -self.enter else 0
            elif (self.state * x < self.leave) if self.strict else (self.state * x <= self.leave):
                self.state = 0
        return self.state


class Heat:
    """h = h' exp(-rate dt) + x over irregular times in seconds."""

    def __init__(self, half_life: float):
        self.rate, self.h, self.t = 0.6931471805599453 / half_life, 0.0, None

    def __call__(self, t: float, x: float) -> float:
        from math import exp

        gap = 0.0 if self.t is None else max(0.0, t - self.t)
        self.h, self.t = self.h * exp(-self.rate * gap) + x, t
        return self.h


class TimeMean:
    """Mean of the values of the last ``span`` units of time, the row's own among
    them; null under ``least`` of them."""

    def __init__(self, span: float, least: int):
        self.span, self.least, self.total, self.held = span, least, 0.0, deque()

    def __call__(self, t: float, x: float) -> float | None:
        self.held.append((t, x))
        self.total += x
        while self.held[0][0] <= t - self.span:
            self.total -= self.held.popleft()[1]
        return self.total / len(self.held) if len(self.held) >= self.least else None


class Smoother:
    """Two-pole super-smoother of a period."""

    def __init__(self, period: float = 10.0):
        from math import cos, exp, pi

        a = exp(-1.414 * pi / period)
        self.c2, self.c3 = 2 * a * cos(1.414 * pi / period), -a * a
        self.c1 = 1 - self.c2 - self.c3
        self.x = self.y1 = self.y2 = None

    def __call__(self, x: float) -> float:
        if self.y1 is None:
            y = x
        elif self.y2 is None:
            y = (x + self.x) / 2
        else:
            y = self.c1 * (x + self.x) / 2 + self.c2 * self.y1 + self.c3 * self.y2
        self.x, self.y2, self.y1 = x, self.y1, y
        return y


class Iir2:
    """y = b0 x + b1 x1 + b2 x2 - a1 y1 - a2 y2, all seeded with the first x."""

    def __init__(self, b0: float, b1: float, b2: float, a1: float, a2: float):
        self.k, self.s = (b0, b1, b2, a1, a2), None

    def __call__(self, x: float) -> float:
        b0, b1, b2, a1, a2 = self.k
        x1, x2, y1, y2 = self.s or (x, x, x, x)
        y = b0 * x + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        self.s = (x, x1, y, y1)
        return y


class Supertrend:
    """Direction and line from close and the two bands."""

    def __init__(self):
        self.line, self.way = None, 1

    def __call__(self, close: float, up: float | None, low: float | None) -> tuple[int, float | None]:
        if self.line is None:
            self.line = up
            return 1, self.line
        self.way = 1 if close > self.line else -1 if close < self.line else self.way
        self.line = up if self.way == -1 else low
        return self.way, self.line


class Cooldown:
    """Keeps a row if ``gap`` seconds have passed since the last one kept."""

    def __init__(self, gap: float):
        self.gap, self.at = gap, None

    def __call__(self, t: float, wanted: bool = True) -> bool:
        keep = bool(wanted) and (self.at is None or t - self.at >= self.gap)
        if keep:
            self.at = t
        return keep


class Streak:
    """Rows since the sign last changed; a zero resets both runs."""

    def __init__(self):
        self.up = self.down = 0

    def __call__(self, change: float | None) -> tuple[int, int]:
        self.up = self.up + 1 if change and change > 0 else 0
        self.down = self.down + 1 if change and change < 0 else 0
        return self.up, self.down
