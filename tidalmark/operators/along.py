"""Columns along ordered rows of a key, several in one pass and without a shuffle of their own.

``laid`` shuffles the rows by key once and sorts them; ``along`` then adds columns in
place, so passes with Spark's own projections between them stay in one stage.
A part sees a stretch of a key's rows as arrays of doubles by name (null is NaN), those that
parts before it have made as well, and keeps what it needs of the rows before.
Rows of one time are never cut apart, and a key's first rows wait until the
parts that look ahead can see far enough, so a pass holds a batch, the rows of
one time, and those that wait.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .ordered import window_quantile

NONE = -(1 << 62)


def laid(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)


class Part:
    """Makes the columns ``names``.  ``start()`` gives a key's worker, called with the
    stretch's columns, the number of its first row in the key and where its times begin."""

    names: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    kind = "double"
    #: So many rows of a key must be there before its first ones can go.
    ahead = 0

    def start(self) -> Callable:
        raise NotImplementedError


class Lag(Part):
    def __init__(self, name: str, column: str):
        self.names, self.reads = (name,), (column,)

    def start(self):
        last = np.nan

        def work(x, first, times):
            nonlocal last
            v = x[self.reads[0]]
            out = np.concatenate([[last], v[:-1]])
            last = v[-1]
            return (out,)

        return work


class So(Part):
    """``how`` of the values so far: sum, min or last (that is not null)."""

    def __init__(self, name: str, how: str, column: str):
        self.names, self.how, self.reads = (name,), how, (column,)

    def start(self):
        held = np.nan

        def work(x, first, times):
            nonlocal held
            v = np.concatenate([[held], x[self.reads[0]]])
            if self.how == "sum":
                there = np.maximum.accumulate(~np.isnan(v))
                out = np.where(there, np.cumsum(np.nan_to_num(v, posinf=np.inf, neginf=-np.inf)), np.nan)
            elif self.how == "min":
                out = np.fmin.accumulate(v)
            else:
                at = np.maximum.accumulate(np.where(np.isnan(v), 0, np.arange(len(v))))
                out = v[at]
            held = out[-1]
            return (out[1:],)

        return work


class AtTime(Part):
    """``how`` (last, mean) of a column over the rows of the row's time."""

    def __init__(self, how: str, **columns: str):
        self.how, self.names, self.reads = how, tuple(columns), tuple(columns.values())

    def start(self):
        def work(x, first, times):
            sizes = np.diff([*times, len(x[self.reads[0]])])
            return tuple(np.repeat(self._of(x[c], times, sizes), sizes) for c in self.reads)

        return work

    def _of(self, v, times, sizes):
        if self.how == "last":
            return v[times + sizes - 1]
        there = ~np.isnan(v)
        n = np.add.reduceat(there.astype(float), times)
        return np.divide(np.add.reduceat(np.where(there, v, 0.0), times), n, out=np.full(len(n), np.nan), where=n > 0)


class From(Part):
    """A column whose first rows take the value of row ``n`` (from 1), null if there is none."""

    def __init__(self, name: str, column: str, n: int):
        self.names, self.reads, self.n, self.ahead = (name,), (column,), n, n

    def start(self):
        def work(x, first, times):
            v = x[self.reads[0]]
            if first >= self.n - 1:
                return (v,)
            out = np.array(v)
            out[: self.n - 1 - first] = v[self.n - 1 - first] if len(v) >= self.n - first else np.nan
            return (out,)

        return work


class Opening(Part):
    """A column whose nulls before its first value take that.  Such rows wait for it."""

    def __init__(self, name: str, column: str):
        self.names, self.reads = (name,), (column,)

    def start(self):
        seen = False

        def work(x, first, times):
            nonlocal seen
            v = x[self.reads[0]]
            there = np.flatnonzero(~np.isnan(v))
            if not seen and len(there):
                v = np.concatenate([np.full(there[0], v[there[0]]), v[there[0] :]])
            seen = seen or len(there) > 0
            return (v,)

        return work


class Moments(Part):
    """Mean ``m_``, deviation ``s_`` or sum of the last ``n`` values, the row's own among them
    unless ``past``; null under ``least`` values."""

    def __init__(self, column: str, n: int, least: int = 1, past: bool = False, mean: str = "", std: str = "", total: str = ""):
        named = {"mean": mean, "std": std, "total": total}
        self.which = [k for k, v in named.items() if v]
        self.names, self.reads = tuple(v for v in named.values() if v), (column,)
        self.n, self.least, self.past = n, max(1, least), past

    def start(self):
        held = np.full(self.n, np.nan)

        def work(x, first, times):
            nonlocal held
            whole = np.concatenate([held, x[self.reads[0]]])
            held = whole[-self.n :]
            v = whole[:-1] if self.past else whole[1:]
            return self._of(v, len(whole) - self.n)

        return work

    def _of(self, v, rows):
        gone = np.isnan(v)
        filled = np.where(gone, 0.0, v)
        upto = np.concatenate([[0], np.cumsum(~gone)])
        count = (upto[self.n :] - upto[: -self.n])[:rows]
        total = np.concatenate([w.sum(1) for w in self._windows(filled)])
        mean = total / np.maximum(count, 1)
        found = {"total": total, "mean": mean}
        if "std" in self.which:
            found["std"] = np.sqrt(self._squares(filled, gone, mean) / np.maximum(count, 1))
        return tuple(np.where(count >= self.least, found[k], np.nan) for k in self.which)

    def _windows(self, v, most: int = 1024):
        w = sliding_window_view(v, self.n)
        return (w[at : at + most] for at in range(0, len(w), most))

    def _squares(self, filled, gone, mean):
        parts, at = [], 0
        for w, g in zip(self._windows(filled), self._windows(gone), strict=True):
            d = w - mean[at : at + len(w), None]
            if g[0].any() or g[-1].any() or g.any():
                d = np.where(g, 0.0, d)
            parts.append(np.einsum("ij,ij->i", d, d))
            at += len(w)
        return np.concatenate(parts)


class Quantile(Part):
    """Of the last ``n`` values; null under ``least`` values."""

    def __init__(self, name: str, column: str, n: int, share: float = 0.5, least: int = 1):
        self.names, self.reads, self.n, self.share, self.least = (name,), (column,), n, share, least

    def start(self):
        held = np.empty(0)

        def work(x, first, times):
            nonlocal held
            v = x[self.reads[0]]
            whole = np.concatenate([held, v])
            held = whole[-self.n :]
            return (window_quantile(whole, self.n, self.share, self.least)[-len(v) :],)

        return work


class Each(Part):
    """``step(state, *values)`` row by row gives the row's new values."""

    def __init__(self, names: str, reads: list[str], start: Callable, step: Callable):
        self.names, self.reads, self.begin, self.step = tuple(names.split()), tuple(reads), start, step

    def start(self):
        state, step = self.begin(), self.step

        def work(x, first, times):
            rows = zip(*[[None if v != v else v for v in x[c].tolist()] for c in self.reads], strict=True)
            made = [step(state, *r) for r in rows]
            return tuple(np.array(c, float) for c in zip(*made, strict=True))

        return work


class Calc(Part):
    """Columns of plain arithmetic between other parts."""

    def __init__(self, names: str, of: Callable, *reads: str):
        self.names, self.of, self.reads = tuple(names.split()), of, reads

    def start(self):
        def work(x, first, times):
            made = self.of(*[x[c] for c in self.reads])
            return made if len(self.names) > 1 else (made,)

        return work


def over(part: np.ndarray, whole: np.ndarray, small: float = 1e-12) -> np.ndarray:
    """Part of a magnitude that is not zero, else null."""
    size = np.abs(whole)
    return np.divide(part, size, out=np.full(len(size), np.nan), where=size > small)


def along(df: DataFrame, parts: list[Part], kept: list[str], keys: tuple[str, ...] = ("symbol",), time: str = "ts") -> DataFrame:
    """The columns ``kept`` of ``df`` and of the parts, all doubles.  ``df`` lies as ``laid`` leaves it."""
    made = {n for p in parts for n in p.names}
    given = [c for c in dict.fromkeys(r for p in parts for r in p.reads) if c in df.columns and c not in made]
    passed = [c for c in kept if c not in made]
    df = df.select(*dict.fromkeys([*keys, time, *passed, *given]))
    ahead = max([p.ahead for p in parts], default=0)
    openings = [p.reads[0] for p in parts if isinstance(p, Opening)]
    out = T.StructType([df.schema[c] if c in passed else T.StructField(c, T.DoubleType()) for c in kept])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def codes(c: pa.Array) -> np.ndarray:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            return c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return pc.fill_null(c.cast(pa.int64()), NONE).to_numpy(zero_copy_only=False)

    def starts(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for c in columns:
            v = codes(batch.column(c))
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, workers, waiting = None, 0, [], None
        for batch in _then_none(batches):
            last = batch is None
            if waiting is not None:
                batch = waiting if last else pa.concat_batches([waiting, batch])
            if batch is None or not batch.num_rows:
                continue
            begins, times = starts(batch, list(keys)), starts(batch, [*keys, time])
            cut = batch.num_rows
            if not last:
                cut = times[-1]
                name = tuple(batch.column(k)[int(begins[-1])].as_py() for k in keys)
                before = first if name == key else 0
                if begins[-1] < cut:
                    whole = cut - begins[-1] + before
                    lone = not before and any(batch.column(c).slice(begins[-1], cut - begins[-1]).null_count == cut - begins[-1] for c in openings)
                    if before < ahead and whole < ahead or lone:
                        cut = begins[-1]
            waiting = batch.slice(cut)
            batch = batch.slice(0, cut)
            ends = [*begins[begins < cut][1:], cut] if cut else []
            x = {c: batch.column(c).cast(pa.int64() if pa.types.is_timestamp(batch.column(c).type) else pa.float64()).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in given}
            pieces = {n: [] for n in made}
            for a, b in zip(begins, ends, strict=False):
                name = tuple(batch.column(k)[int(a)].as_py() for k in keys)
                if name != key:
                    key, first, workers = name, 0, [p.start() for p in parts]
                stretch = {c: v[a:b] for c, v in x.items()}
                at = times[(times >= a) & (times < b)] - a
                for p, work in zip(parts, workers, strict=True):
                    for n, v in zip(p.names, work(stretch, first, at), strict=True):
                        stretch[n] = v
                        pieces[n].append(v)
                first += int(b - a)
            if cut:
                whole = [batch.column(c) if c in passed else pa.array(np.concatenate(pieces[c]), pa.float64(), from_pandas=True) for c in kept]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(whole, kinds, strict=True)], kept)

    return df.mapInArrow(run, out)


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None
