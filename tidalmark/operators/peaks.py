"""Peaks of a series: plateaus, prominence, suppression by height within a distance.

A series of any length lies in blocks (see ``blocks``); what a block cannot
decide alone is decided in a second pass over what its neighbours need of it.

* A peak is a run of equal values above both its neighbours; its place is the
  middle of the run (the left one of two).  Runs at the ends are no peaks.
* Prominence: the height above the higher of the two lowest points on the way
  to a higher value, or to the end, on either side.  A block keeps the stairs
  of its values as seen from outside (each higher than all before it, with the
  lowest point on the way); one pass over the blocks' stairs hands each block
  those of its neighbours that its own values can reach, which together are
  no more than all stairs.
* Suppression: from the highest peak down (ties: the later one first), a peak
  that is kept removes all that are nearer than the distance.  In a block, a
  peak stays undecided while a higher one near it is; blocks with other
  borders decide the rest, until none is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ROWS, _inputs, _items, blocks, each_block, joined, positioned, windowed, written
from .scan import scan


def stairs(x: np.ndarray, held: list[tuple[float, float]]) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """For each value the lowest one since a higher one, and the stairs behind
    the last: (value, lowest since the next higher one), highest first.
    ``held`` are the stairs before the first."""
    held, low = list(held), np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        least = v
        while held and held[-1][0] <= v:
            least = min(least, held.pop()[1])
        low[i] = least
        held.append((v, least))
    return low, held


def _flat(steps: list[tuple[float, float]]) -> list[float]:
    return [v for step in steps for v in step]


def _steps(flat) -> list[tuple[float, float]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _neighbours(sums: DataFrame, keys: tuple[str, ...], order: str, column: str, out: str) -> DataFrame:
    """The stairs before each block, as far as the block's highest value reaches."""

    def step(held: list, flat: list[float]) -> tuple:
        own = _steps(flat)
        top, seen = own[0][0], []
        while held and held[-1][0] <= top:
            seen.append(held.pop())
        if held:
            seen.append(held[-1])
        # The block's highest value passes all that it has popped.
        popped = [low for value, low in seen if value <= top]
        held += [(top, min([own[0][1], *popped])), *own[1:]]
        return (_flat(seen[::-1]),)

    return scan(sums, [column], f"{out} array<double>", list, step, keys, (order,)).select(*keys, "_block", out)


def prominences(df: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], rows: int = ROWS) -> DataFrame:
    """``df`` with ``left_low`` and ``right_low`` of every row: the lowest values on the
    way to a higher one, or to the end."""
    made = written(blocks(df, keys, order, rows=rows))
    sums = T.StructType([*[made.schema[k] for k in keys], *T.StructType.fromDDL("_block long, _left array<double>, _right array<double>")])

    def reduce(batches):
        for batch in batches:
            left, right = [], []
            for _, whole in _items(batch):
                x = _inputs(whole, [value])[0][value]
                left.append(_flat(stairs(x, [])[1]))
                right.append(_flat(stairs(x[::-1], [])[1]))
            both = [pa.array(v, pa.list_(pa.float64())) for v in (left, right)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("_block"), *both], sums.names)

    table = written(made.mapInArrow(reduce, sums).withColumn("_back", -F.col("_block")))
    left = _neighbours(table, keys, "_block", "_left", "_from_left")
    right = _neighbours(table, keys, "_back", "_right", "_from_right")
    state = F.concat(F.array(F.size("_from_left").cast("double")), "_from_left", "_from_right")
    met = joined(joined(made, left, [*keys, "_block"]), right, [*keys, "_block"]).select(*made.columns, state.alias("_state"))

    def kernel(x, pos, own, held):
        v, n = x[value], 1 + int(held[0])
        left_low = stairs(v, _steps(held[1:n].tolist()))[0]
        right_low = stairs(v[::-1], _steps(held[n:].tolist()))[0][::-1]
        return left_low, right_low

    done = each_block(met, keys, [value], "left_low double, right_low double", kernel, rows, state=True)
    return done.select(*df.columns, "left_low", "right_low")


def peaks(df: DataFrame, value: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "seq"), rows: int = ROWS) -> DataFrame:
    """``keys, kind, at, height, prominence`` of the peaks (kind 1) and troughs (-1,
    of the negated series) of a column without nulls."""
    numbered = positioned(df.select(*keys, *order, F.col(value).cast("double").alias("v")), keys, order).select(*keys, F.col("_pos").alias("start"), "v")
    both = numbered.select(*keys, F.explode(F.array(F.lit(1), F.lit(-1))).alias("kind"), "start", "v").withColumn("v", F.col("v") * F.col("kind"))
    keys = (*keys, "kind")

    def changes(x, pos, own):
        new = np.ones(len(pos), bool)
        new[1:] = np.diff(x["v"]) != 0
        new[0] = pos[0] == 0
        return (new[own],)

    runs = windowed(both, ["v"], "first boolean", changes, keys, ("start",), back=1, rows=rows).where("first").drop("first")

    def turns(x, pos, own):
        v, start = x["v"], x["start"]
        high = np.zeros(len(v), bool)
        high[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
        at = start.copy()
        at[:-1] = np.floor((start[:-1] + start[1:] - 1) / 2)
        return high[own], at[own].astype(np.int64)

    turned = windowed(runs, ["v", "start"], "peak boolean, at long", turns, keys, ("start",), back=1, ahead=1, rows=rows)
    found = prominences(turned, "v", keys, ("start",), rows).where("peak")
    return found.select(*keys, "at", F.col("v").alias("height"), (F.col("v") - F.greatest("left_low", "right_low")).alias("prominence"))


def spaced(found: DataFrame, distances: list[int], keys: tuple[str, ...] = ("symbol", "kind"), rows: int = ROWS) -> DataFrame:
    """Peaks with ``kept_<d>`` for each distance: whether it is kept."""
    reach = max(distances)
    names = [f"kept_{d}" for d in distances]
    left = positioned(found, keys, ("at",)).withColumns({c: F.lit(-1) for c in names})
    schema = ", ".join(f"{c} int" for c in names)

    def kernel(x, pos, own):
        at, first = x["at"], np.argsort(x["height"], kind="stable")[::-1]
        out = []
        for d, name in zip(distances, names, strict=True):
            known = x[name].astype(np.int32)
            low, high = np.searchsorted(at, at - d, "right"), np.searchsorted(at, at + d, "left")
            rank = np.empty(len(at), np.int64)
            rank[first] = np.arange(len(at))
            # Rows lent by neighbours do not see all that is near them.
            blind = ((at - d < at[0]) & (pos[0] > 0)) | ((at + d > at[-1]) & (own.stop < len(at)))
            blind[own] = False
            for i in first[known[first] < 0]:
                near = [j for j in range(low[i], high[i]) if rank[j] < rank[i]]
                if any(known[j] == 1 for j in near):
                    known[i] = 0
                elif not blind[i] and all(known[j] == 0 for j in near):
                    known[i] = 1
            out.append(known[own])
        return tuple(out)

    inputs, turn = ["at", "height", *names], 0
    undecided = F.array_min(F.array(*names)) < 0
    while True:
        shift = rows // 2 * (turn % 2)
        made = blocks(left, keys, ("at",), min(reach, rows), min(reach, rows), rows, shift)
        left = written(each_block(made, keys, inputs, schema, kernel, rows, shift=shift))
        turn += 1
        if left.where(undecided).isEmpty():
            return left.select(*found.columns, *[(F.col(c) == 1).alias(c) for c in names])


#: Divisors of the window that give the distances, and shares of the prominence, from strict to loose.
DISTANCES = (3, 4, 6, 10)
LOOSER = (1.0, 0.5, 0.2, 0.05, 0.0)


def relaxed(found: DataFrame, spread: DataFrame, window: int = 30, share: float = 0.1) -> DataFrame:
    """The peaks and troughs of the first setting that leaves two of both in a
    series: distances of ``window`` over 3, 4, 6, 10, and for each one
    prominences of ``share`` of the series' deviation, its half, fifth,
    twentieth, and any.  Where none does, all of a twentieth and any distance.

    ``spread`` has ``symbol`` and ``std``.  Adds ``enough``: whether the series has
    two of both.
    """
    distances = [max(1, int(window / d)) for d in DISTANCES]
    marked = joined(spaced(found, distances), spread, ["symbol"])
    rung = [(F.col(f"kept_{d}"), F.greatest(F.lit(1e-12), F.col("std") * share * k)) for d in distances for k in LOOSER]
    rung.append((F.lit(True), F.greatest(F.lit(1e-12), F.col("std") * (share * 0.05))))
    passes = [kept & (F.col("prominence") >= least) for kept, least in rung]
    marked = marked.withColumn("passes", F.array(*passes))
    sums = [F.sum((F.col("passes")[k] & (F.col("kind") == kind)).cast("long")).alias(f"{side}{k}") for k in range(len(rung)) for kind, side in ((1, "p"), (-1, "t"))]
    ok = [F.least(f"p{k}", f"t{k}") >= 2 for k in range(len(rung))]
    first = F.coalesce(*[F.when(c, F.lit(k)) for k, c in enumerate(ok)])
    chosen = marked.groupBy("symbol").agg(*sums).select("symbol", F.coalesce(first, F.lit(len(rung) - 1)).alias("rung"), first.isNotNull().alias("enough"))
    return joined(marked, chosen, ["symbol"]).where(F.col("passes")[F.col("rung")]).select(*found.columns, "rung", "enough")
