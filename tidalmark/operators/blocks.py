"""One long series on many tasks.

A key's rows get their number by a range partitioning, and every ``rows`` of them
are a block: a row of its own, with its columns as arrays and some rows of its
neighbours.  Blocks of one key lie on any number of tasks, and no task holds
more than one of them beside its Arrow batch.

* ``windowed``: what a row's value needs lies at most ``back`` rows before it
  or ``ahead`` rows behind it.  The kernel works on a whole block at once.
* ``scanned``: a recursion whose steps are composed by an associative rule.
  Each block is reduced to a few numbers, those are combined in the order of
  blocks (a series of ``rows`` times fewer rows), and each block starts from
  the state that all before it leave.

Null keys are a key; null values reach the kernels as NaN.  Rows of equal order
columns get their numbers in any order.  An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .scan import scan

ROWS = 1 << 14


@functools.cache
def _folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tables")


def shared(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only local mode may leave
    that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _folder()
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = f"{shared(spark)}/tables/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b``, where ``columns`` are equal or both null."""
    b = b.withColumnsRenamed({c: f"_{c}_" for c in columns})
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in columns])
    return a.join(b, same, how).drop(*[f"_{c}_" for c in columns])


def positioned(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``df`` with ``_pos``, the row's number in its key, from 0.

    Rows are range-partitioned by key and order, so a key of any size spreads
    over as many tasks as it fills; a row's number is its place in its
    partition and the sum of the key's rows in those before, which is a table
    of one row for each key and partition.
    """
    by = [F.col(c) for c in (*keys, *order)]
    laid = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    sizes = laid.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known: a small one is broadcast and the rows are not shuffled to meet it.
    starts = written(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    met = joined(laid, starts, [*keys, "_part"])
    return met.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_pos"))


def previous(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "seq"), laid: bool = False) -> DataFrame:
    """``df`` with ``{c}_1`` for each of ``columns``: its value in the key's row before.

    Rows are range-partitioned by key and order once, unless they are ``laid`` so,
    and stay where they lie; a task holds a batch and the row before it.  A partition's first row gets its
    values from the last row of the partition before, a table of one row each.
    """
    by = [F.col(c) for c in (*keys, *order)]
    ends = [*keys, *columns]
    kinds = {c: to_arrow_type(df.schema[c].dataType) for c in ends}
    added = T.StructType([*[T.StructField(f"_{c}_1", df.schema[c].dataType) for c in ends], *T.StructType.fromDDL("_part int, _head boolean, _last boolean")])
    out = T.StructType([*df.schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None

        def flagged(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            flags = np.zeros(batch.num_rows, bool)
            flags[-1] = last
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], out.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            n, before = batch.num_rows, []
            for c in ends:
                first = pa.nulls(1, kinds[c]) if held is None else held.column(c).slice(held.num_rows - 1)
                before.append(pa.concat_arrays([first.cast(kinds[c]), batch.column(c).slice(0, n - 1).cast(kinds[c])]))
            head = np.zeros(n, bool)
            head[0] = held is None
            if held is not None:
                yield flagged(held, False)
            held = pa.RecordBatch.from_arrays([*batch.columns, *before, pa.array(np.full(n, part, np.int32)), pa.array(head)], out.names[:-1])
        if held is not None:
            yield flagged(held, True)

    dealt = df if laid else df.repartitionByRange(*by)
    kept = written(dealt.sortWithinPartitions(*by).mapInArrow(run, out))
    tails = kept.where("_last").select(F.lead("_part").over(Window.orderBy("_part")).alias("_next"), *[F.col(c).alias(f"_{c}_0") for c in ends])
    met = kept.join(F.broadcast(tails.where("_next IS NOT NULL")), F.col("_head") & (F.col("_part") == F.col("_next")), "left")
    behind = {c: F.when(F.col("_head"), F.col(f"_{c}_0")).otherwise(F.col(f"_{c}_1")) for c in ends}
    any_row = ~F.col("_head") | F.col("_next").isNotNull()
    same = functools.reduce(Column.__and__, [behind[k].eqNullSafe(F.col(k)) for k in keys], any_row)
    return met.select(*df.columns, *[F.when(same, behind[c]).alias(f"{c}_1") for c in columns])


def blocks(
    df: DataFrame,
    keys: tuple[str, ...] = ("symbol",),
    order: tuple[str, ...] = ("ts", "seq"),
    back: int = 0,
    ahead: int = 0,
    rows: int = ROWS,
    shift: int = 0,
) -> DataFrame:
    """``keys, _block, _items``: the block's rows in order, ``back`` and ``ahead`` of
    its neighbours' among them.  Both are at most ``rows``.  Borders lie
    ``shift`` rows earlier.  Rows that have a ``_pos`` keep it."""
    if max(back, ahead) > rows:
        raise ValueError("a block must reach no further than its neighbours")
    numbered = df if "_pos" in df.columns else positioned(df, keys, order)
    at = (F.col("_pos") + shift) % rows
    block = F.expr(f"(_pos + {shift}) div {rows}")
    into = F.array_compact(F.array(block, F.when(at >= rows - back, block + 1), F.when((at < ahead) & (block > 0), block - 1)))
    item = F.struct("_pos", *[c for c in df.columns if c not in (*keys, "_pos")])
    dealt = numbered.select(*keys, F.explode(into).alias("_block"), item.alias("_item"))
    made = dealt.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    return made.where(F.element_at("_items", -1)["_pos"] >= F.col("_block") * rows - shift)


Kernel = Callable[..., tuple]


def each_block(made: DataFrame, keys: tuple[str, ...], inputs: list[str], schema: str, kernel: Kernel, rows: int, state: bool = False, shift: int = 0) -> DataFrame:
    """The blocks' own rows, with their number and the columns of ``schema``.

    ``kernel(x, pos, own)`` gets the inputs as arrays of doubles by name, the
    numbers of their rows and the slice of the block's own rows, and returns a
    value for each of those.  With ``state`` it also gets the block's state.
    """
    items = made.schema["_items"].dataType.elementType
    added = T.StructType.fromDDL(schema)
    kept = [f for f in items if f.name not in added.names]
    out = T.StructType([*[made.schema[k] for k in keys], *kept, *added])
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in _items(batch):
                x, pos = _inputs(whole, inputs)
                first = batch.column("_block")[i].as_py() * rows - shift
                own = slice(*np.searchsorted(pos, [first, first + rows]))
                n = own.stop - own.start
                more = (np.array(batch.column("_state")[i].as_py() or [], float),) if state else ()
                new = kernel(x, pos, own, *more)
                alike = [batch.column(k).take(pa.array(np.full(n, i))) for k in keys]
                rest = whole.slice(own.start, n)
                columns = [*alike, *[rest.field(f.name) for f in kept]]
                columns += [pa.array(v, t, from_pandas=True) for v, t in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return made.mapInArrow(run, out)


def _items(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray]]:
    lists = batch.column("_items")
    ends = lists.offsets.to_numpy()
    for i in range(batch.num_rows):
        yield i, lists.values.slice(ends[i], ends[i + 1] - ends[i])


def _inputs(items: pa.StructArray, inputs: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    x = {c: items.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs}
    return x, items.field("_pos").to_numpy()


def windowed(
    df: DataFrame,
    inputs: list[str],
    schema: str,
    kernel: Kernel,
    keys: tuple[str, ...] = ("symbol",),
    order: tuple[str, ...] = ("ts", "seq"),
    back: int = 0,
    ahead: int = 0,
    rows: int = ROWS,
) -> DataFrame:
    """``df`` with the columns of ``schema``, which ``kernel`` makes block by block."""
    made = blocks(df, keys, order, back, ahead, rows)
    return each_block(made, keys, inputs, schema, kernel, rows).select(*df.columns, *T.StructType.fromDDL(schema).names)


class Recursion:
    """What ``scanned`` runs.  ``states(x, pos)`` are the rows' states as if the block
    were alone, an array of rows by numbers of which the last row sums the
    block up; ``after(older, newer, n)`` composes the state before ``n`` rows
    with theirs (of one row each, or ``newer`` and ``n`` of many); ``values`` makes
    the columns from the rows' whole states.  ``width`` is the number of numbers."""

    width: int

    def states(self, x: dict[str, np.ndarray], pos: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def after(self, older: np.ndarray, newer: np.ndarray, n: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def values(self, states: np.ndarray, x: dict[str, np.ndarray]) -> tuple:
        raise NotImplementedError


def scanned(
    df: DataFrame,
    inputs: list[str],
    schema: str,
    recursion: Recursion,
    keys: tuple[str, ...] = ("symbol",),
    order: tuple[str, ...] = ("ts", "seq"),
    rows: int = ROWS,
) -> DataFrame:
    """``df`` with the columns of ``schema``, by a recursion along each key."""
    made = written(blocks(df, keys, order, rows=rows))
    sums = T.StructType([*[made.schema[k] for k in keys], *T.StructType.fromDDL("_block long, _sum array<double>, _n long")])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, count = [], []
            for _, whole in _items(batch):
                last.append(recursion.states(*_inputs(whole, inputs))[-1].tolist())
                count.append(len(whole))
            columns = [*[batch.column(k) for k in keys], batch.column("_block"), pa.array(last, pa.list_(pa.float64())), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, sums.names)

    def step(held: list, newer: list[float], n: int) -> tuple:
        before = held[0]
        newer = np.array([newer])
        held[0] = (newer if before is None else recursion.after(np.array([before]), newer, np.array([n])))[0].tolist()
        return (before,)

    reduced = made.mapInArrow(reduce, sums)
    states = scan(reduced, ["_sum", "_n"], "_state array<double>", lambda: [None], step, keys, ("_block",)).drop("_sum", "_n")
    met = joined(made, states, [*keys, "_block"])

    def kernel(x: dict[str, np.ndarray], pos: np.ndarray, own: slice, before: np.ndarray) -> tuple:
        alone = recursion.states(x, pos)
        if len(before):
            alone = recursion.after(np.broadcast_to(before, alone.shape), alone, np.arange(1, len(pos) + 1))
        return recursion.values(alone, x)

    done = each_block(met, keys, inputs, schema, kernel, rows, state=True)
    return done.select(*df.columns, *T.StructType.fromDDL(schema).names)


class Linear(Recursion):
    """s = M s' + u, for a constant square matrix M: ``inputs(x, pos)`` gives u by
    row, ``columns(s, x)`` the values from the states."""

    def __init__(self, matrix: list[list[float]], inputs: Callable, columns: Callable):
        self.m, self.inputs, self.columns, self.width = np.array(matrix, float), inputs, columns, len(matrix)

    def states(self, x, pos):
        s, power, shift = self.inputs(x, pos), self.m, 1
        while shift < len(s):  # each round composes stretches twice as long
            s[shift:] = s[shift:] + s[:-shift] @ power.T
            power, shift = power @ power, 2 * shift
        return s

    def after(self, older, newer, n):
        power = np.broadcast_to(np.eye(len(self.m)), (len(n), *self.m.shape))
        step, left = self.m, np.array(n)
        while left.any():
            power = np.where((left & 1).astype(bool)[:, None, None], power @ step, power)
            step, left = step @ step, left >> 1
        return newer + np.einsum("nij,nj->ni", power, older)

    def values(self, states, x):
        return self.columns(states, x)


class Adjusted(Recursion):
    """Mean and standard deviation with weights (1 - alpha) ** age, ages counted in
    rows; NaN values weigh nothing.  A stretch is its sum of weights, of their
    squares, its mean, its sum of squared deviations and its number of values;
    two are merged without cancellation.  The mean is NaN under ``least``
    values, the deviation (corrected for bias) under two as well."""

    def __init__(self, column: str, alpha: float, least: int = 1):
        self.column, self.keep, self.least, self.width = column, 1.0 - alpha, least, 5

    def states(self, x, pos):
        v = x[self.column]
        there = ~np.isnan(v)
        s = np.zeros((len(v), 5))
        s[:, 0] = s[:, 1] = s[:, 4] = there
        s[there, 2] = v[there]
        shift = 1
        while shift < len(s):
            s[shift:] = self.after(s[:-shift], s[shift:], np.full(len(s) - shift, shift))
            shift *= 2
        return s

    def after(self, older, newer, n):
        fade = self.keep ** np.asarray(n, float)
        weight, both = older[:, 0] * fade, older[:, 0] * fade + newer[:, 0]
        share = np.divide(newer[:, 0], both, out=np.zeros(len(both)), where=both > 0)
        # Where the older stretch has faded to nothing, or has no value, the newer one's mean is the whole's.
        apart = np.where(weight > 0, newer[:, 2] - older[:, 2], 0.0)
        mean = np.where(newer[:, 0] > 0, np.where(weight > 0, older[:, 2] + apart * share, newer[:, 2]), older[:, 2])
        spread = older[:, 3] * fade + newer[:, 3] + apart * apart * weight * share
        return np.stack([both, older[:, 1] * fade * fade + newer[:, 1], mean, spread, older[:, 4] + newer[:, 4]], axis=1)

    def values(self, states, x):
        w, w2, mean, spread, n = states.T
        ok = n >= max(1, self.least)
        left = w * w - w2
        # One value, or one that outweighs all others, has no deviation.
        enough = ok & (n > 1) & (left > 0)
        var = np.divide(spread * w, left, out=np.full(len(w), np.nan), where=enough)
        return np.where(ok, mean, np.nan), np.sqrt(var)


class Last(Recursion):
    """The last value that is not NaN."""

    width = 1

    def __init__(self, column: str):
        self.column = column

    def states(self, x, pos):
        v = x[self.column]
        at = np.maximum.accumulate(np.where(np.isnan(v), -1, np.arange(len(v))))
        return np.where(at >= 0, v[at], np.nan)[:, None]

    def after(self, older, newer, n):
        return np.where(np.isnan(newer), older, newer)

    def values(self, states, x):
        return (states[:, 0],)


class Highest(Recursion):
    """The largest value so far; NaN before the first."""

    width = 1

    def __init__(self, column: str):
        self.column = column

    def states(self, x, pos):
        return np.fmax.accumulate(x[self.column])[:, None]

    def after(self, older, newer, n):
        return np.fmax(older, newer)

    def values(self, states, x):
        return (states[:, 0],)


class Together(Recursion):
    """Several recursions in one pass; their states lie side by side."""

    def __init__(self, *parts: Recursion):
        self.parts, self.width = parts, sum(p.width for p in parts)

    def _split(self, s: np.ndarray) -> list[np.ndarray]:
        return np.split(s, np.cumsum([p.width for p in self.parts])[:-1], axis=1)

    def states(self, x, pos):
        return np.concatenate([p.states(x, pos) for p in self.parts], axis=1)

    def after(self, older, newer, n):
        both = zip(self.parts, self._split(older), self._split(newer), strict=True)
        return np.concatenate([p.after(a, b, n) for p, a, b in both], axis=1)

    def values(self, states, x):
        return tuple(c for p, s in zip(self.parts, self._split(states), strict=True) for c in p.values(s, x))


def recursion_of(step: Callable, inputs: Callable, size: int, given: int, seed: Callable, seeded: int = 1) -> Linear:
    """The linear recursion that ``step(state, inputs)`` describes, for ``size`` states
    and ``given`` inputs by row; its columns are the states.

    The matrices are the step's results for unit vectors, so the step must be
    linear.  ``seed(inputs, number)`` gives the states of a key's first ``seeded``
    rows as they are, None for those that the step makes.
    """
    zero = np.zeros(max(size, given))
    unit = np.eye(max(size, given))
    matrix = np.array([step(unit[i, :size], zero[:given]) for i in range(size)], float).T
    weigh = np.array([step(zero[:size], unit[i, :given]) for i in range(given)], float)

    def by_row(x, pos):
        u = inputs(x)
        out = u @ weigh
        for i in np.flatnonzero(pos < seeded):
            fixed = seed(u[i], pos[i])
            out[i] = [out[i, k] if v is None else v for k, v in enumerate(fixed)]
        return out

    return Linear(matrix, by_row, lambda s, x: tuple(s.T))


class Switch(Recursion):
    """Direction 1 or -1 by a line that is the upper band while the direction is -1
    and the lower one while it is 1; the first row has direction 1 and the
    upper band.  Values beyond the line of the row before set the direction.

    A row's direction and the bands of the row before tell its line, so a
    stretch is a map from either direction before it to the one after it (the
    first two numbers), and the last row's bands and value of the stretch's
    first row decide how two stretches meet.
    """

    width = 8

    def __init__(self, value: str, upper: str, lower: str):
        self.names = value, upper, lower

    @staticmethod
    def _beyond(value, line, way):
        return np.where(value > line, 1.0, np.where(value < line, -1.0, way))

    def states(self, x, pos):
        value, upper, lower = (x[c] for c in self.names)
        n = len(value)
        first = pos == 0
        # If down before (the first number) and if up: the way after the stretch; the line while down and up;
        # the stretch's first value and whether it begins the series.
        s = np.zeros((n, self.width))
        s[:, 0], s[:, 1] = np.where(first, 1.0, -1.0), 1.0
        s[:, 2], s[:, 3] = upper, np.where(first, upper, lower)
        s[:, 4], s[:, 5] = value, first
        s[:, 6] = s[:, 7] = 0.0
        shift = 1
        while shift < n:
            s[shift:] = self.after(s[:-shift], s[shift:], np.full(n - shift, shift))
            shift *= 2
        return s

    def after(self, older, newer, n):
        out = np.array(newer)
        for k in (0, 1):
            way = older[:, k]
            line = np.where(way < 0, older[:, 2], older[:, 3])
            entered = self._beyond(newer[:, 4], line, way)
            out[:, k] = np.where(entered < 0, newer[:, 0], newer[:, 1])
        out[:, 4], out[:, 5] = older[:, 4], older[:, 5]
        return out

    def values(self, states, x):
        return (states[:, 1].astype(np.int32),)
