"""Windows over a regular grid of time buckets, of which most may be empty.

A bucket without events counts as zero.  Only the buckets within reach of a
filled one are made, so the work grows with the events and not with the time
that they span.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import ROWS, joined, windowed


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def bucket(width: int, ts: str = "ts") -> Column:
    """The number of the bucket of ``width`` seconds, from the epoch."""
    return F.expr(f"CAST(floor(unix_micros(CAST({ts} AS TIMESTAMP)) / {width * 1000000}D) AS BIGINT)")


def near_grid(filled: DataFrame, reach: int, key: str = "symbol", at: str = "g", rows: int = ROWS) -> DataFrame:
    """``key, at, v`` of the filled buckets and, with v = 0, of the empty ones less than
    ``reach`` behind one and before the key's last; ``first`` is the key's first."""

    def following(x, pos, own):
        g = x[at]
        return (np.append(g[1:], g[-1] + 1)[own],)

    ends = windowed(filled.select(key, at, "v"), [at], "_next double", following, (key,), (at,), ahead=1, rows=rows)
    last = F.least(F.col("_next").cast("long") - 1, F.col(at) + (reach - 1))
    made = ends.select(key, F.explode(F.sequence(F.col(at), last)).alias("_g"), at, "v")
    made = made.select(key, F.col("_g").alias(at), F.when(F.col("_g") == F.col(at), F.col("v")).otherwise(0.0).alias("v"))
    return joined(made, filled.groupBy(key).agg(F.min(at).alias("first")), [key])


def grid_zscore(filled: DataFrame, n: int = 60, key: str = "symbol", at: str = "g", rows: int = ROWS) -> DataFrame:
    """``near_grid`` with ``z``: v against mean and deviation of the last ``n`` buckets of
    the grid, its own among them; null where they do not differ.  Buckets that
    are left out have no filled one in their window, and no z."""

    def zscore(x, pos, own):
        g, v, first = x[at], x["v"], x["first"]
        start = np.searchsorted(g, g - (n - 1))
        total, square = (np.concatenate([[0.0], np.cumsum(a)]) for a in (v, v * v))
        count = np.minimum(n, g - first + 1)
        end = np.arange(1, len(g) + 1)
        s, q = total[end] - total[start], square[end] - square[start]
        var = np.where(count > 1, (q - s * s / count) / np.maximum(count - 1, 1), 0.0)
        # Sums of a block differ by rounding only where the values do not.
        some = var > 1e-9 * np.maximum(1.0, q)
        return (np.where(some, (v - s / count) / np.sqrt(np.where(some, var, 1.0)), np.nan)[own],)

    grid = near_grid(filled, n, key, at, rows)
    return windowed(grid, [at, "v", "first"], "z double", zscore, (key,), (at,), back=n, rows=max(rows, n))


def time_mean(df: DataFrame, column: str, span: int, out: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """``df`` with the mean of ``column`` over the last ``span`` seconds, the row's own
    time among them.  Stretches of 64 spans lie on tasks of their own, with
    copies of the rows that the next stretch looks back on."""
    t, long = seconds(ts), 64 * span
    at = F.floor(F.col("_t") / long).cast("long")
    copies = F.array_compact(F.array(at, F.when(F.pmod("_t", F.lit(float(long))) >= long - span, at + 1)))
    dealt = df.withColumn("_t", t).withColumn("_part", F.explode(copies))
    frame = Window.partitionBy(key, "_part").orderBy(F.col("_us")).rangeBetween(-(span * 1000000 - 1), 0)
    made = dealt.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(out, F.avg(column).over(frame))
    return made.where(F.col("_part") == at).select(*df.columns, out)
