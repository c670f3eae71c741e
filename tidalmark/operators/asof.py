"""As-of joins as one union and one window: no range join, one shuffle by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: list[str],
    keys: tuple[str, ...] = ("symbol",),
    ts: str = "ts",
    left_seq: str = "seq",
    right_seq: str = "seq",
    direction: str = "backward",
    tolerance: str | None = None,
    exact: bool = True,
) -> DataFrame:
    """``left`` with the right row's ``values`` that is latest at or before it
    (backward), earliest at or after it (forward), or nearest (ties backward).

    Of right rows with equal time the last by ``right_seq`` counts (forward: the
    first).  ``tolerance`` is an interval text; ``exact=False`` leaves out equal
    times.  ``right_ts`` is the time of the row found.
    """
    if direction == "nearest":
        back = asof_join(left, right, values, keys, ts, left_seq, right_seq, "backward", tolerance, exact)
        back = back.withColumnsRenamed({c: f"_b_{c}" for c in [*values, "right_ts"]})
        both = asof_join(back, right, values, keys, ts, left_seq, right_seq, "forward", tolerance, exact)
        gap = lambda a, b: F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))
        first = F.col("_b_right_ts").isNotNull() & (F.col("right_ts").isNull() | (gap(ts, "_b_right_ts") <= gap("right_ts", ts)))
        return both.select(*left.columns, *[F.when(first, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in [*values, "right_ts"]])
    backward = direction == "backward"
    # Forward is backward in reversed order: a frame that only grows is read once.
    # At equal times the right row comes first where it may match, else after.
    place = 0 if exact else 2
    row = F.struct(*[F.col(c) for c in left.columns])
    tagged = left.select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_k"), F.col(left_seq).alias("_s"), row.alias("_row"), F.lit(None).alias("_found"))
    found = F.struct(*[F.col(c) for c in values], F.col(ts).alias("right_ts"))
    other = right.select(*keys, F.col(ts).alias("_t"), F.lit(place).alias("_k"), F.col(right_seq).alias("_s"), F.lit(None).alias("_row"), found.alias("_found"))
    cols = [F.asc(c) if backward or c == "_k" else F.desc(c) for c in ("_t", "_k", "_s")]
    frame = Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        tagged.unionByName(other)
        .withColumn("_found", F.last("_found", ignorenulls=True).over(frame))
        .where(F.col("_row").isNotNull())
        .select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in [*values, "right_ts"]])
    )
    if tolerance:
        near = (
            F.col("right_ts") >= F.col(ts) - F.expr(f"interval {tolerance}")
            if backward
            else F.col("right_ts") <= F.col(ts) + F.expr(f"interval {tolerance}")
        )
        out = out.select(*left.columns, *[F.when(near, F.col(c)).alias(c) for c in [*values, "right_ts"]])
    return out
