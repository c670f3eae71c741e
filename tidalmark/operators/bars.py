"""Time-bucket aggregation of trades, and spines that fill empty buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ordered


def ohlcv(trades: DataFrame, width: str = "1 hour", key: str = "symbol") -> DataFrame:
    """Bars by key and bucket.  The sums are combined before the shuffle."""
    bucket = F.window("ts", width)["start"].cast("timestamp_ntz")
    made = trades.groupBy(key, bucket.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("n"),
        F.sum(F.col("size") * F.col("aggressor")).alias("signed"),
    )
    return made.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("ts")).cast("long"))


def flow_by_bucket(trades: DataFrame, width: str, key: str = "symbol") -> DataFrame:
    """Count, size, mean size, signed, bought and sold size by bucket."""
    buy, sell = F.col("aggressor") > 0, F.col("aggressor") < 0
    bucket = F.window("ts", width)["start"].cast("timestamp_ntz")
    return trades.groupBy(key, bucket.alias("ts")).agg(
        F.count("*").alias("trade_count"),
        F.sum("size").alias("vol"),
        F.avg("size").alias("avg_size"),
        F.sum(F.col("size") * F.col("aggressor")).alias("signed_vol"),
        F.sum(F.when(buy, F.col("size")).otherwise(0.0)).alias("buy_vol"),
        F.sum(F.when(sell, F.col("size")).otherwise(0.0)).alias("sell_vol"),
    )


def with_spine(bars: DataFrame, step: str = "1 hour", key: str = "symbol") -> DataFrame:
    """``bars`` with a row for every bucket between the key's first and last:
    volume and n are 0, and prices the last close, where no trade was."""
    spine = bars.groupBy(key).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        key, F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("ts")
    )
    out = spine.join(bars.drop("seq"), [key, "ts"], "left")
    close = F.last("close", ignorenulls=True).over(ordered(key, by=("ts",)).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_c", close).select(
        key,
        "ts",
        *[F.coalesce(c, "_c").alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
