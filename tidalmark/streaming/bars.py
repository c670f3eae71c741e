"""Structured Streaming twins of the bar and scan operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.feeds import side_of

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_trades(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Trades from event files as they arrive: the same columns as the batch feed."""
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("value") + 100.0).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1.0).alias("size"),
        side_of().alias("aggressor"),
    )


def bars(trades: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars by symbol and event-time window; rows later than ``late`` are left out."""
    return (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width))
        .agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
            F.sum("size").alias("volume"), F.count("*").alias("n"),
        )
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "n")
    )


def sessions(trades: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Trades by symbol until ``gap`` without one."""
    return (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
        .select("symbol", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n", "volume")
    )


def running_ewm(trades: DataFrame, span: float = 12.0) -> DataFrame:
    """Each symbol's exponential mean after every micro-batch; the state is the
    mean and the count, whatever the length of the stream."""
    alpha = 2.0 / (span + 1.0)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for x in rows["price"]:
            mean = x if mean is None else mean + alpha * (x - mean)
        n += len(rows)
        state.update((mean, n))
        yield pd.DataFrame({"symbol": [key[0]], "ewm": [mean], "n": [n]})

    return trades.groupBy("symbol").applyInPandasWithState(step, "symbol string, ewm double, n long", "mean double, n long", "update", GroupStateTimeout.NoTimeout)
