"""File sources: dated partitions and exchange bar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import QualityError

KLINES = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long"


def latest_partition(df: DataFrame, column: str = "date", wanted: str | None = None) -> DataFrame:
    """Rows of the wanted partition, or of the latest that has any."""
    if wanted is None:
        row = df.agg(F.max(column)).first()
        wanted = row[0] if row else None
    out = df.where(F.col(column) == F.lit(wanted))
    if wanted is None or out.isEmpty():
        raise QualityError(f"no rows for {column}={wanted}")
    return out


def common_partition(*feeds: DataFrame, column: str = "date"):
    """The latest value of ``column`` that every feed has, or None."""
    dates = feeds[0].select(column).distinct()
    for other in feeds[1:]:
        dates = dates.intersect(other.select(column))
    return dates.agg(F.max(column)).first()[0]


def read_klines(spark: SparkSession, path: str, symbol: str, interval: str, start: str, end: str) -> DataFrame:
    """Bars from CSV files in [start, end), typed while read; no inference."""
    raw = spark.read.schema(KLINES).option("header", True).csv(path)
    ts = F.timestamp_millis("open_time").cast("timestamp_ntz")
    return (
        raw.withColumn("ts", ts)
        .where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        .select("ts", F.lit(symbol).alias("symbol"), F.lit(interval).alias("interval"), "open", "high", "low", "close", "volume", F.coalesce("trades", F.lit(0)).alias("trades"))
    )


def decode_klines(df: DataFrame, column: str = "payload") -> DataFrame:
    """Rows of JSON arrays (twelve slots) as typed bar columns."""
    slots = F.from_json(column, "array<string>")
    names = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades"]
    kinds = ["bigint", "double", "double", "double", "double", "double", "bigint", "double", "bigint"]
    rows = df.select(slots.alias("s"))
    return rows.select(*[F.try_element_at("s", F.lit(i + 1)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def instruments(df: DataFrame, prefix: str) -> DataFrame:
    """Option instruments from JSON rows with alternative names; rows that do
    not parse are left out."""
    schema = "symbol string, instrument_name string, strike string, strikePrice string, expiry string, expiryDate string, side string, option_type string"
    r = df.select(F.from_json("payload", schema).alias("r")).select("r.*")
    out = r.select(
        F.coalesce("symbol", "instrument_name").alias("instrument"),
        F.coalesce("strike", "strikePrice").try_cast("double").alias("strike"),
        F.coalesce("expiry", "expiryDate").try_cast("bigint").alias("expiry_ms"),
        F.lower(F.substring(F.coalesce("side", "option_type"), 1, 1)).alias("kind"),
    )
    return out.where(F.col("instrument").startswith(prefix) & F.col("strike").isNotNull() & F.col("expiry_ms").isNotNull())
