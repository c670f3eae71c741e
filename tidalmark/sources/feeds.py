"""Market feeds made from the driver's tables.

trades and orderflow come from ``events``, hourly bars from trades, daily bars
from ``orders``, the order book and nested ticks from ``lineitem`` by order, the
option chain from ``lineitem`` and ``part``.  The SQL texts are the same feeds
for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_of(kind: str = "event_type"):
    return (
        F.when(F.col(kind).isin("purchase", "signup"), 1).when(F.col(kind).isin("click", "error"), -1).otherwise(0)
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, price, size, aggressor."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("value") + 100.0).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1.0).alias("size"),
        side_of().alias("aggressor"),
    )


def orderflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, event_type (add, cancel, trade), price, size, aggressor, inventory_pressure."""
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "add").when(F.col("event_type") == "error", "cancel").otherwise("trade")
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        kind.alias("event_type"),
        (F.col("value") + 100.0).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1.0).alias("size"),
        side_of().alias("aggressor"),
        ((F.col("value") - 25.0) / 25.0).alias("inventory_pressure"),
    )


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades whose price is null where seq is divisible by 7."""
    return trades(spark, sf_dir).withColumn("price", F.when(F.col("seq") % 7 != 0, F.col("price")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by symbol: symbol, ts, seq (from 1), open, high, low, close, volume, n, signed."""
    from ..operators.bars import ohlcv

    return ohlcv(trades(spark, sf_dir), "1 hour")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices: ts, open, high, low, close, volume, quantity."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


def book(spark: SparkSession, sf_dir: str, laid: bool = False) -> DataFrame:
    """One row an order: seq, and by level bid_price_i, bid_size_i, ask_price_i, ask_size_i (0 where absent);
    range-partitioned by seq if ``laid``."""
    li = table(spark, sf_dir, "lineitem")
    if laid:
        li = li.repartitionByRange("l_orderkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    aggs = []
    for k in range(LEVELS):
        at = F.col("l_linenumber") == k + 1
        for side, status, sign in (("bid", "O", -1), ("ask", "F", 1)):
            here = at & (F.col("l_linestatus") == status)
            aggs.append(F.coalesce(F.sum(F.when(here, F.col("l_quantity"))), F.lit(0.0)).alias(f"{side}_size_{k}"))
            aggs.append((F.avg(F.when(at, price)) + sign * (k + 1) * 0.5).alias(f"{side}_price_{k}"))
    return li.groupBy(F.col("l_orderkey").alias("seq")).agg(*aggs)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order with arrays price, size, side of its lines in order."""
    li = table(spark, sf_dir, "lineitem")
    item = F.struct(
        "l_linenumber",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("side"),
    )
    rows = li.groupBy(F.col("l_orderkey").alias("seq")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.select("seq", *[F.col("items")[c].alias(c) for c in ("price", "size", "side")])


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option quotes: symbol, ts (month), strike, tte, kind, oi, volume, iv, bid_iv, ask_iv, spot, seq, premium."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    spot = li.agg(F.avg(price)).scalar()
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.col("p_retailprice").alias("strike"),
        F.col("p_size").cast("double").alias("tte"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("kind"),
        F.col("l_quantity").alias("oi"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_discount") + 0.2).alias("iv"),
        (F.col("l_discount") + 0.2 - F.col("l_tax") / 10.0).alias("bid_iv"),
        (F.col("l_discount") + 0.2 + F.col("l_tax") / 10.0).alias("ask_iv"),
        F.round(spot, 4).alias("spot"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        price.alias("premium"),
    )


SIDE_SQL = "CASE WHEN event_type IN ('purchase','signup') THEN 1 WHEN event_type IN ('click','error') THEN -1 ELSE 0 END"
TRADES_SQL = f"""trades AS (SELECT 'S' || (user_id % 10) AS symbol, ts, event_id AS seq, value + 100.0 AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1.0 AS size, {SIDE_SQL} AS aggressor FROM events)"""
FLOW_SQL = f"""flow AS (SELECT 'S' || (user_id % 10) AS symbol, ts, event_id AS seq,
  CASE WHEN event_type IN ('view','click') THEN 'add' WHEN event_type = 'error' THEN 'cancel' ELSE 'trade' END AS event_type,
  value + 100.0 AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1.0 AS size, {SIDE_SQL} AS aggressor,
  (value - 25.0) / 25.0 AS inventory_pressure FROM events)"""
BARS_SQL = TRADES_SQL + """,
bars0 AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(size) AS volume, count(*) AS n, sum(size * aggressor) AS signed FROM trades GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS seq FROM bars0)"""
DAILY_SQL = """daily AS (SELECT date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1)"""
CHAIN_SQL = """chain AS (SELECT p_brand AS symbol, date_trunc('month', l_shipdate) AS ts, p_retailprice AS strike, CAST(p_size AS DOUBLE) AS tte,
  CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS kind, l_quantity AS oi, l_quantity AS volume, l_discount + 0.2 AS iv,
  l_discount + 0.2 - l_tax / 10.0 AS bid_iv, l_discount + 0.2 + l_tax / 10.0 AS ask_iv,
  (SELECT round(avg(l_extendedprice / l_quantity), 4) FROM lineitem) AS spot, l_orderkey * 10 + l_linenumber AS seq,
  l_extendedprice / l_quantity AS premium FROM lineitem JOIN part ON l_partkey = p_partkey)"""
