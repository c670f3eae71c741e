"""Queries over recorded pages, which are written from the feeds beforehand."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators.blocks import shared
from ..sources import feeds, matched, pages
from ..sources.feeds import BARS_SQL, CHAIN_SQL, TRADES_SQL
from .registry import query

#: Milliseconds of the range that is read: two weeks of January 2024, and of options 1995.
START, END = 1_704_672_000_000, 1_705_881_600_000
OPTIONS = 788_918_400_000, 820_454_400_000


def folder(spark) -> str:
    """A new folder for pages, where all executors can write."""
    return f"{shared(spark)}/pages/{uuid.uuid4().hex}"


def millis(column: str = "ts"):
    return F.unix_millis(F.col(column).cast("timestamp"))


def cell(value):
    return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))


@query(
    f"""WITH {BARS_SQL} SELECT symbol, epoch_ms(ts) AS open_time, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, n AS trades
FROM bars WHERE epoch_ms(ts) >= {START} AND epoch_ms(ts) < {END}"""
)
def paged_klines(spark, sf_dir):
    """Bars recorded in pages of 24 with three rows of the next, read for two weeks."""
    path = folder(spark)
    b = feeds.bars(spark, sf_dir).withColumn("open_time", millis())
    zero = F.lit("0")
    cells = [F.col("open_time").cast("string"), *[cell(F.col(c)) for c in ("open", "high", "low", "close", "volume")], (F.col("open_time") + 3_599_999).cast("string"), cell(zero), F.col("n").cast("string"), cell(zero), cell(zero), cell(zero)]
    pages.record(b, path, F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")), "1h", 24, 3)
    r = pages.klines(spark, path, "1h", START, END)
    return r.select("symbol", "open_time", *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume")], "trades")


QUOTES_SQL = CHAIN_SQL + """, candles AS (SELECT symbol AS instrument, epoch_ms(ts) AS open_time, arg_min(premium, (seq, strike, premium)) AS open, max(premium) AS high, min(premium) AS low,
  arg_max(premium, (seq, strike, premium)) AS close, sum(volume) AS volume FROM chain GROUP BY 1, 2)"""


@query(
    f"""WITH {QUOTES_SQL} SELECT instrument, open_time, round(open + 1e-9, 4) AS open, round(high + 1e-9, 4) AS high, round(low + 1e-9, 4) AS low, round(close + 1e-9, 4) AS close,
  CASE WHEN (open_time // 86400000) % 3 = 0 THEN 0.0 ELSE round(volume, 2) END AS volume FROM candles WHERE open_time >= {OPTIONS[0]} AND open_time < {OPTIONS[1]}"""
)
def paged_option_candles(spark, sf_dir):
    """Monthly candles of option premiums; fields go by long or short names by row, a third lack the volume."""
    path = folder(spark)
    at = F.struct("seq", "strike", "premium")
    c = feeds.chain(spark, sf_dir).groupBy("symbol", millis().alias("open_time")).agg(
        F.min_by("premium", at).alias("o"), F.max("premium").alias("h"), F.min("premium").alias("l"), F.max_by("premium", at).alias("c"), F.sum("volume").alias("v")
    )
    day = F.expr("open_time div 86400000")
    v = F.when(day % 3 != 0, F.col("v"))
    long = F.to_json(F.struct(F.col("open_time").alias("timestamp"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), v.alias("volume")))
    short = F.to_json(F.struct(F.col("open_time").alias("t"), "o", "h", "l", "c", v.alias("v")))
    pages.record(c, path, F.when(day % 2 == 0, long).otherwise(short), "1M", 12, 1, F.lit('{"result":[],"candles":{items}}'))
    r = pages.option_candles(spark, path, "1M", *OPTIONS)
    return r.select("instrument", "open_time", *[rnd(F.col(x) + 1e-9, 4).alias(x) for x in ("open", "high", "low", "close")], rnd("volume", 2).alias("volume"))


@query(
    f"""WITH {TRADES_SQL} SELECT symbol AS instrument, epoch_us(ts) // 1000 AS open_time, round(price, 4) AS price, round(size, 4) AS size, CASE aggressor WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE '' END AS side,
  CAST(seq AS VARCHAR) AS trade_id FROM trades WHERE epoch_us(ts) // 1000 >= {START} AND epoch_us(ts) // 1000 < {END}"""
)
def paged_trades(spark, sf_dir):
    """Trades recorded in pages of 100 with ten of the next."""
    path = folder(spark)
    side = F.when(F.col("aggressor") == 1, "buy").when(F.col("aggressor") == -1, "sell").otherwise("")
    t = feeds.trades(spark, sf_dir).withColumn("open_time", millis())
    item = F.to_json(F.struct(F.col("open_time").alias("time"), F.col("price").alias("p"), F.col("size").alias("qty"), side.alias("side"), F.col("seq").cast("string").alias("id")))
    pages.record(t, path, item, "trades", 100, 10, F.lit('{"data":{items}}'))
    r = pages.option_trades(spark, path, START, END)
    return r.select("instrument", "open_time", rnd("price", 4).alias("price"), rnd("size", 4).alias("size"), "side", "trade_id")


@query(
    f"""WITH {TRADES_SQL}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS trades, round(sum(price), 3) AS prices, round(sum(size * aggressor), 3) AS flow FROM trades GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS date, trades, prices, flow FROM d ORDER BY day DESC LIMIT 1 OFFSET 1"""
)
def matched_day(spark, sf_dir):
    """Two feeds by day; the last day of one is missing, so the one before is the newest that both have."""
    path = folder(spark)
    t = feeds.trades(spark, sf_dir).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    # A day's trades in order of time, as a feed numbers them.
    numbered = t.withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")))
    last = t.agg(F.max("date")).first()[0]
    numbered.select("ts", "seq", "price", "date").write.partitionBy("date").parquet(f"{path}/prices")
    numbered.where(F.col("date") < F.lit(last)).select("ts", "seq", (F.col("size") * F.col("aggressor")).alias("flow"), "date").write.partitionBy("date").parquet(f"{path}/flows")
    date, found = matched.common(spark, {"prices": matched.Feed(f"{path}/prices", ("price",)), "flows": matched.Feed(f"{path}/flows", ("flow",))})
    flow = found["flows"].agg(rnd(F.sum("flow"), 3).alias("flow")).scalar()
    return found["prices"].agg(F.lit(date).alias("date"), F.count("*").alias("trades"), rnd(F.sum("price"), 3).alias("prices")).select("*", flow.alias("flow"))


@query(
    f"""WITH {TRADES_SQL} SELECT symbol, seq, coalesce(CASE WHEN seq % 7 <> 0 THEN price END, 0) AS price, size, aggressor FROM trades"""
)
def cleaned_trades(spark, sf_dir):
    """Trades with holes, of which every fifth row comes twice."""
    t = feeds.holed(spark, sf_dir).withColumns({"number": F.col("seq").cast("string"), "seq": F.unix_micros(F.col("ts").cast("timestamp")).cast("string")})
    made = matched.cleaned(t.unionByName(t.where("cast(number as long) % 5 = 0")), "trades")
    return made.select("symbol", F.col("number").cast("long").alias("seq"), "price", "size", "aggressor")
