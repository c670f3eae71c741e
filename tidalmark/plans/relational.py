"""Feeds, bars, ordering, joins, set operations and quality gates as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import ordered, rnd, sdiv, so_far
from ..operators import bars as bar_ops
from ..operators import quality
from ..operators.asof import asof_join
from ..sources import feeds
from ..sources.feeds import BARS_SQL, CHAIN_SQL, DAILY_SQL, FLOW_SQL, TRADES_SQL
from .registry import query


def W():
    return ordered("symbol")



@query(f"WITH {TRADES_SQL} SELECT symbol, ts, seq, price, size, CAST(aggressor AS INTEGER) AS aggressor FROM trades")
def feed_trades(spark, sf_dir):
    return feeds.trades(spark, sf_dir)


@query(f"WITH {FLOW_SQL} SELECT symbol, ts, seq, event_type, price, size, CAST(aggressor AS INTEGER) AS aggressor, round(inventory_pressure, 9) AS inventory_pressure FROM flow")
def feed_orderflow(spark, sf_dir):
    return feeds.orderflow(spark, sf_dir).withColumn("inventory_pressure", rnd("inventory_pressure", 9))


@query(f"WITH {BARS_SQL} SELECT symbol, ts, seq, open, high, low, close, volume, n, signed FROM bars")
def bars_1h(spark, sf_dir):
    return feeds.bars(spark, sf_dir)


@query(f"WITH {DAILY_SQL} SELECT * FROM daily")
def bars_1d(spark, sf_dir):
    return feeds.daily(spark, sf_dir)


@query(
    f"""WITH {BARS_SQL}, e AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol),
s AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e),
j AS (SELECT s.symbol, s.ts, b.open, b.high, b.low, b.close, b.volume, b.n,
  last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM s LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = s.ts)
SELECT symbol, ts, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, coalesce(close, c) AS close,
  coalesce(volume, 0) AS volume, coalesce(n, 0) AS n FROM j"""
)
def bars_spine(spark, sf_dir):
    return bar_ops.with_spine(feeds.bars(spark, sf_dir))


@query(
    f"""WITH {TRADES_SQL}, b AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, count(*) AS trade_count, sum(size) AS vol, avg(size) AS avg_size,
  sum(size * aggressor) AS signed_vol, sum(CASE WHEN aggressor > 0 THEN size ELSE 0 END) AS buy_vol, sum(CASE WHEN aggressor < 0 THEN size ELSE 0 END) AS sell_vol
  FROM trades GROUP BY 1, 2)
SELECT symbol, ts, trade_count, vol, round(avg_size, 6) AS avg_size, signed_vol, round(coalesce((buy_vol - sell_vol) / nullif(buy_vol + sell_vol, 0), 0), 6) AS imbalance,
  sum(signed_vol) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_delta FROM b"""
)
def trade_flow_4h(spark, sf_dir):
    made = bar_ops.flow_by_bucket(feeds.trades(spark, sf_dir), "4 hours")
    run = so_far(ordered("symbol", by=("ts",)))
    return made.select(
        "symbol", "ts", "trade_count", "vol", rnd("avg_size").alias("avg_size"), "signed_vol",
        rnd(sdiv(F.col("buy_vol") - F.col("sell_vol"), F.col("buy_vol") + F.col("sell_vol"))).alias("imbalance"), F.sum("signed_vol").over(run).alias("cum_delta"),
    )


def _pair(spark, sf_dir):
    """Trades of buyers, and of sellers as the other side."""
    t = feeds.trades(spark, sf_dir)
    left = t.where("aggressor = 1").select("symbol", "ts", "seq", "price")
    right = t.where("aggressor = -1").select("symbol", "ts", "seq", F.col("price").alias("ask"))
    return left, right


PAIR_SQL = (
    TRADES_SQL
    + """, l AS (SELECT symbol, ts, seq, price FROM trades WHERE aggressor = 1),
r AS (SELECT symbol, ts, seq, price AS ask FROM trades WHERE aggressor = -1)"""
)


@query(f"WITH {PAIR_SQL} SELECT l.symbol, l.seq, l.price, r.ask, r.ts AS right_ts FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts >= r.ts")
def asof_backward(spark, sf_dir):
    left, right = _pair(spark, sf_dir)
    return asof_join(left, right, ["ask"]).drop("ts")


@query(f"WITH {PAIR_SQL} SELECT l.symbol, l.seq, l.price, r.ask, r.ts AS right_ts FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts <= r.ts")
def asof_forward(spark, sf_dir):
    left, right = _pair(spark, sf_dir)
    return asof_join(left, right, ["ask"], direction="forward").drop("ts")


@query(
    f"""WITH {PAIR_SQL}, b AS (SELECT l.symbol, l.seq, l.ts, l.price, r.ask, r.ts AS rt FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts >= r.ts),
f AS (SELECT l.seq, r.ask, r.ts AS rt FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts <= r.ts)
SELECT b.symbol, b.seq, b.price, CASE WHEN b.rt IS NOT NULL AND (f.rt IS NULL OR b.ts - b.rt <= f.rt - b.ts) THEN b.ask ELSE f.ask END AS ask,
  CASE WHEN b.rt IS NOT NULL AND (f.rt IS NULL OR b.ts - b.rt <= f.rt - b.ts) THEN b.rt ELSE f.rt END AS right_ts FROM b JOIN f USING (seq)"""
)
def asof_nearest(spark, sf_dir):
    left, right = _pair(spark, sf_dir)
    return asof_join(left, right, ["ask"], direction="nearest").drop("ts")


@query(
    f"""WITH {PAIR_SQL}, c AS (SELECT symbol, ts, seq, sum(ask) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM r),
j AS (SELECT l.symbol, l.ts, l.seq, coalesce(c.c, 0) AS c FROM l ASOF LEFT JOIN c ON l.symbol = c.symbol AND l.ts >= c.ts)
SELECT symbol, seq, round(c - lag(c, 1, 0) OVER (PARTITION BY symbol ORDER BY ts, seq), 4) AS delta FROM j"""
)
def asof_cumulative_delta(spark, sf_dir):
    left, right = _pair(spark, sf_dir)
    counted = right.withColumn("c", F.sum("ask").over(so_far(W())))
    j = asof_join(left, counted, ["c"]).withColumn("c", F.coalesce("c", F.lit(0.0)))
    return j.select("symbol", "seq", rnd(F.col("c") - F.lag("c", 1, 0.0).over(W()), 4).alias("delta"))


@query(
    f"""WITH {PAIR_SQL} SELECT l.symbol, l.seq, CASE WHEN r.ts >= l.ts - INTERVAL 30 MINUTE THEN r.ask END AS ask,
  CASE WHEN r.ts >= l.ts - INTERVAL 30 MINUTE THEN r.ts END AS right_ts, l.price FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts >= r.ts"""
)
def asof_tolerance(spark, sf_dir):
    left, right = _pair(spark, sf_dir)
    return asof_join(left, right, ["ask"], tolerance="30 minutes").drop("ts")


@query(f"WITH {TRADES_SQL}, {FLOW_SQL} SELECT t.symbol, t.seq, t.price, f.event_type FROM trades t JOIN flow f ON t.ts = f.ts AND t.seq = f.seq")
def equi_one_to_one(spark, sf_dir):
    t = feeds.trades(spark, sf_dir).select("symbol", "ts", "seq", "price")
    f = feeds.orderflow(spark, sf_dir).select("ts", "seq", "event_type")
    return quality.one_to_one(t, f, ["ts", "seq"]).select("symbol", "seq", "price", "event_type")


@query(
    """SELECT a.event_id AS seq, a.value AS a, b.value * 2 AS b, c.value * 3 AS c, d.event_type AS d FROM events a JOIN events b USING (event_id)
JOIN events c USING (event_id) JOIN events d USING (event_id)"""
)
def four_way_seq_join(spark, sf_dir):
    e = feeds.table(spark, sf_dir, "events")
    parts = [
        e.select(F.col("event_id").alias("seq"), F.col("value").alias("a")),
        e.select(F.col("event_id").alias("seq"), (F.col("value") * 2).alias("b")),
        e.select(F.col("event_id").alias("seq"), (F.col("value") * 3).alias("c")),
        e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("d")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "seq")
    return out


@query(
    f"""WITH {TRADES_SQL}, {FLOW_SQL}, g AS (SELECT symbol, date_trunc('hour', ts) AS h, avg(inventory_pressure) AS p FROM flow WHERE event_type = 'add' GROUP BY 1, 2)
SELECT t.symbol, t.seq, round(coalesce(g.p, 0), 6) AS pressure FROM trades t LEFT JOIN g ON g.symbol = t.symbol AND g.h = date_trunc('hour', t.ts)"""
)
def left_agg_join(spark, sf_dir):
    g = feeds.orderflow(spark, sf_dir).where("event_type = 'add'").groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("inventory_pressure").alias("p"))
    t = feeds.trades(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts"))
    return t.join(g, ["symbol", "h"], "left").select("symbol", "seq", rnd(F.coalesce("p", F.lit(0.0))).alias("pressure"))


@query(
    f"""WITH {TRADES_SQL}, e AS (SELECT symbol, ts, seq, price FROM trades WHERE seq % 50 = 0)
SELECT e.seq AS entry, count(t.seq) AS n, round(max(t.price), 6) AS best, round(arg_max(t.price, t.seq), 6) AS last FROM e
LEFT JOIN trades t ON t.symbol = e.symbol AND t.ts > e.ts AND t.ts <= e.ts + INTERVAL 3 HOUR GROUP BY e.seq"""
)
def range_join_hold(spark, sf_dir):
    """Trades in (entry, entry + 3 hours]: an equi join on time buckets of the
    hold's width, then the exact bounds."""
    t = feeds.trades(spark, sf_dir).select("symbol", "ts", "seq", "price")
    width = 3 * 3600
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (width * 1_000_000))
    e = t.where("seq % 50 = 0").select("symbol", F.col("ts").alias("t0"), F.col("seq").alias("entry"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    inside = (F.col("ts") > F.col("t0")) & (F.col("ts") <= F.col("t0") + F.expr("interval 3 hours"))
    return e.join(t.withColumn("slot", slot), ["symbol", "slot"], "left").groupBy("entry").agg(
        F.count(F.when(inside, 1)).alias("n"), rnd(F.max(F.when(inside, F.col("price")))).alias("best"),
        rnd(F.max_by(F.when(inside, F.col("price")), F.when(inside, F.col("seq")))).alias("last"),
    )


@query(
    f"""WITH {TRADES_SQL} SELECT symbol, seq, price FROM trades t WHERE EXISTS (SELECT 1 FROM trades e WHERE e.symbol = t.symbol AND e.aggressor = 1 AND date_trunc('hour', e.ts) = date_trunc('hour', t.ts) AND e.price > 150)"""
)
def semi_entries(spark, sf_dir):
    t = feeds.trades(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts"))
    return t.join(t.where("aggressor = 1 AND price > 150"), ["symbol", "h"], "left_semi").select("symbol", "seq", "price")


@query(
    f"""WITH {TRADES_SQL} SELECT symbol, seq, price FROM trades t WHERE NOT EXISTS (SELECT 1 FROM trades e WHERE e.symbol = t.symbol AND e.aggressor = 1 AND date_trunc('hour', e.ts) = date_trunc('hour', t.ts))"""
)
def anti_entries(spark, sf_dir):
    t = feeds.trades(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts"))
    return t.join(t.where("aggressor = 1"), ["symbol", "h"], "left_anti").select("symbol", "seq", "price")


@query(
    f"""WITH {BARS_SQL}, r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars)
SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.r, b.r), 4) AS c FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol
WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2"""
)
def pair_self_join(spark, sf_dir):
    """Every pair of symbols, joined on the hour: never a product of rows."""
    r = feeds.bars(spark, sf_dir).select("symbol", "ts", (F.col("close") / F.lag("close").over(W()) - 1).alias("r")).where("r IS NOT NULL")
    a, b = r.toDF("a", "ts", "ra"), r.toDF("b", "ts", "rb")
    return a.join(b, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), rnd(F.corr("ra", "rb"), 4).alias("c"))


@query(
    f"""WITH {TRADES_SQL}, {FLOW_SQL}, u AS (SELECT symbol, ts, seq, 'trade' AS kind, price FROM trades UNION ALL SELECT symbol, ts, seq, event_type, price FROM flow)
SELECT symbol, kind, count(*) AS n, round(sum(price), 2) AS total FROM u GROUP BY 1, 2"""
)
def union_timeline(spark, sf_dir):
    t = feeds.trades(spark, sf_dir).select("symbol", "ts", "seq", F.lit("trade").alias("kind"), "price")
    f = feeds.orderflow(spark, sf_dir).select("symbol", "ts", "seq", F.col("event_type").alias("kind"), "price")
    return t.unionByName(f).groupBy("symbol", "kind").agg(F.count("*").alias("n"), rnd(F.sum("price"), 2).alias("total"))


@query("SELECT CAST(o_orderdate AS DATE) AS d FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def intersect_dates(spark, sf_dir):
    o = feeds.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    return o.intersect(feeds.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")))


@query("SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders")
def except_dates(spark, sf_dir):
    s = feeds.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return s.subtract(feeds.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")))


@query("SELECT max(d) AS d FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def common_partition(spark, sf_dir):
    """The latest date that both feeds have."""
    return intersect_dates(spark, sf_dir).agg(F.max("d").alias("d"))


@query(
    """SELECT l_partkey, l_quantity, l_discount, count(*) AS copies FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1"""
)
def dup_report(spark, sf_dir):
    return quality.duplicates(feeds.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_quantity", "l_discount"])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def drop_duplicates(spark, sf_dir):
    return feeds.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query(
    """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_value,
 CAST(sum(CASE WHEN value < 0 OR value > 400 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range, CAST(count(*) - count(DISTINCT ts) AS BIGINT) AS repeated_ts,
 CAST(sum(CASE WHEN ts < p THEN 1 ELSE 0 END) AS BIGINT) AS backward, CAST(sum(CASE WHEN event_type NOT IN ('view','click','error','purchase') THEN 1 ELSE 0 END) AS BIGINT) AS bad_domain
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)"""
)
def quality_report(spark, sf_dir):
    """One pass of violation counts: nulls, range, uniqueness, order, domain."""
    e = feeds.table(spark, sf_dir, "events")
    return quality.report(
        e, nulls=["value"], ranges={"value": (0, 400)}, unique="ts", order=("user_id", "event_id", "ts"), domains={"event_type": ["view", "click", "error", "purchase"]}
    )


@query(
    """SELECT 'event_id' AS c, 0.0 AS ratio UNION ALL SELECT 'value', round(avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM events"""
)
def null_ratios(spark, sf_dir):
    e = feeds.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return quality.null_ratios(e)


@query(
    """SELECT event_id, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS amount, CAST(floor(value) AS BIGINT) AS whole, upper(event_type) AS kind,
 sha256(event_type) AS hash, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""
)
def strict_cast(spark, sf_dir):
    e = feeds.table(spark, sf_dir, "events")
    out = quality.cast_strict(e.select("event_id", F.col("value").alias("amount"), F.floor("value").alias("whole"), "event_type", "props"), {"amount": "decimal(12,2)", "whole": "bigint"})
    return out.select("event_id", F.col("amount").cast("double").alias("amount"), "whole", F.upper("event_type").alias("kind"), F.sha2("event_type", 256).alias("hash"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    f"""WITH {CHAIN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tte, ask_iv - bid_iv, abs(strike - 1300), seq) AS k FROM chain)
SELECT symbol, strike, tte, seq FROM r WHERE k <= 3"""
)
def topk_spread(spark, sf_dir):
    """Best three quotes a symbol by expiry, spread and distance."""
    w = Window.partitionBy("symbol").orderBy("tte", F.col("ask_iv") - F.col("bid_iv"), F.abs(F.col("strike") - 1300), "seq")
    return feeds.chain(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 3").select("symbol", "strike", "tte", "seq")


@query(
    f"""WITH {CHAIN_SQL} SELECT symbol, ts, arg_min(oi, {{'d': abs(strike - spot), 't': tte, 'k': strike, 's': seq}}) FILTER (kind = 'call') AS call_oi,
 arg_max(strike, {{'k': strike, 's': seq}}) FILTER (strike <= spot) AS lower_strike, arg_min(strike, {{'k': strike, 's': seq}}) FILTER (strike >= spot) AS upper_strike FROM chain GROUP BY 1, 2"""
)
def nearest_strike(spark, sf_dir):
    c = feeds.chain(spark, sf_dir)
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), "tte", "strike", "seq")
    call = F.col("kind") == "call"
    return c.groupBy("symbol", "ts").agg(
        F.min_by(F.when(call, F.col("oi")), F.when(call, near)).alias("call_oi"),
        F.max(F.when(F.col("strike") <= F.col("spot"), F.col("strike"))).alias("lower_strike"),
        F.min(F.when(F.col("strike") >= F.col("spot"), F.col("strike"))).alias("upper_strike"),
    )
