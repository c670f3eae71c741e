"""Feature families over trades, book, nested ticks, option chain and bars."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, corr, ffill, gated, last_n, norm_cdf, norm_cdf_sql, norm_pdf, norm_pdf_sql, ordered, rnd, sdiv, so_far
from ..operators.blocks import previous, written
from ..sources import feeds
from ..sources.feeds import BARS_SQL, CHAIN_SQL, LEVELS, TRADES_SQL
from .registry import query
from .scans import TR_SQL, true_range


def W():
    return ordered("symbol")


QUOTES_SQL = (
    TRADES_SQL
    + """, q AS (SELECT symbol, ts, seq, price AS last, price - 0.5 - size / 1000 AS bid, price + 0.5 + size / 500 AS ask, size AS bid_size, size * 2 + 1 AS ask_size,
  size AS volume, aggressor FROM trades),
p AS (SELECT *, (bid + ask) / 2 AS mid, lag(last) OVER w AS l1, lag(bid) OVER w AS b1, lag(ask) OVER w AS a1, lag((bid + ask) / 2) OVER w AS m1
  FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))"""
)


def quotes(spark, sf_dir) -> DataFrame:
    """Trades with a quote around each: last, bid, ask and their sizes."""
    return feeds.trades(spark, sf_dir).select(
        "symbol", "ts", "seq", F.col("price").alias("last"), (F.col("price") - 0.5 - F.col("size") / 1000).alias("bid"),
        (F.col("price") + 0.5 + F.col("size") / 500).alias("ask"), F.col("size").alias("bid_size"), (F.col("size") * 2 + 1).alias("ask_size"),
        F.col("size").alias("volume"), "aggressor",
    )


def price_features(q: DataFrame, jump: float = 0.05, sweep_volume: float = 90.0, sweep_spread: float = 0.05) -> DataFrame:
    """Row-local price features; previous values come from one window."""
    q = q.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    q = q.withColumns({f"{c}1": F.lag(c).over(W()) for c in ("last", "bid", "ask", "mid")})
    change = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}1"), F.nullif(F.col(f"{c}1"), F.lit(0.0))), F.lit(0.0))
    spread, ret = F.col("ask") - F.col("bid"), change("last")
    imbalance = sdiv(F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size"))
    fair = F.coalesce(sdiv(F.col("bid") * F.col("ask_size") + F.col("ask") * F.col("bid_size"), F.col("bid_size") + F.col("ask_size"), None), F.col("mid"))
    turn = F.coalesce(F.abs(spread - (F.col("ask1") - F.col("bid1"))), F.lit(0.0))
    return q.select(
        "symbol", "seq", rnd("mid").alias("mid"), rnd(spread).alias("spread"), rnd(ret).alias("tick_return"), rnd(change("bid")).alias("bid_return"),
        rnd(change("ask")).alias("ask_return"), rnd(change("mid")).alias("mid_return"),
        F.coalesce(F.signum(F.col("last") - F.col("last1")), F.lit(0.0)).cast("int").alias("tick_direction"), rnd(F.abs(ret)).alias("micro_volatility"),
        (F.abs(ret) > jump).alias("jump_flag"), rnd(sdiv(spread, "mid")).alias("slippage"), rnd(fair, 5).alias("micro_fair"), rnd(imbalance).alias("imbalance"),
        rnd(ret * F.col("volume") * F.col("aggressor")).alias("imbalance_return"), ((F.col("volume") >= sweep_volume) & (turn >= sweep_spread)).alias("sweep_flag"),
    )


@query(
    f"""WITH {QUOTES_SQL} SELECT symbol, seq, round(mid, 6) AS mid, round(ask - bid, 6) AS spread, round(coalesce((last - l1) / nullif(l1, 0), 0), 6) AS tick_return,
  round(coalesce((bid - b1) / nullif(b1, 0), 0), 6) AS bid_return, round(coalesce((ask - a1) / nullif(a1, 0), 0), 6) AS ask_return, round(coalesce((mid - m1) / nullif(m1, 0), 0), 6) AS mid_return,
  CAST(coalesce(sign(last - l1), 0) AS INTEGER) AS tick_direction, round(abs(coalesce((last - l1) / nullif(l1, 0), 0)), 6) AS micro_volatility,
  abs(coalesce((last - l1) / nullif(l1, 0), 0)) > 0.05 AS jump_flag, round((ask - bid) / mid, 6) AS slippage, round((bid * ask_size + ask * bid_size) / (bid_size + ask_size), 5) AS micro_fair,
  round((bid_size - ask_size) / (bid_size + ask_size), 6) AS imbalance, round(coalesce((last - l1) / nullif(l1, 0), 0) * volume * aggressor, 6) + 0.0 AS imbalance_return,
  volume >= 90 AND coalesce(abs((ask - bid) - (a1 - b1)), 0) >= 0.05 AS sweep_flag FROM p"""
)
def fam_price(spark, sf_dir):
    return price_features(quotes(spark, sf_dir))


def book_features(book: DataFrame, order=("seq",), key: str | None = None, levels: int = LEVELS, laid: bool = False) -> DataFrame:
    """Depth, imbalance, slopes, entropy and changes from level arrays.

    Without a key the table is one series; it is range-partitioned either way,
    unless it is ``laid`` so by key and order.
    """
    series = key or "_book"
    book = book if key else book.withColumn(series, F.lit(0))
    arr = lambda name: F.array(*[F.coalesce(f"{name}_{k}", F.lit(0.0)) for k in range(levels)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    weights = [1.0 / (k + 1) for k in range(levels)]
    steps = [k - (levels - 1) / 2 for k in range(levels)]
    norm = sum(s * s for s in steps)
    dot = lambda a, ws: total(F.zip_with(a, F.array(*[F.lit(x) for x in ws]), lambda x, y: x * y))
    b = book.select("*", arr("bid_size").alias("_b"), arr("ask_size").alias("_a"))
    b = b.withColumns({"bids": total("_b"), "asks": total("_a"), "top_bid": F.col("_b")[0], "top_ask": F.col("_a")[0]})
    depth = F.col("bids") + F.col("asks")
    share = F.transform(F.concat("_b", "_a"), lambda x: x / F.col("depth"))
    b = b.withColumn("depth", depth).withColumn("imbalance", sdiv(F.col("bids") - F.col("asks"), "depth"))
    near_b, near_a = dot("_b", weights), dot("_a", weights)
    entropy = F.when(F.col("depth") > 0, -F.aggregate(share, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.ln(p)).otherwise(0.0))).otherwise(0.0)
    bid_slope, ask_slope = dot("_b", [s / norm for s in steps]), dot("_a", [s / norm for s in steps])
    top3 = lambda c: total(F.slice(c, 1, 3))
    # What a row needs of itself comes first, so that only results are written.
    own = b.select(
        *dict.fromkeys([series, *order, "seq"]), "top_bid", "top_ask", "imbalance", F.col("bids").alias("depth_bid"), F.col("asks").alias("depth_ask"),
        sdiv(near_b - near_a, near_b + near_a).alias("near_imbalance"), bid_slope.alias("bid_slope"), ask_slope.alias("ask_slope"), (bid_slope - ask_slope).alias("curvature"),
        sdiv(top3("_b") - top3("_a"), "depth").alias("depth_skew"), entropy.alias("entropy"),
    )
    last = ["top_bid", "top_ask", "imbalance"]
    # Laying the rows reads them twice: once for the borders, once to deal them.
    made = previous(own if laid else written(own), last, (series,), order, laid)
    d = lambda c: F.col(c) - F.coalesce(f"{c}_1", F.lit(0.0))
    before = F.col("top_bid_1") + F.col("top_ask_1")
    turnover = F.try_divide(F.abs(F.col("top_bid") - F.col("top_bid_1")) + F.abs(F.col("top_ask") - F.col("top_ask_1")), F.nullif(before, F.lit(0.0)))
    plain = ["depth_bid", "depth_ask", "imbalance", "near_imbalance", "bid_slope", "ask_slope", "curvature", "depth_skew"]
    return made.select(
        *([key] if key else []), "seq", *[rnd(c).alias(c) for c in plain], rnd("entropy", 5).alias("entropy"),
        rnd(d("top_bid")).alias("queue_change_bid"), rnd(d("top_ask")).alias("queue_change_ask"), rnd(d("imbalance")).alias("imbalance_momentum"),
        rnd(F.coalesce(turnover, F.lit(0.0))).alias("turnover"),
    )


def _sum_sql(fmt: str) -> str:
    return "(" + " + ".join(fmt.format(k=k, w=1.0 / (k + 1), s=(k - (LEVELS - 1) / 2) / sum((j - (LEVELS - 1) / 2) ** 2 for j in range(LEVELS))) for k in range(LEVELS)) + ")"


_LEVELS_SQL = ", ".join(
    f"coalesce(sum(CASE WHEN l_linenumber = {k + 1} AND l_linestatus = '{st}' THEN l_quantity END), 0.0) AS {side}{k}"
    for k in range(LEVELS)
    for side, st in (("b", "O"), ("a", "F"))
)
_ENT = _sum_sql("CASE WHEN b{k} > 0 THEN b{k} / depth * ln(b{k} / depth) ELSE 0 END + CASE WHEN a{k} > 0 THEN a{k} / depth * ln(a{k} / depth) ELSE 0 END")


@query(
    f"""WITH k AS (SELECT l_orderkey AS seq, {_LEVELS_SQL} FROM lineitem GROUP BY 1),
t AS (SELECT *, {_sum_sql('b{k}')} AS bids, {_sum_sql('a{k}')} AS asks, {_sum_sql('b{k}')} + {_sum_sql('a{k}')} AS depth FROM k),
i AS (SELECT *, coalesce((bids - asks) / nullif(depth, 0), 0) AS imb, {_sum_sql('b{k} * {w!r}')} AS nb, {_sum_sql('a{k} * {w!r}')} AS na, {_sum_sql('b{k} * {s!r}')} AS bs, {_sum_sql('a{k} * {s!r}')} AS sa FROM t)
SELECT seq, round(bids, 6) AS depth_bid, round(asks, 6) AS depth_ask, round(imb, 6) AS imbalance, round(coalesce((nb - na) / nullif(nb + na, 0), 0), 6) AS near_imbalance,
  round(bs, 6) + 0.0 AS bid_slope, round(sa, 6) + 0.0 AS ask_slope, round(bs - sa, 6) + 0.0 AS curvature, round(coalesce((b0 + b1 + b2 - a0 - a1 - a2) / nullif(depth, 0), 0), 6) AS depth_skew,
  round(CASE WHEN depth > 0 THEN -{_ENT} ELSE 0 END, 5) + 0.0 AS entropy, round(b0 - lag(b0, 1, 0.0) OVER w, 6) AS queue_change_bid, round(a0 - lag(a0, 1, 0.0) OVER w, 6) AS queue_change_ask,
  round(imb - lag(imb, 1, 0.0) OVER w, 6) AS imbalance_momentum, round(coalesce((abs(b0 - lag(b0) OVER w) + abs(a0 - lag(a0) OVER w)) / nullif(lag(b0 + a0) OVER w, 0), 0), 6) AS turnover
FROM i WINDOW w AS (ORDER BY seq)"""
)
def fam_book(spark, sf_dir):
    """One book by order key.  The lines are range-partitioned by it, which serves both
    their sums by order and the order of the rows."""
    return book_features(feeds.book(spark, sf_dir, laid=True), laid=True)


@query(
    """WITH i AS (SELECT l_orderkey AS seq, l_linenumber AS k, l_extendedprice / l_quantity AS p, l_quantity AS s, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS a FROM lineitem),
g AS (SELECT seq, count(*) AS n, sum(s * a) AS sv, sum(CASE WHEN a > 0 THEN s ELSE 0 END) AS buy, sum(CASE WHEN a < 0 THEN s ELSE 0 END) AS sell, sum(s) AS v, avg(p) AS mp,
  sum(p * s) / sum(s) AS vwap, count(*) FILTER (s >= 40) AS big, sum(CASE WHEN s < 10 THEN s ELSE 0 END) AS small_vol, sum(CASE WHEN s >= 10 AND s < 40 THEN s ELSE 0 END) AS mid_vol,
  sum(CASE WHEN s >= 40 THEN s ELSE 0 END) AS big_vol, count(*) FILTER (a > 0) AS ups FROM i GROUP BY seq)
SELECT seq, sv AS signed_volume, buy AS buy_size, sell AS sell_size, round(coalesce((buy - sell) / nullif(buy + sell, 0), 0), 6) AS imbalance, big AS large_trades, round(v / n, 6) AS avg_size,
  round(ups / CAST(n AS DOUBLE), 6) AS aggressor_ratio, round((mp - vwap) / vwap, 6) AS price_vs_vwap, small_vol, mid_vol, big_vol,
  round(-(CASE WHEN buy > 0 THEN buy / v * ln(buy / v) ELSE 0 END + CASE WHEN sell > 0 THEN sell / v * ln(sell / v) ELSE 0 END), 6) + 0.0 AS sequence_entropy, CAST(sign(sv) AS INTEGER) AS polarity FROM g"""
)
def fam_tick(spark, sf_dir):
    """Order-flow features of array-valued cells, with higher-order functions."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    t = feeds.ticks(spark, sf_dir)
    s, a, p = "size", "side", "price"
    pick = lambda cond: total(F.zip_with(s, a, lambda x, y: F.when(cond(x, y), x).otherwise(0.0)))
    t = t.select(
        "seq", F.size(s).alias("n"), total(F.zip_with(s, a, lambda x, y: x * y)).alias("sv"), pick(lambda x, y: y > 0).alias("buy"), pick(lambda x, y: y < 0).alias("sell"),
        total(s).alias("v"), (total(p) / F.size(p)).alias("mp"), (total(F.zip_with(p, s, lambda x, y: x * y)) / total(s)).alias("vwap"),
        F.size(F.filter(s, lambda x: x >= 40)).alias("big"), pick(lambda x, y: x < 10).alias("small_vol"), pick(lambda x, y: (x >= 10) & (x < 40)).alias("mid_vol"),
        pick(lambda x, y: x >= 40).alias("big_vol"), F.size(F.filter(a, lambda x: x > 0)).alias("ups"),
    )
    part = lambda c: F.when(F.col(c) > 0, F.col(c) / F.col("v") * F.ln(F.col(c) / F.col("v"))).otherwise(0.0)
    return t.select(
        "seq", F.col("sv").alias("signed_volume"), F.col("buy").alias("buy_size"), F.col("sell").alias("sell_size"),
        rnd(sdiv(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell"))).alias("imbalance"), F.col("big").cast("long").alias("large_trades"),
        rnd(F.col("v") / F.col("n")).alias("avg_size"), rnd(F.col("ups") / F.col("n")).alias("aggressor_ratio"), rnd((F.col("mp") - F.col("vwap")) / F.col("vwap")).alias("price_vs_vwap"),
        "small_vol", "mid_vol", "big_vol", rnd(-(part("buy") + part("sell"))).alias("sequence_entropy"), F.signum("sv").cast("int").alias("polarity"),
    )


@query(
    f"""WITH {CHAIN_SQL}, m AS (SELECT *, tte = min(tte) OVER (PARTITION BY symbol, ts) AS near FROM chain),
g AS (SELECT symbol, ts, sum(CASE WHEN kind = 'call' THEN oi ELSE 0 END) AS oc, sum(CASE WHEN kind = 'put' THEN oi ELSE 0 END) AS op, sum(oi) AS oi, max(CASE WHEN near THEN bid_iv END) AS bb,
  min(CASE WHEN near THEN ask_iv END) AS ba, avg(iv) AS iv, sum(volume * abs(strike - spot) / spot) AS money, sum(CASE WHEN kind = 'call' THEN volume * spot ELSE -volume * spot END) AS flow,
  stddev_pop(iv) AS vol_of_vol, avg(iv) FILTER (kind = 'call') - avg(iv) FILTER (kind = 'put') AS skew FROM m GROUP BY 1, 2)
SELECT symbol, ts, oc AS oi_calls, op AS oi_puts, round(coalesce(oc / nullif(oc + op, 0), 0.5), 6) AS call_ratio, round(bb, 6) AS best_bid_iv, round(ba, 6) AS best_ask_iv,
  oi - lag(oi) OVER w AS oi_change, coalesce(iv < 0.9 * lag(iv) OVER w, false) AS iv_crush, round(money, 3) AS moneyness_size, round(flow, 1) AS flow_imbalance,
  round(vol_of_vol, 6) AS vol_of_vol, round(skew, 6) AS skew_index FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
)
def fam_chain(spark, sf_dir):
    """Sums by (symbol, ts, tte), of which (symbol, ts) is made, so that no rows are
    sorted to find the nearest expiry; changes by symbol after it."""
    c = feeds.chain(spark, sf_dir)
    call = F.col("kind") == "call"
    sums = {
        "oc": F.when(call, F.col("oi")).otherwise(0.0), "op": F.when(~call, F.col("oi")).otherwise(0.0), "oi": F.col("oi"),
        "money": F.col("volume") * F.abs(F.col("strike") - F.col("spot")) / F.col("spot"),
        "flow": F.when(call, F.col("volume") * F.col("spot")).otherwise(-F.col("volume") * F.col("spot")),
        "ivs": F.col("iv"), "ivc": F.when(call, F.col("iv")), "ivp": F.when(~call, F.col("iv")),
    }
    counted = ("ivs", "ivc", "ivp")
    part = c.groupBy("symbol", "ts", "tte").agg(
        *[F.sum(x).alias(k) for k, x in sums.items()], *[F.count(sums[k]).alias(f"n_{k}") for k in counted], F.var_pop("iv").alias("var"),
        F.max("bid_iv").alias("bb"), F.min("ask_iv").alias("ba"),
    )
    part = part.withColumn("near", F.col("tte") == F.min("tte").over(Window.partitionBy("symbol", "ts")))
    part = part.withColumn("squares", F.col("n_ivs") * F.col("var") + F.col("ivs") * F.col("ivs") / F.nullif(F.col("n_ivs"), F.lit(0)))
    g = part.groupBy("symbol", "ts").agg(
        *[F.sum(k).alias(k) for k in (*sums, *[f"n_{k}" for k in counted], "squares")],
        F.max(F.when(F.col("near"), F.col("bb"))).alias("bb"), F.min(F.when(F.col("near"), F.col("ba"))).alias("ba"),
    )
    mean = {k: F.col(k) / F.nullif(F.col(f"n_{k}"), F.lit(0)) for k in counted}
    spread = F.col("squares") / F.nullif(F.col("n_ivs"), F.lit(0)) - mean["ivs"] * mean["ivs"]
    g = g.withColumns({"iv": mean["ivs"], "vv": F.when(spread < 0, 0.0).otherwise(F.sqrt(spread)), "skew": mean["ivc"] - mean["ivp"]})
    w = Window.partitionBy("symbol").orderBy("ts")
    return g.select(
        "symbol", "ts", F.col("oc").alias("oi_calls"), F.col("op").alias("oi_puts"), rnd(sdiv("oc", F.col("oc") + F.col("op"), 0.5)).alias("call_ratio"),
        rnd("bb").alias("best_bid_iv"), rnd("ba").alias("best_ask_iv"), (F.col("oi") - F.lag("oi").over(w)).alias("oi_change"),
        F.coalesce(F.col("iv") < 0.9 * F.lag("iv").over(w), F.lit(False)).alias("iv_crush"), rnd("money", 3).alias("moneyness_size"), rnd("flow", 1).alias("flow_imbalance"),
        rnd("vv").alias("vol_of_vol"), rnd("skew").alias("skew_index"),
    )


def black_scholes(spot, strike, iv, tte, call) -> dict:
    """Delta, gamma, vega, theta, vanna, charm at a zero rate; 0 where an input
    is not positive."""
    good = (spot > 0) & (strike > 0) & (iv > 0) & (tte > 0)
    root = iv * F.sqrt(tte)
    d1 = (F.ln(spot / strike) + 0.5 * iv * iv * tte) / root
    n, pdf = norm_cdf(d1), norm_pdf(d1)
    gamma = pdf / (spot * root)
    out = {
        "delta": F.when(call, n).otherwise(-n), "gamma": gamma, "vega": spot * pdf * F.sqrt(tte), "theta": -spot * pdf * iv / (2 * F.sqrt(tte)),
        "vanna": spot * pdf * (1 - d1 / root), "charm": -gamma * spot * root,
    }
    return {k: F.when(good, v).otherwise(0.0) for k, v in out.items()}


_ROOT = "(iv * sqrt(tte))"
_D1 = f"((ln(spot / strike) + 0.5 * iv * iv * tte) / {_ROOT})"


@query(
    f"""WITH {CHAIN_SQL}, d AS (SELECT *, {_D1} AS d1, {_ROOT} AS r FROM chain), p AS (SELECT *, {norm_cdf_sql('d1')} AS n, {norm_pdf_sql('d1')} AS f FROM d),
g AS (SELECT symbol, ts, any_value(spot) AS spot, sum(CASE WHEN kind = 'call' THEN n ELSE -n END * oi) AS delta, sum(f / (spot * r) * oi) AS gamma, sum(spot * f * sqrt(tte) * oi) AS vega,
  sum(-spot * f * iv / (2 * sqrt(tte)) * oi) AS theta, sum(spot * f * (1 - d1 / r) * oi) AS vanna, sum(-f * oi) AS charm FROM p GROUP BY 1, 2)
SELECT symbol, ts, round(delta, 4) AS delta_net, round(gamma, 6) AS gamma_net, round(vega, 2) AS vega_net, round(theta, 3) AS theta_net, round(vanna, 2) AS vanna_net, round(charm, 4) AS charm_net,
  round(delta * spot * 0.01, 3) AS hedge_pressure, round(gamma - coalesce(lag(gamma) OVER w, 0), 6) AS gamma_flow, round(delta - coalesce(lag(delta) OVER w, 0), 4) AS delta_flow,
  round(sum(gamma * spot) OVER (PARTITION BY ts), 3) AS gex_total FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
)
def fam_greeks(spark, sf_dir):
    c = feeds.chain(spark, sf_dir)
    made = black_scholes(F.col("spot"), F.col("strike"), F.col("iv"), F.col("tte"), F.col("kind") == "call")
    names = ("delta", "gamma", "vega", "theta", "vanna", "charm")
    g = c.withColumns(made).groupBy("symbol", "ts").agg(F.first("spot").alias("spot"), *[F.sum(F.col(n) * F.col("oi")).alias(n) for n in names])
    w = Window.partitionBy("symbol").orderBy("ts")
    digits = {"delta": 4, "gamma": 6, "vega": 2, "theta": 3, "vanna": 2, "charm": 4}
    flow = lambda n: F.col(n) - F.coalesce(F.lag(n).over(w), F.lit(0.0))
    return g.select(
        "symbol", "ts", *[rnd(n, digits[n]).alias(f"{n}_net") for n in names], rnd(F.col("delta") * F.col("spot") * 0.01, 3).alias("hedge_pressure"),
        rnd(flow("gamma"), 6).alias("gamma_flow"), rnd(flow("delta"), 4).alias("delta_flow"),
        rnd(F.sum(F.col("gamma") * F.col("spot")).over(Window.partitionBy("ts")), 3).alias("gex_total"),
    )


@query(
    f"""WITH {BARS_SQL}, {TR_SQL}, s AS (SELECT *, ln(close) - ln(lag(close) OVER o) AS r, avg(close) OVER w20 AS m, stddev_samp(close) OVER w20 AS sd, max(high) OVER w20 AS hh, min(low) OVER w20 AS ll,
  max(high) OVER w14 AS h14, min(low) OVER w14 AS l14, sum(tr) OVER w14 AS tr14, 0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2) AS gk,
  lag(close, 12) OVER o AS c12, lag(high - low) OVER o AS hl1, (high + low + close) / 3 AS tp, sum(close * volume) OVER c / sum(volume) OVER c AS vwap
  FROM tr WINDOW o AS (PARTITION BY symbol ORDER BY seq), w20 AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  w14 AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), c AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, list(tp) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tps, CASE WHEN h14 > l14 THEN 100 * (close - l14) / (h14 - l14) ELSE 0 END AS k0 FROM s)
SELECT symbol, seq, round(CASE WHEN seq >= 20 THEN 4 * sd / m ELSE 0 END, 6) AS bb_width, round(CASE WHEN seq >= 20 THEN greatest(least((close - (m + 2 * sd)) / nullif(sd, 0), 10.0), -10.0) ELSE 0 END, 5) AS bb_upper_dev,
  round(CASE WHEN seq >= 20 THEN (hh - ll) / ll ELSE 0 END, 6) AS donchian, round(CASE WHEN seq >= 20 THEN (close - ll) / nullif(hh - ll, 0) ELSE 0 END, 6) AS range_position,
  round(CASE WHEN seq >= 31 THEN stddev_samp(r) OVER w30 ELSE 0 END, 6) AS volatility, round(CASE WHEN seq >= 30 THEN sqrt(greatest(avg(gk) OVER w30, 0)) ELSE 0 END, 6) AS garman_klass,
  round(CASE WHEN seq >= 14 THEN k0 ELSE 0 END, 4) AS stoch_k, round(CASE WHEN seq >= 16 THEN avg(k0) OVER w3 ELSE 0 END, 4) AS stoch_d,
  round(CASE WHEN seq >= 14 AND h14 > l14 THEN -100 * (h14 - close) / (h14 - l14) ELSE 0 END, 4) + 0.0 AS williams_r, round(coalesce(100 * (close / c12 - 1), 0), 5) AS roc,
  round(CASE WHEN seq >= 14 AND h14 > l14 AND tr14 > 0 THEN 100 * log10(tr14 / (h14 - l14)) / log10(14) ELSE 0 END, 4) AS choppiness, round(close / vwap - 1, 6) AS vwap_dev,
  round(coalesce((high - low - hl1) / nullif(hl1, 0), 0), 5) AS range_velocity,
  round(CASE WHEN seq >= 20 THEN greatest(least(coalesce((tp - list_avg(tps)) / nullif(0.015 * list_avg(list_transform(tps, lambda x: abs(x - list_avg(tps)))), 0), 0), 500.0), -500.0) ELSE 0 END, 3) AS cci
FROM l WINDOW w30 AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
)
def fam_technical(spark, sf_dir):
    """Window indicators; warm-up rows are 0.  The recursive ones are scans."""
    w20, w14, w30 = last_n(W(), 20), last_n(W(), 14), last_n(W(), 30)
    b = true_range(feeds.bars(spark, sf_dir)).withColumn("tr", F.greatest("tr", F.col("high") - F.col("low")))
    gk = 0.5 * F.pow(F.ln(F.col("high") / F.col("low")), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(F.col("close") / F.col("open")), 2)
    s = b.select(
        "symbol", "ts", "seq", "high", "low", "close", (F.ln("close") - F.ln(F.lag("close").over(W()))).alias("r"), F.avg("close").over(w20).alias("m"),
        F.stddev_samp("close").over(w20).alias("sd"), F.max("high").over(w20).alias("hh"), F.min("low").over(w20).alias("ll"), F.max("high").over(w14).alias("h14"),
        F.min("low").over(w14).alias("l14"), F.sum("tr").over(w14).alias("tr14"), gk.alias("gk"), F.lag("close", 12).over(W()).alias("c12"),
        F.lag(F.col("high") - F.col("low")).over(W()).alias("hl1"), ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("tp"),
        (F.sum(F.col("close") * F.col("volume")).over(so_far(W())) / F.sum("volume").over(so_far(W()))).alias("vwap"),
    )
    c, span14 = F.col("close"), F.col("h14") - F.col("l14")
    s = s.withColumn("tps", F.collect_list("tp").over(w20)).withColumn("k0", F.when(span14 > 0, 100 * (c - F.col("l14")) / span14).otherwise(0.0))
    mean = F.aggregate("tps", F.lit(0.0), lambda a, x: a + x) / F.size("tps")
    s = s.withColumn("tm", mean)
    mad = F.aggregate(F.transform("tps", lambda x: F.abs(x - F.col("tm"))), F.lit(0.0), lambda a, x: a + x) / F.size("tps")
    at = lambda n, x: F.when(F.col("seq") >= n, x).otherwise(0.0)
    return s.select(
        "symbol", "seq", rnd(at(20, 4 * F.col("sd") / F.col("m"))).alias("bb_width"),
        rnd(at(20, clip(sdiv(c - (F.col("m") + 2 * F.col("sd")), "sd", None), -10.0, 10.0)), 5).alias("bb_upper_dev"), rnd(at(20, (F.col("hh") - F.col("ll")) / F.col("ll"))).alias("donchian"),
        rnd(at(20, sdiv(c - F.col("ll"), F.col("hh") - F.col("ll"), None))).alias("range_position"), rnd(at(31, F.stddev_samp("r").over(w30))).alias("volatility"),
        rnd(at(30, F.sqrt(F.greatest(F.avg("gk").over(w30), F.lit(0.0))))).alias("garman_klass"), rnd(at(14, F.col("k0")), 4).alias("stoch_k"),
        rnd(at(16, F.avg("k0").over(last_n(W(), 3))), 4).alias("stoch_d"), rnd(at(14, F.when(span14 > 0, -100 * (F.col("h14") - c) / span14).otherwise(0.0)), 4).alias("williams_r"),
        rnd(F.coalesce(100 * (c / F.col("c12") - 1), F.lit(0.0)), 5).alias("roc"),
        rnd(at(14, F.when((span14 > 0) & (F.col("tr14") > 0), 100 * F.log10(F.col("tr14") / span14) / math.log10(14)).otherwise(0.0)), 4).alias("choppiness"),
        rnd(c / F.col("vwap") - 1).alias("vwap_dev"), rnd(sdiv(F.col("high") - F.col("low") - F.col("hl1"), "hl1"), 5).alias("range_velocity"),
        rnd(at(20, clip(sdiv(F.col("tp") - F.col("tm"), 0.015 * mad), -500.0, 500.0)), 3).alias("cci"),
    )


@query(
    f"""WITH {TRADES_SQL}, h AS (SELECT date_trunc('hour', ts) AS ts, avg(price) FILTER (symbol = 'S1') AS a, avg(price) FILTER (symbol = 'S2') AS b,
  avg(price) FILTER (symbol = 'S3') AS perp, (avg(size) - 50) / 1000 AS f FROM trades GROUP BY 1),
f AS (SELECT ts, last_value(a IGNORE NULLS) OVER c AS a, last_value(b IGNORE NULLS) OVER c AS b,
  last_value(perp IGNORE NULLS) OVER c - last_value(a IGNORE NULLS) OVER c AS basis, f FROM h WINDOW c AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, ln(a) - ln(lag(a) OVER o) AS ra, ln(b) - ln(lag(b) OVER o) AS rb, row_number() OVER o AS i FROM f WHERE a IS NOT NULL AND b IS NOT NULL WINDOW o AS (ORDER BY ts)),
x AS (SELECT ts, i, round(a - b, 6) AS spread, round(basis - lag(basis) OVER (ORDER BY ts), 6) AS basis_change,
  round((basis - lag(basis) OVER (ORDER BY ts)) / (epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts))), 9) AS basis_velocity, round(avg(f) OVER (ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS funding_8h,
  round(corr(ra, rb) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS corr_24 FROM r)
SELECT ts, spread, basis_change, basis_velocity, funding_8h, corr_24 FROM x WHERE i > 24"""
)
def fam_cross(spark, sf_dir):
    """Two assets and the first one's perpetual by hour: bounded by hours, so one window over the hours.

    The tables have no perpetual: S3 stands in for that of S1, the mean size less 50, in thousands, for its funding rate.
    """
    t = feeds.trades(spark, sf_dir)
    h = t.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(
        F.avg(F.when(F.col("symbol") == "S1", F.col("price"))).alias("a"), F.avg(F.when(F.col("symbol") == "S2", F.col("price"))).alias("b"),
        F.avg(F.when(F.col("symbol") == "S3", F.col("price"))).alias("perp"), ((F.avg("size") - 50) / 1000).alias("f"),
    )
    o = Window.partitionBy(F.lit(0)).orderBy("ts")
    f = h.select("ts", ffill("a", o).alias("a"), ffill("b", o).alias("b"), (ffill("perp", o) - ffill("a", o)).alias("basis"), "f").where("a IS NOT NULL AND b IS NOT NULL")
    d, change = F.col("a") - F.col("b"), F.col("basis") - F.lag("basis").over(o)
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag(F.col("ts").cast("timestamp")).over(o))
    r = f.select(
        "ts", "a", "b", "basis", "f", (F.ln("a") - F.ln(F.lag("a").over(o))).alias("ra"), (F.ln("b") - F.ln(F.lag("b").over(o))).alias("rb"), F.row_number().over(o).alias("i")
    )
    return r.select(
        "ts", "i", rnd(d).alias("spread"), rnd(change).alias("basis_change"), rnd(change / seconds, 9).alias("basis_velocity"), rnd(F.avg("f").over(last_n(o, 8))).alias("funding_8h"),
        rnd(corr("ra", "rb", last_n(o, 24)), 4).alias("corr_24"),
    ).where("i > 24").drop("i")


@query(
    f"""WITH {QUOTES_SQL}, f AS (SELECT *, coalesce((last - l1) / nullif(l1, 0), 0) AS r, (bid_size - ask_size) / (bid_size + ask_size) AS im, ask - bid AS sp,
  lag(ask - bid) OVER w AS sp1 FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))
SELECT symbol, seq, round(0.4 / (1 + sp) + 0.4 * least(greatest(bid_size / (bid_size + ask_size), 0), 1) + 0.2, 6) AS liquidity, coalesce(sp > 1.25 * sp1 OR sp < 0.8 * sp1, false) AS spread_crossover,
  round(1 / (1 + abs(sp - coalesce(sp1, sp))), 6) AS spread_stability, CASE WHEN abs(r) > 0.3 AND sign(r) = sign(aggressor) THEN 'trend' WHEN abs(r) > 0.3 THEN 'mean_revert' ELSE 'range' END AS state,
  round(ln(1 + r), 6) AS log_return, round((last - 130) / 30, 6) AS z_price, round(sp * volume, 5) AS volume_spread, round(r / sp, 6) AS return_over_spread, round(im * r, 6) AS imbalance_return,
  round(0.5 * bid_size / 100 + 0.3 * ask_size / 100 + 0.1 * im + 0.1 * sp, 6) AS pca1 FROM f"""
)
def fam_regime_higher(spark, sf_dir):
    """Market regime and higher-order features: row expressions over lags."""
    q = quotes(spark, sf_dir)
    l1 = F.lag("last").over(W())
    sp = F.col("ask") - F.col("bid")
    f = q.select(
        "*", F.coalesce(F.try_divide(F.col("last") - l1, F.nullif(l1, F.lit(0.0))), F.lit(0.0)).alias("r"), sp.alias("sp"), F.lag(sp).over(W()).alias("sp1"),
        ((F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size"))).alias("im"),
    )
    r, s = F.col("r"), F.col("sp")
    state = F.when((F.abs(r) > 0.3) & (F.signum(r) == F.signum(F.col("aggressor").cast("double"))), "trend").when(F.abs(r) > 0.3, "mean_revert").otherwise("range")
    return f.select(
        "symbol", "seq", rnd(0.4 / (1 + s) + 0.4 * clip(F.col("bid_size") / (F.col("bid_size") + F.col("ask_size")), 0.0, 1.0) + 0.2).alias("liquidity"),
        F.coalesce((s > 1.25 * F.col("sp1")) | (s < 0.8 * F.col("sp1")), F.lit(False)).alias("spread_crossover"), rnd(1 / (1 + F.abs(s - F.coalesce("sp1", "sp")))).alias("spread_stability"),
        state.alias("state"), rnd(F.log1p(r)).alias("log_return"), rnd((F.col("last") - 130) / 30).alias("z_price"), rnd(s * F.col("volume"), 5).alias("volume_spread"),
        rnd(r / s).alias("return_over_spread"), rnd(F.col("im") * r).alias("imbalance_return"),
        rnd(0.5 * F.col("bid_size") / 100 + 0.3 * F.col("ask_size") / 100 + 0.1 * F.col("im") + 0.1 * s).alias("pca1"),
    )


@query(
    """WITH e AS (SELECT event_id AS seq, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS b, ts + to_milliseconds(event_id % 2000) AS ingest FROM events),
m AS (SELECT *, CAST(a IS NULL AS INTEGER) + CAST(b IS NULL AS INTEGER) AS masked, greatest(0.0, (epoch_us(ingest) - epoch_us(ts)) / 1000.0) AS latency FROM e)
SELECT seq, masked, latency AS latency_ms, latency > 1000 AS stale, round(greatest(0, least(1, 1 - 0.5 * masked / 2.0 - 0.2 * CAST(latency > 1000 AS INTEGER))), 6) AS confidence FROM m"""
)
def fam_meta(spark, sf_dir):
    """Null mask, latency, staleness and confidence of each row."""
    e = feeds.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("value") * 2).alias("b"),
    )
    masked = F.col("a").isNull().cast("int") + F.col("b").isNull().cast("int")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    latency = F.greatest(F.lit(0.0), (us(F.col("ts")) + F.col("seq") % 2000 * 1000 - us(F.col("ts"))) / 1000.0)
    m = e.select("seq", masked.alias("masked"), latency.alias("latency_ms"))
    stale = F.col("latency_ms") > 1000
    return m.select("seq", "masked", "latency_ms", stale.alias("stale"), rnd(clip(1 - 0.5 * F.col("masked") / 2.0 - 0.2 * stale.cast("int"), 0.0, 1.0)).alias("confidence"))
