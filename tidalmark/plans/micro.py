"""Microstructure features of bars from trades and depth, in two resolutions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import last_n, ordered, rnd, sdiv
from ..operators.asof import asof_join
from ..operators.blocks import ROWS, joined, windowed
from ..operators.grid import bucket, grid_zscore, time_mean
from ..sources import feeds
from ..sources.feeds import TRADES_SQL
from .options import frames
from .registry import query

LEVELS = 5


def depth(spark, sf_dir) -> DataFrame:
    """A book of five levels around two of three trades, sizes by the trade's number."""
    t = feeds.trades(spark, sf_dir).where("seq % 3 <> 0")
    made = []
    for i in range(1, LEVELS + 1):
        made += [
            (F.col("price") - 0.5 * i).alias(f"bid_{i}_price"), (F.col("size") * ((F.col("seq") + i) % 7)).alias(f"bid_{i}_size"),
            (F.col("price") + 0.5 * i).alias(f"ask_{i}_price"), (F.col("size") * ((F.col("seq") * 3 + i) % 5)).alias(f"ask_{i}_size"),
        ]
    return t.select("symbol", "ts", "seq", *made)


def over(top: Column, bottom: Column) -> Column:
    return sdiv(top, bottom, None)


def depth_features(book: DataFrame, levels: int = LEVELS, memory: int = 60, rows: int = ROWS, bar: int = 1) -> DataFrame:
    """Imbalance by level and in all, pressure of all levels and of the first, slope
    over the levels, and by rows before: change and decay of the first bid.
    ``closes`` says which row is the symbol's last up to some start of ``bar`` seconds."""
    bid = [F.coalesce(f"bid_{i}_size", F.lit(0.0)) for i in range(1, levels + 1)]
    ask = [F.coalesce(f"ask_{i}_size", F.lit(0.0)) for i in range(1, levels + 1)]
    add = lambda cols: sum(cols[1:], cols[0])
    bids = [F.col(f"bid_{i}_price") * F.col(f"bid_{i}_size") for i in range(1, levels + 1)]
    asks = [F.col(f"ask_{i}_price") * F.col(f"ask_{i}_size") for i in range(1, levels + 1)]
    worth = lambda cols: add([F.coalesce(c, F.lit(0.0)) for c in cols])
    # The slope of a line through (i, bid - ask) is a sum with fixed weights.
    middle = (levels + 1) / 2
    scale = sum((i - middle) ** 2 for i in range(1, levels + 1))
    slope = add([(b - a) * ((i - middle) / scale) for i, (b, a) in enumerate(zip(bid, ask, strict=True), 1)])

    def first_bid(x, pos, own):
        top = np.nan_to_num(x["top"])
        highest = np.nanmax(frames(top, memory), 1)
        decay = np.divide(highest - top, highest, out=np.zeros(len(top)), where=highest != 0)
        due = x["due"]  # its first start at or after it; another one than the next row's
        return np.nan_to_num(np.diff(top, prepend=top[:1]))[own], decay[own], (due != np.append(due[1:], np.nan))[own]

    due = F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bar * 1e6))
    made = book.select(
        "symbol", "ts", "seq", due.alias("due"), bid[0].alias("top"), *[over(b - a, b + a).alias(f"imb_level_{i}") for i, (b, a) in enumerate(zip(bid, ask, strict=True), 1)],
        over(add(bid) - add(ask), add(bid) + add(ask)).alias("vol_imb_sum5"), over(worth(bids) - worth(asks), worth(bids) + worth(asks)).alias("book_pressure_delta"),
        over(bids[0] - asks[0], bids[0] + asks[0]).alias("top_book_pressure"), slope.alias("heat_slope"),
    )
    found = windowed(made, ["top", "due"], "step double, liq_decay double, closes boolean", first_bid, back=memory, ahead=1, rows=max(rows, memory))
    return found.drop("due")


def micro_features(
    trades: DataFrame, book: DataFrame, bar: int = 60, fine: int = 1, coarse: int = 10, span: int = 60, burst: float = 3.0, large: float = 5.0, rows: int = ROWS
) -> DataFrame:
    """One row a bar of ``bar`` seconds that has trades, with the features of trades in
    ``fine`` buckets, of depth in ``coarse`` ones, and of both as they stand at the
    bar's start.  ``bar`` is a multiple of ``fine``.  Buckets without trades count
    as zero volume between a symbol's first trade and its last."""
    t = trades.withColumns({"signed": F.col("size") * F.col("aggressor"), "b": bucket(bar), "g": bucket(fine)})
    buy, sell = F.col("aggressor") > 0, F.col("aggressor") < 0
    # One pass over the trades: fine buckets first, bars from them.
    close = F.max_by("price", F.struct("ts", "seq"))
    small = t.groupBy("symbol", "b", "g").agg(
        F.count("price").alias("n"), F.sum("size").alias("vol"), F.sum("signed").alias("signed"), F.sum(F.when(buy, F.col("size")).otherwise(0.0)).alias("buy"),
        F.sum(F.when(sell, F.col("size")).otherwise(0.0)).alias("sell"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(F.struct("ts", "seq")).alias("end"), close.alias("close"),
    )
    bars = small.groupBy("symbol", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "vol", "signed", "buy", "sell")], F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "end").alias("close")
    )
    z = grid_zscore(small.select("symbol", "g", F.col("signed").alias("v")), rows=rows)
    sweeps = z.groupBy("symbol", F.expr(f"g div {bar // fine}").alias("b")).agg(F.max((F.coalesce(F.abs("z"), F.lit(0.0)) > burst).cast("int")).alias("sweep"))

    d = depth_features(book, rows=rows, bar=bar).withColumn("c", bucket(coarse))
    flows = d.groupBy("symbol", "c").agg(F.sum(F.greatest(-F.col("step"), F.lit(0.0))).alias("pull"), F.sum(F.greatest("step", F.lit(0.0))).alias("stack"))
    flows = flows.select("symbol", "c", F.coalesce(over(F.col("pull"), F.col("stack")), F.lit(0.0)).alias("pull_stack"))
    usual = time_mean(t, "size", span, "usual")
    outsized = F.col("size") > large * F.when(F.col("usual") == 0, 1.0).otherwise(F.col("usual"))
    absorbed = usual.groupBy("symbol", bucket(coarse).alias("c")).agg(F.max(outsized.cast("int")).alias("absorbed"))
    ends = absorbed.groupBy("symbol").agg(F.max("c").alias("last"))
    # A bar's start meets no other rows of the depth than those.
    d = joined(joined(d.where("closes"), flows, ["symbol", "c"], "left"), ends, ["symbol"], "left").withColumn("c", F.least("c", "last"))
    d = joined(d, absorbed, ["symbol", "c"], "left")

    levels = [f"imb_level_{i}" for i in range(1, LEVELS + 1)]
    state = [*levels, "vol_imb_sum5", "book_pressure_delta", "top_book_pressure", "heat_slope", "liq_decay", "pull_stack", "absorbed"]
    start = F.timestamp_micros(F.col("b") * (bar * 1000000)).cast("timestamp_ntz")
    placed = joined(bars, sweeps, ["symbol", "b"], "left").withColumns({"ts": start, "seq": F.col("b")})
    m = asof_join(placed, d, state)
    w = ordered("symbol", by=("b",))
    behind = lambda k: w.rangeBetween(-k, 0)
    index = F.col("b") - F.min("b").over(Window.partitionBy("symbol"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m = m.withColumns({
        "spread": F.col("high") - F.col("low"), "mid": (F.col("high") + F.col("low")) / 2, "imb": zero(over(F.col("buy") - F.col("sell"), F.col("vol"))),
        "push": zero(over(F.col("signed"), F.col("vol"))), "index": index, "cum": F.sum("signed").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "before": F.when(F.lag("b").over(w) == F.col("b") - 1, F.lag("signed").over(w)).otherwise(0.0),
    })
    m = m.withColumns({
        "ret": zero(F.col("close") / F.lag("close").over(w) - 1), "flow": zero(F.col("cum") - F.lag("cum").over(w)), "at": F.row_number().over(w),
    })
    five = last_n(w, 5)
    spread = last_n(w, 60)
    velocity = F.when(F.col("index") > 0, (F.col("signed") - F.col("before")) / bar).otherwise(0.0)
    out = {
        "spread": F.col("spread"), "mid": F.col("mid"), "spread_z": over(F.col("spread") - F.avg("spread").over(spread), F.stddev_samp("spread").over(spread)),
        "trade_count": F.col("n"), "vol": F.col("vol"), "avg_size": F.col("vol") / F.col("n"), "buy_vol": F.col("buy"), "sell_vol": F.col("sell"), "buy_sell_imb": F.col("imb"),
        "cum_delta": F.col("cum"), "aggression_idx": F.sum("push").over(behind(2)) / F.least(F.col("index") + 1, F.lit(3)), "orderflow_vel": velocity,
        "microtrend_vector": F.signum(F.round(F.avg("imb").over(last_n(w, 3)), 9)),
        "micro_divergence": F.when(F.col("at") >= 5, F.avg("ret").over(five) - F.avg("flow").over(five)).otherwise(0.0), "spoof_rate": F.lit(0.0),
        "sweep_flag": F.coalesce("sweep", F.lit(0)), "absorption_flag": F.coalesce("absorbed", F.lit(0)), **{c: zero(F.col(c)) for c in state[:-1]},
    }
    return m.select("symbol", F.col("b").alias("bar"), *[v.alias(f"ms_{k}") for k, v in out.items()])


#: Of the queries, as the events lie half an hour apart.
BAR, FINE, COARSE, SPAN, LARGE = 14400, 3600, 2400, 14400, 1.8
_BID = [f"size * ((seq + {i}) % 7)" for i in range(1, 6)]
_ASK = [f"size * ((seq * 3 + {i}) % 5)" for i in range(1, 6)]
_IMB = ",\n  ".join(f"coalesce(({b} - {a}) / nullif({b} + {a}, 0), 0) AS i{i}" for i, (b, a) in enumerate(zip(_BID, _ASK, strict=True), 1))
_BS, _AS = " + ".join(_BID), " + ".join(_ASK)
_BW = " + ".join(f"(price - {0.5 * i}) * {b}" for i, b in enumerate(_BID, 1))
_AW = " + ".join(f"(price + {0.5 * i}) * {a}" for i, a in enumerate(_ASK, 1))
_SLOPE = " + ".join(f"({b} - {a}) * {i - 3}" for i, (b, a) in enumerate(zip(_BID, _ASK, strict=True), 1))


@query(
    f"""WITH {TRADES_SQL}, t AS (SELECT *, epoch_us(ts) / 1e6 AS e, size * aggressor AS signed FROM trades),
ex AS (SELECT symbol, min(e) AS e0, max(e) AS e1 FROM t GROUP BY symbol),
ba AS (SELECT symbol, CAST(floor(e / {BAR}) AS BIGINT) AS b, count(*) AS n, sum(size) AS vol, sum(signed) AS signed, sum(CASE WHEN aggressor > 0 THEN size ELSE 0 END) AS buy,
  sum(CASE WHEN aggressor < 0 THEN size ELSE 0 END) AS sell, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close FROM t GROUP BY 1, 2),
bg AS (SELECT symbol, unnest(range(CAST(floor(e0 / {BAR}) AS BIGINT), CAST(floor(e1 / {BAR}) AS BIGINT) + 1)) AS b FROM ex),
bf AS (SELECT bg.symbol, bg.b, coalesce(signed, 0) AS signed, coalesce(signed / vol, 0) AS push FROM bg LEFT JOIN ba ON ba.symbol = bg.symbol AND ba.b = bg.b),
bw AS (SELECT *, avg(push) OVER (PARTITION BY symbol ORDER BY b ROWS 2 PRECEDING) AS aggr, coalesce(signed - lag(signed) OVER (PARTITION BY symbol ORDER BY b), 0) / {BAR} AS vel,
  sum(signed) OVER (PARTITION BY symbol ORDER BY b) AS cum FROM bf),
fi AS (SELECT symbol, CAST(floor(e / {FINE}) AS BIGINT) AS g, sum(signed) AS v FROM t GROUP BY 1, 2),
fg AS (SELECT symbol, unnest(range(CAST(floor(e0 / {FINE}) AS BIGINT), CAST(floor(e1 / {FINE}) AS BIGINT) + 1)) AS g FROM ex),
fw AS (SELECT fg.symbol, fg.g, coalesce(v, 0) AS v, avg(coalesce(v, 0)) OVER w AS m, stddev_samp(coalesce(v, 0)) OVER w AS s FROM fg LEFT JOIN fi ON fi.symbol = fg.symbol AND fi.g = fg.g
  WINDOW w AS (PARTITION BY fg.symbol ORDER BY fg.g ROWS 59 PRECEDING)),
sw AS (SELECT symbol, g // {BAR // FINE} AS b, max(CASE WHEN s > 1e-4 AND abs(v - m) / s > 3 THEN 1 ELSE 0 END) AS sweep FROM fw GROUP BY 1, 2),
us AS (SELECT *, avg(size) OVER (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN {SPAN * 1000000 - 1} PRECEDING AND CURRENT ROW) AS usual FROM t),
ab AS (SELECT symbol, CAST(floor(e / {COARSE}) AS BIGINT) AS c, max(CASE WHEN size > {LARGE} * CASE WHEN usual = 0 THEN 1 ELSE usual END THEN 1 ELSE 0 END) AS absorbed FROM us GROUP BY 1, 2),
al AS (SELECT symbol, max(c) AS last FROM ab GROUP BY symbol),
d0 AS (SELECT symbol, ts, seq, CAST(floor(e / {COARSE}) AS BIGINT) AS c, {_BID[0]} AS top, {_IMB}, coalesce((({_BS}) - ({_AS})) / nullif(({_BS}) + ({_AS}), 0), 0) AS vs,
  coalesce((({_BW}) - ({_AW})) / nullif(({_BW}) + ({_AW}), 0), 0) AS bp, coalesce(((price - 0.5) * {_BID[0]} - (price + 0.5) * {_ASK[0]}) / nullif((price - 0.5) * {_BID[0]} + (price + 0.5) * {_ASK[0]}, 0), 0) AS tp,
  ({_SLOPE}) / 10 AS hs FROM t WHERE seq % 3 <> 0),
d1 AS (SELECT *, coalesce(top - lag(top) OVER w, 0) AS step, max(top) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 59 PRECEDING) AS mx FROM d0 WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
ps AS (SELECT symbol, c, coalesce(sum(greatest(-step, 0)) / nullif(sum(greatest(step, 0)), 0), 0) AS ratio FROM d1 GROUP BY 1, 2),
d2 AS (SELECT d1.*, coalesce((mx - top) / nullif(mx, 0), 0) AS decay, ps.ratio, coalesce(ab.absorbed, 0) AS absorbed FROM d1 JOIN ps ON ps.symbol = d1.symbol AND ps.c = d1.c JOIN al ON al.symbol = d1.symbol
  LEFT JOIN ab ON ab.symbol = d1.symbol AND ab.c = least(d1.c, al.last)),
bs AS (SELECT ba.*, make_timestamp(ba.b * {BAR * 1000000}) AS ts FROM ba),
j AS (SELECT bs.*, d2.* EXCLUDE (symbol, ts, seq, c, top, step, mx) FROM bs ASOF LEFT JOIN d2 ON d2.symbol = bs.symbol AND d2.ts <= bs.ts),
k AS (SELECT j.*, aggr, vel, cum, coalesce(sweep, 0) AS sweep, high - low AS spread, coalesce((buy - sell) / nullif(vol, 0), 0) AS imb FROM j JOIN bw ON bw.symbol = j.symbol AND bw.b = j.b
  LEFT JOIN sw ON sw.symbol = j.symbol AND sw.b = j.b),
l AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS ret, coalesce(cum - lag(cum) OVER w, 0) AS flow, row_number() OVER w AS r FROM k WINDOW w AS (PARTITION BY symbol ORDER BY b))
SELECT symbol, b AS bar, round(spread, 6) AS ms_spread, round((high + low) / 2, 6) AS ms_mid,
  round((spread - avg(spread) OVER s60) / nullif(stddev_samp(spread) OVER s60, 0), 5) AS ms_spread_z, n AS ms_trade_count, vol AS ms_vol, round(vol / n, 6) AS ms_avg_size, buy AS ms_buy_vol, sell AS ms_sell_vol,
  round(imb, 6) AS ms_buy_sell_imb, cum AS ms_cum_delta, round(aggr, 6) AS ms_aggression_idx, round(vel, 6) AS ms_orderflow_vel, CAST(sign(round(avg(imb) OVER w3, 9)) AS DOUBLE) AS ms_microtrend_vector,
  round(CASE WHEN r >= 5 THEN avg(ret) OVER w5 - avg(flow) OVER w5 ELSE 0 END, 5) AS ms_micro_divergence, 0.0::DOUBLE AS ms_spoof_rate, sweep AS ms_sweep_flag, coalesce(absorbed, 0) AS ms_absorption_flag,
  round(coalesce(i1, 0), 6) AS ms_imb_level_1, round(coalesce(i2, 0), 6) AS ms_imb_level_2, round(coalesce(i3, 0), 6) AS ms_imb_level_3, round(coalesce(i4, 0), 6) AS ms_imb_level_4, round(coalesce(i5, 0), 6) AS ms_imb_level_5,
  round(coalesce(vs, 0), 6) AS ms_vol_imb_sum5, round(coalesce(bp, 0), 6) AS ms_book_pressure_delta, round(coalesce(tp, 0), 6) AS ms_top_book_pressure, round(coalesce(hs, 0), 6) AS ms_heat_slope,
  round(coalesce(decay, 0), 6) AS ms_liq_decay, round(coalesce(ratio, 0), 6) AS ms_pull_stack
FROM l WINDOW s60 AS (PARTITION BY symbol ORDER BY b ROWS 59 PRECEDING), w3 AS (PARTITION BY symbol ORDER BY b ROWS 2 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY b ROWS 4 PRECEDING)"""
)
def ms_features(spark, sf_dir):
    r = micro_features(feeds.trades(spark, sf_dir), depth(spark, sf_dir), BAR, FINE, COARSE, SPAN, large=LARGE)
    whole = ["symbol", "bar", "ms_trade_count", "ms_vol", "ms_buy_vol", "ms_sell_vol", "ms_cum_delta", "ms_microtrend_vector", "ms_spoof_rate", "ms_sweep_flag", "ms_absorption_flag"]
    return r.select(*whole, *[rnd(c, 5 if c in ("ms_spread_z", "ms_micro_divergence") else 6).alias(c) for c in r.columns if c not in whole])
