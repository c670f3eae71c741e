"""The time-cycle family of bars, the regime label on it, and its exact quantile.

Everything lies in blocks (``operators.blocks``): windows in two passes, one
before and one after the recursions, and all recursions in one pass, so that one
symbol's bars spread over any number of tasks.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rnd, sdiv
from ..operators.blocks import ROWS, Last, Switch, Together, joined, positioned, recursion_of, scanned, windowed, written
from ..sources import feeds
from ..sources.feeds import BARS_SQL
from .registry import query

AVERAGES, MEANS, CHANNEL, SESSION_ROWS = (9, 21, 50, 200), (9, 20, 21, 50, 200), 20, 1440
#: Hours at which the second and third session of a day begin.
SESSIONS = (7, 13)


def over_frames(x: np.ndarray, n: int, how, most: int = 1024) -> np.ndarray:
    """``how`` of the last ``n`` values of each row, NaN before the first and where
    there is no value; a few frames at a time."""
    wide = sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)
    return np.concatenate([how(wide[at : at + most]) for at in range(0, len(x), most)]) if len(x) else np.empty(0)


def total(w: np.ndarray) -> np.ndarray:
    there = ~np.isnan(w)
    return np.where(there.any(1), np.where(there, w, 0.0).sum(1), np.nan)


def mean(w: np.ndarray) -> np.ndarray:
    return total(w) / np.maximum((~np.isnan(w)).sum(1), 1)


def deviation(w: np.ndarray) -> np.ndarray:
    n = (~np.isnan(w)).sum(1)
    squares = np.nan_to_num(w - mean(w)[:, None]) ** 2
    return np.sqrt(np.divide(squares.sum(1), n - 1, out=np.full(len(w), np.nan), where=n > 1))


def highest(w: np.ndarray) -> np.ndarray:
    return np.fmax.reduce(w, axis=1)


def lowest(w: np.ndarray) -> np.ndarray:
    return np.fmin.reduce(w, axis=1)


def rising(w: np.ndarray) -> np.ndarray:
    """Weights up to the frame's length for the newest value."""
    weights = np.where(np.isnan(w), 0.0, np.arange(1.0, w.shape[1] + 1))
    return (np.nan_to_num(w) * weights).sum(1) / weights.sum(1)


def share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.full(len(top), np.nan), where=bottom != 0)


def before(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]])


FIRST = [*[f"sma_{n}" for n in MEANS], *"""tr delta hl atr sma_14 std_20 atr_20 atr_10 don_high don_low sto_k sto_d willr roc mom adx di_plus di_minus
    chop hv_30 hv_90 hma_21 wma_21""".split()]  # fmt: skip


def bar_windows(x, pos, own):
    """What a bar's value needs of at most 200 bars before it."""
    high, low, close = x["high"], x["low"], x["close"]
    c1 = before(close)
    tr = np.fmax(high - low, np.fmax(np.abs(high - c1), np.abs(low - c1)))
    atr = over_frames(tr, 14, mean)
    up, down = high - before(high), before(low) - low
    gain, loss = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    plus, minus = 100 * share(over_frames(gain, 14, total), atr), 100 * share(over_frames(loss, 14, total), atr)
    top, bottom = over_frames(high, 14, highest), over_frames(low, 14, lowest)
    stochastic = 100 * share(close - bottom, top - bottom)
    step = np.log(close) - np.log(c1)
    with np.errstate(divide="ignore"):
        chop = 100 * np.log10(share(over_frames(tr, 14, total), np.where(top == bottom, np.nan, top - bottom))) / np.log10(14)
    wma = over_frames(close, 21, rising)
    out = [
        *[over_frames(close, n, mean) for n in MEANS], tr, close - c1, high - low, atr, over_frames(close, 14, mean), over_frames(close, CHANNEL, deviation),
        over_frames(tr, CHANNEL, mean), over_frames(tr, 10, mean), over_frames(high, CHANNEL, highest), over_frames(low, CHANNEL, lowest), stochastic, over_frames(stochastic, 3, mean),
        -100 * share(top - close, top - bottom), share(close - before(close, 12), before(close, 12)), close - before(close, 10),
        over_frames(100 * share(np.abs(plus - minus), plus + minus), 14, mean), plus, minus, np.where(np.isinf(chop), np.nan, chop),
        over_frames(step, 30, deviation) * np.sqrt(30), over_frames(step, 90, deviation) * np.sqrt(90), over_frames(2 * over_frames(close, 10, rising) - wma, 4, rising), wma,
    ]
    return tuple(c[own] for c in out)


def after_windows(x, pos, own):
    """Trend strength, and whether a session's share of volume stands out."""
    apart = over_frames(share(np.abs(x["ema_9"] - x["ema_21"]), x["close"]), 21, mean)
    even = np.nan_to_num(share(apart, np.where(over_frames(apart, 21, highest) == 0, np.nan, over_frames(apart, 21, highest))))
    part = x["part"]
    usual, spread = over_frames(part, SESSION_ROWS, mean), over_frames(part, SESSION_ROWS, deviation)
    out = [0.6 * np.clip(x["adx"] / 50, 0, 1) + 0.4 * even, (part - usual > 1.5 * np.where(spread == 0, np.nan, spread)).astype(np.int32)]
    return tuple(c[own] for c in out)


#: The states of the recursions, in the order in which a step makes them.
STATES = [*[f"ema_{n}" for n in AVERAGES], "e12", "e26", "signal", "second", "third", "ups", "downs", "hl10", "hl20", "mid", "pv", "v"]


def exponentials():
    """All averages of a bar as one linear step: each weighs its input with 2 / (n + 1)
    (1 / n for rises and falls) and starts at the first one."""

    def step(s, u):
        close, rise, fall, hl, pv, v = u
        to = lambda old, new, n: old + (new - old) * 2 / (n + 1)
        emas = [to(s[i], close, n) for i, n in enumerate(AVERAGES)]
        fast, slow = to(s[4], close, 12), to(s[5], close, 26)
        second = to(s[7], emas[1], 21)
        rest = [to(s[6], fast - slow, 9), second, to(s[8], second, 21), to(s[9], rise, 27), to(s[10], fall, 27)]
        return [*emas, fast, slow, *rest, to(s[11], hl, 10), to(s[12], hl, 20), to(s[13], close, CHANNEL), s[14] + pv, s[15] + v]

    def inputs(x):
        rise, fall = np.nan_to_num(np.maximum(x["delta"], 0)), np.nan_to_num(np.maximum(-x["delta"], 0))
        return np.stack([x["close"], rise, fall, x["hl"], x["close"] * x["volume"], x["volume"]], axis=1)

    def seed(u, pos):
        """The states of a key's first bar; of the second, those that start there."""
        close, rise, fall, hl, pv, v = u
        if pos == 0:
            return [*[close] * 6, 0.0, close, close, 0.0, 0.0, hl, hl, close, pv, v]
        return [None] * 9 + [rise, fall] + [None] * 5

    return recursion_of(step, inputs, len(STATES), 6, seed, seeded=2)


def time_cycle(bars: DataFrame, rows: int = ROWS) -> DataFrame:
    """``bars`` (symbol, ts, seq, high, low, close, volume) with the time-cycle columns.

    The score and share of a session compare with all of the symbol's bars in
    that session, later ones as well.  A value without its past is null, as is
    one over nothing (a flat range, no volume).  Prices are not null; equal
    order columns come in any order, and an empty table gives an empty one.
    """
    made = windowed(positioned(bars), ["high", "low", "close"], ", ".join(f"{c} double" for c in FIRST), bar_windows, back=200, rows=max(rows, 200))
    middle = (F.col("high") + F.col("low")) / 2
    made = made.withColumns({"band_up": middle + 3 * F.col("atr_10"), "band_low": middle - 3 * F.col("atr_10")})
    names = ", ".join(f"{c} double" for c in STATES) + ", supertrend_dir int"
    made = scanned(made, ["close", "volume", "delta", "hl", "band_up", "band_low"], names, Together(exponentials(), Switch("close", "band_up", "band_low")), rows=rows)
    hour = F.hour("ts")
    session = F.when(hour < SESSIONS[0], 1).when(hour < SESSIONS[1], 2).otherwise(3)
    made = written(made.withColumn("session", session))
    of = made.groupBy("symbol", "session").agg(F.sum("volume").alias("_all"), F.avg("hv_30").alias("_mean"), F.stddev_samp("hv_30").alias("_spread"))
    made = joined(made, of, ["symbol", "session"]).withColumns({
        "part": sdiv("volume", "_all", None), "session_vol": sdiv(F.col("hv_30") - F.col("_mean"), "_spread"),
    }).drop("_all", "_mean", "_spread")
    made = windowed(made, ["close", "ema_9", "ema_21", "adx", "part"], "trend_strength double, micro_session int", after_windows, back=SESSION_ROWS - 1, rows=max(rows, SESSION_ROWS))
    c = F.col
    return made.withColumns({
        "vwap": sdiv("pv", "v", None), "atr_norm": sdiv("atr", "close", None), "atr_band_upper": c("sma_14") + 2 * c("atr"), "atr_band_lower": c("sma_14") - 2 * c("atr"),
        "rsi_14": 100 - sdiv(F.lit(100.0), 1 + sdiv("ups", "downs", None), None), "macd": c("e12") - c("e26"), "macd_hist": c("e12") - c("e26") - c("signal"),
        "bb_upper": c("sma_20") + 2 * c("std_20"), "bb_lower": c("sma_20") - 2 * c("std_20"), "kc_upper": c("mid") + 1.5 * c("atr_20"), "kc_lower": c("mid") - 1.5 * c("atr_20"),
        "squeeze_on": F.coalesce(4 * c("std_20") < 3 * c("atr_20"), F.lit(False)).cast("int"), "vol_comp_ratio": sdiv(4 * c("std_20"), 3 * c("atr_20"), None),
        "cvi_10_20": sdiv(c("hl10") - c("hl20"), "hl20", None), "dema_21": 2 * c("ema_21") - c("second"), "tema_21": 3 * (c("ema_21") - c("second")) + c("third"),
        "hour": hour, "minute": F.minute("ts"), "session_part": F.coalesce("part", F.lit(0.0)),
    })


def quantiles(df: DataFrame, column: str, q: float, key: str = "symbol") -> DataFrame:
    """``key`` and ``quantile``: exact, linear between neighbours, of the values that
    are not null.  Values are numbered by a range partitioning, so a key of any
    size spreads; a built-in percentile would hold all its values in one task."""
    ranked = written(positioned(df.where(F.col(column).isNotNull()).select(key, column), (key,), (column,)))
    at = ranked.groupBy(key).agg(((F.max("_pos")) * q).alias("_at"))
    near = joined(ranked, at, [key]).where("_pos = floor(_at) OR _pos = ceil(_at)")
    low, high = F.min(column), F.max(column)
    return near.groupBy(key).agg((low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias("quantile"))


VOTES = 5


def majority(x, pos, own):
    """The most frequent of the last five labels, the smallest of equals."""
    counts = np.stack([over_frames((x["raw"] == k).astype(float), VOTES, total) for k in range(3)], axis=1)
    return (counts.argmax(1).astype(np.int32)[own],)


def regime_label(features: DataFrame, adx: float = 25.0, strength: float = 0.5, rows: int = ROWS) -> DataFrame:
    """``symbol, ts, seq, raw, regime`` for the rows of ``time_cycle``: 0 flat, 1 up, 2 down,
    by majority of five bars.

    A bar trends if the ADX and the trend strength reach their thresholds; it is
    up if EMA 21 is above EMA 50 and the normalised range under the symbol's
    upper quartile.  Gaps take the value before, leading ones the first there is.
    """
    held = ["adx", "trend_strength", "atr_norm"]
    made = features.select("symbol", "ts", "seq", "_pos", "ema_21", "ema_50", *held)
    made = scanned(made, held, ", ".join(f"_{c} double" for c in held), Together(*[Last(c) for c in held]), rows=rows)
    first = features.groupBy("symbol").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_first_{c}") for c in held])
    made = joined(joined(made, first, ["symbol"]), quantiles(features, "atr_norm", 0.75), ["symbol"], "left")
    value = lambda c: F.coalesce(f"_{c}", f"_first_{c}")
    trending = F.coalesce((value("adx") >= adx) & (value("trend_strength") >= strength), F.lit(False))
    up = F.coalesce((F.col("ema_21") > F.col("ema_50")) & (value("atr_norm") < F.col("quantile")), F.lit(False))
    made = made.select("symbol", "ts", "seq", "_pos", F.when(~trending, 0).when(up, 1).otherwise(2).alias("raw"))
    return windowed(made, ["raw"], "regime int", majority, back=VOTES - 1, rows=max(rows, VOTES)).drop("_pos")


def _ema(state: str, x: str, n: int) -> str:
    return f"({state} + ({x} - {state}) * 2.0 / {n + 1})"


def _frame(name: str, n: int) -> str:
    return f"{name} AS (PARTITION BY symbol ORDER BY seq ROWS {n - 1} PRECEDING)"


_SECOND = _ema("s.second", _ema("s.ema_21", "b.close", 21), 21)
_RISING = lambda x, n: "(" + " + ".join(f"coalesce(lag({x}, {k}) OVER w, 0) * {n - k}" for k in range(n)) + f") / ({n * (n + 1) // 2} - greatest({n} - seq, 0) * (greatest({n} - seq, 0) + 1) / 2)"
TC_SQL = f"""{BARS_SQL},
t1 AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr, close - lag(close) OVER w AS delta, high - low AS hl,
  ln(close) - ln(lag(close) OVER w) AS lr, high - lag(high) OVER w AS um, lag(low) OVER w - low AS dm, close - lag(close, 10) OVER w AS mom,
  (close - lag(close, 12) OVER w) / nullif(lag(close, 12) OVER w, 0) AS roc, {_RISING('close', 21)} AS wma_21, {_RISING('close', 10)} AS wma_10,
  CASE WHEN hour(ts) < 7 THEN 1 WHEN hour(ts) < 13 THEN 2 ELSE 3 END AS session FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
t2 AS (SELECT *, {', '.join(f'avg(close) OVER w{n} AS sma_{n}' for n in MEANS)}, avg(tr) OVER w14 AS atr, avg(close) OVER w14 AS sma_14, stddev_samp(close) OVER w20 AS std_20, avg(tr) OVER w20 AS atr_20,
  avg(tr) OVER w10 AS atr_10, max(high) OVER w20 AS don_high, min(low) OVER w20 AS don_low, max(high) OVER w14 AS top, min(low) OVER w14 AS bot, sum(tr) OVER w14 AS trs,
  stddev_samp(lr) OVER w30 * sqrt(30) AS hv_30, stddev_samp(lr) OVER w90 * sqrt(90) AS hv_90, 2 * wma_10 - wma_21 AS hm,
  100 * sum(CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END) OVER w14 / nullif(avg(tr) OVER w14, 0) AS di_plus, 100 * sum(CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END) OVER w14 / nullif(avg(tr) OVER w14, 0) AS di_minus
  FROM t1 WINDOW {', '.join(_frame(f'w{n}', n) for n in (9, 10, 14, 20, 21, 30, 50, 90, 200))}),
t3 AS (SELECT *, 100 * (close - bot) / nullif(top - bot, 0) AS sto_k, 100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0) AS dx, {_RISING('hm', 4)} AS hma_21,
  volume / nullif(sum(volume) OVER z, 0) AS part, coalesce((hv_30 - avg(hv_30) OVER z) / nullif(stddev_samp(hv_30) OVER z, 0), 0) AS session_vol,
  sum(close * volume) OVER r / nullif(sum(volume) OVER r, 0) AS vwap FROM t2 WINDOW w AS (PARTITION BY symbol ORDER BY seq), z AS (PARTITION BY symbol, session), r AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, avg(sto_k) OVER w3 AS sto_d, avg(dx) OVER w14 AS adx, part - avg(part) OVER w1440 > 1.5 * nullif(stddev_samp(part) OVER w1440, 0) AS stands_out, (high + low) / 2 + 3 * atr_10 AS bu, (high + low) / 2 - 3 * atr_10 AS bl
  FROM t3 WINDOW {', '.join(_frame(f'w{n}', n) for n in (3, 14, 1440))}),
s AS (SELECT symbol, seq, {', '.join(f'close AS ema_{n}' for n in AVERAGES)}, close AS e12, close AS e26, 0.0::DOUBLE AS signal, close AS second, close AS third, 0.0::DOUBLE AS ups, 0.0::DOUBLE AS downs,
  hl AS hl10, hl AS hl20, close AS mid, 1 AS dir, bu AS line FROM b WHERE seq = 1
UNION ALL SELECT b.symbol, b.seq, {', '.join(_ema(f's.ema_{n}', 'b.close', n) for n in AVERAGES)}, {_ema('s.e12', 'b.close', 12)}, {_ema('s.e26', 'b.close', 26)},
  {_ema('s.signal', f"({_ema('s.e12', 'b.close', 12)} - {_ema('s.e26', 'b.close', 26)})", 9)}, {_SECOND}, {_ema('s.third', _SECOND, 21)},
  CASE WHEN b.seq = 2 THEN greatest(b.delta, 0) ELSE s.ups + (greatest(b.delta, 0) - s.ups) / 14 END, CASE WHEN b.seq = 2 THEN greatest(-b.delta, 0) ELSE s.downs + (greatest(-b.delta, 0) - s.downs) / 14 END,
  {_ema('s.hl10', 'b.hl', 10)}, {_ema('s.hl20', 'b.hl', 20)}, {_ema('s.mid', 'b.close', 20)},
  CASE WHEN b.close > s.line THEN 1 WHEN b.close < s.line THEN -1 ELSE s.dir END,
  CASE WHEN (CASE WHEN b.close > s.line THEN 1 WHEN b.close < s.line THEN -1 ELSE s.dir END) = -1 THEN b.bu ELSE b.bl END FROM s JOIN b ON b.symbol = s.symbol AND b.seq = s.seq + 1),
m AS (SELECT b.*, s.* EXCLUDE (symbol, seq), abs(ema_9 - ema_21) / nullif(close, 0) AS apart FROM b JOIN s ON s.symbol = b.symbol AND s.seq = b.seq),
m2 AS (SELECT *, avg(apart) OVER w21 AS even FROM m WINDOW {_frame('w21', 21)}),
tc AS (SELECT *, CASE WHEN adx IS NOT NULL THEN 0.6 * greatest(least(adx / 50, 1), 0) END + 0.4 * coalesce(even / nullif(max(even) OVER w21, 0), 0) AS trend_strength, atr / nullif(close, 0) AS atr_norm FROM m2 WINDOW {_frame('w21', 21)})"""

#: Means of prices in cents are often exact halves of the last digit.
NUDGE = 1e-9
DIGITS = {"sto_k": 4, "sto_d": 4, "willr": 4, "di_plus": 4, "di_minus": 4, "adx": 4, "chop": 4, "rsi_14": 4, "session_vol": 5}
NUMBERS = [
    *[f"ema_{n}" for n in AVERAGES], *[f"sma_{n}" for n in MEANS], *"""vwap atr atr_norm atr_band_upper atr_band_lower rsi_14 macd macd_hist bb_upper bb_lower kc_upper kc_lower don_high don_low
    sto_k sto_d willr roc mom adx di_plus di_minus chop trend_strength vol_comp_ratio session_vol session_part hv_30 hv_90 cvi_10_20 hma_21 wma_21 dema_21 tema_21""".split(),
]
_MADE = {
    "atr_band_upper": "sma_14 + 2 * atr", "atr_band_lower": "sma_14 - 2 * atr", "rsi_14": "100 - 100 / (1 + ups / nullif(downs, 0))", "macd": "e12 - e26", "macd_hist": "e12 - e26 - signal",
    "bb_upper": "sma_20 + 2 * std_20", "bb_lower": "sma_20 - 2 * std_20", "kc_upper": "mid + 1.5 * atr_20", "kc_lower": "mid - 1.5 * atr_20", "willr": "-100 * (top - close) / nullif(top - bot, 0)",
    "chop": "100 * log10(nullif(trs, 0) / nullif(top - bot, 0)) / log10(14)", "vol_comp_ratio": "4 * std_20 / nullif(3 * atr_20, 0)", "session_part": "coalesce(part, 0)",
    "cvi_10_20": "(hl10 - hl20) / nullif(hl20, 0)", "dema_21": "2 * ema_21 - second", "tema_21": "3 * (ema_21 - second) + third",
}


@query(
    f"""WITH RECURSIVE {TC_SQL} SELECT symbol, seq, {', '.join(f'round({_MADE.get(c, c)} + {NUDGE}, {DIGITS.get(c, 5)}) + 0.0 AS {c}' for c in NUMBERS)}, round(signal, 5) + 0.0 AS macd_sig,
  CAST(coalesce(4 * std_20 < 3 * atr_20, false) AS INTEGER) AS squeeze_on, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(session AS INTEGER) AS session,
  CAST(coalesce(stands_out, false) AS INTEGER) AS micro_session, CAST(dir AS INTEGER) AS supertrend_dir FROM tc"""
)
def tc_features(spark, sf_dir):
    """The whole time-cycle family of the hourly bars."""
    r = time_cycle(feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", "high", "low", "close", "volume"))
    return r.select("symbol", "seq", *[rnd(F.col(c) + NUDGE, DIGITS.get(c, 5)).alias(c) for c in NUMBERS], rnd("signal", 5).alias("macd_sig"), "squeeze_on", "hour", "minute", "session", "micro_session", "supertrend_dir")


@query(
    f"""WITH RECURSIVE {TC_SQL},
q AS (SELECT symbol, quantile_cont(atr_norm, 0.75) AS q FROM tc GROUP BY symbol),
f AS (SELECT tc.symbol, tc.seq, ema_21, ema_50, q, coalesce(last_value(adx IGNORE NULLS) OVER w, first_value(adx IGNORE NULLS) OVER v) AS adx,
  coalesce(last_value(trend_strength IGNORE NULLS) OVER w, first_value(trend_strength IGNORE NULLS) OVER v) AS ts, atr_norm FROM tc JOIN q ON q.symbol = tc.symbol
  WINDOW w AS (PARTITION BY tc.symbol ORDER BY seq ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY tc.symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, CASE WHEN NOT coalesce(adx >= 25 AND ts >= 0.5, false) THEN 0 WHEN coalesce(ema_21 > ema_50 AND atr_norm < q, false) THEN 1 ELSE 2 END AS raw FROM f),
h AS (SELECT symbol, seq, raw, sum(CAST(raw = 0 AS INTEGER)) OVER w AS n0, sum(CAST(raw = 1 AS INTEGER)) OVER w AS n1, sum(CAST(raw = 2 AS INTEGER)) OVER w AS n2 FROM g WINDOW {_frame('w', VOTES)})
SELECT symbol, seq, CAST(raw AS INTEGER) AS raw, CAST(CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS INTEGER) AS regime FROM h"""
)
def label_regime(spark, sf_dir):
    """Market regimes of the hourly bars."""
    bars = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", "high", "low", "close", "volume")
    return regime_label(written(time_cycle(bars))).select("symbol", "seq", "raw", "regime")
