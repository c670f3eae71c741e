"""Futures pipeline: eight steps over trades and order flow.

open interest -> funding -> basis -> positioning -> liquidation -> volume ->
leverage -> regime.  The first, second and fourth step run on the union of both
feeds, ordered by (ts, seq, feed), the others on the trades in it.  A state "as
of" a time is that of the last event at it.

The union is shuffled by symbol once, with the feeds' columns only, and sorted.
What needs other rows (lags, running and rolling statistics, recursions) comes
from passes over it (`operators/along.py`), formulas of a row are projections
between them, so all steps are one stage that holds a batch at a time.
Statistics of a symbol's whole history are aggregates of the few columns they
need, which are written once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, rnd, sdiv, sigmoid
from ..operators import scan as k
from ..operators.along import AtTime, Calc, Each, From, Lag, Moments, Opening, Quantile, So, along, laid, over as share_of
from ..operators.blocks import joined, written
from ..sources import feeds
from ..sources.feeds import FLOW_SQL, TRADES_SQL
from .registry import query

UNION = ("ts", "seq", "feed")
SMALL = 1e-12


def zero(x):
    return F.coalesce(x, F.lit(0.0))


def over(part, whole):
    """Part of a magnitude that is not zero, else null."""
    return part / F.when(F.abs(whole) > SMALL, F.abs(whole))


def moments(c: str, n: int, least: int, past: bool = False) -> Moments:
    return Moments(c, n, least, past, mean=f"m_{c}", std=f"s_{c}")


def filled(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def z_of(x: np.ndarray, mean: np.ndarray, std: np.ndarray, limit: float = np.inf) -> np.ndarray:
    """From the rolled ``m_`` and ``s_`` columns; 0 where there is none."""
    return np.clip(filled(share_of(x - mean, std)), -limit, limit)


def zs(c: str, limit: float = np.inf, name: str = "") -> Calc:
    return Calc(name or f"z_{c}", lambda x, m, s: z_of(x, m, s, limit), c, f"m_{c}", f"s_{c}")


def change(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """0 where either is missing."""
    return filled(x - before)


def growth(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    return filled(np.divide(x, before, out=np.full(len(x), np.nan), where=before != 0) - 1)


def steps(seq: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Steps of seq since the row before, one at least."""
    return np.fmax(np.abs(seq - before), 1.0)


def union(trades: DataFrame, flow: DataFrame) -> DataFrame:
    """Both feeds, by symbol and in order."""
    a = trades.select("symbol", "ts", "seq", F.lit(0).alias("feed"), "price", "size", "aggressor", F.lit(None).cast("string").alias("event_type"), F.lit(0.0).alias("inventory"))
    b = flow.select("symbol", "ts", "seq", F.lit(1).alias("feed"), "price", "size", "aggressor", "event_type", F.col("inventory_pressure").alias("inventory"))
    t = laid(a.unionByName(b), order=UNION)
    up, down, trade, kind, half = F.col("aggressor") > 0, F.col("aggressor") < 0, F.col("feed") == 0, F.col("event_type"), F.col("size") * 0.5
    opens = F.when(trade & up, F.col("size")).when(trade, 0.0).when(kind == "add", F.col("size")).when((kind == "trade") & up, half).otherwise(0.0)
    closes = F.when(trade & down, F.col("size")).when(trade, 0.0).when(kind == "cancel", F.col("size")).when((kind == "trade") & down, half).otherwise(0.0)
    return t.withColumns({"open_flow": opens, "close_flow": closes, "net": opens - closes, "us": F.unix_micros(F.col("ts").cast("timestamp"))})


#: Opens less closes, never under zero, on the union of both feeds.
OPEN_INTEREST = [
    So("c", "sum", "net"), So("low", "min", "c"), Calc("oi", lambda c, low: c - np.fmin(0.0, low), "c", "low"), Lag("p_oi", "oi"), Calc("oi_change", change, "oi", "p_oi"),
    Lag("p_us", "us"), Calc("gap", lambda u, p: u - p, "us", "p_us"), Calc("velocity", lambda c, gap: c / np.where(gap > 0, gap, 1.0), "oi_change", "gap"),
    Lag("p_price", "price"), moments("oi", 100, 1), Calc("z_oi", lambda x, m, s: (x - m) / np.where(s > SMALL, s, 1.0), "oi", "m_oi", "s_oi"),
]


def open_interest(trades: DataFrame, flow: DataFrame) -> DataFrame:
    t = along(union(trades, flow), OPEN_INTEREST, ["symbol", "seq", "feed", "open_flow", "close_flow", "price", "oi", "oi_change", "p_price", "z_oi"])
    ret = F.coalesce(F.col("price") / F.col("p_price") - 1, F.lit(0.0))
    return t.select(
        "*", (F.col("oi_change") - ret).alias("divergence"), sdiv(F.abs("oi_change"), "oi").alias("turnover"),
        (F.col("open_flow") / F.when(F.col("close_flow") > SMALL, F.col("close_flow")).otherwise(1.0)).alias("open_close"),
    )


def impulse(queue: float):
    """Signed flow of an order-flow event."""
    kind, size = F.col("event_type"), F.col("size")
    held = F.when(kind == "add", size).when(kind == "cancel", -size).otherwise(0.0)
    return F.when(kind == "trade", F.col("aggressor") * size).otherwise(0.0) + queue * held + 0.15 * F.col("inventory")


def settlement(ts):
    """Minutes to the next 8-hour settlement, and its weight."""
    minutes = 480 - (F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0) % 480
    return minutes, clip(F.exp(-F.pow((minutes - 20) / 18, 2)), 0.05, 1.0)


def funding(trades: DataFrame, flow: DataFrame) -> DataFrame:
    """On the union; ``a_`` columns are the state as of the time, ``f_`` ones that of funding."""
    trade = F.col("feed") == 0
    notional = F.when(trade, F.col("price") * F.col("size")).otherwise(0.0)
    done = ~trade & (F.col("event_type") == "trade") & (F.col("aggressor") != 0)
    t = union(trades, flow).withColumns({
        "signed": notional * F.col("aggressor"), "notional": notional, "flow": F.when(trade, 0.0).otherwise(impulse(0.20)), "flow30": F.when(~trade, impulse(0.30)),
        "exec": F.when(done, 1.0).otherwise(0.0), "exec_at": F.when(done, F.col("size")).otherwise(0.0),
    })
    t = t.withColumns({"mag": F.abs("flow"), "flow1": F.when(~trade, F.col("flow"))})
    parts = [
        *OPEN_INTEREST, AtTime("last", a_oi="oi", a_oi_change="oi_change", a_z_oi="z_oi", a_velocity="velocity"), AtTime("mean", at_flow="flow30", at_aggr="flow1"),
        So("n_exec", "sum", "exec"), So("n_exec_at", "sum", "exec_at"), AtTime("last", execs="n_exec", exec_size="n_exec_at"), Calc("ret", growth, "price", "p_price"),
        Moments("signed", 96, total="r_signed"), Moments("notional", 96, total="r_notional"), Moments("flow", 128, mean="r_flow"), Moments("mag", 128, mean="r_mag"), Moments("a_oi", 96, mean="r_oi"),
        Each("ewm", ["price"], lambda: k.span(300), lambda s, x: (s(x),)), From("fair", "ewm", 20), Lag("p_seq", "seq"), Calc("step", steps, "seq", "p_seq"),
    ]
    raw = ["symbol", "ts", "seq", "feed", "price", "size", "aggressor", "notional"]
    t = along(t, parts, [*raw, "oi", "oi_change", "z_oi", "gap", "a_oi", "a_oi_change", "a_z_oi", "a_velocity", "at_flow", "at_aggr", "execs", "exec_size", "ret", "r_signed", "r_notional", "r_flow", "r_mag", "r_oi", "fair", "step"])
    t = t.withColumn("fair", F.coalesce("fair", "price"))
    aggr = clip(F.col("r_signed") / (F.col("r_notional") + 1e-9), -1.0, 1.0)
    crowd = clip(over(F.col("r_flow"), F.col("r_mag")), -4.0, 4.0) / 4
    g = clip(over(F.col("a_oi_change"), F.col("r_oi")), -0.6, 0.6)
    lev = (0.6 * g + 0.4 * clip(F.col("a_z_oi"), -4.0, 4.0) / 4) * F.signum("ret") * F.signum(g)
    prem = clip(over(F.col("price") - F.col("fair"), F.col("fair")), -0.02, 0.02) / 0.02
    raw_rate = 0.34 * aggr + 0.24 * crowd + 0.24 * lev + 0.18 * prem
    _, weight = settlement(F.col("ts"))
    t = t.withColumn("weight", weight).withColumn("rate", zero(clip(F.tanh(2.1 * raw_rate * (0.7 + 0.3 * F.col("weight"))) * 0.0015, -0.0015, 0.0015)))

    def flags():
        return [k.Hysteresis(1e-4, 5e-5), k.Ewm(0.1)]

    def step(s, x):
        flag = s[0](x)
        return flag, s[1](float(flag))

    parts = [
        Each("funding_flag flag_mean", ["rate"], flags, step), moments("rate", 256, 16, True), zs("rate", 8.0, "z_f"), Lag("p_rate", "rate"), Calc("rate_change", change, "rate", "p_rate"),
        Calc("rate_velocity", np.divide, "rate_change", "step"), Lag("p_velocity", "rate_velocity"), Calc("rate_acceleration", lambda v, p, n: change(v, p) / n, "rate_velocity", "p_velocity", "step"),
        Calc("pressure", lambda z, v, w: z * v * w, "z_f", "rate_velocity", "weight"), Calc("stress", np.multiply, "z_f", "a_z_oi"),
        AtTime("last", f_rate="rate", f_z_f="z_f", f_pressure="pressure", f_stress="stress"),
    ]
    made = ["weight", "rate", "funding_flag", "flag_mean", "z_f", "rate_change", "rate_velocity", "rate_acceleration", "pressure", "stress", "f_rate", "f_z_f", "f_pressure", "f_stress"]
    t = along(t, parts, [*raw, "oi", "oi_change", "z_oi", "gap", "a_oi", "a_z_oi", "a_velocity", "at_flow", "at_aggr", "execs", "exec_size", *made])
    return t.withColumns({"funding_flag": F.col("funding_flag").cast("int"), "funding_extreme": F.abs("z_f") > 2.5})


def positioning(t: DataFrame) -> DataFrame:
    oe = F.tanh(35 * F.col("oi_change") + 0.55 * F.col("z_oi"))
    dp = F.tanh(2400 * F.col("rate") + 0.42 * F.col("z_f"))
    sig = 0.40 * dp + 0.30 * dp * oe + 0.18 * clip(F.col("flag_mean"), -1.0, 1.0) + 0.12 * F.tanh(1.4 * F.col("stress")) * F.signum(dp)
    t = t.withColumn("ratio", clip(F.exp(clip(sig, -0.693147, 0.693147)), 0.5, 2.0))
    t = t.withColumns({"long_proxy": F.col("oi") * F.col("ratio") / (1 + F.col("ratio")), "short_proxy": F.col("oi") / (1 + F.col("ratio"))})
    t = t.withColumn("skew", F.ln((F.col("long_proxy") + 1e-6) / (F.col("short_proxy") + 1e-6)))
    parts = [Lag("p_ratio", "ratio"), Calc("ratio_change", change, "ratio", "p_ratio"), Lag("p_skew", "skew"), Calc("skew_velocity", change, "skew", "p_skew")]
    return along(t, parts, ["symbol", "seq", "feed", "ratio", "ratio_change", "long_proxy", "short_proxy", "skew", "skew_velocity"])


def first_flow(trades: DataFrame, flow: DataFrame) -> DataFrame:
    """By symbol, the mean flow at the first trade's time that has any: it stands for the times before."""
    at = flow.withColumnRenamed("inventory_pressure", "inventory").groupBy("symbol", "ts").agg(F.avg(impulse(0.30)).alias("first_flow")).where(F.col("first_flow").isNotNull())
    met = joined(at, trades.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_semi")
    return met.groupBy("symbol").agg(F.min_by("first_flow", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62)))).alias("first_flow"))


#: What each step needs of the trades' past.
BASIS_ROLLS = [
    So("flow_so", "last", "at_flow"), Calc("flow_mean", lambda so, first: filled(np.where(np.isnan(so), first, so)), "flow_so", "first_flow"), Moments("notional", 240, 5, total="r_not240"),
    Moments("size", 240, 5, total="r_size240"), Moments("flow_mean", 120, 3, mean="r_flow120"), Quantile("med_notional", "notional", 180, least=5),
    Calc("vwap0", share_of, "r_not240", "r_size240"), From("vwap", "vwap0", 5),
]
LIQUIDATION_ROLLS = [
    Lag("p_price", "price"), Calc("ret", growth, "price", "p_price"), Calc("abs_ret", np.abs, "ret"), Lag("p_a_oi", "a_oi"), Calc("build", lambda x, p: filled(np.fmax(x - p, np.where(np.isnan(x - p), np.nan, 0.0))), "a_oi", "p_a_oi"),
    Calc("oi_pct", lambda x, p: np.where(p > 0, x / np.where(p > 0, p, 1.0) - 1, np.where((p == 0) & (x > 0), 1e9, 0.0)), "a_oi", "p_a_oi"), Lag("p_z", "f_z_f"), Calc("lag_z", filled, "p_z"),
    Lag("p_s", "f_stress"), Calc("lag_s", filled, "p_s"), Quantile("med_ret", "abs_ret", 240, least=10), Quantile("calm", "abs_ret", 90, least=5), Quantile("med_sell", "sell_n", 180, least=5),
    Quantile("med_buy", "buy_n", 180, least=5), Moments("build", 180, 5, total="r_build"), Moments("a_oi", 180, 5, mean="r_oi180"), Moments("apart", 120, 5, total="r_apart"), Moments("both", 120, 5, total="r_both"),
]


def rise(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of a running sum, the row's own value where there is none before."""
    return np.fmax(np.where(np.isnan(before), x, x - before), 0.0)


def jump(x: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    return np.where(i <= 1, 0.0, np.where(i == 2, np.abs(x), np.abs(x - before)))


VOLUME_ROLLS = [
    Quantile("p95", "size", 200, 0.95), From("bar0", "p95", 50), Calc("bar", lambda b, p: np.where(np.isnan(b), p, b), "bar0", "p95"), Lag("p_execs", "execs"), Calc("d_execs", rise, "execs", "p_execs"),
    Lag("p_exec_size", "exec_size"), Calc("d_exec_size", rise, "exec_size", "p_exec_size"), Moments("d_execs", 25, 5, total="r_execs"), Moments("d_exec_size", 25, 5, total="r_exec_size"),
    Moments("size", 25, 5, total="r_size25"), So("trade_volume", "sum", "size"), So("volume_delta", "sum", "impulse"), Lag("p_impulse", "impulse"), So("i", "sum", "one"), Calc("accel", jump, "impulse", "p_impulse", "i"),
    # The gap is that of the union, in microseconds: a trade at the time of the row before it has gap 0.
    Opening("gap0", "gap"), Calc("freq", lambda g: 1.0 / np.fmax(np.where(np.isnan(g), 1e-3, g), 1e-6), "gap0"),
    Calc("large", lambda x, b: np.where(x >= b, x, 0.0), "size", "bar"), So("large_volume", "sum", "large"), Moments("large", 25, total="r_large25"),
    Calc("share", lambda a, b: filled(share_of(a, b)), "r_large25", "r_size25"), Calc("execution", lambda n, x, y: n / 25 + filled(share_of(x, y)), "r_execs", "r_exec_size", "r_size25"),
    *[p for c in ("freq", "share", "accel", "execution") for p in (moments(c, 250, 50), zs(c))],
    Calc("burst", lambda a, b, c, d: np.fmax(0.30 * a + 0.30 * b + 0.20 * c + 0.20 * d, 0.0), "z_freq", "z_share", "z_accel", "z_execution"),
]
STEP = [Lag("p_seq", "seq"), Calc("step", steps, "seq", "p_seq")]
TRADE = ["symbol", "ts", "seq", "price", "size", "notional", "oi", "z_oi", "a_oi", "a_z_oi", "a_velocity", "at_flow", "at_aggr", "z_f", "stress", "f_rate", "f_z_f", "f_pressure", "f_stress"]
MADE = {
    "basis": ["step", "r_not240", "vwap", "r_flow120", "med_notional"],
    "liquidation": ["sell_n", "buy_n", "ret", "oi_pct", "lag_z", "lag_s", "med_ret", "calm", "med_sell", "med_buy", "r_build", "r_oi180", "r_apart", "r_both"],
    "volume": ["trade_volume", "volume_delta", "large_volume", "burst"],
}
PARTS = {"basis": [*STEP, *BASIS_ROLLS], "liquidation": LIQUIDATION_ROLLS, "volume": VOLUME_ROLLS}


def on_trades(t: DataFrame, groups: list[str], first: DataFrame | None) -> DataFrame:
    """The trades of the union with what the steps ``groups`` need of their past."""
    t = t.where("feed = 0").withColumns({
        "impulse": F.col("size") * F.col("aggressor"), "sell_n": F.when(F.col("aggressor") < 0, F.col("notional")).otherwise(0.0), "one": F.lit(1.0),
        "buy_n": F.when(F.col("aggressor") > 0, F.col("notional")).otherwise(0.0),
    })
    t = t.withColumns({"apart": F.abs(F.col("buy_n") - F.col("sell_n")), "both": F.col("buy_n") + F.col("sell_n")})
    if first is not None:
        t = joined(t, F.broadcast(first), ["symbol"], "left")
    return along(t, [p for g in groups for p in PARTS[g]], [*TRADE, *[c for g in groups for c in MADE[g]]])


def basis_formulas(t: DataFrame) -> DataFrame:
    """Spot proxy and basis."""
    fb = F.tanh(zero(F.col("r_flow120")))
    fund = F.tanh(0.7 * F.col("f_pressure") + 0.2 * F.col("f_z_f") + 0.1 * F.col("f_stress"))
    t = t.withColumns({"fb": fb, "fund": fund, "spot": F.coalesce("vwap", "price")})
    spot = F.col("spot") * (1 - clip(0.0015 * F.col("fb") + 0.0018 * F.col("fund"), -0.0075, 0.0075))
    t = t.withColumns({"raw": over(F.col("price") - spot, spot), "light": F.tanh(zero(over(F.col("notional"), F.col("med_notional"))))})
    lean = F.signum(zero(F.col("raw"))) * F.tanh(F.abs("fund") + F.abs("fb"))
    t = t.withColumn("basis", zero(clip(F.col("raw") * (0.65 + 0.35 * F.col("light")) * (1 + 0.25 * lean), -0.25, 0.25)))
    return t.withColumns({"_u": F.unix_micros(F.col("ts").cast("timestamp")), "_b": F.abs("basis")})


SEVEN = 7 * 86_400 * 1_000_000
BASIS = [
    Each("m7", ["_u", "_b"], lambda: k.TimeMean(SEVEN, 64), lambda s, u, b: (s(u, b),)), AtTime("last", _m7="m7"), Lag("_m", "_m7"), moments("basis", 512, 32, True), zs("basis", 8.0, "z_b"),
    Lag("p_basis", "basis"), Calc("basis_change", change, "basis", "p_basis"), Calc("basis_velocity", np.divide, "basis_change", "step"),
]


def basis(t: DataFrame) -> DataFrame:
    """Z-score and reversion of the basis."""
    left = (28800 - F.unix_seconds(F.col("ts").cast("timestamp")) % 28800) % 28800
    side, urgency = F.signum("basis"), F.exp(-left / 7200.0)
    aligned = F.tanh(side * (5.0 * F.col("f_rate") + 0.7 * F.col("f_pressure") + 0.4 * side * F.col("fund")))
    going = F.tanh(0.65 * aligned + 0.35 * F.tanh(side * F.abs("basis_velocity") / 0.0015))
    score = side * F.tanh(F.abs("z_b") / 2) * urgency * (0.6 + 0.4 * F.tanh(2 * F.abs("f_stress"))) - going * (1 - 0.45 * urgency)
    return t.withColumns({"basis_flag": F.abs("z_b") >= 2, "compression": F.coalesce(clip(over(F.abs("basis"), F.col("_m")), 0.0, 10.0), F.lit(1.0)), "reversion": clip(score, -1.0, 1.0)})


def liquidation_formulas(t: DataFrame) -> DataFrame:
    t = t.withColumns({"calm": zero(F.col("calm")), "density": zero(over(F.col("r_build"), F.col("r_oi180"))), "toxicity": zero(over(F.col("r_apart"), F.col("r_both")))})
    collapse = F.tanh(7.5 * F.greatest(-F.col("a_velocity"), F.lit(0.0)))

    def volume(side: str, usual: str, move, sign: float):
        spike = zero(F.tanh(over(F.col(side), F.col(usual))))
        push = zero(F.tanh(over(F.greatest(move, F.lit(0.0)), F.col("med_ret"))))
        gate = F.tanh(F.greatest(sign * F.col("lag_z") + F.col("lag_s"), F.lit(0.0)))
        return F.col(side) * clip(spike * push * collapse * gate, 0.0, 1.0)

    t = t.withColumns({"liq_long": volume("sell_n", "med_sell", -F.col("ret"), 1.0), "liq_short": volume("buy_n", "med_buy", F.col("ret"), -1.0)})
    width = F.tanh(4.5 * F.abs("density") + 0.35 * F.abs("a_z_oi") + 0.20 * F.abs("f_z_f"))
    t = t.withColumns({"liq": F.col("liq_long") + F.col("liq_short"), "zone": width / (1 + 40 * F.col("calm")), "one": F.lit(1.0)})
    return t.withColumns({"zone_p": F.col("price") * F.col("zone"), "_t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "_x": 0.5 * F.col("z_oi") + 0.5 * F.col("stress")})


LIQUIDATION = [
    Each("liq_mean heat leverage_flag", ["liq", "_t", "_x"], lambda: [k.span(90), k.Heat(60.0), k.Hysteresis(1.0, 0.35, strict=True)], lambda s, x, u, y: (s[0](x), s[1](u, x), s[2](y))),
    Moments("zone_p", 180, 10, total="r_zone_p"), Moments("zone", 180, 10, total="r_zone"), Quantile("med_liq", "liq", 180, least=5), Calc("near0", share_of, "r_zone_p", "r_zone"), From("near1", "near0", 10),
    So("near", "last", "near1"), Lag("p_liq", "liq"), So("at", "sum", "one"),
    Calc("liq_velocity", lambda x, p, m, i: np.clip(filled(np.divide(change(x, p), m, out=np.full(len(x), np.nan), where=(i >= 5) & (m != 0))), -5.0, 5.0), "liq", "p_liq", "liq_mean", "at"),
]


def liquidation(t: DataFrame) -> DataFrame:
    t = t.withColumns({"liq_imbalance": (F.col("liq_long") - F.col("liq_short")) / (F.col("liq") + 1e-9), "near": F.coalesce("near", "price"), "leverage_flag": F.col("leverage_flag").cast("int")})
    squeeze = clip(1 + F.tanh(1.5 * F.col("zone") + 8 * F.col("oi_pct")), 0.35, 2.0)
    t = t.withColumn("cluster", F.abs(F.col("price") - F.col("near")) / F.col("price") / squeeze)
    fear, fall = F.greatest("f_stress", F.lit(0.0)), F.greatest(-F.col("a_velocity"), F.lit(0.0))
    index = (
        0.30 * zero(F.tanh(over(F.col("liq"), F.col("med_liq")))) + 0.18 * clip(F.abs("liq_imbalance"), 0.0, 1.0) + 0.18 / (1 + 120 * F.col("cluster"))
        + 0.14 * F.tanh(F.abs("liq_velocity")) + 0.20 * F.tanh(fear + 3 * fall)
    )
    cascade = sigmoid(2.6 / (1 + 140 * F.col("cluster")) + 1.6 * F.tanh(fear + 3.5 * fall) + 1.1 * F.tanh(F.abs(zero(F.col("at_aggr")))) + 0.9 * F.tanh(F.col("toxicity")) - 2.7)
    return t.withColumns({"liq_pressure": clip(index, 0.0, 1.0), "cascade": cascade})


def volume_flow(t: DataFrame) -> DataFrame:
    return t.withColumn("delta_ratio", clip(sdiv("volume_delta", "trade_volume"), -1.0, 1.0))


#: By step: the formulas before its pass, what the pass makes and must keep of them, and those after it.
FORMULAS = {
    "basis": (basis_formulas, BASIS, ["fund", "basis", "z_b", "basis_change", "basis_velocity", "_m"], basis),
    "liquidation": (
        liquidation_formulas, LIQUIDATION, ["zone", "oi_pct", "liq", "liq_long", "liq_short", "toxicity", "med_liq", "heat", "leverage_flag", "near", "liq_velocity"], liquidation,
    ),
    "volume": (lambda t: t, [], MADE["volume"], volume_flow),
}


def with_whole(t: DataFrame, whole: dict) -> DataFrame:
    """``t`` with aggregates of each symbol's whole history."""
    return joined(t, F.broadcast(t.groupBy("symbol").agg(*[v.alias(c) for c, v in whole.items()])), ["symbol"], "left")


def leverage(t: DataFrame) -> DataFrame:
    """Products of states, and the mean of their parts at unit variance over
    the whole history of a symbol (a full-sample statistic)."""
    products = {"x_volume": F.col("z_oi") * F.col("delta_ratio"), "x_funding": F.col("z_f") * F.col("z_oi"), "x_basis": F.col("z_b") * F.col("z_oi")}
    kept = [c for c in ("stress", "liq_pressure", "leverage_flag", "z_b", "basis_flag") if c in t.columns]
    t = written(t.select("symbol", "seq", *kept, *[v.alias(c) for c, v in products.items()]))
    t = with_whole(t, {f"s_{c}": F.stddev_pop(c) for c in products})
    parts = [zero(over(F.col(c), F.col(f"s_{c}"))) for c in products]
    return t.withColumn("leverage_pressure", (parts[0] + parts[1] + parts[2]) / 3)


def regime(t: DataFrame) -> DataFrame:
    names = ("stress", "liq_pressure", "leverage_pressure")
    t = with_whole(t, {f"{how}_{c}": f(c) for c in names for how, f in (("w", F.avg), ("d", F.stddev_pop))})
    norm = lambda c: zero(over(F.col(c) - F.col(f"w_{c}"), F.col(f"d_{c}")))
    return t.withColumns({"basis_extreme": (F.abs("z_b") > 2.5) & F.col("basis_flag"), "derivatives_stress": (norm("stress") + norm("liq_pressure") + norm("leverage_pressure")) / 3})


#: Each step on the trades, what it needs of the others, and what comes after them.
NEEDS = {
    "basis": (["basis"], []), "liquidation": (["liquidation"], []), "volume": (["volume"], []), "leverage": (["basis", "volume"], [leverage]),
    "regime": (["basis", "liquidation", "volume"], [leverage, regime]),
}


def upto(spark, sf_dir: str, last: str) -> DataFrame:
    """The timeline after the step ``last``."""
    trades, flow = feeds.trades(spark, sf_dir), feeds.orderflow(spark, sf_dir)
    t = funding(trades, flow)
    if last == "funding":
        return t
    if last == "positioning":
        return positioning(t)
    groups, after = NEEDS[last]
    t = on_trades(t, groups, first_flow(trades, flow) if "basis" in groups else None)
    before, parts, kept, behind = zip(*[FORMULAS[g] for g in groups], strict=True)
    for formulas in before:
        t = formulas(t)
    if any(parts):
        t = along(t, [p for ps in parts for p in ps], [*TRADE, *dict.fromkeys(c for cs in kept for c in cs)])
    for formulas in (*behind, *after):
        t = formulas(t)
    return t


@query(
    f"""WITH {TRADES_SQL}, {FLOW_SQL}, u AS (SELECT symbol, ts, seq, 0 AS feed, price, CASE WHEN aggressor > 0 THEN size ELSE 0 END AS o, CASE WHEN aggressor < 0 THEN size ELSE 0 END AS c FROM trades
  UNION ALL SELECT symbol, ts, seq, 1, price, CASE WHEN event_type = 'add' THEN size WHEN event_type = 'trade' AND aggressor > 0 THEN size * 0.5 ELSE 0 END,
  CASE WHEN event_type = 'cancel' THEN size WHEN event_type = 'trade' AND aggressor < 0 THEN size * 0.5 ELSE 0 END FROM flow),
s AS (SELECT *, sum(o - c) OVER (PARTITION BY symbol ORDER BY ts, seq, feed ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM u),
i AS (SELECT *, r - least(0, min(r) OVER (PARTITION BY symbol ORDER BY ts, seq, feed ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS oi FROM s),
d AS (SELECT *, coalesce(oi - lag(oi) OVER w, 0) AS ch, avg(oi) OVER f AS m, stddev_pop(oi) OVER f AS sd, coalesce(price / lag(price) OVER w - 1, 0) AS ret FROM i
  WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq, feed), f AS (PARTITION BY symbol ORDER BY ts, seq, feed ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT symbol, seq, CAST(feed AS INTEGER) AS feed, round(oi, 4) AS oi, round(ch, 4) AS oi_change, round((oi - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 4) AS z_oi, round(ch - ret, 5) AS divergence,
  round(coalesce(abs(ch) / nullif(oi, 0), 0), 5) AS turnover, round(o / CASE WHEN c > 1e-12 THEN c ELSE 1 END, 5) AS open_close FROM d"""
)
def fut_open_interest(spark, sf_dir):
    t = open_interest(feeds.trades(spark, sf_dir), feeds.orderflow(spark, sf_dir))
    return t.select(
        "symbol", "seq", "feed", rnd("oi", 4).alias("oi"), rnd("oi_change", 4).alias("oi_change"), rnd("z_oi", 4).alias("z_oi"), rnd("divergence", 5).alias("divergence"),
        rnd("turnover", 5).alias("turnover"), rnd("open_close", 5).alias("open_close"),
    )

def _c(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({low}, least({high}, {x})) END)"


def _o(part: str, whole: str) -> str:
    return f"(({part}) / CASE WHEN abs({whole}) > 1e-12 THEN abs({whole}) END)"


def _n(agg: str, x: str, n: int, least: int, order: str = "ts, seq") -> str:
    """An aggregate over the last ``n`` rows, null under ``least`` values."""
    frame = f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {frame} >= {least} THEN {agg.format(x)} {frame} END)"


def _z(x: str, n: int, least: int, past: bool, order: str = "ts, seq") -> str:
    rows = f"{n} PRECEDING AND 1 PRECEDING" if past else f"{n - 1} PRECEDING AND CURRENT ROW"
    frame = f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {rows})"
    return f"coalesce(CASE WHEN count({x}) {frame} >= {least} AND stddev_pop({x}) {frame} > 1e-12 THEN ({x} - avg({x}) {frame}) / stddev_pop({x}) {frame} END, 0)"


_UO = "ts, seq, feed"
_MED = "quantile_cont({}, 0.5)"
_SIG = "0.40 * dp + 0.30 * dp * tanh(35 * oi_change + 0.55 * z_oi) + 0.18 * greatest(-1, least(1, flag_mean)) + 0.12 * tanh(1.4 * stress) * sign(dp)"
_FUNDING_SQL = f"""q0 AS (SELECT symbol, ts, seq, 0 AS feed, price, size, aggressor, CAST(NULL AS VARCHAR) AS kind, 0.0::DOUBLE AS inv, CASE WHEN aggressor > 0 THEN size ELSE 0 END AS o, CASE WHEN aggressor < 0 THEN size ELSE 0 END AS c FROM trades
  UNION ALL SELECT symbol, ts, seq, 1, price, size, aggressor, event_type, inventory_pressure, CASE WHEN event_type = 'add' THEN size WHEN event_type = 'trade' AND aggressor > 0 THEN size * 0.5 ELSE 0 END,
  CASE WHEN event_type = 'cancel' THEN size WHEN event_type = 'trade' AND aggressor < 0 THEN size * 0.5 ELSE 0 END FROM flow),
q1 AS (SELECT *, sum(o - c) OVER (PARTITION BY symbol ORDER BY {_UO} ROWS UNBOUNDED PRECEDING) AS r FROM q0),
q2 AS (SELECT *, r - least(0, min(r) OVER (PARTITION BY symbol ORDER BY {_UO} ROWS UNBOUNDED PRECEDING)) AS oi FROM q1),
q3 AS (SELECT *, coalesce(oi - lag(oi) OVER w, 0) AS oi_change, coalesce(price / nullif(lag(price) OVER w, 0) - 1, 0) AS ret, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap,
  avg(oi) OVER f AS m, stddev_pop(oi) OVER f AS sd, row_number() OVER w AS i, greatest(coalesce(abs(seq - lag(seq) OVER w), 1), 1) AS step FROM q2
  WINDOW w AS (PARTITION BY symbol ORDER BY {_UO}), f AS (PARTITION BY symbol ORDER BY {_UO} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
q4 AS (SELECT *, oi_change / CASE WHEN gap > 0 THEN gap ELSE 1 END AS velocity, (oi - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END AS z_oi FROM q3),
q5 AS MATERIALIZED (SELECT *, last_value(oi) OVER p AS a_oi, last_value(oi_change) OVER p AS a_oi_change, last_value(z_oi) OVER p AS a_z_oi, last_value(velocity) OVER p AS a_velocity FROM q4
  WINDOW p AS (PARTITION BY symbol, ts ORDER BY seq, feed ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ew AS (SELECT symbol, i, price AS y FROM q5 WHERE i = 1 UNION ALL SELECT q5.symbol, q5.i, 2.0 / 301 * q5.price + (1 - 2.0 / 301) * ew.y FROM ew JOIN q5 ON q5.symbol = ew.symbol AND q5.i = ew.i + 1),
f1 AS (SELECT q5.*, coalesce(CASE WHEN q5.i >= 20 THEN y END, max(CASE WHEN q5.i = 20 THEN y END) OVER (PARTITION BY q5.symbol), price) AS fair, CASE WHEN feed = 0 THEN price * size ELSE 0 END AS notional,
  CASE WHEN kind = 'trade' THEN aggressor * size ELSE 0 END AS hit, CASE kind WHEN 'add' THEN size WHEN 'cancel' THEN -size ELSE 0 END AS held FROM q5 JOIN ew ON ew.symbol = q5.symbol AND ew.i = q5.i),
f2 AS (SELECT *, notional * aggressor AS signed, CASE WHEN feed = 0 THEN 0 ELSE hit + 0.20 * held + 0.15 * inv END AS flow, CASE WHEN feed = 1 THEN hit + 0.30 * held + 0.15 * inv END AS flow30 FROM f1),
f3 AS (SELECT *, {_n("sum({})", "signed", 96, 1, _UO)} / ({_n("sum({})", "notional", 96, 1, _UO)} + 1e-9) AS x1, {_n("avg({})", "flow", 128, 1, _UO)} AS x2, {_n("avg({})", "abs(flow)", 128, 1, _UO)} AS x3,
  {_n("avg({})", "a_oi", 96, 1, _UO)} AS x4 FROM f2),
f4 AS (SELECT *, {_o("x2", "x3")} AS y2, {_o("a_oi_change", "x4")} AS y3, {_o("price - fair", "fair")} AS y4, 480 - (hour(ts) * 60 + minute(ts) + second(ts) / 60.0) % 480 AS minutes FROM f3),
f5 AS (SELECT *, {_c("y3", -0.6, 0.6)} AS g, greatest(0.05, least(1.0, exp(-(((minutes - 20) / 18) ** 2)))) AS weight FROM f4),
f6 AS (SELECT *, 0.34 * {_c("x1", -1, 1)} + 0.24 * {_c("y2", -4, 4)} / 4 + 0.24 * (0.6 * g + 0.4 * greatest(-4, least(4, a_z_oi)) / 4) * sign(ret) * sign(g) + 0.18 * {_c("y4", -0.02, 0.02)} / 0.02 AS raw FROM f5),
f7 AS (SELECT *, coalesce(tanh(2.1 * raw * (0.7 + 0.3 * weight)) * 0.0015, 0) AS rate FROM f6),
f8 AS (SELECT *, coalesce(rate - lag(rate) OVER (PARTITION BY symbol ORDER BY {_UO}), 0) AS rate_change, greatest(-8, least(8, {_z("rate", 256, 16, True, _UO)})) AS z_f FROM f7),
f9 AS (SELECT *, rate_change / step AS rate_velocity, z_f * a_z_oi AS stress, abs(z_f) > 2.5 AS funding_extreme, CASE WHEN feed = 1 AND kind = 'trade' AND aggressor <> 0 THEN size END AS exec FROM f8),
f10 AS MATERIALIZED (SELECT *, coalesce(rate_velocity - lag(rate_velocity) OVER w, 0) / step AS rate_acceleration, z_f * rate_velocity * weight AS pressure,
  CAST(count(exec) OVER w AS DOUBLE) AS execs, coalesce(sum(exec) OVER w, 0) AS exec_size FROM f9 WINDOW w AS (PARTITION BY symbol ORDER BY {_UO})),
fl AS (SELECT symbol, i, CASE WHEN rate >= 1e-4 THEN 1 WHEN rate <= -1e-4 THEN -1 ELSE 0 END AS f, CASE WHEN rate >= 1e-4 THEN 1.0 WHEN rate <= -1e-4 THEN -1.0 ELSE 0.0 END::DOUBLE AS flag_mean FROM f10 WHERE i = 1
  UNION ALL SELECT symbol, i, f, 0.1 * f + 0.9 * old FROM (SELECT t.symbol, t.i, fl.flag_mean AS old, CASE WHEN fl.f = 0 THEN CASE WHEN t.rate >= 1e-4 THEN 1 WHEN t.rate <= -1e-4 THEN -1 ELSE 0 END
    WHEN fl.f * t.rate <= 5e-5 THEN 0 ELSE fl.f END AS f FROM fl JOIN f10 t ON t.symbol = fl.symbol AND t.i = fl.i + 1)),
funding AS MATERIALIZED (SELECT f10.*, CAST(f AS INTEGER) AS funding_flag, flag_mean FROM f10 JOIN fl ON fl.symbol = f10.symbol AND fl.i = f10.i)"""
_POSITIONING_SQL = f"""p1 AS (SELECT *, tanh(2400 * rate + 0.42 * z_f) AS dp FROM funding),
p2 AS (SELECT *, greatest(0.5, least(2.0, exp(greatest(-0.693147, least(0.693147, {_SIG}))))) AS ratio FROM p1),
p3 AS (SELECT *, oi * ratio / (1 + ratio) AS long_proxy, oi / (1 + ratio) AS short_proxy FROM p2),
p4 AS (SELECT *, ln((long_proxy + 1e-6) / (short_proxy + 1e-6)) AS skew FROM p3),
positioning AS (SELECT *, coalesce(ratio - lag(ratio) OVER w, 0) AS ratio_change, coalesce(skew - lag(skew) OVER w, 0) AS skew_velocity FROM p4 WINDOW w AS (PARTITION BY symbol ORDER BY {_UO}))"""
_TRADES_SQL = """t1 AS (SELECT * EXCLUDE (i, ret, step, execs, exec_size), last_value(rate) OVER p AS f_rate, last_value(z_f) OVER p AS f_z_f, last_value(pressure) OVER p AS f_pressure, last_value(stress) OVER p AS f_stress,
  avg(flow30) OVER p AS at_flow, avg(CASE WHEN feed = 1 THEN flow END) OVER p AS at_aggr, max(execs) OVER p AS execs, max(exec_size) OVER p AS exec_size FROM funding
  WINDOW p AS (PARTITION BY symbol, ts ORDER BY seq, feed ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t2 AS MATERIALIZED (SELECT *, row_number() OVER w AS i, coalesce(price / nullif(lag(price) OVER w, 0) - 1, 0) AS ret, greatest(coalesce(abs(seq - lag(seq) OVER w), 1), 1) AS step, size * aggressor AS impulse
  FROM t1 WHERE feed = 0 WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))"""
_BASIS_SQL = f"""b1 AS (SELECT *, {_o(_n("sum({})", "notional", 240, 5), _n("sum({})", "size", 240, 5))} AS vwap, coalesce(last_value(at_flow IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING),
  first_value(at_flow IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS flow_mean FROM t2),
b2 AS (SELECT *, tanh(coalesce({_n("avg({})", "flow_mean", 120, 3)}, 0)) AS fb, tanh(0.7 * f_pressure + 0.2 * f_z_f + 0.1 * f_stress) AS fund,
  coalesce(vwap, max(CASE WHEN i = 5 THEN vwap END) OVER (PARTITION BY symbol), price) AS spot0, {_n(_MED, "notional", 180, 5)} AS med FROM b1),
b3 AS (SELECT *, spot0 * (1 - greatest(-0.0075, least(0.0075, 0.0015 * fb + 0.0018 * fund))) AS spot FROM b2),
b4 AS (SELECT *, {_o("price - spot", "spot")} AS rawb, tanh(coalesce({_o("notional", "med")}, 0)) AS light FROM b3),
b5 AS (SELECT *, rawb * (0.65 + 0.35 * light) * (1 + 0.25 * sign(coalesce(rawb, 0)) * tanh(abs(fund) + abs(fb))) AS b0 FROM b4),
b6 AS (SELECT *, coalesce({_c("b0", -0.25, 0.25)}, 0) AS basis FROM b5),
b7 AS (SELECT *, coalesce(basis - lag(basis) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) AS basis_change, greatest(-8, least(8, {_z("basis", 512, 32, True)})) AS z_b,
  (28800 - (epoch_us(ts) // 1000000) % 28800) % 28800 AS secs, CASE WHEN count(basis) OVER v >= 64 THEN avg(abs(basis)) OVER v END AS m7 FROM b6
  WINDOW v AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW)),
b8 AS (SELECT *, basis_change / step AS basis_velocity, abs(z_b) >= 2 AS basis_flag, exp(-secs / 7200.0) AS urgency, lag(m7) OVER (PARTITION BY symbol ORDER BY ts, seq) AS m1 FROM b7),
b9 AS (SELECT *, {_o("abs(basis)", "m1")} AS c0, tanh(0.65 * tanh(sign(basis) * (5.0 * f_rate + 0.7 * f_pressure + 0.4 * sign(basis) * fund)) + 0.35 * tanh(sign(basis) * abs(basis_velocity) / 0.0015)) AS going FROM b8),
basis AS MATERIALIZED (SELECT *, coalesce({_c("c0", 0, 10)}, 1) AS compression,
  greatest(-1, least(1, sign(basis) * tanh(abs(z_b) / 2) * urgency * (0.6 + 0.4 * tanh(2 * abs(f_stress))) - going * (1 - 0.45 * urgency))) AS reversion FROM b9)"""
_LIQUIDATION_SQL = f"""l1 AS (SELECT *, CASE WHEN aggressor < 0 THEN notional ELSE 0 END AS sell_n, CASE WHEN aggressor > 0 THEN notional ELSE 0 END AS buy_n, abs(ret) AS abs_ret, coalesce(lag(f_z_f) OVER w, 0) AS lag_z,
  coalesce(lag(f_stress) OVER w, 0) AS lag_s, lag(a_oi) OVER w AS before FROM t2 WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
l2 AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE greatest(a_oi - before, 0) END AS build, CASE WHEN before > 0 THEN a_oi / before - 1 WHEN before = 0 AND a_oi > 0 THEN 1e9 ELSE 0 END AS oi_pct,
  {_n(_MED, "abs_ret", 240, 10)} AS med_ret, coalesce({_n(_MED, "abs_ret", 90, 5)}, 0) AS calm, {_n(_MED, "sell_n", 180, 5)} AS med_sell, {_n(_MED, "buy_n", 180, 5)} AS med_buy,
  coalesce({_o(_n("sum({})", "abs(buy_n - sell_n)", 120, 5), _n("sum({})", "(buy_n + sell_n)", 120, 5))}, 0) AS toxicity FROM l1),
l3 AS (SELECT *, coalesce({_o(_n("sum({})", "build", 180, 5), _n("avg({})", "a_oi", 180, 5))}, 0) AS density, tanh(7.5 * greatest(-a_velocity, 0)) AS collapse FROM l2),
l4 AS (SELECT *, sell_n * coalesce(tanh({_o("sell_n", "med_sell")}), 0) * coalesce(tanh({_o("greatest(-ret, 0)", "med_ret")}), 0) * collapse * tanh(greatest(lag_z + lag_s, 0)) AS liq_long,
  buy_n * coalesce(tanh({_o("buy_n", "med_buy")}), 0) * coalesce(tanh({_o("greatest(ret, 0)", "med_ret")}), 0) * collapse * tanh(greatest(lag_s - lag_z, 0)) AS liq_short,
  tanh(4.5 * abs(density) + 0.35 * abs(a_z_oi) + 0.20 * abs(f_z_f)) / (1 + 40 * calm) AS zone FROM l3),
l5 AS MATERIALIZED (SELECT *, liq_long + liq_short AS liq, {_o(_n("sum({})", "(price * zone)", 180, 10), _n("sum({})", "zone", 180, 10))} AS near0, 0.5 * z_oi + 0.5 * stress AS score FROM l4),
lr AS (SELECT symbol, i, ts, liq AS y, liq AS h, CASE WHEN score >= 1 THEN 1 WHEN score <= -1 THEN -1 ELSE 0 END AS flag FROM l5 WHERE i = 1
  UNION ALL SELECT t.symbol, t.i, t.ts, 2.0 / 91 * t.liq + (1 - 2.0 / 91) * lr.y, lr.h * exp(-ln(2.0) / 60 * ((epoch_us(t.ts) - epoch_us(lr.ts)) / 1e6)) + t.liq,
  CASE WHEN lr.flag = 0 THEN CASE WHEN t.score >= 1 THEN 1 WHEN t.score <= -1 THEN -1 ELSE 0 END WHEN lr.flag * t.score < 0.35 THEN 0 ELSE lr.flag END FROM lr JOIN l5 t ON t.symbol = lr.symbol AND t.i = lr.i + 1),
l6 AS (SELECT l5.*, y, h AS heat, CAST(flag AS INTEGER) AS leverage_flag, (liq_long - liq_short) / (liq + 1e-9) AS liq_imbalance, {_n(_MED, "liq", 180, 5)} AS med_liq,
  coalesce(liq - lag(liq) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) AS d_liq, coalesce(last_value(near0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING),
  max(CASE WHEN i = 10 THEN near0 END) OVER (PARTITION BY symbol), price) AS near FROM (SELECT l5.*, y, h, flag FROM l5 JOIN lr ON lr.symbol = l5.symbol AND lr.i = l5.i) l5),
l7 AS (SELECT *, abs(price - near) / price / greatest(0.35, least(2.0, 1 + tanh(1.5 * zone + 8 * oi_pct))) AS cluster, greatest(-5, least(5, coalesce(CASE WHEN i >= 5 AND y <> 0 THEN d_liq / y END, 0))) AS liq_velocity FROM l6),
liquidation AS MATERIALIZED (SELECT *, greatest(0, least(1, 0.30 * coalesce(tanh({_o("liq", "med_liq")}), 0) + 0.18 * least(1, abs(liq_imbalance)) + 0.18 / (1 + 120 * cluster) + 0.14 * tanh(abs(liq_velocity))
  + 0.20 * tanh(greatest(f_stress, 0) + 3 * greatest(-a_velocity, 0)))) AS liq_pressure, 1 / (1 + exp(-(2.6 / (1 + 140 * cluster) + 1.6 * tanh(greatest(f_stress, 0) + 3.5 * greatest(-a_velocity, 0))
  + 1.1 * tanh(abs(coalesce(at_aggr, 0))) + 0.9 * tanh(toxicity) - 2.7))) AS cascade FROM l7)"""
_VOLUME_SQL = f"""v1 AS (SELECT *, {_n("quantile_cont({}, 0.95)", "size", 200, 1)} AS p95, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap0, greatest(coalesce(execs - lag(execs) OVER w, execs), 0) AS d_execs,
  greatest(coalesce(exec_size - lag(exec_size) OVER w, exec_size), 0) AS d_exec_size, CASE WHEN i = 1 THEN 0 WHEN i = 2 THEN abs(impulse) ELSE abs(impulse - lag(impulse) OVER w) END AS accel,
  sum(size) OVER w AS trade_volume, sum(impulse) OVER w AS volume_delta FROM t2 WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
v2 AS (SELECT *, CASE WHEN size >= coalesce(CASE WHEN i >= 50 THEN p95 END, max(CASE WHEN i = 50 THEN p95 END) OVER (PARTITION BY symbol), p95) THEN size ELSE 0 END AS large,
  greatest(-1, least(1, coalesce(volume_delta / nullif(trade_volume, 0), 0))) AS delta_ratio, CASE WHEN gap0 > 0 THEN gap0 END AS gap FROM v1),
v3 AS (SELECT *, sum(large) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS large_volume, coalesce({_o(_n("sum({})", "large", 25, 5), _n("sum({})", "size", 25, 5))}, 0) AS share,
  1.0 / greatest(coalesce(first_value(gap IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e-3), 1e-6) AS freq,
  {_n("sum({})", "d_execs", 25, 5)} / 25 + coalesce({_o(_n("sum({})", "d_exec_size", 25, 5), _n("sum({})", "size", 25, 5))}, 0) AS execution FROM v2),
volume AS MATERIALIZED (SELECT *, greatest(0, 0.30 * {_z("freq", 250, 50, False)} + 0.30 * {_z("share", 250, 50, False)} + 0.20 * {_z("accel", 250, 50, False)} + 0.20 * {_z("execution", 250, 50, False)}) AS burst FROM v3)"""
_LEVERAGE_SQL = f"""g1 AS (SELECT b.*, delta_ratio, b.z_oi * delta_ratio AS x_volume, b.z_f * b.z_oi AS x_funding, z_b * b.z_oi AS x_basis FROM basis b JOIN volume v USING (symbol, seq)),
leverage AS MATERIALIZED (SELECT *, ({" + ".join(f"coalesce({_o(c, f'(stddev_pop({c}) OVER (PARTITION BY symbol))')}, 0)" for c in ("x_volume", "x_funding", "x_basis"))}) / 3 AS leverage_pressure FROM g1)"""
_REGIME_SQL = f"""r1 AS (SELECT g.*, liq_pressure, leverage_flag FROM leverage g JOIN liquidation l USING (symbol, seq)),
regime AS (SELECT *, abs(z_b) > 2.5 AND basis_flag AS basis_extreme,
  ({" + ".join(f"coalesce({_o(f'{c} - avg({c}) OVER (PARTITION BY symbol)', f'(stddev_pop({c}) OVER (PARTITION BY symbol))')}, 0)" for c in ("stress", "liq_pressure", "leverage_pressure"))}) / 3 AS derivatives_stress FROM r1)"""
_SQL = {
    "funding": [], "positioning": [_POSITIONING_SQL], "basis": [_TRADES_SQL, _BASIS_SQL], "liquidation": [_TRADES_SQL, _LIQUIDATION_SQL], "volume": [_TRADES_SQL, _VOLUME_SQL],
    "leverage": [_TRADES_SQL, _BASIS_SQL, _VOLUME_SQL, _LEVERAGE_SQL], "regime": [_TRADES_SQL, _BASIS_SQL, _LIQUIDATION_SQL, _VOLUME_SQL, _LEVERAGE_SQL, _REGIME_SQL],
}


def step_sql(name: str, columns: list[str], flags: list[str], key: tuple[str, ...]) -> str:
    parts = ", ".join([TRADES_SQL, FLOW_SQL, _FUNDING_SQL, *_SQL[name]])
    cast = {"feed": "CAST(feed AS INTEGER) AS feed"}
    shown = ", ".join([*[cast.get(c, c) for c in key], *[f"round({c}, 6) + 0.0 AS {c}" for c in columns], *flags])
    return f"WITH RECURSIVE {parts} SELECT {shown} FROM {name}"


def _step(name: str, columns: list[str], flags: list[str] = (), key: tuple[str, ...] = ("symbol", "seq")):
    def run(spark, sf_dir):
        return upto(spark, sf_dir, name).select(*key, *[rnd(c, 6).alias(c) for c in columns], *flags)

    run.__name__ = f"fut_{name}"
    run.__doc__ = f"The {name} step of the futures pipeline."
    query(step_sql(name, columns, flags, key))(run)


_step("funding", ["rate", "rate_change", "rate_velocity", "rate_acceleration", "z_f", "pressure", "stress", "weight"], ["funding_flag", "funding_extreme"], ("symbol", "seq", "feed"))
_step("positioning", ["ratio", "ratio_change", "long_proxy", "short_proxy", "skew", "skew_velocity"], [], ("symbol", "seq", "feed"))
_step("basis", ["basis", "basis_change", "basis_velocity", "z_b", "compression", "reversion"], ["basis_flag"])
_step("liquidation", ["liq_long", "liq_short", "liq_imbalance", "cluster", "liq_velocity", "liq_pressure", "cascade", "heat"])
_step("volume", ["trade_volume", "volume_delta", "delta_ratio", "large_volume", "burst"])
_step("leverage", ["x_volume", "x_funding", "x_basis", "leverage_pressure"])
_step("regime", ["derivatives_stress"], ["leverage_flag", "basis_extreme"])
