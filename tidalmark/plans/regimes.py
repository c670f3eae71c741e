"""The market-regime family: fifteen features of a snapshot and the one before it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, rnd, sdiv
from ..operators.blocks import windowed
from ..operators.quality import QualityError
from ..sources import feeds
from ..sources.feeds import TRADES_SQL
from .registry import query

#: The columns that a snapshot must have, none of them null.
NEEDED = """micro_volatility best_bid_iv best_ask_iv spread previous_spread top_bid top_ask depth_bid depth_ask cancellation_rate new_order_rate turnover resilience
    elasticity hidden_ratio signed_volume previous_signed_volume aggressor_ratio polarity burst near_volatility tick_direction tick_return previous_tick_return
    previous_realized_vol previous_turnover previous_resilience""".split()  # fmt: skip
TINY = 1e-6


def market_regime(snapshots: DataFrame, keep: tuple[str, ...] = ("symbol", "seq")) -> DataFrame:
    """``keep`` and the fifteen features, row by row.

    A missing column is an error.  A row with a null in a needed column has null
    features (the quality gate rejects such tables before); a ratio over zero
    is 0.
    """
    if missing := sorted(set(NEEDED) - set(snapshots.columns)):
        raise QualityError(f"missing columns: {missing}")
    c = F.col
    spread, was = c("spread"), c("previous_spread")
    top, depth = c("top_bid") + c("top_ask"), c("depth_bid") + c("depth_ask")
    vol, vol_was = c("micro_volatility"), c("previous_realized_vol")
    liquidity = 0.4 / (1 + spread) + 0.4 * clip(sdiv(top, depth), 0.0, 1.0) + 0.2 * clip(1 - c("cancellation_rate") / (c("new_order_rate") + TINY), 0.0, 1.0)
    moved = (c("signed_volume") - c("previous_signed_volume")) / (F.abs("previous_signed_volume") + TINY)
    rising = (c("tick_return") > 0) & (c("previous_tick_return") > 0) & (c("polarity") > 0) & (c("tick_direction") > 0)
    turning = (c("tick_return") * c("previous_tick_return") < 0) | (c("polarity") < -0.5)
    uneven = F.abs(c("turnover") - c("previous_turnover")) + F.abs(c("resilience") - c("previous_resilience"))
    micro = 0.4 / (1 + spread) + 0.3 * F.tanh("elasticity") + 0.2 * (1 - F.greatest("hidden_ratio", F.lit(0.0))) + 0.1 * F.greatest(sdiv(top, spread + TINY), F.lit(0.0))
    whole = sum((c(n).isNull().cast("int") for n in NEEDED), F.lit(0)) == 0
    made = {
        "realized_vol": vol, "iv_atm": (c("best_bid_iv") + c("best_ask_iv")) / 2, "liquidity_score": clip(liquidity, 0.0, 1.0), "volatility_spike_flag": vol > 1.5 * vol_was,
        "spread_stability": clip(1 - F.abs(spread - was) / (F.abs(was) + TINY), 0.0, 1.0), "orderflow_extremeness": moved * (1 + c("aggressor_ratio")),
        "market_state_flag": F.when(rising, "trend").when(turning, "mean_revert").otherwise("range"), "spread_zscore": (spread - was) / (F.abs(was) + TINY),
        "liquidity_fractal_index": clip(uneven / (F.abs("turnover") + F.abs("resilience") + TINY), 0.0, 2.0), "depth_stress_ratio": sdiv(spread, depth + TINY),
        "volatility_compression_flag": vol < 0.8 * vol_was, "momentum_ignition_flag": (c("burst") > 1) & (spread < was) & (vol > vol_was),
        "spread_regime_crossover": (spread > 1.25 * was) | (spread < 0.8 * was), "short_term_vol_forecast_error": vol - c("near_volatility"), "micro_liquidity_index": clip(micro, 0.0, 1.0),
    }
    return snapshots.select(*keep, *[F.when(whole, v).alias(n) for n, v in made.items()])


PAST = ["price", "size", "signed_volume", "turnover", "resilience"]


def _before(x, pos, own):
    """Values of the row before, and the price of the one before that."""
    shifted = [np.append(np.nan, x[c][:-1])[own] for c in PAST]
    return (*shifted, np.concatenate([[np.nan, np.nan], x["price"]])[: len(x["price"])][own])


def snapshots(spark, sf_dir) -> DataFrame:
    """A snapshot at each trade that has two before it, its book and rates by the trade's number."""
    c = F.col
    t = feeds.trades(spark, sf_dir).select(
        "symbol", "ts", "seq", "price", "size", "aggressor", (c("size") * c("aggressor")).alias("signed_volume"), (c("seq") % 11 / 10).alias("turnover"), (c("seq") % 13 / 12).alias("resilience")
    )
    t = windowed(t, PAST, ", ".join(f"{p}_1 double" for p in PAST) + ", price_2 double", _before, back=2).where("price_2 IS NOT NULL")
    ret, ret1 = c("price") / c("price_1") - 1, c("price_1") / c("price_2") - 1
    wide = lambda size: 1 + size * 0.003
    return t.select(
        "symbol", "seq", F.abs(ret).alias("micro_volatility"), (0.2 + c("size") / 1000).alias("best_bid_iv"), (0.21 + c("size") / 1000).alias("best_ask_iv"), wide(c("size")).alias("spread"),
        wide(c("size_1")).alias("previous_spread"), c("size").alias("top_bid"), (c("size") * 2 + 1).alias("top_ask"), (c("size") * 3 + c("seq") % 5).alias("depth_bid"), (c("size") * 2 + 1 + c("seq") % 3).alias("depth_ask"),
        (c("seq") % 7 / 7).alias("cancellation_rate"), (c("seq") % 5 / 4).alias("new_order_rate"), "turnover", "resilience", ((c("seq") % 9 - 4) / 4).alias("elasticity"), (c("seq") % 6 / 5).alias("hidden_ratio"),
        "signed_volume", c("signed_volume_1").alias("previous_signed_volume"), (c("seq") % 4 / 4).alias("aggressor_ratio"), (c("aggressor") * (c("seq") % 3) / 2).alias("polarity"), (c("seq") % 3).cast("double").alias("burst"),
        F.lit(0.02).alias("near_volatility"), F.signum(c("price") - c("price_1")).alias("tick_direction"), ret.alias("tick_return"), ret1.alias("previous_tick_return"), F.abs(ret1).alias("previous_realized_vol"),
        c("turnover_1").alias("previous_turnover"), c("resilience_1").alias("previous_resilience"),
    )


_DIGITS = {"orderflow_extremeness": 4}
_NUMBERS = """realized_vol iv_atm liquidity_score spread_stability orderflow_extremeness spread_zscore liquidity_fractal_index depth_stress_ratio short_term_vol_forecast_error micro_liquidity_index""".split()


@query(
    f"""WITH {TRADES_SQL}, a AS (SELECT *, size * aggressor AS sv, seq % 11 / 10 AS tu, seq % 13 / 12 AS re, lag(price) OVER w AS p1, lag(price, 2) OVER w AS p2, 1 + size * 0.003 AS sp, 1 + lag(size) OVER w * 0.003 AS sp1,
  lag(size * aggressor) OVER w AS sv1, lag(seq % 11 / 10) OVER w AS tu1, lag(seq % 13 / 12) OVER w AS re1, size * 3 + 1 AS top, size * 5 + 1 + seq % 5 + seq % 3 AS depth, seq % 3 * aggressor / 2 AS pol
  FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
b AS (SELECT *, price / p1 - 1 AS r, p1 / p2 - 1 AS r1 FROM a WHERE p2 IS NOT NULL),
f AS (SELECT symbol, seq, abs(r) AS realized_vol, (0.41 + size / 500) / 2 AS iv_atm,
  least(greatest(0.4 / (1 + sp) + 0.4 * least(greatest(top / depth, 0), 1) + 0.2 * least(greatest(1 - seq % 7 / 7 / (seq % 5 / 4 + 1e-6), 0), 1), 0), 1) AS liquidity_score, abs(r) > 1.5 * abs(r1) AS volatility_spike_flag,
  least(greatest(1 - abs(sp - sp1) / (abs(sp1) + 1e-6), 0), 1) AS spread_stability, (sv - sv1) / (abs(sv1) + 1e-6) * (1 + seq % 4 / 4) AS orderflow_extremeness,
  CASE WHEN r > 0 AND r1 > 0 AND pol > 0 THEN 'trend' WHEN r * r1 < 0 OR pol < -0.5 THEN 'mean_revert' ELSE 'range' END AS market_state_flag, (sp - sp1) / (abs(sp1) + 1e-6) AS spread_zscore,
  least((abs(tu - tu1) + abs(re - re1)) / (tu + re + 1e-6), 2) AS liquidity_fractal_index, sp / (depth + 1e-6) AS depth_stress_ratio, abs(r) < 0.8 * abs(r1) AS volatility_compression_flag,
  seq % 3 > 1 AND sp < sp1 AND abs(r) > abs(r1) AS momentum_ignition_flag, sp > 1.25 * sp1 OR sp < 0.8 * sp1 AS spread_regime_crossover, abs(r) - 0.02 AS short_term_vol_forecast_error,
  least(greatest(0.4 / (1 + sp) + 0.3 * (1 - 2 / (exp((seq % 9 - 4) / 2) + 1)) + 0.2 * (1 - seq % 6 / 5) + 0.1 * top / (sp + 1e-6), 0), 1) AS micro_liquidity_index FROM b)
SELECT symbol, seq, {', '.join(f'round({n} + 1e-9, {_DIGITS.get(n, 6)}) + 0.0 AS {n}' for n in _NUMBERS)}, volatility_spike_flag, market_state_flag, volatility_compression_flag, momentum_ignition_flag, spread_regime_crossover FROM f"""
)
def fam_market_regime(spark, sf_dir):
    """The whole family of every trade's snapshot."""
    made = market_regime(snapshots(spark, sf_dir))
    return made.select(*[rnd(F.col(n) + 1e-9, _DIGITS.get(n, 6)).alias(n) if n in _NUMBERS else n for n in made.columns])
