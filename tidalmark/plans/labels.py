"""Reversal labels from microstructure features, and the choice of an option leg."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import norm_cdf, norm_cdf_sql, rnd
from ..operators.blocks import ROWS, joined, windowed
from ..operators.ordered import window_quantile
from ..operators.scan import Cooldown, scan
from ..sources import feeds
from ..sources.feeds import CHAIN_SQL, TRADES_SQL
from .micro import BAR, ms_features
from .options import around_spot, d1_of
from .registry import ORACLE_SQL, query


def extrema(x: np.ndarray, n: int, ends: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Rows above (below) all ``n`` rows before and behind them, as far as there are
    any; the series' first and last row are none.  ``ends`` says whether the
    array starts and ends with those."""
    high, low = np.ones(len(x), bool), np.ones(len(x), bool)
    for k in range(1, n + 1):
        for here, there in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            high[here] &= x[here] > x[there]
            low[here] &= x[here] < x[there]
    for at, is_end in zip((0, -1), ends, strict=True):
        if is_end and len(x):
            high[at] = low[at] = False
    return high, low


def _near(marks: np.ndarray, n: int) -> np.ndarray:
    """Whether a mark is at most ``n`` rows away."""
    total = np.concatenate([[0], np.cumsum(marks)])
    at = np.arange(len(marks))
    return total[np.minimum(at + n + 1, len(marks))] > total[np.maximum(at - n, 0)]


def reversal_candidates(lookback: int = 20, roc: float = 0.008, around: int = 5, spike: float = 1.5, strong: float = 2.5):
    """The kernel: rows whose aggression exceeds its median, next to a divergence
    (``around`` rows), an extremum (half the lookback), or with a strong move."""
    order, reach, back = max(1, lookback // 4), max(3, lookback // 2), max(1, lookback // 2)

    def kernel(x, pos, own):
        close, mid, aggression = x["close"], x["mid"], x["aggression"]
        high, low = extrema(close, order, (pos[0] == 0, own.stop == len(pos)))
        turn = high | low
        slope, drift = np.diff(close, prepend=close[:1]), np.diff(mid, prepend=mid[:1])
        apart = (slope * drift < 0) & (np.abs(slope) > np.abs(drift) * 1.2 + 1e-12) & (np.abs(drift) <= np.abs(slope) * 0.6)
        diverged = (turn & apart) | (np.trunc(x["divergence"]) > 0)
        median = window_quantile(aggression, lookback, 0.5)
        move = np.zeros(len(close))
        move[back:] = close[back:] / close[:-back] - 1
        near = _near(diverged, around) | _near(turn, reach) | ((np.abs(move) >= roc * 0.5) & (aggression > median * strong))
        return turn[own], diverged[own], ((aggression > median * spike + 1e-12) & near)[own]

    return kernel, max(lookback, back, reach + order, around + order + 1)


def reversal_label(bars: DataFrame, gap: float, rows: int = ROWS, **options) -> DataFrame:
    """``bars`` (symbol, ts, seq, close, mid, aggression, divergence; none null) with
    ``turn``, ``diverged``, ``candidate`` and ``reversal``: of the candidates, in order
    of time, those ``gap`` seconds or more after the last one taken.

    The bars lie in blocks with the rows that a block's own ones look back and
    ahead on; only candidates go to the pass that spaces them.
    """
    kernel, reach = reversal_candidates(**options)
    made = windowed(bars, ["close", "mid", "aggression", "divergence"], "turn boolean, diverged boolean, candidate boolean", kernel, back=reach, ahead=reach, rows=max(rows, reach))
    wanted = made.where("candidate").select("symbol", "ts", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    taken = scan(wanted, ["t"], "reversal boolean", lambda: Cooldown(gap), lambda s, t: (s(t),)).select("symbol", "seq", "reversal")
    return joined(made, taken, ["symbol", "seq"], "left").withColumn("reversal", F.coalesce("reversal", F.lit(False)))


GAP = 3 * BAR


@query(
    f"""WITH RECURSIVE {TRADES_SQL}, ms AS ({ORACLE_SQL['ms_features']}),
cl AS (SELECT symbol, CAST(floor(epoch_us(ts) / 1e6 / {BAR}) AS BIGINT) AS bar, arg_max(price, ts) AS close FROM trades GROUP BY 1, 2),
a AS (SELECT ms.symbol, ms.bar, cl.close, ms_mid AS mid, ms_aggression_idx AS aggr, ms_micro_divergence AS dv FROM ms JOIN cl ON cl.symbol = ms.symbol AND cl.bar = ms.bar),
b AS (SELECT *, coalesce(close - lag(close) OVER w, 0) AS ps, coalesce(mid - lag(mid) OVER w, 0) AS mm, coalesce(close / lag(close, 10) OVER w - 1, 0) AS roc,
  median(aggr) OVER (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING) AS med,
  max(close) OVER p AS ph, max(close) OVER f AS fh, min(close) OVER p AS pl, min(close) OVER f AS fl FROM a
  WINDOW w AS (PARTITION BY symbol ORDER BY bar), p AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
c AS (SELECT *, coalesce(close > ph AND close > fh OR close < pl AND close < fl, false) AS turn FROM b),
d AS (SELECT *, turn AND ps * mm < 0 AND abs(ps) > abs(mm) * 1.2 + 1e-12 AND abs(mm) <= abs(ps) * 0.6 OR trunc(dv) > 0 AS diverged FROM c),
e AS (SELECT *, aggr > med * 1.5 + 1e-12 AND (bool_or(diverged) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
  OR bool_or(turn) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) OR abs(roc) >= 0.004 AND aggr > med * 2.5) AS candidate FROM d),
n AS (SELECT x.symbol, x.bar, min(y.bar) AS next FROM e x LEFT JOIN e y ON y.symbol = x.symbol AND y.candidate AND y.bar >= x.bar + 3 WHERE x.candidate GROUP BY 1, 2),
r AS (SELECT symbol, min(bar) AS bar FROM n GROUP BY symbol UNION ALL SELECT n.symbol, n.next FROM r JOIN n ON n.symbol = r.symbol AND n.bar = r.bar AND n.next IS NOT NULL)
SELECT e.symbol, e.bar, e.turn, e.diverged, e.candidate, r.bar IS NOT NULL AS reversal FROM e LEFT JOIN r ON r.symbol = e.symbol AND r.bar = e.bar"""
)
def label_reversal(spark, sf_dir):
    """Reversals of the bars of ``ms_features``, at least three bars apart."""
    from ..operators.grid import bucket

    t = feeds.trades(spark, sf_dir)
    closes = t.groupBy("symbol", bucket(BAR).alias("bar")).agg(F.max_by("price", F.struct("ts", "seq")).alias("close"))
    m = joined(ms_features(spark, sf_dir), closes, ["symbol", "bar"])
    bars = m.select(
        "symbol", F.timestamp_micros(F.col("bar") * (BAR * 1000000)).cast("timestamp_ntz").alias("ts"), F.col("bar").alias("seq"), "close",
        F.col("ms_mid").alias("mid"), F.col("ms_aggression_idx").alias("aggression"), F.col("ms_micro_divergence").alias("divergence"),
    )
    return reversal_label(bars, GAP).select("symbol", F.col("seq").alias("bar"), "turn", "diverged", "candidate", "reversal")


def spread_percent(bid: Column, ask: Column) -> Column:
    return F.when(ask <= 0, 999.0).otherwise(F.greatest(F.lit(0.0), 100.0 * (ask - bid) / F.greatest(F.lit(1e-9), ask)))


def route(
    quotes: DataFrame,
    side: str,
    keys: tuple[str, ...] = ("symbol", "ts"),
    expiries: int = 3,
    band: tuple[float, float] = (0.25, 0.35),
    min_oi: float = 50,
    min_volume: float = 10,
    max_spread: float = 3.0,
    slip: float = 0.005,
    ties: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """One leg a snapshot: of the nearest ``expiries``, the first that has a liquid
    quote within the band of deltas; in it the tightest spread, then the delta
    closest to the band's middle, then ``ties``.

    ``quotes`` has expiry, strike, bid, ask, mid, delta, oi, volume.  Best legs are
    found by expiry with partial aggregates, so a snapshot of any size is no
    group in one task; the second aggregate holds one row an expiry.  Snapshots
    without a leg are left out.  ``skipped`` counts nearer expiries without one.
    """
    spread = spread_percent(F.col("bid"), F.col("ask"))
    size = F.abs("delta")
    fits = (F.col("oi") >= min_oi) & (F.col("volume") >= min_volume) & (spread <= max_spread) & size.between(*band)
    merit = F.struct(spread.alias("s"), F.abs(size - (band[0] + band[1]) / 2).alias("d"), *ties)
    leg = F.struct("strike", "bid", "ask", "mid", "delta", spread.alias("spread_pct"))
    by_expiry = quotes.groupBy(*keys, "expiry").agg(F.min_by(F.when(fits, leg), F.when(fits, merit)).alias("leg"))
    listed = by_expiry.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("expiry", "leg"))), 1, expiries).alias("e"))
    found = listed.select(*keys, F.get(F.filter("e", lambda x: x["leg"].isNotNull()), F.lit(0)).alias("f"), F.expr("array_position(transform(e, x -> x.leg IS NOT NULL), true)").alias("k"))
    legs = found.where("f IS NOT NULL").select(*keys, "f.expiry", "f.leg.*", (F.col("k") - 1).cast("long").alias("skipped"))
    mid = F.when(F.col("mid") > 0, F.col("mid")).otherwise((F.col("bid") + F.col("ask")) / 2)
    limit = F.least("ask", mid * (1.0 + slip)) if "BUY" in side else F.greatest("bid", mid * (1.0 - slip))
    return legs.withColumns({"mid": mid, "limit_price": F.round(limit, 8), "side": F.lit(side)})


@query(
    f"""WITH {CHAIN_SQL}, q AS (SELECT *, premium * (1 - (iv - bid_iv)) AS bid, premium * (1 + (ask_iv - iv)) AS ask, (ln(spot / (strike * 5)) + 0.5 * iv * iv * tte / 12) / (iv * sqrt(tte / 12)) AS d1 FROM chain),
d AS (SELECT *, {norm_cdf_sql('d1')} - CASE WHEN kind = 'call' THEN 0 ELSE 1 END AS delta, 100 * (ask - bid) / ask AS sp, dense_rank() OVER (PARTITION BY symbol, ts ORDER BY tte) AS e FROM q),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY tte, sp, abs(abs(delta) - 0.3), seq, strike, premium) AS r FROM d WHERE e <= 3 AND oi >= 20 AND volume >= 10 AND sp <= 1 AND abs(delta) BETWEEN 0.25 AND 0.35),
l AS (SELECT symbol, ts, tte AS expiry, strike * 5 AS strike, delta, sp, premium AS mid, bid, ask, e - 1 AS skipped FROM c WHERE r = 1)
SELECT symbol, ts, side, expiry, strike, round(delta, 6) AS delta, round(sp, 6) AS spread_pct, round(mid, 6) AS mid, skipped,
  round(CASE WHEN side = 'BUY' THEN least(ask, mid * 1.002) ELSE greatest(bid, mid * 0.998) END, 8) AS limit_price FROM l CROSS JOIN (VALUES ('BUY'), ('SELL')) s(side)"""
)
def option_route(spark, sf_dir):
    """The leg to buy and to sell of each symbol and time, with fall-through to later expiries."""
    c = around_spot(feeds.chain(spark, sf_dir))
    nd = norm_cdf(d1_of(c)[0])
    q = c.withColumns({
        "expiry": F.col("tte"), "bid": F.col("premium") * (1 - (F.col("iv") - F.col("bid_iv"))), "ask": F.col("premium") * (1 + (F.col("ask_iv") - F.col("iv"))), "mid": F.col("premium"),
        "delta": F.when(F.col("kind") == "call", nd).otherwise(nd - 1.0),
    })
    legs = [route(q, side, min_oi=20, max_spread=1.0, slip=0.002, ties=("seq", "strike", "premium")) for side in ("BUY", "SELL")]
    return legs[0].unionByName(legs[1]).select(
        "symbol", "ts", "side", "expiry", "strike", rnd("delta").alias("delta"), rnd("spread_pct").alias("spread_pct"), rnd("mid").alias("mid"), "skipped", rnd("limit_price", 8).alias("limit_price")
    )
