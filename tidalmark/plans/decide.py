"""Decisions from trend and model signals, trade signals, and the figures of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import last_n, ordered, rnd, sdiv, sigmoid
from ..operators.blocks import Highest, Linear, joined, scanned
from ..sources import feeds
from ..sources.feeds import BARS_SQL
from .registry import query
from .strategy import LEDGER_SQL, ledger

#: Thresholds, and by profile the stop and the trail in multiples of range and average.
STOPS = {"scalp": 0.9, "runner": 1.2, "trend": 1.5}
TRAILS = {"scalp": 1.1, "runner": 1.3, "trend": 1.6}
LONG, SHORT = 0.55, 0.45


@dataclass(frozen=True)
class Limits:
    confidence: float = 0.55
    reversal: float = 0.35
    base: float = 0.5
    least: float = 0.1
    most: float = 2.0
    calm: tuple[float, float] = (5.0, 95.0)
    stops: dict = field(default_factory=lambda: dict(STOPS))
    trails: dict = field(default_factory=lambda: dict(TRAILS))


def by_profile(profile: Column, values: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), profile)


def decide(signals: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``signals`` with ``action`` (BUY_CALL, BUY_PUT or FLAT), ``size_risk_pct``, ``stop_atr_mult``,
    ``trail_kama_mult`` and ``reason``.

    Columns read: profile, direction, fresh, regime_conf, impulse_p, reversal_p_3,
    reversal_p_5, whipsaw_risk (null: 0.3) and iv_percentile (null: not
    considered).  The first gate that closes gives FLAT: no direction, little
    confidence, a likely reversal.  A null direction or confidence closes its
    gate, a null chance of reversal counts as 0, a null impulse as well.
    """
    c = F.col
    reversal = F.coalesce(F.greatest("reversal_p_3", "reversal_p_5"), F.lit(0.0))
    confidence, direction = F.coalesce("regime_conf", F.lit(0.0)), F.coalesce("direction", F.lit(0))
    extreme = F.coalesce((c("iv_percentile") < limits.calm[0]) | (c("iv_percentile") > limits.calm[1]), F.lit(False))
    times = (0.5 + confidence) * (0.5 + 0.8 * F.coalesce("impulse_p", F.lit(0.0))) * F.greatest(F.lit(0.5), 1.2 - F.coalesce("whipsaw_risk", F.lit(0.3))) * F.when(extreme, 0.8).otherwise(1.0)
    size = F.greatest(F.lit(limits.least), F.least(F.lit(limits.most), limits.base * times))
    neutral, unsure, turning = direction == 0, confidence < limits.confidence, reversal > limits.reversal
    flat = neutral | unsure | turning
    taken = F.format_string("%s dir=%d fresh=%s conf=%.2f imp=%.2f size=%.2f%%", "profile", direction, F.initcap(c("fresh").cast("string")), confidence, F.coalesce("impulse_p", F.lit(0.0)), size)
    reason = F.when(neutral, "Neutral trend").when(unsure, F.format_string("Low regime confidence %.2f", confidence)).when(turning, F.format_string("High reversal risk %.2f", reversal)).otherwise(taken)
    return signals.withColumns({
        "action": F.when(flat, "FLAT").when(direction > 0, "BUY_CALL").otherwise("BUY_PUT"), "size_risk_pct": F.when(flat, 0.0).otherwise(size),
        "stop_atr_mult": by_profile(c("profile"), limits.stops), "trail_kama_mult": by_profile(c("profile"), limits.trails), "reason": reason,
    })


def trade_signal(chance: Column) -> tuple[Column, Column]:
    """Direction and strength by the chance of a rise; a null chance is flat."""
    way = F.when(chance >= LONG, "long").when(chance <= SHORT, "short").otherwise("flat")
    return way, F.when(chance >= LONG, chance).when(chance <= SHORT, 1 - chance).otherwise(0.0)


SIGNALS_SQL = BARS_SQL + """,
a AS (SELECT symbol, seq, close / avg(close) OVER w20 - 1 AS gap, close / lag(close) OVER w - 1 AS r1, signed / nullif(volume, 0) AS imb, avg(close) OVER w5 - avg(close) OVER w20 AS lean,
  CASE seq % 3 WHEN 0 THEN 'scalp' WHEN 1 THEN 'runner' ELSE 'trend' END AS profile FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY seq), w5 AS (PARTITION BY symbol ORDER BY seq ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING)),
signals AS (SELECT symbol, seq, profile, CAST(sign(lean) AS INTEGER) AS direction, coalesce(sign(lean) <> sign(lag(lean) OVER w), true) AS fresh, round(1 / (1 + exp(-4 * abs(gap))), 4) AS regime_conf,
  round(1 / (1 + exp(-2 * imb)), 4) AS impulse_p, round(0.3 / (1 + exp(-3 * r1)) + 0.1, 4) AS reversal_p_3, round(0.3 / (1 + exp(2 * gap)) + 0.1, 4) AS reversal_p_5,
  CASE WHEN seq % 4 <> 0 THEN CAST(seq * 7 % 100 AS DOUBLE) END AS iv_percentile, round(0.1 + 0.5 * abs(coalesce(imb, 0)), 4) AS whipsaw_risk FROM a WINDOW w AS (PARTITION BY symbol ORDER BY seq))"""


def signals(spark, sf_dir) -> DataFrame:
    """Signals of every hourly bar, from its price, returns and flow."""
    w = ordered("symbol")
    c = F.col
    a = feeds.bars(spark, sf_dir).select(
        "symbol", "ts", "seq", (c("close") / F.avg("close").over(last_n(w, 20)) - 1).alias("gap"), (c("close") / F.lag("close").over(w) - 1).alias("r1"), sdiv("signed", "volume", None).alias("imb"),
        (F.avg("close").over(last_n(w, 5)) - F.avg("close").over(last_n(w, 20))).alias("lean"), F.when(c("seq") % 3 == 0, "scalp").when(c("seq") % 3 == 1, "runner").otherwise("trend").alias("profile"),
    )
    return a.select(
        "symbol", "seq", "profile", F.signum("lean").cast("int").alias("direction"), F.coalesce(F.signum("lean") != F.signum(F.lag("lean").over(w)), F.lit(True)).alias("fresh"),
        rnd(sigmoid(4 * F.abs("gap")), 4).alias("regime_conf"), rnd(sigmoid(2 * c("imb")), 4).alias("impulse_p"), rnd(0.3 * sigmoid(3 * c("r1")) + 0.1, 4).alias("reversal_p_3"),
        rnd(0.3 * sigmoid(-2 * c("gap")) + 0.1, 4).alias("reversal_p_5"), F.when(c("seq") % 4 != 0, (c("seq") * 7 % 100).cast("double")).alias("iv_percentile"),
        rnd(0.1 + 0.5 * F.abs(F.coalesce("imb", F.lit(0.0))), 4).alias("whipsaw_risk"),
    )


@query(
    f"""WITH {SIGNALS_SQL},
d AS (SELECT *, greatest(0.1, least(2.0, 0.5 * (0.5 + regime_conf) * (0.5 + 0.8 * coalesce(impulse_p, 0)) * greatest(0.5, 1.2 - whipsaw_risk) * CASE WHEN iv_percentile < 5 OR iv_percentile > 95 THEN 0.8 ELSE 1 END)) AS size,
  direction = 0 OR regime_conf < 0.55 OR greatest(coalesce(reversal_p_3, 0), reversal_p_5) > 0.35 AS flat FROM signals)
SELECT symbol, seq, profile, CASE WHEN flat THEN 'FLAT' WHEN direction > 0 THEN 'BUY_CALL' ELSE 'BUY_PUT' END AS action, round(CASE WHEN flat THEN 0 ELSE size + 1e-9 END, 6) AS size_risk_pct,
  CASE profile WHEN 'scalp' THEN 0.9 WHEN 'runner' THEN 1.2 ELSE 1.5 END::DOUBLE AS stop_atr_mult, CASE profile WHEN 'scalp' THEN 1.1 WHEN 'runner' THEN 1.3 ELSE 1.6 END::DOUBLE AS trail_kama_mult,
  CASE WHEN direction = 0 THEN 'Neutral trend' WHEN regime_conf < 0.55 THEN 'Low regime confidence' WHEN flat THEN 'High reversal risk' ELSE profile || ' dir=' || direction || ' fresh=' || CASE WHEN fresh THEN 'True' ELSE 'False' END END AS reason FROM d"""
)
def policy_decide(spark, sf_dir):
    """Decisions on every bar; of the reason, what stands before its rounded figures."""
    made = decide(signals(spark, sf_dir))
    words = F.regexp_replace("reason", r"( conf=.*| [0-9.]+)$", "")
    return made.select("symbol", "seq", "profile", "action", rnd(F.col("size_risk_pct") + 1e-9).alias("size_risk_pct"), "stop_atr_mult", "trail_kama_mult", words.alias("reason"))


@query(
    f"""WITH {SIGNALS_SQL} SELECT symbol, seq, CASE WHEN impulse_p >= 0.55 THEN 'long' WHEN impulse_p <= 0.45 THEN 'short' ELSE 'flat' END AS direction,
  round(CASE WHEN impulse_p >= 0.55 THEN impulse_p WHEN impulse_p <= 0.45 THEN 1 - impulse_p ELSE 0 END, 6) AS strength FROM signals"""
)
def trade_signals(spark, sf_dir):
    way, strength = trade_signal(F.col("impulse_p"))
    return signals(spark, sf_dir).select("symbol", "seq", way.alias("direction"), rnd(strength).alias("strength"))


def run_metrics(trades: DataFrame, initial: float = 1000.0) -> DataFrame:
    """One row of figures for ``trades`` (day, pnl in percent, win, profile): capital, counts
    and rates of trades and days, mean percentages, and trades a day by profile.

    Trades of other profiles count as scalps.  Capital is compounded by sums of
    logarithms, so it needs no order; a loss of 100 % or more makes the product
    by sign and size, and one of exactly 100 % leaves nothing.  No trades leave
    the initial capital and zeros.
    """
    c = F.col
    factor = 1 + c("pnl") / 100
    kind = F.when(c("profile").isin("runner", "trend"), c("profile")).otherwise("scalp")
    won = F.coalesce("win", F.lit(False))
    count = lambda cond: F.count(F.when(cond, 1))
    size = F.abs("pnl")
    days = trades.withColumn("profile", kind).groupBy("day").agg(
        F.sum("pnl").alias("p"), F.count("*").alias("n"), count(won).alias("w"), *[count(c("profile") == k).alias(k) for k in STOPS], F.sum(F.when(won, size)).alias("gains"), F.sum(F.when(~won, size)).alias("losses"),
        F.sum(F.ln(F.nullif(F.abs(factor), F.lit(0.0)))).alias("growth"), count(factor < 0).alias("turns"), count(factor == 0).alias("ruins"),
    )
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    of = days.agg(
        F.count("*").alias("days"), *[total(x).alias(x) for x in ("n", "w", *STOPS, "turns", "ruins")], *[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in ("gains", "losses", "growth")],
        count(c("p") > 0).alias("up"), count(c("p") <= 0).alias("down"), F.coalesce(F.sum(F.when(c("p") > 0, c("p"))), F.lit(0.0)).alias("up_sum"), F.coalesce(F.sum(F.when(c("p") <= 0, c("p"))), F.lit(0.0)).alias("down_sum"),
    )
    final = F.when(c("ruins") > 0, 0.0).otherwise(initial * F.exp("growth") * F.when(c("turns") % 2 == 0, 1).otherwise(-1))
    lost, rate = c("n") - c("w"), 100 * sdiv("w", "n")
    return of.select(
        F.lit(float(initial)).alias("initial_capital"), final.alias("final_capital"), c("n").alias("total_trades"), c("w").alias("winning_trades"), lost.alias("losing_trades"), rate.alias("win_rate_pct"),
        (100 - rate).alias("loss_rate_pct"), sdiv("gains", "w").alias("avg_profit_percentage_per_win"), sdiv(c("losses"), lost).alias("avg_loss_percentage_per_loss"), c("up").alias("winning_days"),
        c("down").alias("losing_days"), sdiv("up_sum", "up").alias("avg_profit_percentage_per_winning_days"), sdiv(F.abs("down_sum"), "down").alias("avg_loss_percentage_per_losing_days"),
        sdiv("n", "days").alias("avg_trades_per_day"), sdiv("w", "days").alias("avg_winning_trades_per_day"), sdiv(lost, "days").alias("avg_losing_trades_per_day"),
        *[c(k).alias(f"total_{k}_trades") for k in STOPS], *[sdiv(k, "days").alias(f"avg_{k}_trades_per_day") for k in STOPS],
    )


def small_ledger(spark, sf_dir) -> DataFrame:
    """The ledger with a tenth of its gains, so that a long run keeps its capital in range."""
    return ledger(spark, sf_dir).withColumn("pnl", F.col("pnl") / 10)


_ROUNDED = ["final_capital", "win_rate_pct", "loss_rate_pct", "avg_profit_percentage_per_win", "avg_loss_percentage_per_loss", "avg_profit_percentage_per_winning_days", "avg_loss_percentage_per_losing_days", "avg_trades_per_day", "avg_winning_trades_per_day", "avg_losing_trades_per_day", *[f"avg_{k}_trades_per_day" for k in STOPS]]


@query(
    f"""WITH {LEDGER_SQL}, l AS (SELECT day, win, profile, pnl / 10 AS pnl FROM ledger), d AS (SELECT day, sum(pnl) AS p FROM l GROUP BY day),
k AS (SELECT count(*) AS nd, count(*) FILTER (p > 0) AS up, count(*) FILTER (p <= 0) AS down, coalesce(avg(p) FILTER (p > 0), 0) AS mu, coalesce(abs(avg(p) FILTER (p <= 0)), 0) AS md FROM d)
SELECT 1000.0::DOUBLE AS initial_capital, round(1000 * product(1 + pnl / 100), 4) AS final_capital, count(*) AS total_trades, count(*) FILTER (win) AS winning_trades, count(*) FILTER (NOT win) AS losing_trades,
  round(100 * avg(CAST(win AS INTEGER)), 4) AS win_rate_pct, round(100 - 100 * avg(CAST(win AS INTEGER)), 4) AS loss_rate_pct, round(avg(abs(pnl)) FILTER (win), 4) AS avg_profit_percentage_per_win,
  round(avg(abs(pnl)) FILTER (NOT win), 4) AS avg_loss_percentage_per_loss, any_value(up) AS winning_days, any_value(down) AS losing_days, round(any_value(mu), 4) AS avg_profit_percentage_per_winning_days,
  round(any_value(md), 4) AS avg_loss_percentage_per_losing_days, round(count(*) / any_value(nd), 4) AS avg_trades_per_day, round(count(*) FILTER (win) / any_value(nd), 4) AS avg_winning_trades_per_day,
  round(count(*) FILTER (NOT win) / any_value(nd), 4) AS avg_losing_trades_per_day, {', '.join(f"count(*) FILTER (profile = '{p}') AS total_{p}_trades, round(count(*) FILTER (profile = '{p}') / any_value(nd), 4) AS avg_{p}_trades_per_day" for p in STOPS)}
FROM l CROSS JOIN k"""
)
def run_report(spark, sf_dir):
    """All figures of a run's ledger."""
    made = run_metrics(small_ledger(spark, sf_dir))
    return made.select(*[rnd(x, 4).alias(x) if x in _ROUNDED else x for x in made.columns])


def performance(trades: DataFrame, capital: float = 1000.0, periods: float = 1440.0) -> DataFrame:
    """By symbol: ending capital, profit, hit rate, worst fall from the peak, Sharpe and
    Sortino ratio of the changes of equity, and mean win over mean loss.

    ``trades`` has symbol, ts, seq and pnl.  Equity is a sum along the series, in
    blocks; the peak is that of all equities so far, the first change is 0.
    """
    equity = scanned(trades.select("symbol", "ts", "seq", "pnl"), ["pnl"], "run double", Linear([[1.0]], lambda x, pos: x["pnl"][:, None].copy(), lambda s, x: (s[:, 0],)))
    e = equity.withColumn("equity", capital + F.col("run"))
    e = scanned(e, ["equity"], "peak double", Highest("equity"))
    c = F.col
    # The first change is 0 whatever the first trade made.
    first = trades.groupBy("symbol").agg(F.min_by("pnl", F.struct("ts", "seq")).alias("_pnl"), F.min(F.struct("ts", "seq")).alias("_at"))
    e = joined(e, first, ["symbol"])
    change = F.when(F.struct("ts", "seq") == c("_at"), 0.0).otherwise(c("pnl"))
    e = e.withColumns({"r": change, "fall": sdiv(c("equity") - c("peak"), "peak")})
    of = e.groupBy("symbol").agg(
        F.count("*").alias("n_trades"), (capital + F.sum("pnl")).alias("ending_capital"), F.avg((c("pnl") > 0).cast("int")).alias("hit_rate"), F.min("fall").alias("max_dd"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"),
        F.stddev_samp(F.when(c("r") < 0, c("r"))).alias("_d"), F.avg(F.when(c("pnl") > 0, c("pnl"))).alias("_w"), F.avg(F.when(c("pnl") < 0, -c("pnl"))).alias("_l"),
    )
    still = F.coalesce(c("_s"), F.lit(0.0)) == 0
    down = F.when(F.coalesce(c("_d"), F.lit(0.0)) == 0, 1e-12).otherwise(c("_d"))
    ratio = lambda spread: F.when(still, 0.0).otherwise(c("_m") / spread * periods**0.5)
    return of.select(
        "symbol", "n_trades", "ending_capital", (c("ending_capital") - capital).alias("net_profit"), ((c("ending_capital") - capital) / max(capital, 1e-12)).alias("total_return"), "hit_rate", "max_dd",
        ratio(F.nullif(c("_s"), F.lit(0.0))).alias("sharpe"), ratio(down).alias("sortino"), F.coalesce(c("_w") / F.when(c("_l").isNotNull(), F.greatest(c("_l"), F.lit(1e-12))), F.lit(0.0)).alias("avg_rr"),
    )


@query(
    f"""WITH {LEDGER_SQL}, e AS (SELECT symbol, ts, seq, pnl, 1000 + sum(pnl) OVER w AS equity, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) = 1 THEN 0 ELSE pnl END AS r
  FROM ledger WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM e)
SELECT symbol, count(*) AS n_trades, round(1000 + sum(pnl), 4) AS ending_capital, round(sum(pnl), 4) AS net_profit, round(sum(pnl) / 1000, 6) AS total_return, round(avg(CAST(pnl > 0 AS INTEGER)), 6) AS hit_rate,
  round(min(fall), 6) AS max_dd, round(avg(r) / stddev_samp(r) * sqrt(1440), 4) AS sharpe, round(avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(1440), 4) AS sortino,
  round(avg(pnl) FILTER (pnl > 0) / avg(-pnl) FILTER (pnl < 0), 5) AS avg_rr FROM f GROUP BY symbol"""
)
def performance_report(spark, sf_dir):
    """Sharpe, Sortino and the other figures of each symbol's equity."""
    digits = {"total_return": 6, "hit_rate": 6, "max_dd": 6, "avg_rr": 5}
    made = performance(ledger(spark, sf_dir))
    return made.select("symbol", "n_trades", *[rnd(x, digits.get(x, 4)).alias(x) for x in made.columns[2:]])
