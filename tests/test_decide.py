"""Decisions gate by gate, figures of runs against loops in pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalmark.operators.blocks import Highest, scanned
from tidalmark.plans.decide import decide, performance, run_metrics, trade_signal

SIGNALS = "profile string, direction int, fresh boolean, regime_conf double, impulse_p double, reversal_p_3 double, reversal_p_5 double, whipsaw_risk double, iv_percentile double"
CASES = [
    (("scalp", 1, True, 0.8, 0.6, 0.1, 0.2, None, None), "BUY_CALL", 0.5 * 1.3 * 0.98 * 0.9, 0.9, "scalp dir=1 fresh=True conf=0.80 imp=0.60 size=0.57%"),
    (("trend", -1, False, 0.8, 0.6, 0.1, 0.2, 0.9, 97.0), "BUY_PUT", 0.5 * 1.3 * 0.98 * 0.5 * 0.8, 1.5, None),
    (("runner", 0, True, 0.8, 0.6, 0.1, 0.2, 0.3, 50.0), "FLAT", 0.0, 1.2, "Neutral trend"),
    (("runner", 1, True, 0.54, 0.6, 0.1, 0.2, 0.3, 50.0), "FLAT", 0.0, 1.2, "Low regime confidence 0.54"),
    (("runner", 1, True, 0.55, 0.6, 0.1, 0.36, 0.3, 50.0), "FLAT", 0.0, 1.2, "High reversal risk 0.36"),
    (("runner", 1, True, 0.55, None, None, 0.35, 0.3, 5.0), "BUY_CALL", 0.5 * 1.05 * 0.5 * 0.9, 1.2, None),
    (("other", None, None, None, None, None, None, None, None), "FLAT", 0.0, None, "Neutral trend"),
]


@pytest.mark.parametrize("signal,action,size,stop,reason", CASES)
def test_gates(spark, signal, action, size, stop, reason):
    r = decide(spark.createDataFrame([signal], SIGNALS)).first()
    assert r.action == action and abs(r.size_risk_pct - size) < 1e-12 and r.stop_atr_mult == stop
    assert reason is None or r.reason == reason


def test_sizes_stay_in_their_bounds(spark):
    many = decide(spark.createDataFrame([("scalp", 1, True, 40.0, 9.0, 0.0, 0.0, 0.0, None), ("scalp", 1, True, 0.6, -0.6, 0.0, 0.0, 3.0, 1.0)], SIGNALS)).collect()
    assert [r.size_risk_pct for r in many] == [2.0, 0.1]


def test_trade_signals(spark):
    way, strength = trade_signal(F.col("p"))
    got = spark.createDataFrame([(0.55,), (0.5,), (0.45,), (None,)], "p double").select(way.alias("w"), strength.alias("s")).collect()
    assert [(r.w, round(r.s, 9)) for r in got] == [("long", 0.55), ("flat", 0.0), ("short", 0.55), ("flat", 0.0)]


LEDGER = "symbol string, ts long, seq long, day string, pnl double, win boolean, profile string"


def ledger(n, seed=0):
    r = np.random.default_rng(seed)
    pnl = np.round(r.normal(0.1, 3, n), 2)
    return [("ab"[i % 2], i // 3, i, f"d{i // 10}", float(pnl[i]), bool(pnl[i] > 0), ["scalp", "runner", "trend", "odd"][i % 4]) for i in range(n)]


def test_figures_of_a_run_equal_the_loop(spark):
    rows = ledger(133)
    got = run_metrics(spark.createDataFrame(rows, LEDGER).repartition(4)).first()
    x = pd.DataFrame(rows, columns=[c.split()[0] for c in LEDGER.split(", ")])
    capital = 1000.0
    for p in x["pnl"]:
        capital *= 1 + p / 100
    by_day = x.groupby("day")["pnl"].sum()
    assert math.isclose(got.final_capital, capital, rel_tol=1e-9)
    assert (got.total_trades, got.winning_trades, got.total_scalp_trades, got.total_trend_trades) == (133, x["win"].sum(), 67, 33)
    assert math.isclose(got.avg_profit_percentage_per_winning_days, by_day[by_day > 0].mean()) and math.isclose(got.avg_loss_percentage_per_losing_days, -by_day[by_day <= 0].mean())
    assert math.isclose(got.avg_loss_percentage_per_loss, x["pnl"][~x["win"]].abs().mean()) and math.isclose(got.avg_losing_trades_per_day, (~x["win"]).sum() / 14)


def test_ruin_turned_signs_and_no_trades(spark):
    of = lambda *pnl: run_metrics(spark.createDataFrame([("a", i, i, "d", p, p > 0, None) for i, p in enumerate(pnl)], LEDGER)).first()
    assert abs(of(-150.0, 10.0).final_capital + 550) < 1e-9 and abs(of(-150.0, -150.0).final_capital - 250) < 1e-9
    assert of(-100.0, 50.0).final_capital == 0.0 and of(1.0).total_scalp_trades == 1
    none = of()
    assert none.final_capital == 1000.0 and none.total_trades == 0 and none.win_rate_pct == 0.0 and none.avg_trades_per_day == 0.0


def test_performance_equals_pandas(spark):
    rows = ledger(200, 4) + [("one", 0, 0, "d", 5.0, True, "scalp")]
    got = {r.symbol: r for r in performance(spark.createDataFrame(rows, LEDGER).repartition(4)).collect()}
    for s in "ab":
        pnl = pd.Series([r[4] for r in rows if r[0] == s])
        equity = 1000 + pnl.cumsum()
        change = equity.diff().fillna(0.0)
        assert math.isclose(got[s].max_dd, (equity / equity.cummax() - 1).min(), rel_tol=1e-9)
        assert math.isclose(got[s].sharpe, change.mean() / change.std() * math.sqrt(1440), rel_tol=1e-9)
        assert math.isclose(got[s].sortino, change.mean() / change[change < 0].std() * math.sqrt(1440), rel_tol=1e-9)
        assert math.isclose(got[s].avg_rr, pnl[pnl > 0].mean() / -pnl[pnl < 0].mean(), rel_tol=1e-9)
    assert (got["one"].sharpe, got["one"].sortino, got["one"].avg_rr, got["one"].ending_capital) == (0.0, 0.0, 0.0, 1005.0)


@pytest.mark.parametrize("rows", [3, 100000])
def test_highest_so_far(spark, rows):
    v = [None, 1.0, 5.0, None, 2.0, 7.0, 6.0]
    df = spark.createDataFrame([("a", i, i, x) for i, x in enumerate(v)], "symbol string, ts long, seq long, v double")
    got = scanned(df, ["v"], "m double", Highest("v"), rows=rows).orderBy("seq").collect()
    assert [r.m for r in got] == [None, 1.0, 5.0, 5.0, 5.0, 7.0, 7.0]
