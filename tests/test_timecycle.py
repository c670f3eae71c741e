"""The time-cycle family: recursions by block, windows by pandas, exact quantiles, regimes."""

import numpy as np
import pandas as pd
import pytest

from tidalmark.operators.blocks import Last, Switch, Together, recursion_of, scanned
from tidalmark.plans.timecycle import quantiles, regime_label, time_cycle

TYPES = "symbol string, ts timestamp_ntz, seq long, high double, low double, close double, volume double"


def bars(spark, n, symbol="a", seed=0, flat=False):
    r = np.random.default_rng(seed)
    close = np.full(n, 7.0) if flat else np.exp(r.normal(0, 0.02, n).cumsum()) * 100
    reach = np.zeros(n) if flat else r.uniform(0.1, 2, n)
    rows = pd.DataFrame({"symbol": symbol, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h"), "seq": np.arange(1, n + 1), "high": close + reach, "low": close - reach, "close": close, "volume": np.zeros(n) if flat else r.integers(0, 50, n) * 1.0})
    return rows, spark.createDataFrame(rows.sample(frac=1, random_state=1), TYPES)


def of(df):
    return df.orderBy("symbol", "seq").toPandas()


def direction(value, upper, lower):
    line, way, out = upper[0], 1, [1]
    for i in range(1, len(value)):
        way = 1 if value[i] > line else -1 if value[i] < line else way
        line = upper[i] if way == -1 else lower[i]
        out.append(way)
    return out


@pytest.mark.parametrize("rows", [1, 7, 64, 100000])
def test_switch_beside_others_equals_the_loop(spark, rows):
    r = np.random.default_rng(3)
    value = np.round(r.normal(0, 1, 300).cumsum())
    given = pd.DataFrame({"symbol": "a", "ts": np.arange(300), "seq": np.arange(300), "v": value, "up": value + r.integers(0, 4, 300), "down": value - r.integers(0, 4, 300)})
    both = Together(Last("v"), Switch("v", "up", "down"))
    got = of(scanned(spark.createDataFrame(given).repartition(3), ["v", "up", "down"], "last double, way int", both, rows=rows))
    assert list(got["way"]) == direction(value, given["up"].to_numpy(), given["down"].to_numpy())
    assert list(got["last"]) == list(value)


@pytest.mark.parametrize("rows", [1, 5, 100000])
def test_a_described_recursion_starts_where_its_seeds_say(spark, rows):
    made = recursion_of(lambda s, u: [s[0] + (u[0] - s[0]) / 4, s[1] + (u[0] - s[1]) / 2], lambda x: x["v"][:, None], 2, 1, lambda u, pos: [u[0], 0.0] if pos == 0 else [None, u[0]], seeded=2)
    v = np.random.default_rng(1).normal(size=40)
    given = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": np.arange(40), "seq": np.arange(40), "v": v}))
    got = of(scanned(given, ["v"], "slow double, fast double", made, rows=rows))
    assert np.allclose(got["slow"], pd.Series(v).ewm(alpha=0.25, adjust=False).mean())
    assert np.allclose(got["fast"][1:], pd.Series(v[1:]).ewm(alpha=0.5, adjust=False).mean())


def test_family_by_its_definitions(spark):
    x, df = bars(spark, 700)
    got = of(time_cycle(df))
    c, v = x["close"], x["volume"]
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    tr = pd.concat([x["high"] - x["low"], (x["high"] - c.shift()).abs(), (x["low"] - c.shift()).abs()], axis=1).max(axis=1)
    hv = np.log(c).diff().rolling(30, min_periods=1).std() * np.sqrt(30)
    hours = x["ts"].dt.hour
    session = np.where(hours < 7, 1, np.where(hours < 13, 2, 3))
    part = v / v.groupby(session).transform("sum")
    wma = lambda s, n: s.rolling(n, min_periods=1).apply(lambda w: np.dot(w, np.arange(1, n + 1)[-len(w) :]) / np.arange(1, n + 1)[-len(w) :].sum(), raw=True)
    rise, fall = c.diff().clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-c.diff().clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    e1 = ema(c, 21)
    want = {
        "ema_200": ema(c, 200), "sma_200": c.rolling(200, min_periods=1).mean(), "vwap": (c * v).cumsum() / v.cumsum().replace(0, np.nan), "atr": tr.rolling(14, min_periods=1).mean(),
        "signal": ema(ema(c, 12) - ema(c, 26), 9), "rsi_14": 100 - 100 / (1 + rise / fall.replace(0, np.nan)), "hv_90": np.log(c).diff().rolling(90, min_periods=1).std() * np.sqrt(90),
        "tema_21": 3 * (e1 - ema(e1, 21)) + ema(ema(e1, 21), 21), "hma_21": wma(2 * wma(c, 10) - wma(c, 21), 4), "session_part": part,
        "session_vol": ((hv - hv.groupby(session).transform("mean")) / hv.groupby(session).transform("std")).fillna(0),
        "cvi_10_20": (ema(x["high"] - x["low"], 10) - ema(x["high"] - x["low"], 20)) / ema(x["high"] - x["low"], 20),
    }
    for name, values in want.items():
        assert np.allclose(got[name].astype(float), values, equal_nan=True, rtol=1e-9, atol=1e-9), name
    assert list(got["micro_session"]) == list(((part - part.rolling(1440, min_periods=1).mean()) > 1.5 * part.rolling(1440, min_periods=1).std()).astype(int))


def test_one_symbol_in_many_blocks_equals_one_block(spark):
    _, df = bars(spark, 3500)
    few, many = of(time_cycle(df)), of(time_cycle(df, rows=500))
    pd.testing.assert_frame_equal(few, many, rtol=1e-9)
    a, b = of(regime_label(time_cycle(df))), of(regime_label(time_cycle(df), rows=250))
    pd.testing.assert_frame_equal(a, b)
    assert set(a["raw"]) == {0, 1, 2}


def test_flat_and_single_and_empty_series(spark):
    _, flat = bars(spark, 60, flat=True)
    _, one = bars(spark, 1, symbol="b")
    got = of(time_cycle(flat.union(one)))
    assert got["sto_k"][:60].isna().all() and got["vwap"][:60].isna().all() and (got["session_vol"] == 0).all() and (got["supertrend_dir"] == 1).all()
    assert len(got) == 61 and got["hv_30"].isna()[60]
    assert set(of(regime_label(time_cycle(flat.union(one))))["regime"]) == {0}
    assert time_cycle(one.where("false")).isEmpty()


@pytest.mark.parametrize("q", [0.0, 0.3, 0.75, 1.0])
def test_quantiles_equal_numpy(spark, q):
    r = np.random.default_rng(5)
    given = {"a": np.round(r.normal(size=501), 1), "b": [4.0], "c": r.normal(size=8)}
    df = spark.createDataFrame([(k, float(v)) for k, x in given.items() for v in x] + [("a", None), ("d", None), (None, 2.0)], "symbol string, x double")
    got = {r["symbol"]: r["quantile"] for r in quantiles(df.repartition(5), "x", q).collect()}
    assert got.keys() == {*given, None} and got[None] == 2.0
    assert all(abs(got[k] - np.quantile(x, q)) < 1e-12 for k, x in given.items())
