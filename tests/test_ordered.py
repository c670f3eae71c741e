"""Sorted windows and the option features made of them."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidalmark.operators.ordered import Ordered, window_quantile, window_ranks
from tidalmark.plans.options import option_features


def holed(seed: int, n: int, kinds: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    x = r.integers(0, kinds, n) / 4.0
    x[r.random(n) < 0.2] = np.nan
    return x


def test_ordered_equals_a_sorted_list():
    r, held, want = np.random.default_rng(0), Ordered(load=4), []
    for _ in range(3000):
        if want and r.random() < 0.45:
            held.drop(want.pop(int(r.integers(len(want)))))
            want.sort()
        else:
            v = float(r.integers(0, 40))
            held.add(v)
            want = sorted([*want, v])
        v = float(r.integers(-1, 41))
        assert held.rank(v) == (sum(x < v for x in want), sum(x <= v for x in want))
        assert [held.at(k) for k in range(held.size)] == want
    with pytest.raises(IndexError):
        held.at(held.size)


@pytest.mark.parametrize("n", [1, 2, 30, 900])
def test_ranks_and_quantiles_equal_pandas(n):
    x = holed(n, 700)
    s = pd.Series(x).rolling(n, min_periods=1)
    low, high, share = window_ranks(x, n)
    assert np.array_equal(low, s.min(), equal_nan=True) and np.array_equal(high, s.max(), equal_nan=True)
    want = s.apply(lambda w: w.rank(pct=True).iloc[-1])
    assert np.allclose(share, want, equal_nan=True)
    for q in (0.0, 0.3, 0.5, 1.0):
        got = window_quantile(x, n, q, least=min(n, 3))
        assert np.allclose(got, pd.Series(x).rolling(n, min_periods=min(n, 3)).quantile(q), equal_nan=True)


def test_time_does_not_grow_with_the_window():
    x = np.random.default_rng(1).normal(size=40000)
    took = []
    for n in (30, 10000):
        began = time.process_time()
        window_ranks(x, n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]  # the window is 333 times as long


def quotes(spark, n: int = 400):
    r = np.random.default_rng(2)
    rows = [
        ("a" if i % 4 else None, datetime(2024, 1, 1) + timedelta(days=i // 9), i, float(r.integers(90, 110)), float(1 + i % 3), "call" if r.random() < 0.5 else "put",
         float(r.integers(1, 50)), None if r.random() < 0.1 else 0.2 + int(r.integers(0, 9)) / 100, 100.0, float(r.random() * 9))
        for i in range(n)
    ]
    names = "symbol string, ts timestamp_ntz, seq long, strike double, tte double, kind string, oi double, iv double, spot double, premium double"
    return spark.createDataFrame(rows, names).repartition(3)


def test_option_windows_equal_pandas_in_blocks_of_any_size(spark):
    q = quotes(spark).where("symbol = 'a'")
    d = q.toPandas().sort_values("seq").reset_index(drop=True)
    for rows in (100, 5000):
        g = option_features(q, lookbacks=(30, 90), rows=rows).toPandas().sort_values("seq").reset_index(drop=True)
        ratio, iv = d["premium"] / d["spot"], d["iv"]
        roll = ratio.rolling(30, min_periods=1)
        assert np.allclose(g["prem_z"].astype(float), (ratio - roll.mean()) / roll.std(), equal_nan=True)
        for n in (30, 90):
            low, high = iv.rolling(n, min_periods=1).min(), iv.rolling(n, min_periods=1).max()
            assert np.allclose(g[f"iv_rank_{n}"].astype(float), (iv - low) / (high - low).replace(0, np.nan), equal_nan=True)
        short, long = iv.rolling(5, min_periods=1).mean(), iv.rolling(30, min_periods=1).mean()
        crush = ((long - short) / long).clip(lower=0).fillna(0)
        crush[crush < 1e-12] = 0
        assert np.allclose(g["iv_crush"], (crush / crush.rolling(30, min_periods=1).max().replace(0, np.nan)).fillna(0))
        assert np.allclose(g["oi_change"].astype(float), d["oi"].diff(), equal_nan=True)
        gap = d["ts"].diff().dt.total_seconds().replace(0, np.nan).fillna(1.0)
        assert np.allclose(g["oi_per_sec"], d["oi"].diff().fillna(0) / gap)
        usual = d["oi"].rolling(30).std().fillna(0)
        assert list(g["unusual_oi"]) == list((d["oi"].diff().abs() > 3 * usual).astype(int))
        by = d.groupby(["ts", "tte"])["iv"].mean().unstack()
        slope = by.apply(lambda r: r.dropna().iloc[1] - r.dropna().iloc[0] if len(r.dropna()) > 1 else np.nan, axis=1)
        assert np.allclose(g["term_slope"].astype(float), d["ts"].map(slope), equal_nan=True)
        kinds = d.groupby(["ts", "kind"])["iv"].mean().unstack()
        assert np.allclose(g["skew_index"].astype(float), d["ts"].map(kinds["call"] - kinds["put"]), equal_nan=True)


def test_rows_without_a_symbol_and_empty_tables(spark):
    q = quotes(spark, 40)
    got = option_features(q)
    assert got.where("symbol IS NULL").count() == 10
    assert option_features(q.limit(0)).count() == 0
