"""The windows of option features run once."""

import numpy as np

from tidalmark.operators.ordered import LOAD, window_quantile, window_ranks
from tidalmark.plans.options import around_spot, option_features
from tidalmark.sources import feeds


def test_windows_run_once(spark, sf_dir):
    r = option_features(around_spot(feeds.chain(spark, sf_dir)))
    assert r._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_short_windows_equal_sorting():
    x = np.round(np.random.default_rng(3).normal(size=400), 1)
    x[::7] = np.nan
    assert LOAD >= 50
    low, high, share = window_ranks(x, 50)
    middle = window_quantile(x, 50, 0.3, 10)
    for i, v in enumerate(x):
        w = x[max(0, i - 49) : i + 1]
        w = w[~np.isnan(w)]
        if len(w):
            assert low[i] == w.min() and high[i] == w.max()
        if v == v:
            assert share[i] == ((w < v).sum() + ((w == v).sum() + 1) / 2) / len(w)
        assert np.isnan(middle[i]) if len(w) < 10 else np.isclose(middle[i], np.quantile(w, 0.3))
