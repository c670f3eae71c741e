"""Fills, scales and components against numpy; saved and loaded again."""

import numpy as np
import pandas as pd
import pytest

from tidalmark import catalog
from tidalmark.operators.prepare import fit, linear_score, load

NAMES = ["a", "b", "c", "d e", "none", "same"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    d = pd.DataFrame(r.normal(size=(400, 3)) @ r.normal(size=(3, 3)) + 5, columns=["a", "b", "c"])
    d["d e"] = np.round(d["a"] * 2 + r.normal(size=400) * 1e-3, 1)
    d["none"], d["same"] = np.nan, 7.0
    d.loc[r.random(400) < 0.1, "b"] = np.nan
    d["id"] = range(400)
    return spark.createDataFrame(d).repartition(5), d


def filled(d: pd.DataFrame, how: str) -> pd.DataFrame:
    x = d[NAMES].copy()
    fill = {"mean": x.mean(), "median": x.median(), "most_frequent": x.mode().iloc[0], "constant": pd.Series(3.0, index=NAMES)}[how]
    return x.fillna(fill).fillna(3.0)


@pytest.mark.parametrize("impute", ["mean", "median", "most_frequent", "constant"])
@pytest.mark.parametrize("scaler", ["standard", "minmax"])
def test_fills_and_scales_equal_pandas(data, impute, scaler):
    df, d = data
    x = filled(d, impute)
    want = (x - x.mean()) / x.std(ddof=0).replace(0, 1) if scaler == "standard" else (x - x.min()) / (x.max() - x.min()).replace(0, 1)
    got = fit(df, NAMES, impute, scaler, constant=3.0).transform(df, ["id"]).toPandas().sort_values("id")
    assert list(got.columns) == ["id", *NAMES] and np.allclose(got[NAMES], want, atol=1e-9)


@pytest.mark.parametrize(("components", "n"), [(0.99, 3), (0.5, 1), (2, 2), (50, 6)])
def test_components_equal_numpy(spark, data, tmp_path, components, n):
    df, d = data
    x = filled(d, "median")
    x = ((x - x.mean()) / x.std(ddof=0).replace(0, 1)).to_numpy()
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    shares = s**2 / (s**2).sum()
    made = fit(df, NAMES, components=components, constant=3.0)
    assert len(made.components) == n and np.allclose(made.shares, shares[:n], atol=1e-9)
    got = made.transform(df, ["id"]).toPandas().sort_values("id")
    want = u * s
    for k in range(min(n, 3)):  # the rest have no variance and no direction
        column = got[f"PC_{k}"].to_numpy()
        assert np.allclose(np.abs(column), np.abs(want[:, k]), atol=1e-7)
        row = np.array(made.components[k])
        assert row[np.abs(row).argmax()] > 0
    made.save(spark, str(tmp_path / "p"))
    again = load(spark, str(tmp_path / "p"))
    assert again == made and again.transform(df, ["id"]).exceptAll(made.transform(df, ["id"])).isEmpty()


def test_share_of_the_variance_is_kept(data):
    df, _ = data
    assert sum(fit(df, NAMES, components=0.99, constant=0.0).shares) >= 0.99


def test_wrong_requests_raise(data):
    df, _ = data
    with pytest.raises(ValueError, match="missing columns: z"):
        fit(df, ["a", "z"])
    with pytest.raises(ValueError, match="scaler"):
        fit(df, ["a"], scaler="robust")
    with pytest.raises(ValueError, match="fill"):
        fit(df, ["a"], impute="guess")
    with pytest.raises(ValueError, match="missing columns: b"):
        fit(df, ["a", "b"]).transform(df.drop("b"))


def test_an_empty_table(data):
    df, _ = data
    made = fit(df.limit(0), ["a", "b"], components=0.99)
    assert made.transform(df, ["id"]).count() == 400 and made.fills == [0.0, 0.0]


def test_linear_score(data):
    df, d = data
    got = linear_score(df, {"bias": -1, "weights": {"a": 0.5, "d e": -0.1}}).toPandas().sort_values("id")
    assert np.allclose(got["probability"], 1 / (1 + np.exp(1 - 0.5 * d["a"] + 0.1 * d["d e"])))
    with pytest.raises(ValueError, match="missing"):
        linear_score(df, {"weights": {"z": 1}})


def test_components_of_the_bars(spark, sf_dir):
    got = catalog.QUERIES["principal_components"](spark, sf_dir).toPandas()
    x = got[[c for c in got.columns if c.startswith("PC_")]].to_numpy()
    both = np.cov(x.T)
    assert np.allclose(both - np.diag(np.diag(both)), 0, atol=1e-8) and (np.diff(np.diag(both)) <= 1e-12).all()
