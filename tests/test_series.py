"""Blocks of long series: whatever the size of a block, results are those of the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalmark.operators.blocks import Adjusted, Last, Linear, blocks, positioned, scanned, windowed
from tidalmark.operators.peaks import peaks, prominences, relaxed, spaced
from tidalmark.plans.series import analytic_weights, cycle_features, cycle_label, smoothed

TYPES = "symbol string, ts long, seq long, x double"


def frame(spark, series: dict, parts: int = 5):
    rows = [(k, i // 3, i, None if v is None or np.isnan(v) else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, TYPES).repartition(parts)


def by_key(df, key):
    return df.where(F.col("symbol").eqNullSafe(F.lit(key))).orderBy("seq").toPandas()


def walk(seed: int, n: int, holes: float = 0.0) -> np.ndarray:
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=n).cumsum(), 1) + 50
    x[r.random(n) < holes] = np.nan
    return x


SHAPES = {
    "walk": walk(1, 500), "flat": np.full(40, 3.0), "plateaus": np.repeat(walk(2, 60), 7), "steps": np.repeat([1, 2, 2, 3, 1, 3, 3, 1, 2, 3, 3, 3, 0], 9),
    "up": np.arange(200) + 3.0 * (np.arange(200) % 2), "down": -np.arange(200) + 3.0 * (np.arange(200) % 2), "ties": np.tile([0.0, 1.0], 100), "one": np.array([5.0]),
    "two": np.array([1.0, 2.0]), "peak": np.array([1.0, 2.0, 1.0]), None: walk(3, 90),
}


def test_positions(spark):
    got = positioned(frame(spark, SHAPES))
    for key, x in SHAPES.items():
        assert list(by_key(got, key)["_pos"]) == list(range(len(x)))


@pytest.mark.parametrize("rows", [5, 64, 100000])
def test_blocks_hold_their_neighbours_rows(spark, rows):
    made = blocks(frame(spark, {"a": walk(0, 203), "b": walk(0, 10)}), back=3, ahead=2, rows=rows)
    for r in made.collect():
        n = 203 if r["symbol"] == "a" else 10
        first, last = r["_block"] * rows, min(n, r["_block"] * rows + rows)
        assert first < n and [i["_pos"] for i in r["_items"]] == list(range(max(0, first - 3), min(n, last + 2)))


def test_a_block_reaches_no_further_than_its_neighbours(spark):
    with pytest.raises(ValueError, match="neighbours"):
        blocks(frame(spark, {"a": [1.0]}), back=9, rows=8)


@pytest.mark.parametrize("rows", [7, 64, 100000])
def test_adjusted_weights_equal_pandas(spark, rows):
    series = {"a": walk(4, 700, 0.3) + 1e6, "b": np.full(30, np.nan), "c": np.concatenate([np.full(40, np.nan), walk(5, 50)]), "d": np.full(50, 0.1)}
    got = scanned(frame(spark, series), ["x"], "m double, s double", Adjusted("x", 0.07, 4), rows=rows)
    for key, x in series.items():
        g, e = by_key(got, key), pd.Series(x).ewm(alpha=0.07, min_periods=4)
        assert np.allclose(g["m"].astype(float), e.mean(), rtol=1e-12, equal_nan=True)
        assert np.allclose(g["s"].astype(float), e.std(), rtol=1e-6, atol=1e-9, equal_nan=True)


def test_adjusted_weights_fade_to_nothing(spark):
    """Weights of rows long ago are zero in doubles; the mean stays that of the rest."""
    x = np.concatenate([walk(6, 20), np.full(3000, np.nan), walk(7, 20)])
    got = by_key(scanned(frame(spark, {"a": x}), ["x"], "m double, s double", Adjusted("x", 0.5), rows=50), "a")
    tail = pd.Series(x[3020:]).ewm(alpha=0.5)
    assert np.allclose(got["m"].astype(float)[3020:], tail.mean()) and np.allclose(got["s"].astype(float)[3021:], tail.std()[1:])
    assert np.allclose(got["m"].astype(float)[20:3020], pd.Series(x[:20]).ewm(alpha=0.5).mean().iloc[-1])


@pytest.mark.parametrize("rows", [3, 50, 100000])
def test_linear_recursions_equal_the_pass_row_by_row(spark, rows):
    x = walk(8, 400)
    m, y, want = np.array([[0.6, -0.2], [1.0, 0.0]]), np.zeros(2), []
    for v in x:
        y = m @ y + np.array([v, 0.0])
        want.append(y[0])
    rule = Linear(m, lambda x, pos: np.stack([x["x"], 0 * x["x"]], axis=1), lambda s, x: (s[:, 0],))
    got = by_key(scanned(frame(spark, {"a": x}), ["x"], "y double", rule, rows=rows), "a")
    assert np.allclose(got["y"], want, rtol=1e-9)


def test_the_last_value(spark):
    x = walk(9, 100, 0.7)
    x[:5] = np.nan
    got = by_key(scanned(frame(spark, {"a": x}), ["x"], "y double", Last("x"), rows=9), "a")
    assert np.allclose(got["y"].astype(float), pd.Series(x).ffill(), equal_nan=True)


def test_one_symbol_on_many_tasks(spark):
    """A symbol with all rows is worked on by more than one task, each with a part of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, {"a": walk(10, 4000)})
        got = scanned(df, ["x"], "m double, s double", Adjusted("x", 0.1), rows=100)
        parts = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_tables(spark):
    none = frame(spark, {})
    assert scanned(none, ["x"], "m double, s double", Adjusted("x", 0.1)).count() == 0
    assert windowed(none, ["x"], "y double", lambda x, pos, own: (x["x"][own],)).count() == 0
    assert spaced(peaks(none, "x"), [3]).count() == 0
    assert cycle_label(none.withColumnRenamed("x", "close")).count() == 0


def brute_peaks(x: np.ndarray) -> list[tuple[int, float, float]]:
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            at = (i + j) // 2
            left = right = at
            while left > 0 and x[left - 1] <= x[at]:
                left -= 1
            while right < len(x) - 1 and x[right + 1] <= x[at]:
                right += 1
            out.append((at, x[at], x[at] - max(x[left : at + 1].min(), x[at : right + 1].min())))
        i = j + 1
    return out


def brute_spaced(found: list, d: int) -> set[int]:
    kept = []
    for at, *_ in sorted(found, key=lambda p: (-p[1], -p[0])):
        if all(abs(at - k) >= d for k in kept):
            kept.append(at)
    return set(kept)


@pytest.mark.parametrize("rows", [10, 37, 100000])
def test_peaks_equal_brute_force(spark, rows):
    df = frame(spark, SHAPES)
    got = spaced(peaks(df, "x", rows=rows), [2, 5, 10], rows=rows).toPandas()
    for key, x in SHAPES.items():
        for kind in (1, -1):
            g = got[(got["symbol"].isna() if key is None else got["symbol"] == key) & (got["kind"] == kind)].sort_values("at")
            want = brute_peaks(kind * x)
            assert list(g["at"]) == [p[0] for p in want], (key, kind)
            assert np.allclose(g["height"], [p[1] for p in want]) and np.allclose(g["prominence"], [p[2] for p in want]), (key, kind)
            for d in (2, 5, 10):
                assert set(g["at"][g[f"kept_{d}"]]) == brute_spaced(want, d), (key, kind, d)


def test_prominence_of_every_row(spark):
    x = walk(11, 300)
    got = by_key(prominences(frame(spark, {"a": x}), "x", ("symbol",), ("seq",), rows=8), "a")
    for i, v in enumerate(x):
        left = max([j for j in range(i) if x[j] > v], default=-1)
        right = min([j for j in range(i + 1, len(x)) if x[j] > v], default=len(x))
        assert (got["left_low"][i], got["right_low"][i]) == (x[left + 1 : i + 1].min(), x[i:right].min())


def test_suppression_along_a_chain_of_blocks(spark):
    """Each peak hides the next lower one: what is kept depends on the far end."""
    rows = [("a", 1, 2 * i, float(i), 1.0) for i in range(300)]
    found = spark.createDataFrame(rows, "symbol string, kind int, at long, height double, prominence double")
    got = spaced(found, [3, 7], rows=10).toPandas()
    for d in (3, 7):
        assert set(got["at"][got[f"kept_{d}"]]) == brute_spaced([(2 * i, i) for i in range(300)], d)


def brute_ladder(x: np.ndarray, window: int = 30, share: float = 0.1):
    both, std = [brute_peaks(k * x) for k in (1, -1)], x.std()
    for n in (3, 4, 6, 10):
        d = max(1, int(window / n))
        for loose in (1.0, 0.5, 0.2, 0.05, 0.0):
            least = max(1e-12, std * share * loose)
            left = [[p[0] for p in f if p[0] in brute_spaced(f, d) and p[2] >= least] for f in both]
            if min(map(len, left)) >= 2:
                return left, True
    left = [[p[0] for p in f if p[2] >= max(1e-12, std * share * 0.05)] for f in both]
    return left, min(map(len, left)) >= 2


def test_ladder(spark):
    """Series of one turn, of close turns and of small ones stop at other rungs."""
    line = np.linspace(0, 500, 300)
    dips, small = line - 12.0 * (np.arange(300) % 40 == 35), line - 3.0 * (np.arange(300) % 40 == 35)
    near = np.concatenate([np.arange(50.0), [40, 55, 40, 55, 40], np.arange(40, 0, -1.0)])
    series = {"walk": walk(12, 200), "turn": np.concatenate([np.arange(40.0), np.arange(40.0)[::-1]]), "near": near, "dips": dips, "small": small}
    df = frame(spark, series)
    found = peaks(df, "x", rows=50)
    spread = df.groupBy("symbol").agg(F.stddev_pop("x").alias("std"))
    got = relaxed(found, spread).toPandas()
    rungs = set()
    for key, x in series.items():
        g = got[got["symbol"] == key]
        want, enough = brute_ladder(x)
        for kind, places in zip((1, -1), want, strict=True):
            assert sorted(g["at"][g["kind"] == kind]) == places, key
        assert set(g["enough"]) <= {enough}
        rungs |= set(g["rung"])
    assert len(rungs) > 2


def test_smoothing_fills_forward_then_back(spark):
    x = walk(13, 120, 0.4)
    x[:4] = np.nan
    got = by_key(smoothed(frame(spark, {"a": x}).withColumnRenamed("x", "close"), rows=11), "a")
    want = pd.Series(x).ffill().bfill().rolling(5, min_periods=1).mean()
    assert np.allclose(got["smooth"], want, atol=1e-8)


def test_cycle_label_equals_brute_force(spark):
    x = walk(14, 400)
    x[[7, 8, 90]] = np.nan
    made = cycle_label(frame(spark, {"a": x, None: x}).withColumnRenamed("x", "close"), rows=33)
    got = by_key(made, "a")
    assert list(by_key(made, None)["label"]) == list(got["label"])
    v = np.round(pd.Series(x).ffill().bfill().rolling(5, min_periods=1).mean().to_numpy(), 9)
    want = np.where(np.gradient(v) < 0, 3, 1)
    for places, label in zip(brute_ladder(v)[0], (2, 0), strict=True):
        for p in places:
            want[max(0, p - 2) : p + 3] = label
    want[np.isnan(x)] = 0
    assert list(got["label"]) == list(want)


def test_analytic_signal_of_a_wave():
    """The phase of a cosine is its argument."""
    t = np.arange(64)
    z = np.cos(2 * np.pi * 5 * t / 64 + 0.3) @ analytic_weights()
    assert np.isclose(np.angle(z), np.mod(2 * np.pi * 5 * 63 / 64 + 0.3 + np.pi, 2 * np.pi) - np.pi)


def test_cycle_features_in_blocks_equal_those_of_the_whole(spark):
    df = frame(spark, {"a": walk(15, 900), "b": walk(16, 70)}).withColumnRenamed("x", "close")
    for key in "ab":
        part, whole = by_key(cycle_features(df, rows=128), key), by_key(cycle_features(df), key)
        names = [c for c in whole.columns if c != "symbol"]
        assert np.allclose(part[names].astype(float), whole[names].astype(float), rtol=1e-9, atol=1e-9)
        assert (whole["phase"][:63] == 0).all() and (whole["period"][:127] == 1).all() and (whole["consistency"][:31] == 0).all()


def test_dominant_period_of_a_wave(spark):
    x = 100 + 5 * np.sin(2 * np.pi * np.arange(300) / 16)
    got = by_key(cycle_features(frame(spark, {"a": x}).withColumnRenamed("x", "close"), rows=150), "a")
    assert (got["period"][127:] == 16).all() and np.allclose(got["smooth"][1], x[:2].mean())


def test_previous_values_over_partitions(spark):
    from tidalmark.operators.blocks import previous

    rows = [(k, i, None if i % 7 == 3 else float(i * i)) for k in ("a", None, "b") for i in range(40)] + [("c", 1, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, seq long, x double").repartition(5)
    got = {(r["symbol"], r["seq"]): r["x_1"] for r in previous(df, ["x"], order=("seq",)).collect()}
    value = {(k, i): x for k, i, x in rows}
    assert len(got) == len(rows) and got == {(k, i): value.get((k, i - 1)) for k, i, _ in rows}
    assert previous(df.where("seq < 0"), ["x"], order=("seq",)).count() == 0


def test_lines_of_a_book_are_shuffled_once_and_of_a_chain_not(spark, monkeypatch):
    from tidalmark.operators import blocks
    from tidalmark.plans import families

    plans = []
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df)
    written = blocks.written
    monkeypatch.setattr(blocks, "written", keep)
    monkeypatch.setattr(families, "written", keep)
    families.fam_book(spark, "/root/testdata/sf0.001")
    assert [p.count("Exchange") for p in plans] == [1]
    chain = families.fam_chain(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = chain[: chain.index("Scan parquet")]
    assert below.rindex("HashAggregate") > below.rindex("Sort ")
