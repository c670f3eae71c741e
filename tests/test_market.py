"""Market operators: queries against their SQL, causality, edge cases, streams."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalmark import catalog
from tidalmark.functions.expr import norm_cdf
from tidalmark.operators import quality
from tidalmark.operators.asof import asof_join
from tidalmark.operators.scan import Ewm, Heat, Hysteresis, Roll, TimeMean, scan, span
from tidalmark.sources import feeds, files, sinks
from tidalmark.streaming import bars as streams

TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = ["flagship", "bars_spine", "asof_nearest", "range_join_hold", "ema_family", "heat", "fam_price", "fam_tick", "fam_greeks", "fut_open_interest", "kpis", "exits"]


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(3)
        elif df[c].dtype.kind not in "iu":
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = plain(catalog.QUERIES[name](spark, sf_dir).toPandas()), plain(con.sql(catalog.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind in "fiu":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-4, atol=2e-3, equal_nan=True), c
        else:
            assert list(got[c]) == list(want[c]), c


def test_every_query_is_registered_once():
    assert len(catalog.QUERIES) > 70 and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_past_only_features_do_not_look_ahead(spark, sf_dir):
    """Dropping later trades does not change earlier rows."""
    from tidalmark.plans.families import price_features, quotes

    q = quotes(spark, sf_dir)
    cut = q.agg(F.percentile("seq", F.lit(0.5))).first()[0]
    whole = price_features(q).where(F.col("seq") <= cut)
    half = price_features(q.where(F.col("seq") <= cut))
    assert whole.exceptAll(half).isEmpty() and half.exceptAll(whole).isEmpty()


def test_asof_ties_and_keys(spark):
    t = lambda *x: spark.createDataFrame(list(x), "symbol string, ts int, seq long, v int")
    left = t(("a", 5, 1, 0), ("a", 2, 2, 0), ("b", 5, 3, 0))
    right = t(("a", 5, 1, 10), ("a", 5, 2, 11), ("a", 3, 3, 12)).withColumnRenamed("v", "w")
    got = {r["seq"]: r["w"] for r in asof_join(left, right, ["w"]).collect()}
    assert got == {1: 11, 2: None, 3: None}
    got = {r["seq"]: r["w"] for r in asof_join(left, right, ["w"], exact=False).collect()}
    assert got == {1: 12, 2: None, 3: None}
    got = {r["seq"]: r["w"] for r in asof_join(left, right, ["w"], direction="forward").collect()}
    assert got == {1: 10, 2: 12, 3: None}


def test_scan_equals_pandas(spark):
    r = np.random.default_rng(0)
    x = [None if r.random() < 0.2 else float(r.normal()) for _ in range(300)]
    rows = [("ab"[i % 2], i, i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts int, seq int, x double").repartition(5)
    got = scan(df, ["x"], "y double", lambda: span(5), lambda s, v: (s(v),)).toPandas().sort_values("seq")
    for key in "ab":
        part = got[got.symbol == key]
        want = part["x"].ewm(span=5, adjust=False).mean()
        assert np.allclose(part["y"], want, equal_nan=True)


def test_rolls_equal_brute_force_across_batches(spark):
    import statistics

    rows = [(f"k{i % 2}", i, None if i % 7 == 3 else float((i * 37) % 11)) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, seq long, x double").withColumn("ts", F.col("seq"))
    rolls = [Roll("a", "sum", "x", 5, 2), Roll("b", "std", "x", 8, 3, past=True), Roll("c", "median", "x", 6), Roll("d", "mean", "x", 4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = scan(df, rolls=rolls).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("k0", "k1"):
        mine = sorted((r for r in got if r["symbol"] == key), key=lambda r: r["seq"])
        for i, r in enumerate(mine):
            last = lambda n, end: [m["x"] for m in mine[max(0, end - n) : end] if m["x"] is not None]  # noqa: B023, E731
            a, b, c, d = last(5, i + 1), last(8, i), last(6, i + 1), last(4, i + 1)
            assert r["a"] == (pytest.approx(sum(a)) if len(a) >= 2 else None)
            assert r["b"] == (pytest.approx(statistics.pstdev(b)) if len(b) >= 3 else None)
            assert r["c"] == (pytest.approx(statistics.median(c)) if c else None)
            assert r["d"] == (pytest.approx(statistics.mean(d)) if d else None)


def test_state_machines():
    h = Hysteresis(1.0, 0.35)
    # A state ends on its own side's value: far beyond the other side too, and then without a flip.
    assert [h(x) for x in (0.5, 1.2, 0.6, -2, 0.3, -1.1, None)] == [0, 1, 1, 0, 0, -1, -1]
    assert [Hysteresis(1.0, 0.35, strict)(1) or None for strict in (True, False)] == [1, 1]
    strict, lax = Hysteresis(1.0, 0.35, strict=True), Hysteresis(1.0, 0.35)
    assert [(strict(x), lax(x)) for x in (2, 0.35, 0.3)] == [(1, 1), (1, 0), (0, 0)]
    week = TimeMean(10, 2)
    assert [week(t, x) for t, x in ((0, 1.0), (5, 3.0), (10, 5.0))] == [None, 2.0, 4.0]
    heat = Heat(60.0)
    assert heat(0, 8.0) == 8 and heat(60, 0.0) == pytest.approx(4)
    assert Ewm(0.5)(None) is None


def test_normal_cdf(spark):
    got = spark.range(1).select(*[norm_cdf(F.lit(x)).alias(str(i)) for i, x in enumerate((-1.96, 0.0, 1.0))]).first()
    assert [round(v, 4) for v in got] == [0.025, 0.5, 0.8413]


def test_quality(spark, sf_dir):
    e = feeds.table(spark, sf_dir, "events")
    with pytest.raises(quality.QualityError):
        quality.cast_strict(e, {"nothing": "int"})
    with pytest.raises(quality.QualityError):
        quality.one_to_one(e.union(e), e, ["event_id"])
    assert quality.cast_report(e.withColumn("x", F.lit("no")), {"x": "double"}).first()["x"] == e.count()
    assert quality.check_schema(e, e.select("ts", "value").schema) and not quality.check_schema(e, e.schema)
    assert quality.resolve_aliases(e, {"price": ["value"]}).columns[0] == "price"


def test_files_and_manifest(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_text("open_time,open,high,low,close,volume,close_time,quote_volume,trades\n0,1,2,0.5,1.5,10,1,1,3\n60000,1,2,0.5,1.5,10,1,1,\n")
    k = files.read_klines(spark, str(path), "X", "1m", "1970-01-01 00:00:00", "1970-01-01 00:01:00")
    assert [(r["close"], r["trades"]) for r in k.collect()] == [(1.5, 3)]
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int")
    assert files.latest_partition(df).first()["v"] == 2 and files.common_partition(df, df.where("v = 1")) == "2024-01-01"
    with pytest.raises(quality.QualityError):
        files.latest_partition(df, wanted="1999-01-01")
    ran = []
    steps = [("a", lambda _: ran.append("a") or df), ("b", lambda last: ran.append("b") or last.where("v = 2"))]
    for run in ("one", "two"):
        made = sinks.run_steps(spark, steps, str(tmp_path / "out"), run)
    assert ran == ["a", "b"] and made["b"].count() == 1
    assert {(r["name"], r["n_rows"], r["n_nulls"]) for r in sinks.read_manifest(spark, str(tmp_path / "out/_manifest")).collect()} == {("a", 2, 0), ("b", 1, 0)}


def test_streams(spark, sf_dir, tmp_path):
    e = feeds.table(spark, sf_dir, "events")
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "events"))
    t = streams.read_trades(spark, str(tmp_path / "events"), 10)
    for name, made, mode in (("tm_b", streams.bars(t), "complete"), ("tm_s", streams.sessions(t), "append"), ("tm_e", streams.running_ewm(t), "update")):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    bars = spark.table("tm_b")
    want = feeds.bars(spark, sf_dir)
    assert bars.count() == want.count() and bars.agg(F.sum("n")).first()[0] == e.count()
    assert spark.table("tm_e").agg(F.max("n")).first()[0] > 0 and spark.table("tm_s").count() > 0
