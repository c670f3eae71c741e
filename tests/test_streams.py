"""Streams of rows in any order within the watermark give the batch result, row by row."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalmark.operators.scan import scan
from tidalmark.streaming.ordered import HALTS, TREND, day_end, halt_step, running_halts, running_trend, trend_step

START = datetime(2024, 3, 1, 20)
ROWS = "symbol string, ts timestamp, seq long, pnl double, fast double, slow double, major double, base double, up boolean, broke boolean"


def rows(n: int = 120):
    r = np.random.default_rng(4)
    out = []
    for i in range(n):
        t = START + timedelta(minutes=7 * i + int(r.integers(0, 5)))
        x = [float(v) for v in r.integers(0, 4, 4)]
        out.append(("ab"[i % 2], t, i, float(r.integers(-5, 5)), *x, bool(r.random() < 0.5), bool(r.random() < 0.3)))
    return out


def dealt(spark, tmp_path, seed: int) -> str:
    """Files of five rows, each row up to half an hour late, and a last row that
    moves the watermark behind all others."""
    r = np.random.default_rng(seed)
    data = sorted(rows(), key=lambda x: x[1].timestamp() + 1800 * r.random())
    data = [data[i : i + 5] for i in range(0, len(data), 5)] + [[("end", START + timedelta(days=9), 10**6, 0.0, 0.0, 0.0, 0.0, 0.0, True, False)]]
    for k, part in enumerate(data):
        spark.createDataFrame(part, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    return f"{tmp_path}/in/*"


def run(spark, folder: str, make, tmp_path, name: str) -> set:
    stream = make(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 2).parquet(folder))
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()
    return {tuple(r) for r in spark.table(name).where("symbol <> 'end'").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_kill_switch_in_any_order(spark, tmp_path, seed):
    got = run(spark, dealt(spark, tmp_path, seed), lambda s: running_halts(s, "40 minutes"), tmp_path, f"halts{seed}")
    start, step, _ = halt_step()
    df = spark.createDataFrame(rows(), ROWS).withColumn("day", F.to_date("ts"))
    batch = scan(df, ["pnl"], HALTS, start, step, keys=("symbol", "day")).select("symbol", "ts", "seq", "day_pnl", "losses", "halted")
    want = {tuple(r) for r in batch.collect()}
    assert {r for r in got if r[2] is not None} == want
    closed = {(r[0], r[1]): r[3:] for r in got if r[2] is None}
    last = batch.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.max_by(F.struct("day_pnl", "losses", "halted"), F.struct("ts", "seq")).alias("x"))
    for r in last.collect():
        end = datetime(r["d"].year, r["d"].month, r["d"].day) + timedelta(days=1)
        assert closed.pop((r["symbol"], end)) == tuple(r["x"])
    assert not closed


def test_trend_in_any_order(spark, tmp_path):
    got = run(spark, dealt(spark, tmp_path, 3), lambda s: running_trend(s, "40 minutes"), tmp_path, "trend")
    start, step = trend_step()
    df = spark.createDataFrame(rows(), ROWS)
    batch = scan(df, ["fast", "slow", "major", "base", "up", "broke"], TREND, start, step).select("symbol", "ts", "seq", *[c.split()[0] for c in TREND.split(", ")])
    assert got == {tuple(r) for r in batch.collect()}
    assert {r[3] for r in got} == {-1, 0, 1} and any(r[4] for r in got)


def test_a_day_ends_at_midnight():
    assert day_end(0) == day_end(86_399_999_999) == 86_400_000_000 and day_end(86_400_000_000) == 2 * 86_400_000_000
