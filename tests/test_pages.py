"""Recorded pages: pruning, overlaps, names of fields, rows that do not parse."""

import json
import os

from pyspark.sql import functions as F

from tidalmark.sources import pages

HOUR = 3_600_000


def put(path, symbol, interval, cursor, until, text, name="part-0.txt"):
    folder = f"{path}/symbol={symbol}/interval={interval}/cursor={cursor}/until={until}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w" if isinstance(text, str) else "wb") as f:
        f.write(text)


def bar(k, close=1.0):
    return [k * HOUR, "1", "2", "0.5", str(close), "10", k * HOUR + HOUR - 1, "7", 3, "4", "2", "0"]


def test_pages_outside_the_range_are_never_opened(spark, tmp_path):
    path = str(tmp_path)
    put(path, "btc", "1h", 0, 3 * HOUR, b"this is no gzip", "part-0.txt.gz")
    put(path, "btc", "1h", 3 * HOUR, 6 * HOUR, json.dumps([bar(3), bar(4), bar(5)]))
    put(path, "btc", "1h", 6 * HOUR, 9 * HOUR, b"neither", "part-0.txt.gz")
    put(path, "btc", "4h", 3 * HOUR, 6 * HOUR, b"another interval", "part-0.txt.gz")
    got = pages.klines(spark, path, "1h", 4 * HOUR, 6 * HOUR)
    assert [(r.symbol, r.open_time // HOUR, r.trades) for r in got.orderBy("open_time").collect()] == [("BTC", 4, 3), ("BTC", 5, 3)]


def test_a_bar_counts_once_as_the_page_asked_last_has_it(spark, tmp_path):
    path = str(tmp_path)
    put(path, "x", "1h", 0, 2 * HOUR, json.dumps([bar(0), bar(1, 5.0), bar(1, 6.0), bar(2, 9.0)]))
    put(path, "x", "1h", 2 * HOUR, 4 * HOUR, json.dumps([bar(2, 8.0), bar(3)]))
    put(path, "y", "1h", 0, 2 * HOUR, json.dumps([bar(2, 1.5)]))
    put(path, "z", "1h", 2 * HOUR, 4 * HOUR, "[]")
    got = pages.klines(spark, path, "1h", 0, 4 * HOUR).orderBy("symbol", "open_time").collect()
    assert [(r.symbol, r.open_time // HOUR, r.close) for r in got] == [("X", 0, 1.0), ("X", 1, 6.0), ("X", 2, 8.0), ("X", 3, 1.0), ("Y", 2, 1.5)]


def test_what_does_not_parse_is_null_and_rows_without_time_go(spark, tmp_path):
    path = str(tmp_path)
    put(path, "x", "1h", 0, 2 * HOUR, json.dumps([bar(0), [HOUR, "wrong"], ["?", "1"], []]))
    put(path, "x", "1h", 2 * HOUR, 3 * HOUR, "not json")
    got = pages.klines(spark, path, "1h", 0, 4 * HOUR).orderBy("open_time").collect()
    assert [(r.open_time, r.open, r.trades) for r in got] == [(0, 1.0, 3), (HOUR, None, None)]


def test_option_fields_under_any_name(spark, tmp_path):
    path = str(tmp_path)
    put(path, "C-1", "1h", 0, 9, json.dumps({"result": [], "candles": [{"time": 0, "t": 5, "o": 1, "high": 3, "l": 1, "c": 2}, {"open_time": 6, "open": "2", "h": 2, "low": 2, "close": 2, "v": 4}]}))
    put(path, "C-1", "trades", 0, 9, json.dumps({"data": [{"t": 1, "p": "2.5", "q": 3, "s": "buy", "id": 7}, {"time": 2, "price": 1}, {"time": 2, "price": 1}]}))
    put(path, "C-1", "trades", 5, 9, json.dumps({"trades": [{"timestamp": 1, "price": 2.5, "size": 3, "side": "BUY", "trade_id": "7"}], "data": []}))
    candles = pages.option_candles(spark, path, "1h", 0, 9).orderBy("open_time").collect()
    assert [(r.open_time, r.open, r.high, r.low, r.close, r.volume) for r in candles] == [(5, 1, 3, 1, 2, 0), (6, 2, 2, 2, 2, 4)]
    trades = pages.option_trades(spark, path, 0, 9).orderBy("open_time").collect()
    assert [(r.instrument, r.open_time, r.price, r.size, r.side, r.trade_id) for r in trades] == [("C-1", 1, 2.5, 3.0, "BUY", "7"), ("C-1", 2, 1.0, 0.0, "", "")]


def test_what_is_recorded_is_read_again(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(250).select(F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"), (F.col("id") * 1000).alias("open_time"))
    pages.record(df.repartition(4), path, F.concat(F.lit("["), F.col("open_time"), F.lit(',"1","1","1","1","2"]')), "1m", size=20, overlap=7)
    found = pages.pages(spark, path, "1m", 0, 250_000)
    assert found.count() == 15
    sizes = found.select(F.size(F.from_json("value", "array<array<string>>")).alias("n")).where("n = 27").count()
    assert sizes == 9  # the fourth page of a symbol has three or four rows behind it, the fifth none
    got = pages.klines(spark, path, "1m", 50_000, 200_000)
    assert got.count() == 150 and got.agg(F.sum("volume")).first()[0] == 300.0
    assert pages.klines(spark, path, "5m", 0, 250_000).isEmpty()


def test_pages_lie_together_in_few_files(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(1000).select(F.lit("s").alias("symbol"), (F.col("id") * 10).alias("open_time"))
    pages.record(df.repartition(4), path, F.concat(F.lit("["), F.col("open_time"), F.lit(',"1","1","1","1","2"]')), "1m", size=10, overlap=3, together=40)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".txt")]
    assert len(files) == 3
    found = pages.pages(spark, path, "1m", 0, 10_000).collect()
    assert sorted((r.cursor, r.until) for r in found) == [(k * 100, k * 100 + 91) for k in range(100)]
    assert sorted({len(json.loads(r.value)) for r in found}) == [10, 13]
    # Only the pages that reach into the range are left of a file.
    assert sorted(r.cursor for r in pages.pages(spark, path, "1m", 500, 700).collect()) == [500, 600]


def test_a_page_of_several_lines_is_one_page(spark, tmp_path):
    path = str(tmp_path)
    put(path, "x", "1h", 0, 2 * HOUR, json.dumps([bar(0), bar(1)], indent=1))
    assert pages.pages(spark, path, "1h", 0, HOUR).count() == 1
    assert pages.klines(spark, path, "1h", 0, 2 * HOUR).count() == 2
