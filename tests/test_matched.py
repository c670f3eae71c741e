"""Feeds by date: older folders, feeds of one date, checks, cleaning."""

import os

import pytest
from pyspark.sql import functions as F

from tidalmark.operators.quality import QualityError
from tidalmark.sources.matched import Feed, checked, cleaned, common, dates, matched, newest

ROWS = "ts timestamp_ntz, seq long, v double"


def at(k):
    return f"2024-01-01 00:00:{k:02d}"


def feed(spark, rows):
    return spark.createDataFrame([(at(t), s, v) for t, s, v in rows], "ts string, seq long, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def put(spark, path, date, rows):
    feed(spark, rows).write.parquet(f"{path}/date={date}")


def broken(path, date):
    os.makedirs(f"{path}/date={date}")
    with open(f"{path}/date={date}/part-0.parquet", "wb") as f:
        f.write(b"no parquet")


def test_the_newest_folder_that_can_be_read_and_has_rows(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, "2024-01-01", [(1, 1, 1.0)])
    put(spark, path, "2024-01-02", [(1, 1, 2.0)])
    put(spark, path, "2024-01-03", [])
    broken(path, "2024-01-04")
    assert dates(spark, path) == [f"2024-01-0{k}" for k in range(1, 5)]
    date, df = newest(spark, path)
    assert date == "2024-01-02" and df.first()["v"] == 2.0
    assert newest(spark, path, "2024-01-01")[1].first()["v"] == 1.0
    for wanted in ("2024-01-03", "2024-01-04", "2023-01-01"):
        with pytest.raises(QualityError):
            newest(spark, path, wanted)
    with pytest.raises(QualityError, match="no readable folder"):
        newest(spark, str(tmp_path / "none"))


def test_feeds_of_one_date(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for date in ("2024-01-01", "2024-01-02"):
        put(spark, a, date, [(1, 1, 1.0), (2, 2, None)])
        put(spark, b, date, [(1, 5, 1.0)])
    feeds = {"a": Feed(a, ("v",)), "b": Feed(b)}
    date, found = matched(spark, feeds)
    assert date == "2024-01-02" and found["a"].count() == 2 and found["b"].columns == ["ts", "seq"]
    put(spark, a, "2024-01-03", [(1, 1, 1.0)])
    with pytest.raises(QualityError, match="differ"):
        matched(spark, feeds)
    assert matched(spark, feeds, "2024-01-01")[0] == "2024-01-01" and common(spark, feeds)[0] == "2024-01-02"
    with pytest.raises(QualityError, match="b: no folder"):
        matched(spark, feeds, "2024-01-03")
    broken(b, "2024-01-03")
    assert common(spark, feeds)[0] == "2024-01-02"


def test_checks_of_a_feed(spark):
    good = feed(spark, [(2, 7, 1.0), (1, 3, 1.0), (2, 7, 4.0), (2, 9, None)])
    assert checked(good, "x", Feed("", ("v",))).count() == 4
    with pytest.raises(QualityError, match=r"missing columns \['w'\]"):
        checked(good, "x", Feed("", ("w",)))
    with pytest.raises(QualityError, match="falls 1 times"):
        checked(feed(spark, [(1, 5, 1.0), (2, 4, 1.0), (3, 6, 1.0)]), "x", Feed(""))
    with pytest.raises(QualityError, match="'seq': 1"):
        checked(good.withColumn("seq", F.when(F.col("seq") == 9, "wrong").otherwise(F.col("seq").cast("string"))), "x", Feed(""))


def test_cleaning(spark):
    raw = feed(spark, [(2, 7, 1.0), (1, 3, None), (2, 7, 1.0), (1, 3, 0.0)]).withColumn("flag", F.when(F.col("seq") == 7, True))
    got = sorted(map(tuple, cleaned(raw.withColumn("seq", F.col("seq").cast("string")), "x").select("seq", "v", "flag").collect()))
    assert got == [(3, 0.0, False), (3, 0.0, False), (7, 1.0, True)]
    with pytest.raises(QualityError, match="critical nulls"):
        cleaned(raw.withColumn("ts", F.when(F.col("seq") == 7, F.col("ts"))), "x")
    with pytest.raises(QualityError, match="no rule fills"):
        cleaned(raw.withColumn("name", F.when(F.col("seq") == 7, "n")), "x")
    with pytest.raises(QualityError, match="falls"):
        cleaned(feed(spark, [(1, 5, 1.0), (2, 4, 1.0)]), "x")
    assert cleaned(raw.where("false"), "x").isEmpty()
