"""Futures steps against their SQL on tables with several events at one time."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalmark import catalog


@pytest.fixture(scope="module")
def tied(spark, sf_dir, tmp_path_factory):
    """Each event three times, at the same time and under other numbers."""
    folder = str(tmp_path_factory.mktemp("tied"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = e.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    last = e.agg(F.max("event_id")).first()[0] + 1
    copies.withColumn("event_id", F.col("event_id") + F.col("k") * last).drop("k").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def same_as_sql(spark, folder, name, key):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, folder).toPandas().sort_values(key).reset_index(drop=True)
    want = con.sql(catalog.ORACLE_SQL[name]).df().sort_values(key).reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        if c == "symbol":
            assert list(got[c]) == list(want[c])
        else:
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), c


def test_volume_with_events_of_one_time(spark, tied):
    same_as_sql(spark, tied, "fut_volume", ["symbol", "seq"])


@pytest.mark.parametrize("name", ["open_interest", "funding", "positioning", "basis", "liquidation", "leverage", "regime"])
def test_steps_with_events_of_one_time(spark, tied, name):
    union = name in ("open_interest", "funding", "positioning")
    same_as_sql(spark, tied, f"fut_{name}", ["symbol", "seq", "feed"][: 3 if union else 2])


@pytest.mark.parametrize("name", ["fut_volume", "fut_open_interest"])
def test_rows_are_shuffled_once(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window [" not in plan
