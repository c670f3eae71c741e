"""Past-only queries give the same rows when the series ends early."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidalmark import catalog
from tidalmark.operators.blocks import windowed
from tidalmark.operators.lookahead import changed, in_plan

PAST_ONLY = """
    ema_family rsi_tsi atr_adx filters kama supertrend hysteresis heat cooldown run_length smoothed_flows
    rolling_full rolling_partial zscores time_range_7d moments ols wma_hma mad_and_ranks entropy_autocorr
    ewm_adjusted fam_price fam_technical fam_cross fam_regime_higher fam_meta fam_cycle fut_open_interest
""".split()


@pytest.fixture(scope="module")
def early(spark, tmp_path_factory):
    """The tables up to noon of a day in the middle."""
    folder = str(tmp_path_factory.mktemp("early"))
    source = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{source}/events.parquet")
    events.where("ts < timestamp'2024-01-12 12:00:00'").write.parquet(f"{folder}/events.parquet")
    return folder, source


def trades(spark, sf_dir):
    from tidalmark.sources import feeds

    return feeds.trades(spark, sf_dir).select("symbol", "ts", "seq", "price")


@pytest.mark.parametrize("name", PAST_ONLY)
def test_later_rows_change_nothing(spark, early, name):
    folder, source = early
    made = catalog.QUERIES[name](spark, folder)
    whole = catalog.QUERIES[name](spark, source)
    assert not made.isEmpty() and changed(made, whole).isEmpty()


def windows() -> tuple[dict, dict]:
    """Columns that look ahead, and some that do not."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    down = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    near = Window.partitionBy("symbol").orderBy("seq")
    planted = {
        "lead": F.lead("price").over(w), "lag back": F.lag("price", -2).over(w), "lag down": F.lag("price").over(down), "frame": F.avg("price").over(w.rowsBetween(-3, 1)),
        "open": F.max("price").over(w.rowsBetween(0, Window.unboundedFollowing)), "no order": F.avg("price").over(Window.partitionBy("symbol")),
        "down": F.sum("price").over(down.rowsBetween(Window.unboundedPreceding, 0)), "inside": F.lit(1.0) + F.when(F.col("seq") > 3, F.lead("price", 2).over(w)).otherwise(0.0),
        "rank": F.percent_rank().over(w), "time": F.avg("price").over(near.rangeBetween(-5, 40)),
    }
    clean = {
        "lag": F.lag("price").over(w), "past": F.avg("price").over(w.rowsBetween(-3, -1)), "so far": F.sum("price").over(w), "row": F.row_number().over(w),
        "lead back": F.lead("price", -1).over(w), "lead down": F.lead("price").over(down), "span": F.avg("price").over(near.rangeBetween(-40, 0)),
        "frame down": F.avg("price").over(down.rowsBetween(0, 3)),
    }
    return planted, clean


PLANTED = ["lead", "lag back", "lag down", "frame", "open", "no order", "down", "inside", "rank", "time"]
CLEAN = ["lag", "past", "so far", "row", "lead back", "lead down", "span", "frame down"]


@pytest.mark.parametrize("name", PLANTED)
def test_a_planted_look_ahead_is_found(spark, early, name):
    """By the plan, and by the rows that change."""
    folder, source = early
    make = lambda d: trades(spark, d).withColumn("x", windows()[0][name])
    assert in_plan(make(folder)) and not changed(make(folder), make(source)).isEmpty()


@pytest.mark.parametrize("name", CLEAN)
def test_past_windows_are_clean(spark, early, name):
    folder, source = early
    make = lambda d: trades(spark, d).withColumn("x", windows()[1][name])
    assert not in_plan(make(folder)) and changed(make(folder), make(source)).isEmpty()


def test_what_the_plan_does_not_show_changes_rows(spark, early):
    """An aggregate joined back, and a kernel that sees a batch before its rows go out."""

    def joined_back(d):
        t = trades(spark, d)
        return t.join(t.groupBy("symbol").agg(F.avg("price").alias("m")), "symbol")

    def kernel(d):
        """Each row minus the mean of its block, which the plan says nothing about."""
        return windowed(trades(spark, d), ["price"], "x double", lambda x, pos, own: ((x["price"] - x["price"].mean())[own],))

    folder, source = early
    assert not in_plan(joined_back(folder)) and not changed(joined_back(folder), joined_back(source)).isEmpty()
    assert not in_plan(kernel(folder)) and not changed(kernel(folder), kernel(source)).isEmpty()


LOOKING = {"differences": "lead", "label_cycle": None}


@pytest.mark.parametrize("name", LOOKING)
def test_queries_that_look_ahead_are_known(spark, early, name):
    folder, source = early
    assert not changed(catalog.QUERIES[name](spark, folder), catalog.QUERIES[name](spark, source)).isEmpty()
    if LOOKING[name]:
        assert any(LOOKING[name] in x for x in in_plan(catalog.QUERIES[name](spark, folder)))
