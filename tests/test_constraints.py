"""Rules counted while tables are written; feeds with one thing broken at a time."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalmark import catalog
from tidalmark.operators.constraints import WARNING, Rule, check_feed, finite, in_order, merged, one_of, present, ranges, report, write_checked
from tidalmark.operators.quality import QualityError, cast_strict
from tidalmark.plans.rules import FAMILIES, FEED_RULES, family_rules

SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType(), False), T.StructField("symbol", T.StringType(), False), T.StructField("price", T.DoubleType(), False), T.StructField("note", T.StringType()),
])


@pytest.fixture(scope="module")
def feed(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(seconds=i), "S1", 100.0 + i, None) for i in range(50)]
    return spark.createDataFrame(rows, SCHEMA)


def test_a_whole_feed_passes(feed):
    check_feed(in_order(feed.orderBy(F.rand(1))), SCHEMA)


def test_a_missing_column(feed):
    with pytest.raises(QualityError, match="missing price"):
        check_feed(feed.drop("price"), SCHEMA)
    with pytest.raises(QualityError, match="time"):
        check_feed(feed.drop("ts"), SCHEMA)


def test_a_column_too_many(feed):
    with pytest.raises(QualityError, match="unexpected more"):
        check_feed(feed.withColumn("more", F.lit(1)), SCHEMA)


def test_a_wrong_type(feed):
    broken = feed.withColumn("price", F.lit("not-a-number"))
    with pytest.raises(QualityError, match="price is string"):
        check_feed(broken, SCHEMA)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast_strict(broken, {"price": "double"}).collect()


def test_nulls(feed):
    with pytest.raises(QualityError, match="price present: 50 nulls"):
        check_feed(feed.withColumn("price", F.lit(None).cast("double")), SCHEMA)
    check_feed(feed, SCHEMA)  # note may be null


def test_times_that_do_not_rise(feed):
    first = feed.agg(F.min("ts")).first()[0]
    broken = feed.withColumn("ts", F.when(F.col("price") == 149.0, F.lit(first)).otherwise(F.col("ts")))
    with pytest.raises(QualityError, match="ts repeats"):
        in_order(broken)
    assert in_order(broken, keys=("price",)).count() == 50


def test_repeated_rows(feed):
    twice = feed.union(feed.limit(1))
    with pytest.raises(QualityError, match="equal rows repeat"):
        check_feed(twice, SCHEMA)
    check_feed(twice, SCHEMA, repeats=True)
    assert in_order(twice, drop_repeats=True).count() == 50
    with pytest.raises(QualityError, match="ts repeats"):
        in_order(twice)


def table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, "a", True), (-2.0, "b", None), (5.0, "c", False), (None, None, True), (nan, "a", True), (inf, "a", True)]
    return spark.createDataFrame(rows, "x double, k string, flag boolean").repartition(3)


RULES = [*ranges("0 4: x\n- 3: x"), *finite("x"), *one_of("k", ["a", "b"]), *present("x flag", WARNING)]
BROKEN = [4, 3, 2, 1, 1, 1]  # NaN is above every number


def test_counts_of_broken_rows(spark):
    rows = report(table(spark), "t", RULES).collect()
    assert [r["n_broken"] for r in rows] == BROKEN and {r["n_rows"] for r in rows} == {6}
    assert [r["severity"] for r in rows] == ["error"] * 4 + ["warning"] * 2
    both = merged([report(table(spark), "t", RULES), report(table(spark).limit(0), "none", RULES)])
    assert both.where("dataset = 'none'").agg(F.sum("n_broken"), F.sum("n_rows")).first() == (0, 0)


def test_rules_are_counted_while_a_table_is_written(spark, tmp_path):
    """One job writes and counts; errors raise, warnings do not."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = table(spark)
    counted = df.mapInArrow(seen, df.schema)
    with pytest.raises(QualityError, match=r"x in \[0, 4\] \(4 of 6 rows\)"):
        write_checked(counted, str(tmp_path / "a"), "t", RULES)
    assert reads.value == 6
    got = write_checked(counted, str(tmp_path / "b"), "t", RULES[4:]).collect()
    assert reads.value == 12 and [r["n_broken"] for r in got] == [1, 1] and spark.read.parquet(str(tmp_path / "b")).count() == 6
    with pytest.raises(Exception, match="already exists"):
        write_checked(df, str(tmp_path / "b"), "t", [])


def test_each_mutation_of_a_feed_breaks_its_rule(spark, sf_dir):
    """A value moved out of a rule's range is counted by that rule."""
    from tidalmark.sources import feeds

    t = feeds.trades(spark, sf_dir)
    clean = {r["rule"]: r["n_broken"] for r in report(t, "trades", FEED_RULES["trades"]).collect()}
    assert all(n == 0 for rule, n in clean.items() if rule != "size usual") and clean["size usual"] > 0
    changes = {"price positive": ("price", -1.0), "size positive": ("size", 0.0), "aggressor of 3": ("aggressor", 2), "symbol present": ("symbol", None)}
    for rule, (column, value) in changes.items():
        kind = dict(t.dtypes)[column]
        broken = t.withColumn(column, F.when(F.col("seq") == 3, F.lit(value).cast(kind)).otherwise(F.col(column)))
        assert {r["rule"]: r["n_broken"] for r in report(broken, "trades", FEED_RULES["trades"]).collect()}[rule] == 1


@pytest.mark.parametrize("name", [f for f in FAMILIES if not f.startswith("fut_") or f in ("fut_open_interest", "fut_regime")])
def test_families_keep_their_rules(spark, sf_dir, name):
    rules = family_rules(name)
    made = catalog.QUERIES[name](spark, sf_dir)
    broken = {r["rule"]: r["n_broken"] for r in report(made, name, rules).collect() if r["n_broken"]}
    assert not broken
    column = rules[0].name.split()[0]
    low = made.withColumn(column, F.lit(-1e9).cast(dict(made.dtypes)[column]))
    assert report(low.limit(5), name, [Rule(f"{column} low", f"{column} > -100")]).first()["n_broken"] == 5
