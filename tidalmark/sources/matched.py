"""Feeds that lie in folders by date: the newest usable one, the same one of
several feeds, and a feed cleaned by fixed rules.

Folders are listed by Spark's file system, so any store will do; only their
names, a few for each day, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import windowed, written
from ..operators.quality import QualityError


def dates(spark: SparkSession, path: str, column: str = "date") -> list[str]:
    """The values of ``column`` that the feed's folders name, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def partition(spark: SparkSession, path: str, date: str, column: str = "date") -> DataFrame:
    """The rows of one folder, which must have any that can be read."""
    try:
        df = spark.read.parquet(f"{path}/{column}={date}")
        empty = df.isEmpty()
    except Exception as e:
        raise QualityError(f"cannot read {column}={date} of {path}") from e
    if empty:
        raise QualityError(f"no rows for {column}={date} of {path}")
    return df


def newest(spark: SparkSession, path: str, wanted: str | None = None, column: str = "date") -> tuple[str, DataFrame]:
    """The wanted folder, or the newest that can be read and has rows; older ones are
    tried in turn."""
    there = dates(spark, path, column)
    if wanted is not None:
        if wanted not in there:
            raise QualityError(f"no folder {column}={wanted} in {path}")
        return wanted, partition(spark, path, wanted, column)
    for date in reversed(there):
        try:
            return date, partition(spark, path, date, column)
        except QualityError:
            continue
    raise QualityError(f"no readable folder with rows in {path}")


@dataclass(frozen=True)
class Feed:
    """Where a feed lies, what it must have, and the columns that order it."""

    path: str
    columns: tuple[str, ...] = ()
    ts: str = "ts"
    seq: str = "seq"


def falls(df: DataFrame, ts: str, seq: str) -> int:
    """How often the sequence falls while time rises.  The table is one series, in blocks."""
    rows = df.select(F.lit(0).alias("_all"), F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col(seq).alias("_seq"))
    made = windowed(rows, ["_seq"], "_before double", lambda x, pos, own: (([float("nan"), *x["_seq"][:-1]])[own],), ("_all",), back=1)
    return made.where("_seq < _before").count()


def checked(df: DataFrame, name: str, feed: Feed) -> DataFrame:
    """The feed's columns, with time and sequence in their types.  A missing column,
    a time or sequence that is null or does not parse, or a sequence that falls
    is an error."""
    columns = list(dict.fromkeys([feed.ts, feed.seq, *feed.columns]))
    if missing := [c for c in columns if c not in df.columns]:
        raise QualityError(f"{name}: missing columns {missing}")
    kinds = {feed.ts: "timestamp_ntz", feed.seq: "long"}
    out = df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in columns])
    bad = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in kinds]).first().asDict()
    if any(bad.values()):
        raise QualityError(f"{name}: nulls or values that do not parse: {bad}")
    if n := falls(out, feed.ts, feed.seq):
        raise QualityError(f"{name}: the sequence falls {n} times")
    return out


def matched(spark: SparkSession, feeds: dict[str, Feed], wanted: str | None = None, column: str = "date") -> tuple[str, dict[str, DataFrame]]:
    """The date and the checked feeds, all of the same date: the wanted one, or the
    last folder of each, which must be the same."""
    found = {}
    for name, feed in feeds.items():
        there = dates(spark, feed.path, column)
        if not there or (wanted is not None and wanted not in there):
            raise QualityError(f"{name}: no folder {column}={wanted or '*'} in {feed.path}")
        found[name] = wanted or there[-1]
    if len(set(found.values())) != 1:
        raise QualityError(f"the feeds' last folders differ: {found}")
    date = next(iter(found.values()))
    return date, {name: checked(partition(spark, feed.path, date, column), name, feed) for name, feed in feeds.items()}


def common(spark: SparkSession, feeds: dict[str, Feed], column: str = "date") -> tuple[str, dict[str, DataFrame]]:
    """As ``matched``, at the newest date at which every feed can be read, has rows and
    passes its check."""
    shared = set.intersection(*[set(dates(spark, f.path, column)) for f in feeds.values()])
    for date in sorted(shared, reverse=True):
        try:
            return matched(spark, feeds, date, column)
        except QualityError:
            continue
    raise QualityError(f"no date that all of {sorted(feeds)} have")


def cleaned(df: DataFrame, name: str, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """A table of the feed's distinct rows with time and sequence in their types, null
    numbers as 0 and null flags as false.

    A null time or sequence, any other null that is left, or a sequence that
    falls is an error, and the nulls are counted while the table is written.
    """
    if missing := [c for c in (ts, seq) if c not in df.columns]:
        raise QualityError(f"{name}: missing columns {missing}")
    kinds = {ts: "timestamp_ntz", seq: "long"}

    def repaired(f: T.StructField):
        if f.name in kinds:
            return F.col(f.name).try_cast(kinds[f.name])
        if isinstance(f.dataType, T.BooleanType):
            return F.coalesce(f.name, F.lit(False))
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(f.name, F.lit(0).cast(f.dataType))
        return F.col(f.name)

    # Rows are equal as they came: two that differ in a null and a 0 both stay.
    typed = df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()}).distinct()
    seen = Observation()
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in typed.columns]
    table = written(typed.select(*[repaired(f).alias(f.name) for f in typed.schema]).observe(seen, F.count(F.lit(1)).alias("_rows"), *counts))
    nulls = {c: n for c, n in seen.get.items() if n and c != "_rows"}
    if nulls:
        raise QualityError(f"{name}: {'critical nulls' if set(nulls) & {ts, seq} else 'nulls that no rule fills'}: {nulls}")
    if n := falls(table, ts, seq):
        raise QualityError(f"{name}: the sequence falls {n} times")
    return table
