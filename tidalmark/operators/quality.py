"""Casts, constraint checks and reports, each one aggregated pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QualityError(ValueError):
    """A feed breaks its contract."""


def cast_strict(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to the given types; a value that does not fit fails the job
    (ANSI casts), a missing column raises at once."""
    missing = [c for c in kinds if c not in df.columns]
    if missing:
        raise QualityError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def cast_report(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """For each column, how many non-null values the cast would lose."""
    bad = [F.sum((F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()).cast("long")).alias(c) for c, k in kinds.items()]
    return df.agg(*bad)


def check_schema(df: DataFrame, wanted: T.StructType, extra: bool = False) -> list[str]:
    """Differences of names and types, without reading a row."""
    have = {f.name: f.dataType for f in df.schema}
    found = [f"missing {f.name}" for f in wanted if f.name not in have]
    found += [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in wanted if f.name in have and have[f.name] != f.dataType]
    if not extra:
        found += [f"unexpected {c}" for c in have if c not in wanted.names]
    return found


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical names for the first alias that is there."""
    picked = []
    for name, others in aliases.items():
        got = next((c for c in [name, *others] if c in df.columns), None)
        if got is None:
            raise QualityError(f"none of {[name, *others]} is a column")
        picked.append(F.col(got).alias(name))
    taken = {c for name, others in aliases.items() for c in [name, *others]}
    return df.select(*picked, *[c for c in df.columns if c not in taken])


def duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Groups of equal rows, with their number of copies."""
    return df.groupBy(*(subset or df.columns)).agg(F.count("*").alias("copies")).where("copies > 1")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that raises where a key repeats on either side."""
    for name, side in (("left", left), ("right", right)):
        if not duplicates(side.select(*on), on).isEmpty():
            raise QualityError(f"{name} side repeats a key of {on}")
    return left.join(right, on)


def report(
    df: DataFrame,
    nulls: list[str] = (),
    ranges: dict[str, tuple[float, float]] | None = None,
    unique: str | None = None,
    order: tuple[str, str, str] | None = None,
    domains: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Counts of violations in one row.  ``order`` is (key, sequence, value)."""
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    aggs = [F.count("*").alias("n_rows"), *[count(F.col(c).isNull()).alias(f"null_{c}") for c in nulls]]
    wrong: Column | None = None
    for c, (low, high) in (ranges or {}).items():
        bad = (F.col(c) < low) | (F.col(c) > high)
        wrong = bad if wrong is None else wrong | bad
    if wrong is not None:
        aggs.append(count(wrong).alias("out_of_range"))
    if unique:
        aggs.append((F.count("*") - F.countDistinct(unique)).alias("repeated_ts"))
    if order:
        key, seq, value = order
        df = df.withColumn("_before", F.lag(value).over(Window.partitionBy(key).orderBy(seq)))
        aggs.append(count(F.col(value) < F.col("_before")).alias("backward"))
    for c, allowed in (domains or {}).items():
        aggs.append(count(~F.col(c).isin(allowed)).alias("bad_domain"))
    return df.agg(*aggs)


def null_ratios(df: DataFrame) -> DataFrame:
    """c and ratio: the share of nulls of every column, from one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), (F.round(F.col(c), 6) + 0.0).alias("ratio")) for c in df.columns])
    return one.select(F.inline(pairs))


NULL_POLICIES = {"zero": 0.0, "one": 1.0}


def fill(df: DataFrame, policies: dict[str, str], window) -> DataFrame:
    """Null policies by column: raise, zero, one, false, ffill, ffill_zero, bfill_zero."""
    must = [c for c, p in policies.items() if p == "raise"]
    if must and not df.where(" OR ".join(f"`{c}` IS NULL" for c in must)).isEmpty():
        raise QualityError(f"null in one of {must}")
    made = {}
    for c, p in policies.items():
        run = F.last(c, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
        ahead = F.first(c, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
        if p in NULL_POLICIES:
            made[c] = F.coalesce(c, F.lit(NULL_POLICIES[p]))
        elif p == "false":
            made[c] = F.coalesce(c, F.lit(False))
        elif p == "ffill":
            made[c] = run
        elif p == "ffill_zero":
            made[c] = F.coalesce(run, F.lit(0.0))
        elif p == "bfill_zero":
            made[c] = F.coalesce(run, ahead, F.lit(0.0))
        elif p != "raise":
            raise QualityError(f"no policy {p!r}")
    return df.withColumns(made)
