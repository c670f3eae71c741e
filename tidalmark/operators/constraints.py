"""Constraints of feeds and feature families, counted while the data are written.

A rule is a predicate that every row must fulfil, with a severity.  All rules of
a table become one set of metrics that Spark gathers in the tasks that write it
(``DataFrame.observe``), so checking costs no second scan.  A rule is broken by
a row where its predicate is false; a null is the matter of a rule of its own,
except in rules that say otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import QualityError, check_schema, duplicates

ERROR, WARNING = "error", "warning"
REPORT = "dataset string, rule string, severity string, n_rows long, n_broken long"


@dataclass(frozen=True)
class Rule:
    """``holds`` is a SQL predicate; ``name`` says what it is about."""

    name: str
    holds: str
    severity: str = ERROR

    def broken(self) -> Column:
        return F.sum(F.coalesce(~F.expr(self.holds), F.lit(False)).cast("long"))


def ranges(table: str, severity: str = ERROR) -> list[Rule]:
    """Rules of a table of lines ``low high: column column ...``; ``-`` is no bound."""
    made = []
    for line in table.strip().splitlines():
        bounds, columns = line.split(":")
        low, high = bounds.split()
        for c in columns.split():
            parts = [f"{c} >= {low}"] * (low != "-") + [f"{c} <= {high}"] * (high != "-")
            made.append(Rule(f"{c} in [{low}, {high}]", " AND ".join(parts), severity))
    return made


def present(columns: str, severity: str = ERROR) -> list[Rule]:
    """No nulls."""
    return [Rule(f"{c} present", f"{c} IS NOT NULL", severity) for c in columns.split()]


def finite(columns: str, severity: str = ERROR) -> list[Rule]:
    """Neither infinite nor NaN; the bounds are what a double can hold."""
    return [Rule(f"{c} finite", f"abs({c}) <= 1.7976931348623157e308 AND NOT isnan({c})", severity) for c in columns.split()]


def one_of(column: str, allowed: list, severity: str = ERROR) -> list[Rule]:
    listed = ", ".join(f"'{a}'" if isinstance(a, str) else str(a) for a in allowed)
    return [Rule(f"{column} of {len(allowed)}", f"{column} IN ({listed})", severity)]


def _metrics(rules: list[Rule]) -> list[Column]:
    return [F.count("*").alias("n_rows"), *[r.broken().alias(f"r{k}") for k, r in enumerate(rules)]]


def _rows(dataset: str, rules: list[Rule], got: dict) -> list[tuple]:
    return [(dataset, r.name, r.severity, got["n_rows"], got[f"r{k}"] or 0) for k, r in enumerate(rules)]


def report(df: DataFrame, dataset: str, rules: list[Rule]) -> DataFrame:
    """One row a rule, from one aggregation of ``df``."""
    one = df.agg(*_metrics(rules))
    lines = [F.struct(F.lit(dataset).alias("dataset"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), "n_rows", F.coalesce(f"r{k}", F.lit(0)).alias("n_broken")) for k, r in enumerate(rules)]
    return one.select(F.inline(F.array(*lines)))


def merged(reports: list[DataFrame]) -> DataFrame:
    """Reports of several tables as one."""
    whole = reports[0]
    for r in reports[1:]:
        whole = whole.unionByName(r)
    return whole


def write_checked(df: DataFrame, path: str, dataset: str, rules: list[Rule], mode: str = "errorifexists") -> DataFrame:
    """Writes ``df`` as Parquet and returns the report of its rules, which the same
    job has gathered.  Raises ``QualityError`` after it where a rule of severity
    error is broken; a table so refused stays where it is, to be looked at, so a
    manifest should name only tables whose call has returned.  An empty table
    breaks no rule.

    A task that is run again is counted once; a lost executor can have a
    shuffle's tasks counted again, so counts of broken rows can be too high
    then, and never too low.
    """
    seen = Observation(f"rules of {dataset}")
    df.observe(seen, *_metrics(rules)).write.mode(mode).parquet(path)
    rows = _rows(dataset, rules, seen.get)
    broken = [f"{name} ({n} of {total} rows)" for _, name, severity, total, n in rows if severity == ERROR and n]
    if broken:
        raise QualityError(f"{dataset}: " + "; ".join(broken))
    return df.sparkSession.createDataFrame(rows, REPORT)


def check_feed(df: DataFrame, wanted: T.StructType, ts: str = "ts", repeats: bool = False) -> None:
    """Raises where columns, types or nulls break the feed's schema, or equal rows
    repeat (unless ``repeats``).  Nullable columns may hold nulls; ``ts`` never."""
    found = check_schema(df, wanted)
    if ts not in df.columns:
        found.append(f"no time column {ts}")
    if found:
        raise QualityError("; ".join(found))
    must = dict.fromkeys([ts, *[f.name for f in wanted if not f.nullable]])
    got = df.agg(*_metrics(rules := present(" ".join(must)))).first().asDict()
    found = [f"{name}: {n} nulls" for _, name, _, _, n in _rows("", rules, got) if n]
    if not repeats and not duplicates(df).isEmpty():
        found.append("equal rows repeat")
    if found:
        raise QualityError("; ".join(found))


def in_order(df: DataFrame, ts: str = "ts", keys: tuple[str, ...] = (), drop_repeats: bool = False) -> DataFrame:
    """``df`` sorted by time in each partition of its keys, with strictly rising
    times in each key: equal rows go first if ``drop_repeats``, a time that then
    stands twice raises."""
    left = df.dropDuplicates() if drop_repeats else df
    if not duplicates(left.select(*keys, ts), [*keys, ts]).isEmpty():
        raise QualityError(f"{ts} repeats")
    return left.repartitionByRange(*keys, ts).sortWithinPartitions(*keys, ts)
