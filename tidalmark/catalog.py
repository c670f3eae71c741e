"""Registry of the market-data queries and of the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import decide, families, futures, labels, micro, options, paged, regimes, relational, rolling, rules, scans, series, strategy, timecycle  # noqa: F401  (registration)
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with moving average, Bollinger width and outlier z-score."""
    return rolling.flagship(spark, sf_dir)
