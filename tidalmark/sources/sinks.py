"""Sinks: Parquet output with a manifest row and a provenance row."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256("|".join(df.columns).encode()).hexdigest()


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def write_with_manifest(df: DataFrame, path: str, manifest: str, name: str, run_id: str, config: dict | None = None, rows_per_file: int = 2_000_000) -> DataFrame:
    """Writes ``df`` under ``path`` and appends one row to the manifest folder:
    name, path, rows, nulls, schema_hash, config_hash, run_id.

    The counts come from what was written, so a retried task is not counted
    twice.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    written = spark.read.parquet(path)
    nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in written.columns), F.lit(0))
    row = written.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_nulls")).select(
        F.lit(name).alias("name"), F.lit(path).alias("path"), "n_rows", "n_nulls", F.lit(schema_hash(written)).alias("schema_hash"),
        F.lit(config_hash(config or {})).alias("config_hash"), F.lit(run_id).alias("run_id"),
    )
    row.write.mode("append").json(manifest)
    return written


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema("name string, path string, n_rows long, n_nulls long, schema_hash string, config_hash string, run_id string").json(manifest)


def finished(spark: SparkSession, manifest: str, name: str, config: dict | None = None) -> bool:
    """Whether the manifest has this step with this configuration (to skip it)."""
    try:
        rows = read_manifest(spark, manifest)
        return not rows.where((F.col("name") == name) & (F.col("config_hash") == config_hash(config or {}))).isEmpty()
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


def run_steps(spark: SparkSession, steps: list, folder: str, run_id: str, config: dict | None = None) -> dict[str, DataFrame]:
    """Runs (name, function) steps in order, each from the written result of the
    one before; a step that the manifest has is read, not run again."""
    made: dict[str, DataFrame] = {}
    last: DataFrame | None = None
    for name, step in steps:
        path = f"{folder}/{name}"
        if finished(spark, f"{folder}/_manifest", name, config):
            last = spark.read.parquet(path)
        else:
            last = write_with_manifest(step(last), path, f"{folder}/_manifest", name, run_id, config)
        made[name] = last
    return made
