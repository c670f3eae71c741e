"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame with the columns of ``docs``; the last one adds the
mix's columns.  The runner may write each result as Parquet and read it again
for the next stage; ``run`` applies them one after another, with a checkpoint
in the shared folder between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalmark.llm import decontam, langid, mixing, simjoin, toxicity
from tidalmark.llm.common import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    return langid.reject(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return simjoin.first_of_group(docs, n=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how many words of each."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
]

#: The first three stages are learned or approximate in ways SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
