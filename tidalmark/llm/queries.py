"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, htmlwrap, langid, licenses, linededup, lm, mixing, phrases, simjoin, tokencount, toxicity, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


ORACLE_SQL["op6_mixing"] = mixing.ORACLE_SQL


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontam.judged(found).drop("hit_spans", "hit_items")


ORACLE_SQL["op7_decontamination"] = decontam.ORACLE_SQL


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return langid.predict(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return tokencount.digest(table(spark, sf_dir, "documents"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return simjoin.join(table(spark, sf_dir, "documents"))


ORACLE_SQL["op2_ngram_join"] = simjoin.ORACLE_SQL


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return htmlwrap.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    left = linededup.dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op11_line_dedup"] = linededup.ORACLE_SQL


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    return variants.group(table(spark, sf_dir, "documents"), slip=199)


ORACLE_SQL["op12_spelling_variants"] = variants.ORACLE_SQL


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return phrases.mine(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_collocations"] = phrases.ORACLE_SQL
