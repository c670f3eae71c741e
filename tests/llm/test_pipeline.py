"""The pipeline's stages row by row against brute force, and its bounds."""

from collections import defaultdict

import corpus_pipeline
from test_counting import WS, brute_hits
from test_similarity import brute

from tidalmark.llm import langid, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, 0), (-2, "", "x", "y", 0), (-3, "12 !!", None, "y", 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert docs.columns[: len(columns)] == columns
        rows[name] = (before.collect(), docs.collect())

    def ids(found):
        return sorted(r["doc_id"] for r in found)

    before, after = rows["language"]
    judged = langid.predict(spark.createDataFrame(before, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)).collect()
    assert ids(after) == ids(r for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.3)
    before, after = rows["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity.score(spark.createDataFrame(before, columns_of(spark, sf_dir)), labels).collect()
    assert ids(after) == ids(r for r in judged if not r["predicted"])
    before, after = rows["near duplicates"]
    groups = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert ids(after) == sorted(int(d) for d, _, component in groups if d == component)
    before, after = rows["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits([r["text"] for r in before], items)
    assert ids(after) == ids(r for r, (n, hit, _) in zip(before, hits, strict=True) if not hit or 20 * hit < n)
    before, after = rows["mixing"]
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in before:
        sizes[r["source"]] += len(WS.findall((r["text"] or "").encode()))
    for r in after:
        assert 0 < r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * sizes[s]


def columns_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").schema
