"""Similarity join and nearest neighbours against brute force."""

import os
import random

import numpy as np
import pytest

from tidalmark.llm import ann, simjoin
from tidalmark.llm.common import cut, discard

from llm_words import words


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(s), str(low[find(i)] if d is not None else None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def noisy():
    r, rows, d = random.Random(5), [], 0
    for base in range(12):
        text = words(base, r.choice([4, 6, 9, 14, 25, 60, 150, 400])).split()
        for _ in range(6):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5, 9])):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], ["new%d" % r.randrange(9)], [copy[at], "extra"]])
            rows.append((d, " ".join(copy)))
            d += 1
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_join_loses_no_link(spark, docs, n, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(None if d is None else d + 1000, t) for d, t in noisy()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, n, percent)
    for options in ({}, {"hubs": 1, "small": 1, "cells": 64})[: 2 if n == 4 else 1]:  # then most pairs come by their rarest shingles
        got = simjoin.join(df, n=n, percent=percent, **options).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want


def test_rarest_shingles_meet_for_every_linked_pair(spark):
    """For any order of shingles; and parities never reject a linked pair."""
    r = np.random.default_rng(3)
    for percent in (60, 80, 85):
        for _ in range(200):
            both, more, less = r.integers(1, 60), r.integers(0, 12), r.integers(0, 12)
            found = np.unique(r.integers(0, 1 << 63, both + more + less, dtype=np.uint64))
            a, b = found[: both + more], np.concatenate([found[:both], found[both + more :]])
            if 100 * both < percent * (both + more + less):
                continue
            if len(a) > len(b):
                a, b = b, a
            rank = {x: k for k, x in enumerate(r.permutation(found).tolist())}
            small, large = (sorted(x.tolist(), key=rank.get) for x in (a, b))
            own = len(a) - simjoin.overlap(len(a), len(a), percent) + 1
            other = len(b) - simjoin.overlap(len(b), -(-len(b) * percent // 100), percent) + 1
            assert set(small[:own]) & set(large[:other])
            odd = np.bitwise_count((simjoin.parities(np.sort(a)) ^ simjoin.parities(np.sort(b))).view(np.uint64)).sum()
            assert odd * (100 + percent) <= (len(a) + len(b)) * (100 - percent)


def test_signatures_meet_for_every_linked_pair():
    """Linked sets of all sizes share a signature (pigeonhole, empty segments)."""
    r = np.random.default_rng(3)
    for percent in (85, 60):
        bands = simjoin.Bands(percent)
        for size in [6, 7, 8, 9, 11, 13, 17, 20, 30, 50, 90, 200, 700]:
            for _ in range(40):
                a = np.unique(r.integers(0, 1 << 63, size, np.uint64))
                most = simjoin.bound(len(a), len(a), percent)
                drop = r.integers(0, most + 1)
                b = np.unique(np.concatenate([a[drop:], r.integers(0, 1 << 63, r.integers(0, most - drop + 1), np.uint64)]))
                both = len(np.intersect1d(a, b))
                same = len(a) == len(b) == both
                if 100 * both >= percent * (len(a) + len(b) - both) and not same:
                    assert np.intersect1d(simjoin.signatures(a, bands), simjoin.signatures(b, bands)).size


def test_first_of_group(docs, none):
    left = simjoin.first_of_group(docs)
    ids = [r["doc_id"] for r in left.collect()]
    assert left.columns == docs.columns
    assert 50 in ids and not {51, 52} & set(ids) and ids.count(57) == 1 and 58 not in ids and None in ids and {53, 54, 55} <= set(ids)
    assert simjoin.first_of_group(none).count() == 0
    assert simjoin.join(none).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 20))
    x[100:200] = x[0] + 0.01 * r.normal(size=(100, 20))
    x[300] = x[50]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1050, [0.0] * 20, ""), (1100, [float("nan")] * 20, ""), (1150, [1.0, None] * 10, ""), (1200, [1.0] * 3, ""), (None, x[0].tolist(), ""), (5, x[5].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(df, shard_rows=200, block_rows=7).collect()
    n = np.linalg.norm(x, axis=1)
    by: dict = {}
    for row in got:
        by.setdefault(row["query_id"], []).append(row)
    assert set(by) == set(range(0, 900, 50))
    hit = 0
    for q, found in by.items():
        found.sort(key=lambda row: row["rank"])
        assert [row["rank"] for row in found] == [1, 2, 3, 4, 5]
        cosine = x @ x[q] / (n * n[q])
        assert all(abs(cosine[row["vec_id"]] - row["score"]) < 1e-9 for row in found)
        cosine[q] = -9
        hit += len(set(np.lexsort((np.arange(900), -cosine))[:5]) & {row["vec_id"] for row in found})
    assert hit >= 0.9 * 5 * len(by)
    assert ann.search(df.where("vec_id < 0")).count() == 0
    assert ann.search(df.where("vec_id IN (0, 1, 2)")).count() == 2


def test_bit_map_reaches_the_driver_in_few_rows(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from tidalmark.llm import common

    ids = spark.range(300_000).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    spots = ids.select(common.spot(F.col("id")).alias("b")).distinct().toArrow()["b"].to_numpy()
    sizes = []
    frame = type(ids)
    for name in ("collect", "toArrow"):
        real = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, real=real: sizes.append(len(out := real(self))) or out)
    bits = np.unpackbits(common.bit_map(ids, "id").value)
    assert len(bits) == common.MAP_BITS and np.array_equal(np.flatnonzero(bits), np.sort(spots))
    assert 0 < sum(sizes) <= common.MAP_BITS // 64 // common.MAP_WORDS
    assert not common.bit_map(ids.limit(0), "id").value.any()


def test_signatures_of_the_same_rows_are_one_bucket(spark):
    text = words(3, 300).split()
    near = [*text[:150], "changed", *text[151:]]
    rows = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(text)), (4, words(9, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps, copies = docs.where("doc_id <> 3").selectExpr("doc_id AS id"), docs.where("doc_id = 3").selectExpr("doc_id AS id")
    kept = simjoin.signed(docs, reps, copies, "doc_id", "text", 4, 85)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4]
    live = simjoin.bucketed(simjoin.shared(kept, 2, 0).union(simjoin.shared(kept, 2, 1))).collect()
    assert sorted((r["id"], r["n"]) for r in live) == [(1, 2), (2, 2)]
    assert live[0]["weight"] == live[1]["weight"] > 1


def test_discard_of_a_union(spark, docs):
    one, two = cut(docs.select("doc_id")), cut(docs.select("doc_id"))
    discard(one.union(two))
    assert not [f for t in (one, two) for f in t.inputFiles() if os.path.exists(f.removeprefix("file://"))]


def test_only_shingles_of_several_labels_meet_parities(spark):
    """Rare shingles travel without parities; those of one label go before the join of pairs."""
    rows = [(7, 0, 1, 1), (7, 0, 2, 1), (8, 0, 1, 1), (8, 1, 3, 3), (9, 2, 3, 3)]
    tokens = spark.createDataFrame(rows, "token long, place int, id long, label long")
    assert sorted(tuple(r) for r in simjoin.several(tokens, "token").collect()) == [(8, 0, 1, 1), (8, 1, 3, 3)]
    found = np.arange(1, 41, dtype=np.uint64)
    sets = spark.createDataFrame([(1, 1, 40, [0] * 8, bytearray(found.tobytes()))], "id long, label long, size long, parity array<long>, set binary")
    made = simjoin.rarest(sets, 80, 64)
    assert made.columns == ["id", "label", "place", "token"]
    assert made.count() == 40 - simjoin.overlap(40, 32, 80) + 1
