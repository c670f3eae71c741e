"""Approximate nearest neighbours with multi-index hashing.

Codes: vectors are rotated by a learned rotation (principal axes, then
iterative quantisation on a bounded sample of ``fit_rows`` vectors) and each
coordinate's sign is a bit.  A code is cut into substrings of 8 bits, each with
an index of its own.  Codes within Hamming radius ``r`` of the query's agree
with it in one of ``m`` substrings up to ``r // m`` bits, so probing those
values of each substring finds every code within ``r``; the floats of what is
found are then compared exactly.

The radius of a query grows until the codes outside it could hold one of its
nearest only with a small chance: from the sample comes, for every cosine, the
Hamming distance within which ``recall`` of the pairs with that cosine lie, and
the search goes on to that distance for the worst of the ``k`` found so far, or
to all codes where fewer than ``k`` were found.

Vectors are dealt into shards and queries into blocks, both of bounded size, by
a hash of the id; each (shard, block) is searched in a task of its own and the
results of the shards are merged by query.

Vectors that are null, zero, or hold a null or non-finite component take no
part, nor do those whose length is not the most frequent one, or whose id is
null.  Rows that repeat an id count as one, with the smallest of their vectors.
Ties go to the smaller id.  With no other vector a query has no row; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted

SUB = 8
POP = np.array([bin(v).count("1") for v in range(256)], np.uint8)


class Codes:
    """The rotation, and for cosines in steps of 0.05 the radius that holds
    ``recall`` of the pairs."""

    def __init__(self, x: np.ndarray, recall: float = 0.97, rounds: int = 30, seed: int = 0):
        r = np.random.default_rng(seed)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = x.shape[1]
        self.bits = -(-d // SUB) * SUB
        _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=True)
        v = x @ axes.T
        spin, _ = np.linalg.qr(r.normal(size=(d, d)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ spin).T @ v)
            spin = (u @ w).T
        turn = axes.T @ spin
        if self.bits > d:  # a few more random directions fill the last substring
            turn = np.hstack([turn, r.normal(size=(d, self.bits - d))])
        self.turn = turn
        code = self.of(x)
        some = r.permutation(len(x))[:400]
        cos = x[some] @ x.T
        far = np.array([POP[code ^ code[i]].sum(1) for i in some])
        self.radius = np.full(21, self.bits)
        for b in range(21):
            near = far[(cos >= b / 20) & (cos < b / 20 + 0.08) & (cos < 0.9999)]
            p = np.arccos(min(1.0, b / 20)) / np.pi
            guess = self.bits * p + 2.2 * np.sqrt(self.bits * p * (1 - p)) + 1
            self.radius[b] = min(self.bits, int(np.quantile(near, recall)) + 1 if len(near) >= 200 else int(guess) + 1)
        self.radius = np.maximum.accumulate(self.radius[::-1])[::-1]

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.turn > 0, axis=1)

    def reach(self, cosine: float) -> int:
        return self.bits if cosine < 0 else int(self.radius[min(20, int(cosine * 20))])


class Shard:
    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray):
        self.codes, self.ids = codes, ids
        self.x = x.astype(np.float64)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.code = codes.of(self.x)
        self.m = self.code.shape[1]
        self.order = [np.argsort(self.code[:, j], kind="stable") for j in range(self.m)]
        self.start = [np.searchsorted(self.code[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius, by pigeonhole probing."""
        flips = np.flatnonzero(POP <= radius // self.m)
        seen = np.zeros(len(self.ids), bool)
        for j in range(self.m):
            values = code[j] ^ flips
            first, last = self.start[j][values], self.start[j][values + 1]
            n = last - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            seen[self.order[j][at]] = True
        found = np.flatnonzero(seen)
        return found[POP[self.code[found] ^ code].sum(1) <= radius]

    def nearest(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found, nearest first."""
        q = q.astype(np.float64)
        size, code = np.sqrt((q * q).sum()), self.codes.of(q[None])[0]
        radius = self.codes.bits // 4
        while True:
            found = self.within(code, radius)
            found = found[self.ids[found] != own]
            cosine = (self.x[found] @ q) / (self.norm[found] * size)
            top = np.lexsort((self.ids[found], -cosine))[:k]
            if radius >= self.codes.bits:
                break
            need = self.codes.reach(cosine[top[-1]]) if len(top) == k else min(self.codes.bits, radius + 8)
            if need <= radius:
                break
            radius = need
        return self.ids[found[top]], cosine[top]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vector of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = quoted(vec_col)
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    )
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0)).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    fit_rows: int = 6000,
    shard_rows: int = 32_768,
    block_rows: int = 8192,
) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest found of each row whose id
    is divisible by ``every``."""
    rows = cut(valid(vectors, id_col, vec_col))
    total = rows.count()
    out = f"query_id long, {id_col} long, score double"
    if not total:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    share = int(min(1.0, fit_rows / total) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < share).limit(2 * fit_rows).collect()
    some = some or rows.limit(fit_rows).collect()
    codes = Codes(np.array([r["v"] for r in sorted(some, key=lambda r: r["id"])], float))
    shared = rows.sparkSession.sparkContext.broadcast(codes)
    shards = max(8, -(-total // shard_rows))
    asked = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // block_rows))
    left = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v"
    )
    right = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"),
        F.pmod(F.xxhash64("id", F.lit("q")), F.lit(blocks)).cast("int").alias("block"),
        "id",
        "v",
    )

    def one(_, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        asked, ids, scores = [], [], []
        if vectors.num_rows and queries.num_rows:
            shard = Shard(shared.value, vectors.column("id").to_numpy(), matrix(vectors.column("v")))
            for own, q in zip(queries.column("id").to_pylist(), matrix(queries.column("v")), strict=True):
                found, cosine = shard.nearest(own, q, k)
                asked += [own] * len(found)
                ids += found.tolist()
                scores += cosine.tolist()
        return pa.table({"query_id": pa.array(asked, pa.int64()), id_col: pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(one, out)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(id_col))
    return (
        found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
    )
