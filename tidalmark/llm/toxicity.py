"""Toxicity by weak supervision.

Lexicons are made from the labelled documents of the training fold: word stems
(prefixes of 3 to 6 letters) and whole words whose presence raises the odds of
the label, dealt into several lexicon voters by strength, next to pattern
voters (shouting, repeated marks, insults aimed at a person, and so on).
Every voter says toxic (1), clean (-1) or abstains (0).

A generative label model estimates, without looking at labels, the share of
toxic documents, each voter's accuracy (its mean vote in either class) and the
voters' correlations (the covariance of votes within the classes), by
expectation-maximisation over the counts of vote patterns.  Voters that agree
because they are correlated so count less.  Its posterior labels train a
linear classifier (logistic regression over hashed stems and the voters'
weights), which scores the whole text of every document.

The model is fitted on a bounded sample of at most ``most_rows`` labelled rows.
Only the text is read for a score.

Nulls: a null or empty text has no feature and gets the score of the bias
alone.  Without labelled rows every score is 0.  Repeated labels of a document
count as toxic if any is.  Repeated rows each get their own row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, bit_map, cut, id_hash, quoted, spot, where

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5, 6, 7, 8)
BUCKETS = 1 << 15
VOTERS, STRONG = 6, 4
THRESHOLD = 0.3
#: Words that a task remembers, the first it meets (a few hundred bytes each).
MEMO = 60_000

#: Features of the sample that a step of the fit works on at once.
PART = 1 << 17

UPPER = re.compile(r"[A-Z]{4}")
#: Patterns of the pattern voters, and words of which a text must
#: have one for the pattern to be tried.
SHOUTS = re.compile(r"\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b){2,}")
PATTERNS = [
    (re.compile(r"\b(?:you|your|du|dein|tu|ton|eres|tus?)\s+(?:\w+\s+){0,2}(?:idiot|moron|loser|scum)", re.I), {"idiot", "moron", "loser", "scum"}),
    (re.compile(r"\b(?:shut up|go away|get lost|hate you|kill yourself)\b", re.I), {"shut", "away", "lost", "hate", "kill"}),
]


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def marks_of(text: str, words: set[str]) -> list[int]:
    """Votes of the pattern voters."""
    out = [1 if "!!!" in text or "???" in text else 0, 1 if UPPER.search(text) and SHOUTS.search(text) else 0]
    return out + [1 if w & words and p.search(text) else 0 for p, w in PATTERNS]


def stems_of(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEMS if len(word) > k] + [word]


def digest(words: set[str]) -> bytes:
    return blake2b("\n".join(sorted(words)).encode(), digest_size=16).digest()


class Bags:
    """Texts' sets of words, kept as numbers of the words: a set is made when it is
    asked for, as the sets of a whole sample would fill the driver.  With
    ``beside``, each comes in a pair with its value there."""

    def __init__(self, vocabulary: list[str], codes: list[np.ndarray], beside: list | None = None):
        self.vocabulary, self.codes, self.beside = vocabulary, codes, beside

    def __len__(self) -> int:
        return len(self.codes)

    def __iter__(self) -> Iterator:
        for k, c in enumerate(self.codes):
            words = {self.vocabulary[i] for i in c.tolist()}
            yield words if self.beside is None else (words, self.beside[k])


def coded(lists: pa.ChunkedArray) -> tuple[list[str], list[np.ndarray]]:
    """The words of all lists in order, and each list as numbers of its words."""
    whole = lists.combine_chunks()
    flat = whole.flatten().dictionary_encode()
    found = flat.dictionary.to_pylist()
    order = np.array(sorted(range(len(found)), key=found.__getitem__), np.int64)
    rank = np.empty(len(found), np.int32)
    rank[order] = np.arange(len(found))
    ends = np.cumsum(pc.list_value_length(whole).to_numpy())
    return [found[i] for i in order], np.split(rank[flat.indices.to_numpy()], ends[:-1])


def candidates(rows: Iterable[tuple[set[str], int]], floor: float = 2.0) -> list[str]:
    """Stems that the sample's toxic texts have more often; ``rows`` are gone
    through more than once."""
    met: set[tuple[int, bytes]] = set()
    once: dict[int, int] = {}
    for k, (words, y) in enumerate(rows):  # texts of the same words count once
        if (key := (y, digest(words))) not in met:
            met.add(key)
            once[k] = y
    n = [sum(1 for y in once.values() if not y), sum(1 for y in once.values() if y)]
    positive, negative = Counter(), Counter()
    for k, (words, y) in enumerate(rows):
        if k in once and y:
            positive.update({s for w in words for s in stems_of(w)})
    often: dict[str, tuple[str, ...]] = {}
    for k, (words, y) in enumerate(rows):
        if k in once and not y:  # only stems that may be found are counted
            for w in words:
                if w not in often:
                    often[w] = tuple(s for s in stems_of(w) if positive.get(s, 0) >= 4)
            negative.update(set(chain.from_iterable(map(often.__getitem__, words))))
    found = []
    for s, c in positive.items():
        odds = math.log((c + 0.5) / (n[1] + 1)) - math.log((negative[s] + 0.5) / (n[0] + 1))
        if c >= 4 and odds >= floor and negative[s] <= c / 4:
            found.append((-odds, s))
    return [s for _, s in sorted(found)]


class Lexicons:
    """Toxic stems dealt into lexicons: strong ones into the first STRONG,
    weaker ones into the rest; index: stem -> lexicon."""

    def __init__(self, counts: dict[str, tuple[int, int]], n: tuple[int, int]):
        """counts: documents with each stem, clean and toxic, of ``n`` in all."""
        found = []
        for s, (negative, positive) in counts.items():
            share = (positive / (n[1] + 1)) / (positive / (n[1] + 1) + (negative + 0.5) / (n[0] + 1))
            if positive >= max(3, 2e-4 * n[1]) and share >= 0.97 and negative <= 0.05 * positive:
                found.append((20 * negative - positive, len(s), s))
        kept: dict[str, bool] = {}
        for loss, _, s in sorted(found):  # what a kept stem covers adds nothing
            body = s.rstrip("*")
            if not any(body[:k] + "*" in kept for k in STEMS if k < len(body)):
                kept[s] = -loss >= 0.02 * n[1] and -loss >= 8
        self.index = {s: zlib.crc32(s.encode()) % STRONG if strong else STRONG + zlib.crc32(s.encode()) % (VOTERS - STRONG) for s, strong in kept.items()}

    def of(self, word: str) -> int:
        for s in stems_of(word):
            if s in self.index:
                return self.index[s]
        return -1

    def votes(self, marks: list[int], hits: np.ndarray) -> np.ndarray:
        """hits: distinct words of the text in each lexicon."""
        total = hits[:STRONG].sum() + 0.4 * hits[STRONG:].sum()
        out = [1 if h else (-1 if not total else 0) for h in hits]
        out += [1 if total >= 2 else (-1 if not total else 0), 1 if total >= 4 else (-1 if total < 1 else 0)]
        return np.array([*out, *marks], np.int8)


class LabelModel:
    """Class share, class-conditional means and covariance of the votes."""

    def __init__(self, votes: np.ndarray, rounds: int = 50):
        patterns, counts = np.unique(votes, axis=0, return_counts=True)
        x, w = patterns.astype(float), counts / counts.sum()
        self.used = (x != x[0]).any(0)
        x = x[:, self.used]
        q = 1 / (1 + np.exp(-2.0 * (x.mean(1) if x.shape[1] else np.full(len(x), -9.0))))
        for _ in range(rounds):
            share = min(0.9, max(1e-4, float((w * q).sum())))
            means, cov = [], 0.05 * np.eye(x.shape[1])
            for p in (1 - q, q):
                weight = w * p / max(1e-12, (w * p).sum())
                means.append(weight @ x)
                centred = x - means[-1]
                cov += ((w * p)[:, None] * centred).T @ centred
            self.share, self.means, self.cov = share, means, cov
            q = self.posterior_of(x)
        self.accuracy = [(1 + m) / 2 for m in self.means]

    def posterior_of(self, x: np.ndarray) -> np.ndarray:
        if not x.shape[1]:
            return np.full(len(x), self.share)
        direction = np.linalg.solve(self.cov, self.means[1] - self.means[0])
        middle = (self.means[1] + self.means[0]) / 2
        z = (x - middle) @ direction + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.posterior_of(votes[:, self.used].astype(float))


def is_feature(stem: str) -> bool:
    return stem[-1] != "*" or len(stem) == 6


def bucket(stem: str) -> int:
    return zlib.crc32(stem.encode()) % BUCKETS


class Model:
    """The linear classifier; ``known`` maps a word to its lexicon and weight."""

    def __init__(self, lexicons: Lexicons, words: Bags | list[set[str]], marks: list[list[int]], rounds: int = 60):
        self.lexicons = lexicons
        self.cache: dict[str, tuple[int, float]] = {}
        hits = np.array([self.hits(w) for w in words])
        votes = np.array([self.lexicons.votes(m, h) for m, h in zip(marks, hits, strict=True)])
        self.label_model = LabelModel(votes)
        posterior = self.label_model.posterior(votes)
        cells = [np.unique([bucket(s) for w in ws for s in stems_of(w) if is_feature(s)] or [0]).astype(np.int32) for ws in words]
        row = np.repeat(np.arange(len(words), dtype=np.int32), [len(c) for c in cells])
        size = 1 / np.sqrt(np.array([len(c) for c in cells]))
        col = np.concatenate(cells)
        del cells
        parts = [slice(at, at + PART) for at in range(0, len(col), PART)]
        dense = self.dense(hits, votes)
        self.w, self.u = np.zeros(BUCKETS), np.zeros(dense.shape[1])
        gw, gu = np.full(BUCKETS, 1e-2), np.full(dense.shape[1], 1e-2)
        for _ in range(rounds):  # full-batch AdaGrad
            z, dw = np.zeros(len(words)), np.zeros(BUCKETS)
            for p in parts:  # each entry is added in its turn, as over all at once
                r, c = row[p].astype(np.intp), col[p].astype(np.intp)
                np.add.at(z, r, self.w[c] * size[r])
            z += dense @ self.u
            d = (1 / (1 + np.exp(-z)) - posterior) / len(words)
            for p in parts:
                r, c = row[p].astype(np.intp), col[p].astype(np.intp)
                np.add.at(dw, c, d[r] * size[r])
            dw += 1e-5 * self.w
            du = dense.T @ d + 1e-5 * self.u
            gw += dw * dw
            gu += du * du
            self.w -= 0.05 * dw / np.sqrt(gw)
            self.u -= 0.5 * du / np.sqrt(gu)
        self.cache = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def hits(self, words: set[str]) -> np.ndarray:
        out = np.zeros(VOTERS, int)
        for w in words:
            k = self.lexicons.of(w)
            if k >= 0:
                out[k] += 1
        return out

    @staticmethod
    def dense(hits: np.ndarray, votes: np.ndarray) -> np.ndarray:
        strong, weak = hits[:, :STRONG].sum(1, keepdims=True), hits[:, STRONG:].sum(1, keepdims=True)
        parts = [np.ones_like(strong), np.log1p(strong), np.minimum(strong, 1), np.log1p(weak), np.minimum(weak, 1)]
        return np.hstack([*parts, votes]).astype(float)

    def known(self, word: str) -> tuple[int, tuple[int, ...]]:
        got = (self.lexicons.of(word), tuple(bucket(s) for s in stems_of(word) if is_feature(s)))
        if len(self.cache) < MEMO:
            self.cache[word] = got
        return got

    def score(self, text: str) -> float:
        words = words_of(text)
        get, known = self.cache.get, self.known
        found = [get(w) or known(w) for w in words]
        hits = np.zeros((1, VOTERS), int)
        for k, _ in found:
            if k >= 0:
                hits[0, k] += 1
        cells = set(chain.from_iterable([c for _, c in found]))
        z = float(self.w[np.fromiter(cells, int, len(cells))].sum() / math.sqrt(len(cells))) if cells else 0.0
        votes = self.lexicons.votes(marks_of(text, words), hits[0])
        z += float((self.dense(hits, votes[None]) @ self.u)[0])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn, most_rows: int
) -> Model | None:
    """Candidate stems and the classifier come from a sample of ``most_rows``
    labelled rows; the stems' counts from all labelled rows of the fold."""
    wanted = cut(
        labels.where(quoted(label_col).isNotNull() & quoted(id_col).isNotNull())
        .groupBy(quoted(id_col).alias("_i"))
        .agg(F.max(quoted(label_col)).alias("_y"))
    )
    total = wanted.count()
    if not total:
        return None
    share = int(min(1.0, most_rows / total) * (1 << 30))
    some = wanted.where(F.pmod(F.xxhash64("_i", F.lit("toxicity")), F.lit(1 << 30)) < share).limit(2 * most_rows)
    texts = docs.where(learn & quoted(text_col).isNotNull()).select(
        quoted(id_col).alias("_i"), quoted(text_col).alias("_t"), spot(quoted(id_col)).alias("_s")
    )

    def read():
        def run(ts):
            words = [words_of(t) for t in ts.to_pylist()]
            return [sorted(w) for w in words], [marks_of(t, w) for t, w in zip(ts.to_pylist(), words, strict=True)]

        return run

    sampled = texts.join(F.broadcast(some), "_i").select("_i", "_t", "_y")
    rows = append(sampled, ["_t"], "_w array<string>, _m array<int>", read, ["_i", "_y"]).limit(2 * most_rows).toArrow()
    if not rows.num_rows:
        return None
    vocabulary, codes = coded(rows["_w"])
    read_rows = sorted(
        zip(rows["_i"].to_pylist(), codes, rows["_m"].to_pylist(), rows["_y"].to_pylist(), strict=True),
        key=lambda r: (str(r[0]), r[1].astype(">i4").tobytes()),  # words as lists of strings compare
    )
    del rows, codes
    pa.default_memory_pool().release_unused()
    words, marks = Bags(vocabulary, [r[1] for r in read_rows]), [r[2] for r in read_rows]
    stems = candidates(Bags(vocabulary, words.codes, [int(r[3] > 0) for r in read_rows]))
    del read_rows
    number = {s: k for k, s in enumerate(stems)}
    shared = bit_map(wanted, "_i")

    def kernel():
        have, memo = np.unpackbits(shared.value), {}

        def of(word: str) -> tuple[int, ...]:
            got = tuple(number[s] for s in stems_of(word) if s in number)
            if len(memo) < MEMO:
                memo[word] = got
            return got

        def run(spots, ts):
            out, get = [], memo.get
            for ok, t in zip(have[spots.to_numpy()], ts.to_pylist(), strict=True):
                found = [of(w) if (k := get(w)) is None else k for w in words_of(t)] if ok else []
                out.append(sorted({-1}.union(*found)) if ok else [])
            return (out,)

        return run

    # Only labelled rows have a hit, or the -1 that counts the row itself; texts are not shuffled.
    found = append(texts, ["_s", "_t"], "c array<int>", kernel, ["_i"]).where(F.size("c") > 0)
    counted = (
        found.join(wanted, "_i")
        .select(F.explode("c").alias("s"), (F.col("_y") > 0).cast("long").alias("y"))
        .groupBy("s")
        .agg((F.count("*") - F.sum("y")).alias("c0"), F.sum("y").alias("c1"))
        .collect()
    )
    counts = {r["s"]: (r["c0"], r["c1"]) for r in counted}
    n = counts.pop(-1)
    return Model(Lexicons({stems[k]: c for k, c in counts.items()}, n), words, marks)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = 6000,
    threshold: float = THRESHOLD,
    folds: int = 4,
    held: int = 2,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with held_out, score and predicted; columns of these names are replaced.

    Learns from labels of rows whose crc32(id) mod ``folds`` is not ``held``.
    About ``most_rows`` labelled rows (their whole texts) are used to fit; every
    whole text is scored.
    """
    model = fit(docs, labels, id_col, text_col, label_col, id_hash(id_col, folds) != held, most_rows)

    def kernel():
        def run(texts):
            made = [model.score(t or "") if model else 0.0 for t in texts.to_pylist()]
            return made, [int(s >= threshold) for s in made]

        return run

    held_docs = docs.withColumn("held_out", id_hash(id_col, folds) == held)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "held_out"]
    return append(held_docs, [text_col], "score double, predicted int", kernel, [*keep, "held_out"])


def reject(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = 6000,
    threshold: float = THRESHOLD,
    folds: int = 4,
    held: int = 2,
) -> DataFrame:
    """``docs`` without those predicted toxic."""
    model = fit(docs, labels, id_col, text_col, label_col, id_hash(id_col, folds) != held, most_rows)

    def kernel():
        return lambda texts: [model is None or model.score(t or "") < threshold for t in texts.to_pylist()]

    return where(docs, [text_col], kernel)
