"""Language ID with a convolutional network over bytes.

Bytes are embedded, filters of widths 2, 3 and 4 slide over windows of
``WINDOW`` bytes, each filter's maximum in the window is kept, and a softmax
over the languages reads those maxima.  It is trained in numpy with Adam, on
the driver, on a bounded sample: about ``per_lang`` labelled documents of each
language (by hash of the id; their whole texts), from whose windows each of 500
steps draws 64.  Scoring cuts the whole text of every document into consecutive windows and averages the
windows' log-probabilities by their number of bytes.

Nulls: a null text, or one without a letter, is ``und`` with score 0.  Without
a labelled row nothing is learned and every document is ``und``.  Ties go to
the language first in code-point order.  Repeated rows each get their own row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, id_hash, quoted, where

WINDOW, EMBED, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 16
WIDEST, N = max(WIDTHS), len(WIDTHS) * FILTERS
UND = "und"
LETTER = re.compile(r"[^\W\d_]")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window bytes, the text of each, and the number of bytes in each."""
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-sizes // WINDOW))
    out = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    at = 0
    for text, count in zip(texts, counts, strict=True):
        out[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += count * WINDOW
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts) - 1
    length = np.full(len(owner), WINDOW)
    length[ends] = sizes - (counts - 1) * WINDOW
    return out.reshape(-1, WINDOW), owner, length


class Net:
    """Parameters: embedding [256, E], filters [WIDEST * E, N] with zeros where
    a filter is narrower, their bias, and the softmax layer."""

    def __init__(self, langs: list[str], seed: int = 0):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.mask = np.zeros((WIDEST * EMBED, N), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)),
            "f": r.normal(0, 0.3, self.mask.shape) * self.mask,
            "b": np.zeros(N),
            "o": r.normal(0, 0.1, (N, len(langs))),
            "c": np.zeros(len(langs)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def spread(self, x: np.ndarray) -> np.ndarray:
        e = np.take(self.p["e"], x, axis=0)
        n, s = WINDOW - WIDEST + 1, e.itemsize
        return as_strided(e, (len(x), n, WIDEST * EMBED), (WINDOW * EMBED * s, EMBED * s, s)).reshape(-1, WIDEST * EMBED)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = (self.spread(x) @ self.p["f"]).reshape(len(x), -1, N).max(1)
        h = np.maximum(z + self.p["b"], 0)
        y = h @ self.p["o"] + self.p["c"]
        y -= y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, t: int, m: dict, v: dict) -> None:
        spread = self.spread(x)
        conv = (spread @ self.p["f"]).reshape(len(x), -1, N)
        best = conv.argmax(1)
        z = np.take_along_axis(conv, best[:, None], 1)[:, 0] + self.p["b"]
        h = np.maximum(z, 0)
        o = h @ self.p["o"] + self.p["c"]
        q = np.exp(o - o.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(x)), y] -= 1
        q /= len(x)
        dz = (q @ self.p["o"].T) * (z > 0)
        rows = (np.arange(len(x))[:, None] * conv.shape[1] + best).ravel()
        picked = spread[rows].reshape(len(x), N, -1)
        df = np.einsum("bnk,bn->kn", picked, dz) * self.mask
        de = np.zeros_like(self.p["e"])
        back = (dz[:, :, None] * self.p["f"].T[None]).reshape(len(x), N, WIDEST, EMBED)
        for k in range(WIDEST):
            np.add.at(de, np.take_along_axis(x, best + k, 1), back[:, :, k])
        grads = {"e": de, "f": df, "b": dz.sum(0), "o": h.T @ q, "c": q.sum(0)}
        for k, g in grads.items():
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g
            v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
            self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def train(rows: list[tuple[bytes, str]], steps: int = 500, batch: int = 64) -> Net:
    langs = sorted({lang for _, lang in rows}, key=str.encode)
    net, r = Net(langs), np.random.default_rng(1)
    number = {lang: k for k, lang in enumerate(langs)}
    x, owner, length = windows([t for t, _ in rows])
    y = np.array([number[lang] for _, lang in rows])[owner]
    order = r.permutation(np.flatnonzero(length > 0))
    groups = [g for k in range(len(langs)) if len(g := order[y[order] == k])]
    m: dict = {}
    v: dict = {}
    for t in range(1, steps + 1):
        pick = np.concatenate([r.choice(g, -(-batch // len(groups))) for g in groups])
        part = x[pick].copy()
        for row in np.flatnonzero(r.random(len(part)) < 0.4):  # short texts too
            part[row, r.integers(4, WINDOW) :] = 0
        net.step(part, y[pick], 0.01 * (1 - t / (steps + 1)), t, m, v)
    return net


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn, per_lang: int) -> list:
    """At most about ``per_lang`` labelled rows of each language, whole texts."""
    rows = docs.where(learn & quoted(lang_col).isNotNull() & quoted(text_col).isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy(quoted(lang_col).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    h = F.pmod(F.xxhash64(quoted(id_col), F.lit("langid")), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(quoted(lang_col) == lang, int(min(1.0, per_lang / n) * (1 << 30))).otherwise(share)
    got = rows.where(h < share).select(
        quoted(text_col).cast("binary").alias("t"), quoted(lang_col).alias("l"), quoted(id_col).cast("string").alias("i")
    ).limit(per_lang * len(counts) * 2)
    return sorted((bytes(r["t"]), r["l"], zlib.crc32((r["i"] or "").encode())) for r in got.collect())


def judge(net: Net | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [UND] * len(texts), [0.0] * len(texts)
    have = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if net is None or not have:
        return names, scores
    x, owner, length = windows([texts[i].encode() for i in have])
    total = np.zeros((len(have), len(net.langs)))
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        np.add.at(total, owner[part], net.log_probs(x[part]) * length[part, None])
    total /= np.bincount(owner, length, len(have))[:, None]
    q = np.exp(total - total.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    for i, best, p in zip(have, q.argmax(1), q.max(1), strict=True):
        names[i], scores[i] = net.langs[best], float(p)
    return names, scores


def learned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 600,
    folds: int = 3,
    held: int = 1,
) -> Net | None:
    """The network of the rows whose crc32(id) mod ``folds`` is not ``held``."""
    rows = sample(docs, id_col, text_col, lang_col, id_hash(id_col, folds) != held, per_lang)
    return train([(t, lang) for t, lang, _ in rows]) if rows else None


def predict(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 3,
    held: int = 1,
    keep: list[str] | None = None,
    **options,
) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; columns of these names are replaced."""
    net = learned(docs, id_col, text_col, folds=folds, held=held, **options)
    held_docs = docs.withColumn("held_out", id_hash(id_col, folds) == held)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "held_out"]
    return append(
        held_docs, [text_col], "lang_pred string, score double", lambda: lambda texts: judge(net, texts.to_pylist()), [*keep, "held_out"]
    )


def reject(docs: DataFrame, least: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those whose language is ``und`` or scored under ``least``."""
    net = learned(docs, text_col=text_col, **options)

    def kernel():
        def run(texts):
            names, scores = judge(net, texts.to_pylist())
            return [n != UND and s >= least for n, s in zip(names, scores, strict=True)]

        return run

    return where(docs, [text_col], kernel)
