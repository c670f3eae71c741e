"""Benchmark decontamination with a broadcast set of test n-grams.

The benchmark's windows of ``n`` words (a shorter item is one window) go to the
executors as a broadcast hash set.  The benchmark may be of any size: it is cut
by a hash of the item's text into blocks of about ``block_bytes`` at most, and
the training documents pass through one block after another, so what one
broadcast holds is bounded.  Each task maps a document's words to the numbers
of the block's words (others: none), hashes the windows that consist of known
words only with a rolling hash, looks the hashes up, and verifies each hit
word by word.

Words: A-Z lower-cased, then runs of other bytes than
``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

Nulls: a null text has no words and no hit; an item without words (or null)
has no window; an item whose id is null marks words but is not among the items
listed.  Repeated items count once.  Empty tables give empty results, an empty
benchmark no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, append, cut, quoted, raw

BASE = np.uint64(0x9E3779B97F4A7C15)
SPANS = "array<struct<first:int,last:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_TABLE).split()


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, BASE, np.uint64))
    return out


class Windows:
    """Windows of the items of one block: word numbers, and for each window
    length the sorted hashes with the windows that have them."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - n + 1) if ids else 0):
                owners = found.setdefault(tuple(ids[at : at + n]), set())
                if item is not None:
                    owners.add(item)
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[tuple[tuple[int, ...], set[str]]]]]] = {}
        for length in sorted({len(w) for w in found}):
            table: dict[int, list] = {}
            for window, owners in found.items():
                if len(window) == length:
                    h = int((np.array(window, np.uint64) * powers(length)).sum(dtype=np.uint64))
                    table.setdefault(h, []).append((window, owners))
            self.by_length[length] = (np.array(sorted(table), np.uint64), table)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged spans [first, last] of hit words, items."""
        words = words_of(text)
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        if not ids.any():
            return len(words), [], set()
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        spans, items = [], set()
        for length, (hashes, table) in self.by_length.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for k, p in enumerate(powers(length)):
                h += ids[at + k] * p
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero(hashes[place] == h):
                here = tuple(ids[at[i] : at[i] + length].tolist())
                for window, owners in table[int(h[i])]:
                    if window == here:
                        spans.append((int(at[i]), int(at[i]) + length - 1))
                        items |= owners
        return len(words), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's distinct items in parts of about ``block_bytes``."""
    items = benchmark.select(
        quoted(item_col).cast("string").alias("item"), quoted(text_col).cast("binary").alias("text")
    ).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k) for k in range(count)]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 13,
    block_bytes: int = 16 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (first and last word of each hit
    stretch) and hit_items (ids of the items with windows in the text)."""
    keep = docs.columns if keep is None else keep
    parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    out, last = docs, len(parts) - 1
    for k, part in enumerate(parts):
        shared = docs.sparkSession.sparkContext.broadcast(
            Windows([(r["item"], bytes(r["text"])) for r in part.collect()], n)
        )

        def kernel(shared=shared, more=k > 0):
            windows = shared.value

            def run(*columns):
                before = [c.to_pylist() for c in columns[:-1]] if more else None
                counts, spans, items = [], [], []
                for i, text in enumerate(raw(columns[-1])):
                    count, hit, named = windows.scan(text)
                    if before:
                        hit = merged(hit + [(s["first"], s["last"]) for s in before[0][i]])
                        named = named | set(before[1][i])
                    counts.append(count)
                    spans.append([{"first": a, "last": b} for a, b in hit])
                    items.append(sorted(named))
                return counts, spans, items

            return run

        names = [*(["hit_spans", "hit_items"] if k else []), text_col]
        out = append(
            out,
            names,
            f"n_words long, hit_spans {SPANS}, hit_items array<string>",
            kernel,
            keep if k == last else list(dict.fromkeys([*keep, text_col])),
        )
        if k < last:
            out = cut(out)
    return out


def n_hit() -> F.Column:
    return F.aggregate(
        "hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"] + 1).cast("long")
    )


def judged(scanned: DataFrame, share: int = 20) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the scan's columns."""
    hits = n_hit()
    return scanned.select(
        "*",
        hits.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        ((hits > 0) & (hits * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (``remove='documents'``), or
    with the hit words cut out of every text (``remove='spans'``).

    Columns go by number meanwhile, so that none is mistaken for an added one.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain, text = docs.toDF(*names), names[docs.columns.index(text_col)]
    scanned = judged(scan(plain, benchmark, text_col=text, **options))
    if remove == "documents":
        left = scanned.where(~F.col("contaminated")).select(*names)
    else:
        left = append(scanned, ["hit_spans", text], f"{text} string", lambda: _without, names).select(*names)
    return left.toDF(*docs.columns)


def _without(spans: pa.Array, texts: pa.Array):
    out = []
    for hit, text in zip(spans.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
        if text is None or not hit:
            out.append(text.decode() if text is not None else None)
            continue
        mask = np.frombuffer(text.lower().translate(WORD_TABLE), np.uint8) != 0x20
        edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        parts, at = [], 0
        for s in hit:
            parts.append(text[at : starts[s["first"]]])
            at = ends[s["last"]]
        out.append(b"".join([*parts, text[at:]]).decode())
    return (out,)


def empty_digest() -> str:
    return hashlib.sha256(b"").hexdigest()


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT p.doc_id, p.i, n.n, g.item_id
      FROM p CROSS JOIN (SELECT DISTINCT n FROM g) n
      JOIN g ON g.n = n.n AND g.s = array_to_string(p.w[p.i : p.i + n.n - 1], ' ')
      WHERE p.i + n.n - 1 <= len(p.w)),
x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(y.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(y.items, '')) AS items_sha256,
       coalesce(x.n_hit, 0) > 0 AND 20 * coalesce(x.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""
