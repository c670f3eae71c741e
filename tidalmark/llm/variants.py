"""Spelling variants of the corpus's words, grouped by a symmetric-delete join.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case.  A
run whose unsigned crc32 h of ``<id>:<run>`` is a multiple of ``slip`` loses
its code point h % length first (the corpus's own misspellings); 0 turns that
off.  The vocabulary is all results of at least ``least_chars`` code points
that occur ``least`` times.

1. *Vocabulary*: an Arrow kernel adds up the words of as many documents as fit
   in a table of ``HELD`` words; Spark sums the rest by word.
2. *Keys*: every word emits itself and each distinct single deletion as the
   64-bit hash of the string, with the place deleted (-1: none).  The hash is
   a sum over the letters, so that all deletions of a word of any length cost
   as much as its letters.
3. *Join*: an equi-join on the hash brings words together.  A pair is near if
   the strings behind the key are the same (so a collision of hashes costs a
   comparison and no more) and the words differ by one letter put in, left out
   or replaced.  Near words have exactly one such string in common, so no
   pair is met twice.  A key has at most as many words as one letter can be
   put into it, 90 for each place, however large the corpus is.
4. *Forms*: by word, the number of near words and the one of largest count, if
   that is ``times`` the word's own; partial aggregates go first.
5. *Roots*: a form has ``times`` the count of its word, so chains are short
   (27 forms reach 2**63); each round follows a form twice as far, until none
   has another.

A null text has no words, a null id counts as empty text; repeated rows count
again (occurrences are what is counted).  Ties of count go to the word that
comes first in code-point order.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, raw, slices, small_batches

LETTERS = "a-zÀ-ÿ"
#: Distinct words that a task adds up before it sends them on.
HELD = 1 << 18
BASE = 0x9E3779B97F4A7C15


def vocabulary(docs: DataFrame, text_col: str, id_col: str, least: int, least_chars: int, slip: int, most: int = HELD) -> DataFrame:
    """``word, n``: the words that occur ``least`` times."""
    src = docs.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("id"), quoted(text_col).alias("text"))
    runs = re.compile(f"[{LETTERS}]{{{max(1, least_chars)},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, 1):
                for id_, text in zip(raw(part.column(0)), raw(part.column(1)), strict=True):
                    own = Counter(runs.findall(text.lower().decode(errors="replace")))
                    slips = []
                    if slip:
                        begun = crc32(id_ + b":")
                        slips = [(w, h) for w in own if not (h := crc32(w.encode(), begun)) % slip]
                    for word, h in slips:
                        n, at = own.pop(word), h % len(word)
                        if len(word) > least_chars:
                            held[word[:at] + word[at + 1 :]] += n
                    held.update(own)
                    if len(held) >= most:
                        yield sent(held)
                        held.clear()
        if held:
            yield sent(held)

    def sent(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    small_batches(docs)
    found = src.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length, as a matrix of code points: the hash of each
    word, and of the word without its letter j, which needs one running sum of
    letters in place and one of letters moved up."""
    with np.errstate(over="ignore"):
        n, length = words.shape
        power = np.multiply.accumulate(np.full(length + 1, BASE, np.uint64))
        letters = words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        letters ^= letters >> np.uint64(32)
        placed = np.zeros((n, length + 1), np.uint64)
        moved = np.zeros((n, length + 1), np.uint64)
        np.cumsum(letters * power[1:], axis=1, out=placed[:, 1:])
        np.cumsum(letters * power[:-1], axis=1, out=moved[:, 1:])
        return _mixed(placed[:, -1]), _mixed(placed[:, :-1] + moved[:, -1:] - moved[:, 1:])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def keys(words: DataFrame) -> DataFrame:
    """``key, at, word, n`` of each word itself (at -1) and of each of its
    distinct deletions (at the first letter of a run of equal ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            length = np.fromiter(map(len, texts), np.int64, len(texts))
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                most = max(1, (1 << 18) // int(size))
                for first in range(0, len(rows), most):
                    yield _keys(batch, texts, rows[first : first + most], int(size))

    return words.select("word", "n").mapInArrow(run, "key long, at int, word string, n long")


def _keys(batch: pa.RecordBatch, texts: list[str], rows: np.ndarray, size: int) -> pa.RecordBatch:
    points = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), "<u4").reshape(len(rows), size)
    own, less = hashes(points)
    first = np.ones(points.shape, bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]
    which, at = np.nonzero(first)
    took = pa.array(np.concatenate([rows, rows[which]]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([own, less[first]])),
            pa.array(np.concatenate([np.full(len(rows), -1), at]).astype(np.int32)),
            batch.column(0).take(took),
            batch.column(1).take(took),
        ],
        ["key", "at", "word", "n"],
    )


def near(words: DataFrame) -> DataFrame:
    """``word, n, other, m``: each pair of words that differ by one letter put
    in, left out or replaced, in both directions."""
    found = keys(words)
    a = found.select("key", F.col("at").alias("i"), "word", "n")
    b = found.select("key", F.col("at").alias("j"), F.col("word").alias("other"), F.col("n").alias("m"))
    whole = "{w} = concat(substr({v}, 1, {i}), substr({v}, {i} + 2))"
    same = F.expr(
        "CASE WHEN i < 0 AND j < 0 THEN false"
        f" WHEN i < 0 THEN {whole.format(w='word', v='other', i='j')}"
        f" WHEN j < 0 THEN {whole.format(w='other', v='word', i='i')}"
        " ELSE word <> other AND concat(substr(word, 1, i), substr(word, i + 2)) = concat(substr(other, 1, j), substr(other, j + 2))"
        " AND levenshtein(word, other, 1) = 1 END"
    )
    return a.join(b.hint("merge"), "key").where(same).select("word", "n", "other", "m")


def forms(words: DataFrame, times: int) -> DataFrame:
    """``word, n_near, form, form_n``; the last two null where no near word has
    ``times`` the word's count."""
    # The smallest by (-count, word) is the most frequent one, ties in code-point order.
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other")))
    by_word = near(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.m") >= F.col("n") * times
    return by_word.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))


def roots(linked: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form: the form that has none itself."""
    reach = cut(linked.select("word", F.col("form").alias("root")))
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = reach.join(on, "root", "left")
        if not further.where("next IS NOT NULL").take(1):
            return reach
        reach = cut(further.select("word", F.coalesce("next", "root").alias("root")))


def group(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    least: int = 5,
    least_chars: int = 6,
    times: int = 5,
    slip: int = 0,
    held: int = HELD,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of the corpus."""
    words = cut(vocabulary(docs, text_col, id_col, least, least_chars, slip, held))
    found = cut(forms(words, times))
    whole = words.join(found, "word", "left").join(roots(found.where("form IS NOT NULL")), "word", "left")
    return whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
c AS (SELECT id, w, count(*) AS n FROM t WHERE length(w) >= 6 GROUP BY id, w),
x AS (SELECT id, w, n, hex(encode(id || ':' || w)) AS e FROM c),
y AS (SELECT id, w, n, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(e) // 2 + 1),
             lambda k: list_transform(range(0, 8), lambda b: ((('0x' || substr(e, 2 * k - 1, 2))::UBIGINT) >> b) & 1)))),
             lambda a, b: xor(a >> 1, 3988292384::UBIGINT * (xor(a, b) & 1))) AS r FROM x),
h AS (SELECT w, n, xor(r, 4294967295::UBIGINT) AS h FROM y),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
         UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN words b ON a.s = b.word
         UNION SELECT b.word, b.n, a.word, a.n FROM d a JOIN words b ON a.s = b.word),
g AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
f AS (SELECT g.word, g.n_near, CASE WHEN g.m >= 5 * g.n THEN min(near.other) END AS form, CASE WHEN g.m >= 5 * g.n THEN g.m END AS form_n
      FROM g JOIN near ON near.word = g.word AND near.m = g.m GROUP BY g.word, g.n_near, g.m, g.n),
z AS (WITH RECURSIVE p(word, top) AS (SELECT word, word FROM words UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.top AND f.form IS NOT NULL)
      SELECT p.word, p.top AS root FROM p LEFT JOIN f ON f.word = p.top WHERE f.form IS NULL)
SELECT words.word, words.n, coalesce(f.n_near, 0) AS n_near, f.form, f.form_n, z.root
FROM words JOIN z ON z.word = words.word LEFT JOIN f ON f.word = words.word
"""
