"""Collocations from vertical positional lists.

A-Z in lower case; a text is split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those
into words ``[^\\x20\\x09]+``.  All is counted by language (null: ``und``).

1. A task numbers the words of as many documents as make a block of ``BLOCK``
   words; the block's postings are the places of each word.
2. A phrase's list holds the places where it starts.  It is extended by a
   merge-join of those places, moved behind the phrase, with the postings of
   the words that may follow (``Lists.extended``); a list's length is the phrase's exact frequency
   in the block, and the sums over blocks are its frequency.
3. One pass over the corpus for each length: only phrases whose words (from
   the third word on: whose first and last words but one) are frequent are
   extended.  Frequent phrases reach the tasks as a bit map of ``BITS`` bits
   (2 MB), whatever their number.  The map can let a phrase through that is
   not frequent, which the sum then drops, and never keeps one out; when it
   fills up, more lists are extended and the result stays the same.
4. Candidates (``least`` occurrences) are cut at each place; the counts of both
   parts are joined to them, the lowest score counts.
5. Sub-phrases of longer candidates take the largest of their counts, which
   decides what is dropped.  The first ``top`` of each language follow by a
   window, which Spark limits in each partition before rows move.

Scores are exact: decimals of 38 digits, for counts up to 10**15.

A null text has no words.  Repeated rows count again.  Ties of score and count
go by phrase in the order of UTF-8 bytes.  An empty table gives an empty
result.  A block ends between documents or pieces, so a single piece longer
than a block, of numbers of 4 bytes, is the most that a task holds beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bits_at, cut, quoted, raw, slices, small_batches

BLOCK = 1 << 21
BITS = 1 << 24
SEGMENT = 2 << 20
#: A byte that UTF-8 never has, for the end of a piece.
END = b"\xff"
PIECES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class Numbers(dict):
    """The numbers of one language's words, given out by the block."""

    def __init__(self, block: Block, lang: str):
        super().__init__({END: 0})
        self.block, self.lang = block, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.block.words)
        self.block.words.append(word)
        self.block.langs.append(self.block.numbered.index(self.lang))
        return n


class Block:
    """Words of a run of documents, by number, in order; 0 ends a piece."""

    def __init__(self):
        self.words, self.langs, self.numbered = [END], [-1], []
        self.by_lang: dict[str, Numbers] = {}
        self.parts, self.size = [np.zeros(1, np.int32)], 0

    def add(self, lang: str, tokens: list[bytes], ends: bool) -> None:
        if lang not in self.by_lang:
            self.numbered.append(lang)
            self.by_lang[lang] = Numbers(self, lang)
        self.parts.append(np.fromiter(map(self.by_lang[lang].__getitem__, tokens), np.int32, len(tokens)))
        if ends:
            self.parts.append(np.zeros(1, np.int32))
        self.size += len(tokens)


def blocks(batches: Iterator[pa.RecordBatch], most: int, stretch: int) -> Iterator[Block]:
    """Blocks of about ``most`` words of the (lang, text) rows of a task; so many
    bytes of a text are taken apart at once."""
    block = Block()
    for batch in batches:
        for part in slices(batch, 1):
            for lang, text in zip(part.column(0).to_pylist(), raw(part.column(1)), strict=True):
                text, at = text.lower().translate(PIECES), 0
                while at < len(text):
                    # A stretch ends behind a piece, or where none ends for long, behind a word.
                    end = len(text) if len(text) - at <= stretch else text.rfind(END, at, at + stretch) + 1
                    whole = end > at
                    if not whole:
                        found = [i for i in (text.find(c, at + stretch) for c in (b" ", b"\t", END)) if i >= 0]
                        end = min(found) if found else len(text)
                        whole = end == len(text)
                    block.add(lang, text[at:end].replace(END, b" \xff ").split(), whole)
                    at = end
                    if whole and block.size >= most:
                        yield block
                        block = Block()
    if block.size:
        yield block


def _turned(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(1)) | (h >> np.uint64(63))


class Lists:
    """The lists of a block's phrases of one length: ``start`` in order, the
    number of the phrase at each start, and each phrase's words and hash."""

    def __init__(self, start: np.ndarray, phrase: np.ndarray, words: np.ndarray, hashed: np.ndarray):
        self.start, self.phrase, self.words, self.hashed = start, phrase, words, hashed

    @classmethod
    def postings(cls, block: Block) -> Lists:
        ids = np.concatenate(block.parts)
        block.parts = []
        start = np.flatnonzero(ids).astype(np.int32)
        seeds = [xxhash.xxh64_intdigest(lang.encode(), 42) for lang in block.numbered]
        hashed = [0, *[xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(block.words[1:], block.langs[1:], strict=True)]]
        return cls(start, ids[start], np.arange(len(block.words), dtype=np.int32)[:, None], np.array(hashed, np.uint64))

    def frequent(self, bits: np.ndarray) -> Lists:
        """Those whose bit is set."""
        spot = (self.hashed & np.uint64(bits.size * 8 - 1)).astype(np.int64)
        kept = (bits[spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)[self.phrase]
        return Lists(self.start[kept], self.phrase[kept], self.words, self.hashed)

    def extended(self, postings: Lists) -> Lists:
        """Each phrase by the word behind it.  Both sides lie in order of places.
        The extended phrase without its first word is a phrase of this length
        that starts one further; without a list of its own it is not frequent,
        and neither is the extended one."""
        size = self.words.shape[1]
        behind = _met(self.start + 1, self.start) >= 0
        at = _met(self.start + size, postings.start)
        ok = behind & (at >= 0)
        pair = self.phrase[ok].astype(np.int64) * len(postings.words) + postings.phrase[at[ok]]
        del behind, at
        found, phrase = np.unique(pair, return_inverse=True)
        del pair
        old, word = np.divmod(found, len(postings.words))
        words = np.concatenate([self.words[old], postings.words[word]], axis=1)
        return Lists(self.start[ok], phrase.astype(np.int32), words, _turned(self.hashed[old]) ^ postings.hashed[word])

    def lengths(self) -> np.ndarray:
        return np.bincount(self.phrase, minlength=len(self.words))


def _met(places: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each of the ordered ``places`` stands in the ordered ``among``, or -1."""
    at = np.searchsorted(among, places).astype(np.int32)
    at[at == len(among)] = -1
    if len(among):
        at[among[at] != places] = -1
    return at


def phrase_hash() -> Column:
    """The hash of ``Lists``, of the columns lang and phrase."""
    return F.expr("aggregate(split(phrase, ' '), 0L, (h, w) -> (shiftleft(h, 1) | shiftrightunsigned(h, 63)) ^ xxhash64(lang, w))")


def counts(docs: DataFrame, maps: list, least: int, block: int = BLOCK, stretch: int = SEGMENT) -> DataFrame:
    """``lang, phrase, n`` of the phrases of ``len(maps) + 1`` words with ``least``
    occurrences, of which ``maps`` names the frequent ones by length.  For
    single words, a null phrase has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, block, stretch):
            found = postings = Lists.postings(part)
            for k, bits in enumerate(maps):
                found = found.frequent(np.frombuffer(bits.value, np.uint8))
                postings = found if k == 0 else postings
                found = found.extended(postings)
            postings = None
            yield from _sent(part, found, not maps)
            del part, found  # before the next one is read
        pa.default_memory_pool().release_unused()

    small_batches(docs)
    # Lists' lengths are sums of a block already; hardly any row meets its like in a task.
    lengths = docs.mapInArrow(run, "lang string, phrase string, n long").repartition("lang", "phrase")
    sums = lengths.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= least) | F.col("phrase").isNull())


def _sent(block: Block, found: Lists, totals: bool, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    names = ["lang", "phrase", "n"]
    length = found.lengths()
    words, langs = pa.array(block.words, pa.binary()), np.array(block.langs)
    # The postings have a row for the end of a piece, without places.
    rows = np.flatnonzero(length)
    for first in range(0, len(rows), most):
        some = rows[first : first + most]
        texts = [words.take(pa.array(found.words[some, k])) for k in range(found.words.shape[1])]
        phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary())) if len(texts) > 1 else texts[0]
        lang = pa.array(block.numbered, pa.string()).take(pa.array(langs[found.words[some, 0]]))
        yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(length[some])], names)
    if totals and len(rows):
        n = np.bincount(langs[rows], length[rows], len(block.numbered)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(block.numbered, pa.string()), pa.nulls(len(n), pa.string()), pa.array(n)], names)


def scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` at each candidate's lowest cut."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.expr("sequence(1, size(split(phrase, ' ')) - 1)")).alias("k"))
    halves = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    met = halves.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(
        "(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)))"
        " div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    )
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    return met.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def inside(candidates: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the largest count among longer candidates with
    the phrase of two words or more inside."""
    parts = F.expr(
        "flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))"
    )
    long = candidates.select("lang", "n", F.split("phrase", " ").alias("w")).where("size(w) > 2")
    return long.select("lang", "n", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    percent: int = 50,
    top: int = 2000,
    block: int = BLOCK,
    stretch: int = SEGMENT,
    bits: int = BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``."""
    src = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"), quoted(text_col).alias("text"))
    levels, maps = [], []
    for size in range(1, longest + 1):
        found = cut(counts(src, maps, least, block, stretch))
        levels.append(found.where("phrase IS NOT NULL"))
        if size == 1:
            totals = found.where("phrase IS NULL").select("lang", "n")
        if size < longest:
            maps.append(bits_at(levels[-1], phrase_hash().bitwiseAND(F.lit(bits - 1)), bits))
    known = levels[0]
    for level in levels[1:-1]:
        known = known.unionByName(level)
    candidates = levels[1]
    for level in levels[2:]:
        candidates = candidates.unionByName(level)
    left = scored(candidates, known).join(inside(candidates), ["lang", "phrase"], "left")
    left = left.where(f"longer IS NULL OR 100 * longer < {int(percent)} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w
      UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
k AS (SELECT c.*, u.k, array_to_string(w[1 : u.k], ' ') AS p, array_to_string(w[u.k + 1 : size], ' ') AS q
      FROM c JOIN (VALUES (1), (2)) u(k) ON u.k < size),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r,
             CAST((1000000::HUGEINT * k.a * k.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.p JOIN f y ON y.lang = k.lang AND y.phrase = k.q),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3)
      GROUP BY lang, phrase),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, encode(m.phrase)) AS rank
      FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * m.a)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, t.n, o.score FROM o JOIN t ON t.lang = o.lang WHERE o.rank <= 2000
"""
