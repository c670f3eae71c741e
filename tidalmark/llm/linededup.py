"""Lines that many documents share, dropped from all documents but one.

A text is split at ``\\n``.  A line's key is the line without
``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case.  Keys of at least
``least_chars`` code points found in at least ``least_docs`` documents lose all
their lines, except in the document of largest id that holds them; the lines
left are joined by ``\\n`` in their order.

1. An Arrow kernel splits each text and emits each key that a document holds
   once, as a 128-bit digest with the document's id (written once, about 24
   bytes a line).
2. Digests are grouped by (digest, id), which counts a document once whatever
   its rows, then by digest with partial counts, so a line that a third of all
   documents hold is never gathered.
3. Digests over the threshold meet the written lines again.  Those of more
   than a ten-thousandth of all matches go as a broadcast of ``HOT`` rows at
   most, all others by a shuffle in which no key has more rows than that.
4. Each document gets the digests it loses, and a second kernel takes its text
   apart by position and puts the rest together.

Digests are BLAKE2b of 16 bytes: two different keys among 10**12 are taken for
one with a chance under 10**-14.

A null or empty text is one empty line.  Rows of one id are one document: they
count once and lose the same keys.  Rows of null id are one document too,
smaller than any other.  An empty table gives an empty table.  Columns of any
name pass through, but one that an added column replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, cut, quoted, raw, slices, small_batches, unused

#: Rows of the broadcast of the keys that most documents share, at most.
HOT = 10_000
SPACE = b" \t\n\x0b\x0c\r"


def digest(line: bytes, least_chars: int) -> bytes | None:
    """Of the line's key; None where that is too short to be dropped."""
    key = line.strip(SPACE)
    if len(key) < least_chars or (not key.isascii() and len(key.decode(errors="replace")) < least_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def line_keys(docs: DataFrame, text_col: str, id_col: str, least_chars: int) -> DataFrame:
    """``id, h1, h2``: each key of a row once, as two halves of its digest."""
    src = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    out = T.StructType([src.schema["id"], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows, found = [], []
                for at, text in enumerate(raw(part.column(1))):
                    own = {digest(line, least_chars) for line in set(text.split(b"\n"))} - {None}
                    found += own
                    rows += [at] * len(own)
                halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                ids = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(halves[:, 0]), pa.array(halves[:, 1])], out.names)

    small_batches(docs)
    return src.mapInArrow(run, out)


def shared_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """``h1, h2, keeper, n``: keys of at least so many documents, with the
    largest id among them and their number."""
    once = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return once.groupBy("h1", "h2").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= least_docs)


def losses(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """``id, drops``: the digests that a document loses, each once."""
    total = shared.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") >= max(1000, total // HOT + 1)
    hot, rest = shared.where(many), shared.where(~many)
    met = lines.join(F.broadcast(hot), ["h1", "h2"]).unionByName(lines.join(rest.hint("merge"), ["h1", "h2"]))
    lost = met.where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    least_docs: int = 3,
    least_chars: int = 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_lines`` (before), ``n_dropped``
    and ``kept`` (the text that is left)."""
    names = docs.columns if keep is None else keep
    lines = cut(line_keys(docs, text_col, id_col, least_chars))
    shared = cut(shared_keys(lines, least_docs))
    id_, drops = unused(docs, "id"), unused(docs, "drops")
    lost = losses(lines, shared).toDF(id_, drops)
    src = docs.select(*[quoted(c) for c in dict.fromkeys([*names, id_col, text_col])])
    met = src.join(lost, quoted(id_col).eqNullSafe(quoted(id_)), "left")
    return append(met, [drops, text_col], "n_lines long, n_dropped long, kept string", lambda: lambda *x: _left(least_chars, *x), names)


def _left(least_chars: int, drops: pa.Array, texts: pa.Array):
    n_lines, n_dropped, kept = [], [], []
    start = drops.offsets.to_numpy()
    values = drops.values
    halves = np.empty((len(values), 2), "<i8")
    halves[:, 0], halves[:, 1] = values.field(0).to_numpy(), values.field(1).to_numpy()
    for at, text in enumerate(raw(texts)):
        lines = text.split(b"\n")
        gone = {h.tobytes() for h in halves[start[at] : start[at + 1]]}
        left = [x for x in lines if digest(x, least_chars) not in gone] if gone else lines
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(left))
        kept.append(b"\n".join(left))
    return n_lines, n_dropped, pa.array(kept, pa.binary()).cast(pa.string())


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT r, doc_id, unnest(w) AS line, unnest(range(len(w))) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 3),
x AS (SELECT k.r, k.doc_id, k.i, k.line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY r, doc_id
"""
