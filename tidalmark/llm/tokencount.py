"""Token counts from pre-token frequencies.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens
as its pre-tokens have pieces.  Each task splits texts into pre-tokens and
counts them by document.  The pieces of a pre-token are counted once:

* those of the ``head`` most frequent pre-tokens of a bounded sample of
  documents on the driver, and broadcast (a table of at most ``head`` rows,
  which only saves shuffling and never changes a result);
* those of every other pre-token where a shuffle by pre-token brings its
  (document, frequency) rows together, in ``SALTS`` tasks at most, so that one
  pre-token of many documents does not fill a single task.

The sums by document follow; no ids are made for documents.

The library splits off the special string before everything else and counts it
as one token; so does this.  A text is handled whole.  Nulls count as empty: 0
bytes, 0 tokens.  Rows that repeat an id each get their own row.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, quoted, slices

#: The public pre-tokenizer's pattern and special string.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
SPLIT = regex.compile(PATTERN)
#: Code points that this pattern and the library's splitter may class apart
#: (later Unicode versions): a text with one is split by the library.
OTHER = regex.compile("[^\u0000-\u0557\u2000-\u206f]")
OVER = 1024
MEMO = 400_000
SALTS = 4
_memo: dict[str, dict[str, int]] = {}
_tokenizers: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """The library's tokenizer, once a process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def pieces(path: str, pretokens: list[str]) -> list[int]:
    made = tokenizer(path).encode_batch(pretokens, add_special_tokens=False)
    return [len(e.ids) for e in made]


def split_text(text: str, path: str) -> list[str]:
    if OTHER.search(text):
        return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return SPLIT.findall(text)


def pretokens(text: str, path: str) -> tuple[Counter, int]:
    """Frequencies of pre-tokens, and the number of special strings."""
    if SPECIAL not in text:
        return Counter(split_text(text, path)), 0
    parts = text.split(SPECIAL)
    counts: Counter = Counter()
    for part in parts:
        counts.update(split_text(part, path))
    return counts, len(parts) - 1


def head_table(docs: DataFrame, id_col: str, text_col: str, path: str, head: int, sample_docs: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of about ``sample_docs`` texts."""
    total = docs.count()
    share = int(min(1.0, sample_docs / max(1, total)) * (1 << 30))
    some = docs.where(F.pmod(F.xxhash64(quoted(id_col), quoted(text_col)), F.lit(1 << 30)) < share)

    def kernel():
        def run(texts):
            counts: Counter = Counter()
            for t in texts.to_pylist():
                counts.update(pretokens(t or "", path)[0])
            return ([[{"p": p, "n": n} for p, n in counts.items()]] + [[]] * (len(texts) - 1),)

        return run

    rows = (
        append(some, [text_col], "c array<struct<p:string,n:long>>", kernel, [])
        .select(F.inline("c"))
        .groupBy("p")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > 1)
        .orderBy(F.desc("n"), "p")
        .limit(head)
        .select("p")
        .collect()
    )
    found = [r["p"] for r in rows if r["p"]]
    return dict(zip(found, pieces(path, found), strict=True)) if found else {}


def count(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    head: int = 100_000,
    sample_docs: int = 4000,
) -> DataFrame:
    """id, n_bytes, n_tokens for each row of ``docs``."""
    path = path or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(head_table(docs, id_col, text_col, path, head, sample_docs))
    src = docs.select(
        F.monotonically_increasing_id().alias("rid"), quoted(id_col).alias("id"), quoted(text_col).alias("text")
    )
    out = f"rid long, id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, piece string"
    id_kind = src.schema["id"].dataType

    def split(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        known = shared.value
        kinds = [pa.int64(), to_arrow_type(id_kind), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for part in slices(batch, 2):
                rid, ids, sizes, tokens, rest = [], [], [], [], []
                for r, i, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    t = t or ""
                    counts, total = pretokens(t, path)
                    for p, n in counts.items():
                        k = known.get(p)
                        if k is None:
                            rid.append(r)
                            ids.append(None)
                            sizes.append(None)
                            tokens.append(n)
                            rest.append(p)
                        else:
                            total += k * n
                    rid.append(r)
                    ids.append(i)
                    sizes.append(len(t.encode()))
                    tokens.append(total)
                    rest.append(None)
                columns = [rid, ids, sizes, tokens, rest]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rid", "id", "n_bytes", "n_tokens", "piece"]
                )

    def summed(batches):
        memo = _memo.setdefault(path, {})
        for batch in batches:
            rest = batch.column(4).to_pylist()
            if len(memo) > MEMO:
                memo.clear()
            new = list({p for p in rest if p is not None and p not in memo})
            memo.update(zip(new, pieces(path, new), strict=True))
            n = [k if p is None else k * memo[p] for k, p in zip(batch.column(3).to_pylist(), rest, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in range(3)], pa.array(n, pa.int64())], ["rid", "id", "n_bytes", "n_tokens"]
            )

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A document's own row goes by its rid, and a pre-token of many documents to SALTS tasks, each of which counts its pieces once.
    place = F.when(F.col("piece").isNull(), F.xxhash64("rid")).otherwise(F.xxhash64("piece", F.pmod("rid", F.lit(SALTS))))
    dealt = src.mapInArrow(split, out).repartition(parts, place)
    return (
        dealt.mapInArrow(summed, out.rsplit(",", 1)[0])
        .groupBy("rid")
        .agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        .drop("rid")
    )


def digest(docs: DataFrame, **options) -> DataFrame:
    return count(docs, **options).withColumn("over_limit", F.col("n_tokens") > OVER)
