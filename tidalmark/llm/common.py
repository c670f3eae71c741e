"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are not part of a letter-or-digit word, mapped to a space.
WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder.

    The folder is the one that the session names in ``spark.checkpoint.dir``;
    where none is set a temporary one is chosen in local mode, and a cluster
    is refused, as its executors share no such folder.  A written
    table survives lost executors, and its true size is known to later joins
    (a checkpoint keeps the estimate of the plan it was made by, which grows
    beyond all bounds in iterations).  Spark's file system removes the tables
    when the driver ends.
    """
    spark = df.sparkSession
    path = _fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fresh(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _folder()
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def dealt(frames: list[DataFrame], key: str) -> Iterator[DataFrame]:
    """``cut`` of the frames' union into buckets of ``key``, while the block lasts: joins on
    the key read the table where it lies, and only their other side moves.

    Each frame should lie by ``key`` in ``parts`` partitions, or each task writes a
    file for each bucket.  Frames are written one after another, and the shuffle
    files of each can go before the next one begins.
    """
    spark = frames[0].sparkSession
    path, name = _fresh(spark), f"dealt_{uuid.uuid4().hex}"
    for df in frames:
        df.write.format("parquet").bucketBy(parts(df), key).mode("append").option("path", path).saveAsTable(name)
        spark._jvm.System.gc()
    table = spark.table(name)
    try:
        yield table
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark.read.schema(table.schema).parquet(path))


def freed(df: DataFrame) -> DataFrame:
    """``cut``, and a request that Spark drop the shuffle files behind it now:
    it does so when the driver's JVM finds them unreachable, which a driver of
    little garbage may not look for until the disks are full."""
    out = cut(df)
    df.sparkSession._jvm.System.gc()
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a ``cut`` table, or a union of some, that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@functools.cache
def _folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tables")


#: Bits of the maps that drop rows before a join which then decides.
MAP_BITS, MAP_WORDS = 1 << 22, 16


def spot(column: Column) -> Column:
    """A value's place in a bit map."""
    return F.pmod(F.xxhash64(column), F.lit(MAP_BITS)).cast("int")


def bit_map(df: DataFrame, column: str):
    """A broadcast bit map, of a fixed size, of the values of a column: a row
    whose bit is not set has no partner in ``df``.

    Executors merge the bits of each 64-bit word, then those of MAP_WORDS words
    to one row, so the driver gets 1 row for each MAP_WORDS words at most and
    less than a MB in all, of any ``df``.
    """
    return bits_at(df, spot(quoted(column)), MAP_BITS)


def bits_at(df: DataFrame, place: Column, bits: int):
    """A broadcast bit map of ``bits`` places (a multiple of 1024), with the bits
    that ``place`` names set."""
    bit = F.expr("shiftleft(1L, b % 64)")
    words = df.select(place.alias("b")).groupBy(F.expr("b div 64").cast("int").alias("w")).agg(F.bit_or(bit).alias("m"))
    parts = [F.max(F.when(F.col("w") % MAP_WORDS == k, F.col("m"))).alias(f"m{k}") for k in range(MAP_WORDS)]
    rows = words.groupBy(F.expr(f"w div {MAP_WORDS}").cast("int").alias("r")).agg(*parts).na.fill(0).toArrow()
    found = np.zeros((bits // 64 // MAP_WORDS, MAP_WORDS), "<i8")
    for k in range(MAP_WORDS):
        found[rows["r"].to_numpy(), k] = rows[f"m{k}"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(np.packbits(np.unpackbits(found.view(np.uint8).ravel(), bitorder="little")))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of rows that go to a Python worker at once (both sides hold a batch).
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> None:
    """Bound the session's Arrow batches by bytes: a batch of so many rows of
    long texts or sets would take as much memory as they happen to need."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(name) == f"{64 << 20}b":  # Spark's default; what a user set stays
        conf.set(name, str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_hash(id_col: str, mod: int) -> Column:
    """crc32 of the id's text, modulo ``mod``; a null id counts as empty text."""
    text = F.coalesce(quoted(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(mod))


def append(
    df: DataFrame,
    inputs: list[str],
    schema: str,
    kernel: Callable[[], Callable[..., list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns that an Arrow kernel makes from the columns ``inputs``.

    ``kernel()`` runs once a task and returns a function from the input arrays
    to one list (or array) for each field of ``schema``.  ``keep`` names the
    columns that stay (all by default); one whose name an added column takes
    is replaced.
    """
    added = T.StructType.fromDDL(schema)
    new = {f.name.lower() for f in added}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    cols = list(dict.fromkeys([*keep, *inputs]))
    src = df.select(*[quoted(c) for c in cols])
    out = T.StructType([*[src.schema[c] for c in keep], *added])
    kinds = [_arrow(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for batch in batches:
            for part in slices(batch, cols.index(inputs[-1])):
                made = f(*[part.column(cols.index(c)) for c in inputs])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(cols.index(c)) for c in keep], *arrays], [*keep, *added.names]
                )
        pa.default_memory_pool().release_unused()

    small_batches(df)
    return src.mapInArrow(run, out)


def where(df: DataFrame, inputs: list[str], kernel: Callable[[], Callable[..., list]]) -> DataFrame:
    """The rows for which an Arrow kernel over the columns ``inputs`` says True.

    Every column is sent once and comes back as it is, whatever its name.
    """
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for batch in batches:
            for part in slices(batch, at[-1]):
                yield part.filter(pa.array(f(*[part.column(i) for i in at]), pa.bool_()))
        pa.default_memory_pool().release_unused()

    small_batches(df)
    return df.mapInArrow(run, df.schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of ``column`` (a row at least)."""
    size = batch.column(column).nbytes // max(1, batch.num_rows)
    rows = max(1, min(batch.num_rows, most // max(1, size)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def raw(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]
