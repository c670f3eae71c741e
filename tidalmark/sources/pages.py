"""Recorded pages of an exchange: bars, option candles and option trades.

A page is the JSON that a call returned, in a folder
``<path>/symbol=<s>/interval=<i>/cursor=<ms>/until=<ms>``: the call asked from
``cursor`` and the next one asks from ``until``.  A file holds one page, or several
successive ones, each behind a record separator (which JSON never holds) and
its own ``cursor,until`` line; the folder then names the range of all.  So the number of files
grows with the pages by ``together``, and a store is not asked for a file by page.  A read of
[start, end) prunes the folders, so a file outside the range is never opened,
and each page is a row of its own until its array is taken apart.  Pages may overlap, within a
recording or from several: a bar counts once, as the page asked last has it.
Any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import blocks

PAGE = "value string, symbol string, interval string, cursor long, until long"
#: The places of a bar's columns in its array.
KLINE = {"open_time": (0, "long"), "open": (1, "double"), "high": (2, "double"), "low": (3, "double"), "close": (4, "double"), "volume": (5, "double"), "quote_volume": (7, "double"), "trades": (8, "long"), "taker_base_vol": (9, "double"), "taker_quote_vol": (10, "double")}
#: The names that a field goes by, the first that has a value counts.
ENVELOPES = ("result", "candles", "trades", "data")
CANDLE = {
    "open_time": (("time", "t", "timestamp", "open_time"), "long"), "open": (("open", "o"), "double"), "high": (("high", "h"), "double"), "low": (("low", "l"), "double"),
    "close": (("close", "c"), "double"), "volume": (("volume", "v"), "double"),
}
TRADE = {"open_time": (("timestamp", "t", "time"), "long"), "price": (("price", "p"), "double"), "size": (("size", "qty", "q"), "double"), "side": (("side", "s"), "string"), "trade_id": (("id", "trade_id"), "string")}


#: Between the pages of a file, and what a page's own range looks like.
SEPARATOR, RANGE = "\x1e", "^(-?[0-9]+),(-?[0-9]+)\n"


def record(df: DataFrame, path: str, item: Column, interval: str, size: int = 1000, overlap: int = 0, envelope: Column | None = None, together: int = 64) -> None:
    """Write the rows (symbol, open_time and what ``item`` names) as pages of ``size``, each
    with ``overlap`` rows of the next one, ``together`` of them in a file.  ``item`` is the JSON of a row, ``envelope``
    (of ``{items}``, by symbol) what stands around the page's array."""
    rows, overlap = df.select("symbol", "open_time", item.alias("item")), min(overlap, size)
    whole = size * together
    made = blocks(rows, ("symbol",), ("open_time", "item"), ahead=overlap, rows=whole)
    made = made.withColumn("own", F.filter("_items", lambda r: r["_pos"] < (F.col("_block") + 1) * whole))
    times = lambda part: F.transform(part, lambda r: r["open_time"])

    def page(k):
        own = times(F.slice("own", k * size + 1, F.lit(size)))
        items = F.slice("_items", k * size + 1, F.lit(size + overlap))
        body = F.concat(F.lit("["), F.array_join(F.transform(items, lambda r: r["item"]), ","), F.lit("]"))
        text = body if envelope is None else F.replace(envelope, F.lit("{items}"), body)
        return F.concat(F.lit(SEPARATOR), F.array_min(own), F.lit(","), F.array_max(own) + 1, F.lit("\n"), text)

    several = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(own) - 1) div {size} as int)")), page)
    pages = made.select(
        F.array_join(several, "").alias("value"), "symbol", F.lit(interval).alias("interval"), F.array_min(times("own")).alias("cursor"), (F.array_max(times("own")) + 1).alias("until")
    )
    pages.write.partitionBy("symbol", "interval", "cursor", "until").text(path)


def pages(spark: SparkSession, path: str, interval: str, start: int, end: int) -> DataFrame:
    """The pages that may hold rows of [start, end), in milliseconds."""
    near = (F.col("until") > start) & (F.col("cursor") < end)
    found = spark.read.schema(PAGE).text(path, wholetext=True).where((F.col("interval") == interval) & near)
    each = found.withColumn("value", F.explode(F.filter(F.split("value", SEPARATOR), lambda v: v != "")))
    own = [F.regexp_extract("value", RANGE, k).try_cast("long") for k in (1, 2)]
    asked = each.withColumns({"cursor": F.coalesce(own[0], "cursor"), "until": F.coalesce(own[1], "until"), "value": F.regexp_replace("value", RANGE, "")})
    return asked.where(near)


def once(rows: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Rows of [start, end), one for each value of ``keys``: that of the page asked
    last; of equals in one page, the largest."""
    inside = rows.where((F.col("open_time") >= start) & (F.col("open_time") < end))
    rest = [c for c in rows.columns if c not in (*keys, "cursor", "until")]
    kept = inside.groupBy(*keys).agg(F.max(F.struct("cursor", "until", *rest)).alias("r"))
    return kept.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def klines(spark: SparkSession, path: str, interval: str, start: int, end: int) -> DataFrame:
    """Bars of [start, end): ``symbol, interval, open_time`` and the columns of ``KLINE``.
    Symbols are in capitals; rows without an open time go, and what does not
    parse is null."""
    found = pages(spark, path, interval, start, end)
    rows = found.select(F.upper("symbol").alias("symbol"), "interval", "cursor", "until", F.explode(F.from_json("value", "array<array<string>>")).alias("s"))
    cells = [F.try_element_at("s", F.lit(at + 1)).try_cast(kind).alias(c) for c, (at, kind) in KLINE.items()]
    return once(rows.select("symbol", "interval", "cursor", "until", *cells), ["symbol", "interval", "open_time"], start, end)


def named(spec: dict) -> tuple[T.ArrayType, list[Column]]:
    """The schema of a page's rows under any of their names, and their columns."""
    names = list(dict.fromkeys(n for several, _ in spec.values() for n in several))
    schema = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))

    def column(several, kind):
        """The first that is neither missing nor empty; a number of 0 counts as missing
        unless no other name has a value."""
        texts = [F.nullif(F.col(f"s.{n}"), F.lit("")) for n in several]
        if kind == "string":
            return F.coalesce(*texts)
        numbers = [t.try_cast("double") for t in texts]
        return F.coalesce(*[F.when(v != 0, t) for v, t in zip(numbers, texts, strict=True)], *texts).try_cast(kind)

    return schema, [column(several, kind).alias(c) for c, (several, kind) in spec.items()]


def unwrapped(found: DataFrame, spec: dict) -> DataFrame:
    """The rows of pages whose array lies under the first envelope that has any."""
    schema, columns = named(spec)
    envelope = T.StructType([T.StructField(e, schema) for e in ENVELOPES])
    inner = found.withColumn("e", F.from_json("value", envelope))
    items = F.coalesce(*[F.when(F.size(F.col(f"e.{e}")) > 0, F.col(f"e.{e}")) for e in ENVELOPES])
    return inner.select("symbol", "interval", "cursor", "until", F.explode(items).alias("s")).select(F.col("symbol").alias("instrument"), "interval", "cursor", "until", *columns)


def option_candles(spark: SparkSession, path: str, interval: str, start: int, end: int) -> DataFrame:
    """Candles of instruments in [start, end); a missing volume is 0."""
    rows = unwrapped(pages(spark, path, interval, start, end), CANDLE).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return once(rows, ["instrument", "interval", "open_time"], start, end)


def option_trades(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Trades of instruments in [start, end), sides in capitals; missing sizes are 0 and
    missing sides and ids empty.  Trades without an id count once for each
    instrument, time, price, size and side."""
    rows = unwrapped(pages(spark, path, "trades", start, end), TRADE)
    rows = rows.withColumns({"size": F.coalesce("size", F.lit(0.0)), "side": F.upper(F.coalesce("side", F.lit(""))), "trade_id": F.coalesce("trade_id", F.lit(""))})
    return once(rows, ["instrument", "open_time", "trade_id", "price", "size", "side"], start, end).drop("interval")
