"""Row-by-row state over streams whose rows come in any order.

The twin of ``operators.scan`` for streams: rows wait in the state of their key
until the watermark has passed them, and then go through the step in order of
event time.  What comes out does not depend on how rows are dealt to files and
micro-batches, as long as none is later than the watermark's delay; later ones
are dropped by Spark and counted in its progress.

A timer of each key stands at its earliest waiting row.  A second kind of timer
closes a period (a day): when the watermark passes its end, ``close`` gives the
period's last rows, even where no further row ever comes.

Sessions need the RocksDB state store (``prepare``), as Spark keeps timers there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Sets the session's state store; a provider that the user has chosen stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name, "HDFSBacked"):
        spark.conf.set(name, ROCKS)


class InOrder(StatefulProcessor):
    """Waiting rows are a list state; the step's own state is pickled."""

    def __init__(self, names: list[str], rows: T.StructType, out: list[str], start: Callable, step: Callable, period: Callable | None, close: Callable | None):
        self.names, self.rows, self.out = names, rows, out
        self.start, self.step, self.period, self.closing = start, step, period, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.held = handle.getValueState("held", T.StructType([T.StructField("state", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            times = part["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(t), int(s), pickle.dumps(tuple(v))) for t, s, v in zip(times, part["seq"], part[self.names].itertuples(index=False), strict=True)])
            first = min(int(times.min()), first if first is not None else int(times.min()))
        if first is not None:
            self.handle.registerTimer(max(first // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        state = pickle.loads(self.held.get()[0]) if self.held.exists() else {"own": self.start(), "end": None}
        out, left = [], []
        for t, seq, values in rows:
            if t > passed:
                left.append((t, seq, values))
                continue
            out += self._closed(state, t, key)
            if self.period and state["end"] is None:
                state["end"] = self.period(t)
                self.handle.registerTimer(max(state["end"] // 1000, passed // 1000) + 1)
            out.append((*key, t, seq, *self.step(state["own"], *pickle.loads(values))))
        out += self._closed(state, passed, key)
        self.held.update((pickle.dumps(state),))
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        elif rows:
            self.waiting.clear()
        if out:
            made = pd.DataFrame(out, columns=self.out)
            made["ts"] = pd.to_datetime(made["ts"], unit="us")
            yield made

    def _closed(self, state: dict, t: int, key) -> list[tuple]:
        """The period's last row, if time ``t`` is beyond its end."""
        if state["end"] is None or t < state["end"]:
            return []
        out = [(*key, state["end"], None, *self.closing(state["own"]))]
        state["own"], state["end"] = self.start(), None
        return out


def ordered_scan(
    df: DataFrame,
    inputs: list[str],
    schema: str,
    start: Callable[[], object],
    step: Callable[..., tuple],
    late: str = "10 minutes",
    key: str = "symbol",
    period: Callable[[int], int] | None = None,
    close: Callable[[object], tuple] | None = None,
) -> DataFrame:
    """``key, ts, seq`` and the columns of ``schema`` of each row of a stream, from
    ``step(state, *inputs)``, in order of (ts, seq) by key.

    ``period(t)`` gives the end of the period that a time (microseconds) lies in;
    where it ends, a row of ``close(state)`` with a null seq goes out and the
    state starts anew.
    """
    prepare(df.sparkSession)
    added = T.StructType.fromDDL(schema)
    out = T.StructType([df.schema[key], T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), *added])
    rows = T.StructType([T.StructField("t", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("row", T.BinaryType())])
    worker = InOrder(inputs, rows, out.names, start, step, period, close)
    columns = list(dict.fromkeys([key, "ts", "seq", *inputs]))
    return df.select(*columns).withWatermark("ts", late).groupBy(key).transformWithStateInPandas(worker, out, "append", "EventTime")


def trend_step(weights: tuple[float, float, float] = (0.45, 0.35, 0.20)):
    """Start and step of the trend engine, for ``scan`` and ``ordered_scan`` alike:
    direction by two of three votes, whether it is fresh, strength, and the
    number of rows since the last flip."""

    def start() -> dict:
        return {"direction": 0, "since": None}

    def step(s: dict, fast: float, slow: float, major: float, base: float, up: bool, broke: bool) -> tuple:
        ups = (fast > slow) + (major > base) + bool(up)
        downs = (fast < slow) + (major < base) + (not up)
        direction = 1 if ups >= 2 and ups > downs else -1 if downs >= 2 and downs > ups else 0
        fresh = direction != s["direction"] and direction != 0
        s["since"] = 0 if fresh else None if s["since"] is None else s["since"] + 1
        s["direction"] = direction
        strength = weights[0] * (fast != slow) + weights[1] * (major != base) + weights[2] * bool(broke)
        return direction, bool(fresh), max(0.0, min(1.0, strength)), s["since"]

    return start, step


TREND = "direction int, fresh boolean, strength double, since long"
HALTS = "day_pnl double, losses int, halted boolean"
DAY = 86_400_000_000


def halt_step(stop: float = 5.0, most: int = 3):
    """Start, step and close of the kill switch: halted from the trade on which the
    day's result falls to ``-stop`` or ``most`` losses come in a row."""

    def start() -> dict:
        return {"pnl": 0.0, "losses": 0, "halted": False}

    def step(s: dict, pnl: float) -> tuple:
        s["pnl"] += pnl
        s["losses"] = s["losses"] + 1 if pnl < 0 else 0
        s["halted"] = s["halted"] or s["pnl"] <= -abs(stop) or s["losses"] >= most
        return s["pnl"], s["losses"], s["halted"]

    def close(s: dict) -> tuple:
        return s["pnl"], s["losses"], s["halted"]

    return start, step, close


def day_end(t: int) -> int:
    return (t // DAY + 1) * DAY


def running_halts(results: DataFrame, late: str = "10 minutes", stop: float = 5.0, most: int = 3) -> DataFrame:
    """The kill switch over a stream of (symbol, ts, seq, pnl): a row a trade, and one
    with a null seq at the end of each day that had trades."""
    start, step, close = halt_step(stop, most)
    return ordered_scan(results, ["pnl"], HALTS, start, step, late, period=day_end, close=close)


def running_trend(indicators: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The trend engine over a stream of (symbol, ts, seq, fast, slow, major, base, up, broke)."""
    start, step = trend_step()
    return ordered_scan(indicators, ["fast", "slow", "major", "base", "up", "broke"], TREND, start, step, late)
