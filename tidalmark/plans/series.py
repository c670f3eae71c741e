"""Queries over long series: weighted statistics, spectra, peaks and cycle labels.

All of them lie in blocks (``operators.blocks``), so that one symbol's rows
spread over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators.blocks import ROWS, Adjusted, Last, Linear, joined, positioned, scanned, windowed
from ..operators.peaks import peaks, relaxed, spaced
from ..sources import feeds
from ..sources.feeds import BARS_SQL, TRADES_SQL
from .registry import query

ALPHA, LEAST = 0.06, 3


@query(
    f"""WITH {TRADES_SQL},
h AS (SELECT symbol, seq, CASE WHEN seq % 7 <> 0 THEN price END AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM trades),
w AS (SELECT a.symbol, a.seq, b.x, pow({1 - ALPHA}, a.i - b.i) AS w FROM h a JOIN h b ON b.symbol = a.symbol AND b.i <= a.i AND b.x IS NOT NULL),
m AS (SELECT symbol, seq, count(*) AS n, sum(w) AS w, sum(w * w) AS w2, sum(w * x) / sum(w) AS mean, sum(w * x * x) AS xx FROM w GROUP BY symbol, seq)
SELECT h.symbol, h.seq, round(CASE WHEN n >= {LEAST} THEN mean END, 5) AS mean,
       round(CASE WHEN n >= {LEAST} THEN sqrt(greatest(xx / w - mean * mean, 0) * w * w / (w * w - w2)) END, 4) AS std
FROM h LEFT JOIN m ON m.symbol = h.symbol AND m.seq = h.seq"""
)
def ewm_adjusted(spark, sf_dir):
    """Mean and deviation of past prices with weights that sum to one."""
    r = scanned(feeds.holed(spark, sf_dir).select("symbol", "ts", "seq", "price"), ["price"], "m double, s double", Adjusted("price", ALPHA, LEAST))
    return r.select("symbol", "seq", rnd("m", 5).alias("mean"), rnd("s", 4).alias("std"))


def _weighted_sql(x: str, source: str, out: str) -> str:
    return f"""{out} AS (SELECT a.ts, a.i, sum(w * b.{x}) / sum(w) AS m, sum(w) AS w, sum(w * w) AS w2, sum(w * b.{x} * b.{x}) AS xx
  FROM (SELECT a.ts, a.i, b.i AS j, pow(0.9, a.i - b.i) AS w FROM pair a JOIN pair b ON b.i <= a.i) a JOIN {source} b ON b.i = a.j GROUP BY a.ts, a.i)"""


@query(
    f"""WITH {BARS_SQL}, pair AS (SELECT a.ts, a.close AS a, b.close AS b, row_number() OVER (ORDER BY a.ts) AS i
  FROM bars a JOIN bars b ON b.ts = a.ts AND a.symbol = 'S1' AND b.symbol = 'S2'),
{_weighted_sql('a', 'pair', 'ma')}, {_weighted_sql('b', 'pair', 'mb')},
da AS (SELECT pair.i, pair.a - ma.m AS d FROM pair JOIN ma ON ma.i = pair.i), db AS (SELECT pair.i, pair.b - mb.m AS d FROM pair JOIN mb ON mb.i = pair.i),
{_weighted_sql('d', 'da', 'ca')}, {_weighted_sql('d', 'db', 'cb')}
SELECT ma.ts, round(ca.m * cb.m / sqrt((ma.xx / ma.w - ma.m * ma.m) * ma.w * ma.w / (ma.w * ma.w - ma.w2)
  * (mb.xx / mb.w - mb.m * mb.m) * mb.w * mb.w / (mb.w * mb.w - mb.w2)), 5) AS corr
FROM ma JOIN mb ON mb.i = ma.i JOIN ca ON ca.i = ma.i JOIN cb ON cb.i = ma.i WHERE ma.i > 2"""
)
def ewma_correlation(spark, sf_dir):
    """Product of the weighted mean deviations of two assets over that of their
    weighted standard deviations, where both have prices."""
    b = feeds.bars(spark, sf_dir)
    side = lambda s, c: b.where(F.col("symbol") == s).select("ts", F.col("close").alias(c))
    pair = side("S1", "a").join(side("S2", "b"), "ts").withColumn("pair", F.lit("S1 S2"))
    for c in ("a", "b"):
        pair = scanned(pair, [c], f"m{c} double, s{c} double", Adjusted(c, 0.1), ("pair",), ("ts",))
    pair = pair.withColumns({"da": F.col("a") - F.col("ma"), "db": F.col("b") - F.col("mb")})
    for c in ("da", "db"):
        pair = scanned(pair, [c], f"c{c} double, _s{c} double", Adjusted(c, 0.1), ("pair",), ("ts",))
    first = positioned(pair, ("pair",), ("ts",)).where("_pos > 1")
    return first.select("ts", rnd(F.col("cda") * F.col("cdb") / (F.col("sa") * F.col("sb")), 5).alias("corr"))


PHASE, PERIOD, TREND, STEADY = 64, 128, 32, 32


def analytic_weights(n: int = PHASE) -> np.ndarray:
    """The last value of the analytic signal of n values is their sum with these
    weights: the spectrum without negative frequencies, turned back."""
    double = np.where((np.arange(n) > 0) & (np.arange(n) < n / 2), 2.0, 0.0)
    double[0] = 1.0
    if n % 2 == 0:
        double[n // 2] = 1.0
    ages = n - 1 - np.arange(n)
    return (double * np.exp(2j * np.pi * np.outer(ages, np.arange(n)) / n)).sum(1) / n


def spectrum(x, pos, own, most: int = 1024) -> tuple:
    """Phase over 64 rows, period over 128, frequency, its change and steadiness,
    trend and cycle; each has its fixed value until its window is full."""
    v = x["close"]
    n = len(v)
    phase, period, trend, steady = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    if n >= PHASE:
        phase[PHASE - 1 :] = np.angle(sliding_window_view(v, PHASE) @ analytic_weights())
    if n >= PERIOD:
        windows = sliding_window_view(v, PERIOD)
        for first in range(0, len(windows), most):
            part = windows[first : first + most]
            power = np.abs(np.fft.rfft(part - part.mean(1, keepdims=True), axis=1))
            power[:, 0] = 0.0
            peak = np.maximum(power.argmax(1), 1)
            period[PERIOD - 1 + first :][: len(part)] = PERIOD / peak
    # Rows before the key's first do not exist; lent rows have no whole window, and are not returned.
    step = np.diff(phase, prepend=phase[:1])
    whole = np.mod(step + np.pi, 2 * np.pi) - np.pi
    whole[(whole == -np.pi) & (step > 0)] = np.pi
    frequency = np.clip(np.where(np.abs(step) < np.pi, step, whole), -np.pi, np.pi)
    change = np.clip(np.diff(frequency, prepend=frequency[:1]), -2 * np.pi, 2 * np.pi)
    if n >= TREND:
        trend[TREND - 1 :] = sliding_window_view(v, TREND).mean(1)
        steady[STEADY - 1 :] = 1.0 - np.minimum(1.0, sliding_window_view(frequency, STEADY).std(1) / np.pi)
    return tuple(c[own] for c in (phase, period, frequency, change, steady, trend, v - trend))


def smoother(period: float = 10.0) -> Linear:
    """Two poles over the mean of two rows; the state is the last two results and
    the last input."""
    a = math.exp(-1.414 * math.pi / period)
    c2, c3 = 2 * a * math.cos(1.414 * math.pi / period), -a * a
    c1 = 1 - c2 - c3

    def inputs(x, pos):
        v = x["close"]
        u = np.stack([c1 / 2 * v, np.zeros(len(v)), v], axis=1)
        if pos[0] == 0:  # the first result is the first value, the second their mean
            u[0, 0] = v[0]
            if len(v) > 1:
                u[1, 0] = (v[0] + v[1]) / 2 - (c2 + c1 / 2) * v[0]
        return u

    return Linear([[c2, c3, c1 / 2], [1, 0, 0], [0, 0, 0]], inputs, lambda s, x: (s[:, 0],))


def cycle_features(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """The eight cycle features of ``close``, which has no nulls, by symbol."""
    made = scanned(df, ["close"], "smooth double", smoother(), rows=rows)
    names = "phase period frequency acceleration consistency trend cycle".split()
    return windowed(made, ["close"], ", ".join(f"{c} double" for c in names), spectrum, back=PERIOD - 1, rows=rows)


_A = math.exp(-1.414 * math.pi / 10)
_C2, _C3 = 2 * _A * math.cos(1.414 * math.pi / 10), -_A * _A
_C1 = 1 - _C2 - _C3


@query(
    f"""WITH RECURSIVE {BARS_SQL},
k AS (SELECT j, sum(h * cos(2 * pi() * k * j / 64)) / 64 AS re, sum(h * sin(2 * pi() * k * j / 64)) / 64 AS im
  FROM (SELECT unnest(range(64)) AS j) CROSS JOIN (SELECT k, CASE WHEN k IN (0, 32) THEN 1 WHEN k < 32 THEN 2 ELSE 0 END AS h FROM (SELECT unnest(range(64)) AS k)) GROUP BY j),
ph AS (SELECT b.symbol, b.seq, atan2(sum(p.close * k.im), sum(p.close * k.re)) AS phase
  FROM bars b CROSS JOIN k JOIN bars p ON p.symbol = b.symbol AND p.seq = b.seq - k.j WHERE b.seq >= 64 GROUP BY b.symbol, b.seq),
f AS (SELECT b.symbol, b.seq, k.k, sqrt(pow(sum(p.close * cos(2 * pi() * k.k * j.j / 128)), 2) + pow(sum(p.close * sin(2 * pi() * k.k * j.j / 128)), 2)) AS power
  FROM bars b CROSS JOIN (SELECT unnest(range(1, 65)) AS k) k CROSS JOIN (SELECT unnest(range(128)) AS j) j
  JOIN bars p ON p.symbol = b.symbol AND p.seq = b.seq - j.j WHERE b.seq >= 128 GROUP BY b.symbol, b.seq, k.k),
pe AS (SELECT symbol, seq, 128.0 / arg_max(k, power) AS period FROM f GROUP BY symbol, seq),
s AS (SELECT symbol, seq, close AS y, 0.0::DOUBLE AS y1, close AS x FROM bars WHERE seq = 1
  UNION ALL SELECT b.symbol, b.seq, CASE WHEN b.seq = 2 THEN (b.close + s.x) / 2 ELSE {_C1!r} * (b.close + s.x) / 2 + {_C2!r} * s.y + {_C3!r} * s.y1 END, s.y, b.close
  FROM s JOIN bars b ON b.symbol = s.symbol AND b.seq = s.seq + 1),
a AS (SELECT b.symbol, b.seq, b.close, coalesce(ph.phase, 0) AS phase, coalesce(pe.period, 1) AS period, s.y AS smooth,
  CASE WHEN b.seq >= 32 THEN avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.seq ROWS 31 PRECEDING) ELSE 0 END AS trend
  FROM bars b JOIN s ON s.symbol = b.symbol AND s.seq = b.seq LEFT JOIN ph ON ph.symbol = b.symbol AND ph.seq = b.seq
  LEFT JOIN pe ON pe.symbol = b.symbol AND pe.seq = b.seq),
q AS (SELECT *, coalesce(phase - lag(phase) OVER (PARTITION BY symbol ORDER BY seq), 0) AS d FROM a),
r AS (SELECT *, CASE WHEN abs(d) < pi() THEN d ELSE d - 2 * pi() * floor((d + pi()) / (2 * pi())) END AS freq FROM q)
SELECT symbol, seq, round(phase, 6) AS phase, round(period, 4) AS period, round(smooth, 5) AS smooth, round(freq, 6) AS frequency,
  round(trend, 7) AS trend, round(close - trend, 7) AS cycle,
  round(coalesce(freq - lag(freq) OVER (PARTITION BY symbol ORDER BY seq), 0), 6) AS acceleration,
  CASE WHEN seq >= 32 THEN round(1 - least(1, stddev_pop(freq) OVER (PARTITION BY symbol ORDER BY seq ROWS 31 PRECEDING) / pi()), 6) ELSE 0 END AS consistency
FROM r"""
)
def fam_cycle(spark, sf_dir):
    """Hilbert phase, dominant period, super-smoother, instantaneous frequency, trend, cycle, phase acceleration and consistency."""
    r = cycle_features(feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", "close"))
    digits = {"period": 4, "smooth": 5, "trend": 7, "cycle": 7}
    names = "phase period smooth frequency trend cycle acceleration consistency".split()
    return r.select("symbol", "seq", *[rnd(c, digits.get(c, 6)).alias(c) for c in names])


def smoothed(df: DataFrame, window: int = 5, rows: int = ROWS) -> DataFrame:
    """``df`` with ``smooth``: the mean of the last ``window`` closes, filled forward,
    then back to the first; 9 digits, so that equal means are equal."""
    filled = scanned(df, ["close"], "last double", Last("close"), rows=rows)
    first = filled.groupBy("symbol").agg(F.min_by("last", F.struct(F.isnan("last") | F.col("last").isNull(), "ts", "seq")).alias("first"))
    whole = joined(filled, first, ["symbol"]).withColumn("last", F.coalesce("last", "first")).drop("first")

    def mean(x, pos, own):
        padded = np.concatenate([np.zeros(window), x["last"]])
        n = np.minimum(pos + 1, window)
        total = sum(padded[window - k : len(padded) - k] * (pos >= k) for k in range(window))
        return (np.round(total / n, 9)[own],)

    return windowed(whole, ["last"], "smooth double", mean, back=window - 1, rows=rows).drop("last")


def cycle_label(df: DataFrame, window: int = 30, smooth: int = 5, share: float = 0.1, rows: int = ROWS) -> DataFrame:
    """``df`` with ``label``: 0 bottom, 1 rise, 2 top, 3 fall.

    Rows fall where the smoothed close does and rise elsewhere; those within
    half the smoothing window of a peak are tops, of a trough bottoms, if the
    ladder of ``relaxed`` leaves the series two of both.  A null close is 0.
    A series without turns keeps rises and falls.
    """
    made = positioned(smoothed(df, smooth, rows))
    spread = made.groupBy("symbol").agg(F.stddev_pop("smooth").alias("std"))
    found = relaxed(peaks(made.drop("_pos"), "smooth", rows=rows), spread, window, share)
    half = max(1, smooth // 2)
    near = found.where("enough").select("symbol", "kind", F.explode(F.sequence(F.col("at") - half, F.col("at") + half)).alias("_pos"))
    marks = near.groupBy("symbol", "_pos").agg(F.min("kind").alias("kind"))  # a trough marks over a peak

    def falls(x, pos, own):
        v = x["smooth"]
        return ((np.gradient(v) < 0 if len(v) > 1 else np.zeros(len(v), bool))[own],)

    sloped = windowed(made, ["smooth"], "falls boolean", falls, back=1, ahead=1, rows=rows)
    label = F.when(F.col("close").isNull(), 0).when(F.col("kind") == -1, 0).when(F.col("kind") == 1, 2).when(F.col("falls"), 3).otherwise(1)
    return joined(sloped, marks, ["symbol", "_pos"], "left").select(*df.columns, label.alias("label"))


SMOOTH_SQL = BARS_SQL + """,
sm AS (SELECT symbol, ts, seq, seq - 1 AS p, round(avg(close) OVER (PARTITION BY symbol ORDER BY seq ROWS 4 PRECEDING), 9) AS v FROM bars),
both_ AS (SELECT symbol, p, 1 AS kind, v FROM sm UNION ALL SELECT symbol, p, -1, -v FROM sm),
ch AS (SELECT *, lag(v) OVER (PARTITION BY symbol, kind ORDER BY p) AS v0 FROM both_),
ru AS (SELECT symbol, kind, p AS a, v, lead(p) OVER w - 1 AS z, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM ch WHERE v0 IS NULL OR v0 <> v WINDOW w AS (PARTITION BY symbol, kind ORDER BY p)),
tu AS (SELECT symbol, kind, (a + z) // 2 AS mid, v FROM ru WHERE v > pv AND v > nv),
le AS (SELECT t.symbol, t.kind, t.mid, max(CASE WHEN b.v > t.v AND b.p < t.mid THEN b.p END) AS l, min(CASE WHEN b.v > t.v AND b.p > t.mid THEN b.p END) AS r
  FROM tu t JOIN both_ b ON b.symbol = t.symbol AND b.kind = t.kind GROUP BY t.symbol, t.kind, t.mid),
pr AS (SELECT t.symbol, t.kind, t.mid, t.v AS height, t.v - greatest(min(b.v) FILTER (WHERE b.p <= t.mid), min(b.v) FILTER (WHERE b.p >= t.mid)) AS prominence
  FROM tu t JOIN le USING (symbol, kind, mid) JOIN both_ b ON b.symbol = t.symbol AND b.kind = t.kind AND b.p > coalesce(le.l, -1) AND b.p < coalesce(le.r, 1000000000)
  GROUP BY t.symbol, t.kind, t.mid, t.v),
rk AS (SELECT symbol, kind, mid, d, row_number() OVER (PARTITION BY symbol, kind, d ORDER BY height DESC, mid DESC) AS n FROM pr CROSS JOIN (VALUES (10), (7), (5), (3)) x(d)),
gr AS (SELECT symbol, kind, d, n, [mid] AS kept FROM rk WHERE n = 1
  UNION ALL SELECT g.symbol, g.kind, g.d, r.n, CASE WHEN len(list_filter(g.kept, lambda q: abs(q - r.mid) < r.d)) = 0 THEN list_append(g.kept, r.mid) ELSE g.kept END
  FROM gr g JOIN rk r ON r.symbol = g.symbol AND r.kind = g.kind AND r.d = g.d AND r.n = g.n + 1),
fi AS (SELECT symbol, kind, d, arg_max(kept, n) AS kept FROM gr GROUP BY symbol, kind, d),
ke AS (SELECT pr.*, f10.kept AS k10, f7.kept AS k7, f5.kept AS k5, f3.kept AS k3 FROM pr
  JOIN fi f10 ON f10.symbol = pr.symbol AND f10.kind = pr.kind AND f10.d = 10 JOIN fi f7 ON f7.symbol = pr.symbol AND f7.kind = pr.kind AND f7.d = 7
  JOIN fi f5 ON f5.symbol = pr.symbol AND f5.kind = pr.kind AND f5.d = 5 JOIN fi f3 ON f3.symbol = pr.symbol AND f3.kind = pr.kind AND f3.d = 3)"""


@query(
    f"""WITH RECURSIVE {SMOOTH_SQL} SELECT symbol, kind, mid AS place, round(height, 6) AS height, round(prominence, 6) AS prominence,
  list_contains(k10, mid) AS kept_10, list_contains(k7, mid) AS kept_7, list_contains(k5, mid) AS kept_5, list_contains(k3, mid) AS kept_3 FROM ke"""
)
def series_peaks(spark, sf_dir):
    """Peaks and troughs of the smoothed closes: prominence, and what four distances keep."""
    made = smoothed(feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", "close"))
    found = spaced(peaks(made, "smooth"), [10, 7, 5, 3])
    return found.select("symbol", "kind", F.col("at").alias("place"), rnd("height").alias("height"), rnd("prominence").alias("prominence"), *[f"kept_{d}" for d in (10, 7, 5, 3)])


@query(
    f"""WITH RECURSIVE {SMOOTH_SQL}, sd AS (SELECT symbol, stddev_pop(v) AS s FROM sm GROUP BY symbol),
st AS (SELECT i, d, m FROM (SELECT unnest([10, 7, 5, 3]) AS d, unnest(range(4)) AS a) CROSS JOIN (SELECT unnest([0.1, 0.05, 0.02, 0.005, 0.0]) AS m, unnest(range(5)) AS b) CROSS JOIN LATERAL (SELECT a * 5 + b AS i)
  UNION ALL SELECT 20, 1, 0.005),
pa AS (SELECT ke.symbol, ke.kind, ke.mid, st.i FROM ke JOIN sd ON sd.symbol = ke.symbol CROSS JOIN st
  WHERE ke.prominence >= greatest(1e-12, sd.s * st.m) AND CASE st.d WHEN 10 THEN list_contains(k10, mid) WHEN 7 THEN list_contains(k7, mid) WHEN 5 THEN list_contains(k5, mid) WHEN 3 THEN list_contains(k3, mid) ELSE true END),
go AS (SELECT symbol, min(i) AS i FROM (SELECT symbol, i FROM pa GROUP BY symbol, i HAVING count(*) FILTER (WHERE kind = 1) >= 2 AND count(*) FILTER (WHERE kind = -1) >= 2) GROUP BY symbol),
ma AS (SELECT sm.symbol, sm.p, min(pa.kind) AS kind FROM sm JOIN go ON go.symbol = sm.symbol JOIN pa ON pa.symbol = sm.symbol AND pa.i = go.i AND abs(pa.mid - sm.p) <= 2 GROUP BY sm.symbol, sm.p),
sl AS (SELECT symbol, seq, p, coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v) AS g FROM sm WINDOW w AS (PARTITION BY symbol ORDER BY p))
SELECT sl.symbol, sl.seq, CASE WHEN ma.kind = -1 THEN 0 WHEN ma.kind = 1 THEN 2 WHEN g < 0 THEN 3 ELSE 1 END AS label
FROM sl LEFT JOIN ma ON ma.symbol = sl.symbol AND ma.p = sl.p"""
)
def label_cycle(spark, sf_dir):
    """Bottom, rise, top or fall of each hourly bar."""
    return cycle_label(feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", "close")).select("symbol", "seq", "label")
