"""Recursive features: one scan pass computes all recursions of a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import last_n, ordered, past_n, rnd, sdiv, so_far
from ..operators import scan as k
from ..operators.scan import scan
from ..sources import feeds
from ..sources.feeds import BARS_SQL, TRADES_SQL
from .registry import query


def W():
    return ordered("symbol")


def e(y: str, x: str, a: str) -> str:
    return f"({y} + (({x}) - {y}) * {a})"


E12, E50 = e("s.e12", "b.close", "(2.0/13)"), e("s.e50", "b.close", "(2.0/51)")
D1, D2, D3 = e("s.d1", "b.close", "(2.0/22)"), "", ""
D2 = e("s.d2", D1, "(2.0/22)")
D3 = e("s.d3", D2, "(2.0/22)")


@query(
    f"""WITH RECURSIVE {BARS_SQL}, s AS (SELECT symbol, seq, close AS e12, close AS e50, 0.0::DOUBLE AS sig, close AS d1, close AS d2, close AS d3 FROM bars WHERE seq = 1
UNION ALL SELECT b.symbol, b.seq, {E12}, {E50}, {e('s.sig', f'{E12} - {E50}', '0.2')}, {D1}, {D2}, {D3} FROM s JOIN bars b ON b.symbol = s.symbol AND b.seq = s.seq + 1)
SELECT symbol, seq, round(e12, 5) AS ema_12, round(e50, 5) AS ema_50, round(e12 - e50, 5) AS macd, round(sig, 5) AS signal, round(e12 - e50 - sig, 5) AS histogram,
  round(2 * d1 - d2, 5) AS dema_21, round(3 * d1 - 3 * d2 + d3, 5) AS tema_21 FROM s"""
)
def ema_family(spark, sf_dir):
    def start():
        return [k.span(12), k.span(50), k.span(9), k.span(21), k.span(21), k.span(21)]

    def step(s, x):
        a, b = s[0](x), s[1](x)
        d1 = s[3](x)
        d2 = s[4](d1)
        return a, b, s[2](a - b), d1, d2, s[5](d2)

    r = scan(feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", "close"), ["close"], "a double, b double, g double, d1 double, d2 double, d3 double", start, step)
    return r.select(
        "symbol", "seq", rnd("a", 5).alias("ema_12"), rnd("b", 5).alias("ema_50"), rnd(F.col("a") - F.col("b"), 5).alias("macd"), rnd("g", 5).alias("signal"),
        rnd(F.col("a") - F.col("b") - F.col("g"), 5).alias("histogram"), rnd(2 * F.col("d1") - F.col("d2"), 5).alias("dema_21"),
        rnd(3 * F.col("d1") - 3 * F.col("d2") + F.col("d3"), 5).alias("tema_21"),
    )


RSI_U, RSI_D = e("s.u", "greatest(b.d, 0)", "(1.0/14)"), e("s.w", "greatest(-b.d, 0)", "(1.0/14)")
T1, A1 = e("s.t1", "b.d", "(2.0/26)"), e("s.a1", "abs(b.d)", "(2.0/26)")


@query(
    f"""WITH RECURSIVE {BARS_SQL}, c AS (SELECT symbol, seq, close - lag(close) OVER (PARTITION BY symbol ORDER BY seq) AS d FROM bars),
s AS (SELECT symbol, seq, greatest(d, 0) AS u, greatest(-d, 0) AS w, d AS t1, abs(d) AS a1, d AS t2, abs(d) AS a2 FROM c WHERE seq = 2
UNION ALL SELECT b.symbol, b.seq, {RSI_U}, {RSI_D}, {T1}, {A1}, {e('s.t2', T1, '(2.0/14)')}, {e('s.a2', A1, '(2.0/14)')} FROM s JOIN c b ON b.symbol = s.symbol AND b.seq = s.seq + 1)
SELECT symbol, seq, round(CASE WHEN w = 0 THEN 0 ELSE 100 - 100 / (1 + u / w) END, 5) AS rsi, round(CASE WHEN a2 = 0 THEN 0 ELSE 100 * t2 / a2 END, 5) AS tsi FROM s"""
)
def rsi_tsi(spark, sf_dir):
    d = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", (F.col("close") - F.lag("close").over(W())).alias("d")).where("d IS NOT NULL")

    def start():
        return [k.wilder(14), k.wilder(14), k.span(25), k.span(25), k.span(13), k.span(13)]

    def step(s, d):
        return s[0](max(d, 0.0)), s[1](max(-d, 0.0)), s[4](s[2](d)), s[5](s[3](abs(d)))

    r = scan(d, ["d"], "u double, w double, t double, a double", start, step)
    return r.select("symbol", "seq", rnd(100 - sdiv(F.lit(100.0), 1 + sdiv("u", "w", None), 100.0), 5).alias("rsi"), rnd(100 * sdiv("t", "a"), 5).alias("tsi"))


def true_range(bars):
    c1 = F.lag("close").over(W())
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c1), F.abs(F.col("low") - c1)))


TR_SQL = """tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
  coalesce(CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high > lag(high) OVER w THEN high - lag(high) OVER w END, 0) AS pdm,
  coalesce(CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND low < lag(low) OVER w THEN lag(low) OVER w - low END, 0) AS mdm
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq))"""
ATR, PDM, MDM = e("s.atr", "b.tr", "(1.0/14)"), e("s.p", "b.pdm", "(1.0/14)"), e("s.m", "b.mdm", "(1.0/14)")
DX = f"(CASE WHEN {PDM} + {MDM} = 0 OR {ATR} = 0 THEN 0 ELSE 100 * abs({PDM} - {MDM}) / ({PDM} + {MDM}) END)"


@query(
    f"""WITH RECURSIVE {BARS_SQL}, {TR_SQL}, s AS (SELECT symbol, seq, tr AS atr, pdm::DOUBLE AS p, mdm::DOUBLE AS m, 0.0::DOUBLE AS adx FROM tr WHERE seq = 1
UNION ALL SELECT b.symbol, b.seq, {ATR}, {PDM}, {MDM}, {e('s.adx', DX, '(1.0/14)')} FROM s JOIN tr b ON b.symbol = s.symbol AND b.seq = s.seq + 1)
SELECT symbol, seq, round(atr, 5) AS atr_14, round(CASE WHEN atr = 0 THEN 0 ELSE 100 * p / atr END, 4) AS di_plus, round(CASE WHEN atr = 0 THEN 0 ELSE 100 * m / atr END, 4) AS di_minus,
  round(adx, 4) AS adx FROM s"""
)
def atr_adx(spark, sf_dir):
    b = true_range(feeds.bars(spark, sf_dir))
    up, down = F.col("high") - F.lag("high").over(W()), F.lag("low").over(W()) - F.col("low")
    b = b.select(
        "symbol", "ts", "seq", "tr", F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)).alias("pdm"), F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)).alias("mdm")
    )

    def start():
        return [k.wilder(14), k.wilder(14), k.wilder(14), k.wilder(14)]

    def step(s, tr, p, m):
        atr, p, m = s[0](tr), s[1](p), s[2](m)
        dx = 0.0 if not atr or not p + m else 100 * abs(p - m) / (p + m)
        return atr, p, m, s[3](dx)

    r = scan(b, ["tr", "pdm", "mdm"], "atr double, p double, m double, adx double", start, step)
    return r.select(
        "symbol", "seq", rnd("atr", 5).alias("atr_14"), rnd(100 * sdiv("p", "atr"), 4).alias("di_plus"), rnd(100 * sdiv("m", "atr"), 4).alias("di_minus"), rnd("adx", 4).alias("adx")
    )


SMOOTH = k.Smoother()
C1, C2, C3 = repr(SMOOTH.c1), repr(SMOOTH.c2), repr(SMOOTH.c3)


@query(
    f"""WITH RECURSIVE {BARS_SQL}, b AS (SELECT symbol, seq, close AS x, lag(close) OVER (PARTITION BY symbol ORDER BY seq) AS x1, lag(close, 2) OVER (PARTITION BY symbol ORDER BY seq) AS x2 FROM bars),
s AS (SELECT symbol, seq, x AS y, x AS y1, x AS f, x AS f1 FROM b WHERE seq = 1
UNION ALL SELECT b.symbol, b.seq, CASE WHEN b.seq = 2 THEN (b.x + b.x1) / 2 ELSE {C1} * (b.x + b.x1) / 2 + {C2} * s.y + {C3} * s.y1 END, s.y,
  0.2 * b.x + 0.3 * b.x1 + 0.1 * coalesce(b.x2, b.x1) - -0.5 * s.f - 0.1 * s.f1, s.f FROM s JOIN b ON b.symbol = s.symbol AND b.seq = s.seq + 1)
SELECT symbol, seq, round(y, 4) AS super_smoother, round(f, 4) AS iir2 FROM s"""
)
def filters(spark, sf_dir):
    """Super-smoother of period 10, and a two-pole filter."""

    def start():
        return [k.Smoother(), k.Iir2(0.2, 0.3, 0.1, -0.5, 0.1)]

    r = scan(feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", "close"), ["close"], "y double, f double", start, lambda s, x: (s[0](x), s[1](x)))
    return r.select("symbol", "seq", rnd("y", 4).alias("super_smoother"), rnd("f", 4).alias("iir2"))


@query(
    f"""WITH RECURSIVE {BARS_SQL}, d AS (SELECT symbol, seq, close, abs(close - lag(close) OVER (PARTITION BY symbol ORDER BY seq)) AS a FROM bars),
v AS (SELECT *, abs(close - first_value(close) OVER w) AS way, sum(a) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS path
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
c AS (SELECT symbol, seq, close, power(coalesce(way / nullif(path, 0), 0) * (2.0/3 - 2.0/31) + 2.0/31, 2) AS sc FROM v),
s AS (SELECT symbol, seq, close AS y FROM c WHERE seq = 1 UNION ALL SELECT c.symbol, c.seq, s.y + c.sc * (c.close - s.y) FROM s JOIN c ON c.symbol = s.symbol AND c.seq = s.seq + 1)
SELECT symbol, seq, round(y, 5) AS kama FROM s"""
)
def kama(spark, sf_dir):
    b = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", "close", F.abs(F.col("close") - F.lag("close").over(W())).alias("a"))
    way = F.abs(F.col("close") - F.first("close").over(last_n(W(), 10)))
    er = sdiv(way, F.sum("a").over(last_n(W(), 9)))
    b = b.withColumn("sc", F.pow(er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2))

    def step(s, x, sc):
        s[0] = x if s[0] is None else s[0] + sc * (x - s[0])
        return (s[0],)

    return scan(b, ["close", "sc"], "y double", lambda: [None], step).select("symbol", "seq", rnd("y", 5).alias("kama"))


@query(
    f"""WITH RECURSIVE {BARS_SQL}, {TR_SQL}, u AS (SELECT symbol, seq, close, (high + low) / 2 + 3 * avg(tr) OVER w AS up, (high + low) / 2 - 3 * avg(tr) OVER w AS low
  FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
s AS (SELECT symbol, seq, 1 AS dir, up AS line FROM u WHERE seq = 1 UNION ALL
  SELECT u.symbol, u.seq, CASE WHEN u.close > s.line THEN 1 WHEN u.close < s.line THEN -1 ELSE s.dir END,
    CASE WHEN (CASE WHEN u.close > s.line THEN 1 WHEN u.close < s.line THEN -1 ELSE s.dir END) = -1 THEN u.up ELSE u.low END FROM s JOIN u ON u.symbol = s.symbol AND u.seq = s.seq + 1)
SELECT symbol, seq, CAST(dir AS INTEGER) AS direction, round(line, 5) AS line FROM s"""
)
def supertrend(spark, sf_dir):
    b = true_range(feeds.bars(spark, sf_dir))
    atr, mid = F.avg("tr").over(last_n(W(), 10)), (F.col("high") + F.col("low")) / 2
    b = b.select("symbol", "ts", "seq", "close", (mid + 3 * atr).alias("up"), (mid - 3 * atr).alias("down"))
    r = scan(b, ["close", "up", "down"], "direction int, line double", k.Supertrend, lambda s, *x: s(*x))
    return r.select("symbol", "seq", "direction", rnd("line", 5).alias("line"))


@query(
    f"""WITH RECURSIVE {BARS_SQL}, z AS (SELECT symbol, seq, coalesce((close - avg(close) OVER p) / nullif(stddev_pop(close) OVER p, 0), 0) AS z
  FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)),
s AS (SELECT symbol, seq, 0 AS f FROM z WHERE seq = 1 UNION ALL
  SELECT z.symbol, z.seq, CASE WHEN s.f = 0 THEN CASE WHEN z.z >= 1 THEN 1 WHEN z.z <= -1 THEN -1 ELSE 0 END WHEN s.f * z.z < 0.35 THEN 0 ELSE s.f END
  FROM s JOIN z ON z.symbol = s.symbol AND z.seq = s.seq + 1)
SELECT symbol, seq, CAST(f AS INTEGER) AS flag FROM s"""
)
def hysteresis(spark, sf_dir):
    p = past_n(W(), 64)
    z = sdiv(F.col("close") - F.avg("close").over(p), F.stddev_pop("close").over(p))
    b = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", z.alias("z"))
    return scan(b, ["z"], "flag int", lambda: k.Hysteresis(1.0, 0.35, strict=True), lambda s, z: (s(z),)).select("symbol", "seq", "flag")


@query(
    f"""WITH RECURSIVE {TRADES_SQL}, t AS (SELECT symbol, row_number() OVER w AS i, seq, size * abs(aggressor) AS x,
  coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0) AS dt FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
s AS (SELECT symbol, i, seq, x AS h FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.i, t.seq, s.h * exp(-ln(2.0) / 3600.0 * t.dt) + t.x FROM s JOIN t ON t.symbol = s.symbol AND t.i = s.i + 1)
SELECT symbol, seq, round(h, 3) AS heat FROM s"""
)
def heat(spark, sf_dir):
    t = feeds.trades(spark, sf_dir).select(
        "symbol", "ts", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("size") * F.abs("aggressor")).alias("x")
    )
    return scan(t, ["t", "x"], "h double", lambda: k.Heat(3600.0), lambda s, t, x: (s(t, x),)).select("symbol", "seq", rnd("h", 3).alias("heat"))


@query(
    f"""WITH RECURSIVE {TRADES_SQL}, t AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i, seq, ts FROM trades WHERE aggressor = 1),
s AS (SELECT symbol, i, seq, ts AS kept, true AS keep FROM t WHERE i = 1 UNION ALL
  SELECT t.symbol, t.i, t.seq, CASE WHEN t.ts - s.kept >= INTERVAL 4 HOUR THEN t.ts ELSE s.kept END, t.ts - s.kept >= INTERVAL 4 HOUR FROM s JOIN t ON t.symbol = s.symbol AND t.i = s.i + 1)
SELECT symbol, seq FROM s WHERE keep"""
)
def cooldown(spark, sf_dir):
    """Entries at least four hours after the last one kept."""
    t = feeds.trades(spark, sf_dir).where("aggressor = 1").select("symbol", "ts", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return scan(t, ["t"], "keep boolean", lambda: k.Cooldown(4 * 3600.0), lambda s, t: (s(t),)).where("keep").select("symbol", "seq")


@query(
    f"""WITH {BARS_SQL}, d AS (SELECT symbol, seq, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY seq)) AS g FROM bars),
i AS (SELECT *, sum(CASE WHEN g IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM (SELECT *, lag(g) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM d))
SELECT symbol, seq, CAST(CASE WHEN g > 0 THEN row_number() OVER (PARTITION BY symbol, island ORDER BY seq) ELSE 0 END AS BIGINT) AS up,
  CAST(CASE WHEN g < 0 THEN row_number() OVER (PARTITION BY symbol, island ORDER BY seq) ELSE 0 END AS BIGINT) AS down FROM i"""
)
def run_length(spark, sf_dir):
    b = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", (F.col("close") - F.lag("close").over(W())).alias("d"))
    return scan(b, ["d"], "up long, down long", k.Streak, lambda s, d: s(d)).select("symbol", "seq", "up", "down")


@query(
    f"""WITH {BARS_SQL}, r AS (SELECT symbol, seq, greatest(coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY seq) - 1, 0), -0.5) / 10 AS r FROM bars)
SELECT symbol, seq, round(exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 5) AS capital FROM r"""
)
def compound_capital(spark, sf_dir):
    r = F.greatest(F.coalesce(F.col("close") / F.lag("close").over(W()) - 1, F.lit(0.0)), F.lit(-0.5)) / 10
    b = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", r.alias("r"))
    return b.select("symbol", "seq", rnd(F.exp(F.sum(F.log1p("r")).over(so_far(W()))), 5).alias("capital"))


J2 = e("s.j2", e("s.j1", "b.close", "(2.0/21)"), "(2.0/21)")


@query(
    f"""WITH RECURSIVE {BARS_SQL}, m AS (SELECT symbol, seq, close, sum(coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume)
  OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adl, high - low AS hl FROM bars),
s AS (SELECT symbol, seq, close AS j1, close AS j2, adl AS c3, adl AS c10, hl AS r10 FROM m WHERE seq = 1
UNION ALL SELECT b.symbol, b.seq, {e('s.j1', 'b.close', '(2.0/21)')}, {J2}, {e('s.c3', 'b.adl', '(2.0/4)')}, {e('s.c10', 'b.adl', '(2.0/11)')}, {e('s.r10', 'b.hl', '(2.0/11)')}
  FROM s JOIN m b ON b.symbol = s.symbol AND b.seq = s.seq + 1)
SELECT symbol, seq, round(j2, 5) AS jma, round(c3 - c10, 3) AS chaikin, round(coalesce(100 * (r10 / nullif(lag(r10, 20) OVER (PARTITION BY symbol ORDER BY seq), 0) - 1), 0), 4) AS cvi FROM s"""
)
def smoothed_flows(spark, sf_dir):
    """Double EWM (JMA-like), Chaikin oscillator, Chaikin volatility."""
    hl = F.col("high") - F.col("low")
    flow = sdiv((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), hl) * F.col("volume")
    b = feeds.bars(spark, sf_dir).withColumn("hl", hl).withColumn("adl", F.sum(flow).over(so_far(W()))).select("symbol", "ts", "seq", "close", "adl", "hl")

    def start():
        return [k.span(20), k.span(20), k.span(3), k.span(10), k.span(10)]

    def step(s, x, adl, hl):
        return s[1](s[0](x)), s[2](adl), s[3](adl), s[4](hl)

    r = scan(b, ["close", "adl", "hl"], "j double, c3 double, c10 double, r10 double", start, step)
    cvi = F.coalesce(100 * (F.try_divide(F.col("r10"), F.nullif(F.lag("r10", 20).over(W()), F.lit(0.0))) - 1), F.lit(0.0))
    return r.select("symbol", "seq", rnd("j", 5).alias("jma"), rnd(F.col("c3") - F.col("c10"), 3).alias("chaikin"), rnd(cvi, 4).alias("cvi"))


@query(
    f"""WITH {BARS_SQL}, d AS (SELECT symbol, ts, seq, close, CASE WHEN close > avg(close) OVER w9 THEN 1 ELSE -1 END + CASE WHEN close > lag(close, 3) OVER o THEN 1 ELSE -1 END
  + CASE WHEN signed > 0 THEN 1 ELSE -1 END AS votes FROM bars WINDOW w9 AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), o AS (PARTITION BY symbol ORDER BY seq)),
v AS (SELECT *, sign(votes) AS dir, lag(sign(votes)) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM d)
SELECT symbol, seq, CAST(dir AS INTEGER) AS direction, (dir <> coalesce(before, 0) AND dir <> 0) AS fresh,
  last_value(CASE WHEN dir <> coalesce(before, 0) AND dir <> 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_flip FROM v"""
)
def trend_votes(spark, sf_dir):
    """Three votes, the direction, whether it is fresh, and the last flip."""
    c = F.col("close")
    one = lambda cond: F.when(cond, 1).otherwise(-1)
    votes = one(c > F.avg("close").over(last_n(W(), 9))) + one(c > F.lag("close", 3).over(W())) + one(F.col("signed") > 0)
    v = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", F.signum(votes).cast("int").alias("direction"))
    fresh = (F.col("direction") != F.coalesce(F.lag("direction").over(W()), F.lit(0))) & (F.col("direction") != 0)
    v = v.withColumn("fresh", fresh)
    return v.select("symbol", "seq", "direction", "fresh", F.last(F.when(F.col("fresh"), F.col("ts")), ignorenulls=True).over(so_far(W())).alias("last_flip"))
