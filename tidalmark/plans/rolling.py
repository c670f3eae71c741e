"""Window and rolling features over hourly bars and trades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import bfill, clip, corr, ffill, gated, kurt, last_n, ordered, past_n, rnd, sdiv, skew, so_far, weighted_mean
from ..sources import feeds
from ..sources.feeds import BARS_SQL, TRADES_SQL
from .registry import query


def W():
    return ordered("symbol")

B = BARS_SQL


def win(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def past(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


ORD = "(PARTITION BY symbol ORDER BY ts, seq)"
CUM = "(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {B}, s AS (SELECT symbol, ts, close,
  CASE WHEN count(close) OVER {win(20)} >= 20 THEN avg(close) OVER {win(20)} END AS sma,
  CASE WHEN count(close) OVER {win(20)} >= 20 THEN stddev_samp(close) OVER {win(20)} END AS sd,
  CASE WHEN count(close) OVER {past(64)} >= 16 THEN avg(close) OVER {past(64)} END AS m,
  CASE WHEN count(close) OVER {past(64)} >= 16 THEN stddev_pop(close) OVER {past(64)} END AS p FROM bars)
SELECT symbol, ts, round(close, 6) AS close, round(sma, 6) AS sma20, round(4 * sd / sma, 6) AS bb_width, round((close - m) / p, 5) AS z
FROM s WHERE p > 0 AND abs((close - m) / p) > 2"""
)
def flagship(spark, sf_dir):
    """Hourly bars, SMA 20, Bollinger width, past-only z-score; outliers only."""
    bars = feeds.bars(spark, sf_dir)
    full, before = last_n(W(), 20), past_n(W(), 64)
    made = bars.select(
        "symbol", "ts", "close",
        gated(F.avg, "close", full, 20).alias("sma"),
        gated(F.stddev_samp, "close", full, 20).alias("sd"),
        gated(F.avg, "close", before, 16).alias("m"),
        gated(F.stddev_pop, "close", before, 16).alias("p"),
    )
    z = (F.col("close") - F.col("m")) / F.col("p")
    return made.where((F.col("p") > 0)).where(F.abs(z) > 2).select(
        "symbol", "ts", rnd("close").alias("close"), rnd("sma").alias("sma20"), rnd(F.col("sd") * 4 / F.col("sma")).alias("bb_width"), rnd(z, 5).alias("z")
    )


@query(
    f"""WITH {B} SELECT symbol, ts,
  round(CASE WHEN count(close) OVER {win(20)} >= 20 THEN avg(close) OVER {win(20)} END, 6) AS sma,
  round(CASE WHEN count(close) OVER {win(20)} >= 20 THEN stddev_samp(close) OVER {win(20)} END, 5) AS sd,
  round(CASE WHEN count(close) OVER {win(20)} >= 20 THEN min(low) OVER {win(20)} END, 6) AS lo,
  round(CASE WHEN count(close) OVER {win(20)} >= 20 THEN max(high) OVER {win(20)} END, 6) AS hi FROM bars"""
)
def rolling_full(spark, sf_dir):
    f = last_n(W(), 20)
    enough = F.count("close").over(f) >= 20
    return feeds.bars(spark, sf_dir).select(
        "symbol", "ts", rnd(gated(F.avg, "close", f, 20)).alias("sma"), rnd(gated(F.stddev_samp, "close", f, 20), 5).alias("sd"),
        rnd(F.when(enough, F.min("low").over(f))).alias("lo"), rnd(F.when(enough, F.max("high").over(f))).alias("hi"),
    )


@query(
    f"""WITH {B} SELECT symbol, ts, round(avg(close) OVER {win(14)}, 6) AS sma, round(stddev_samp(close) OVER {win(14)}, 5) AS sd,
  round(sum(volume) OVER {win(14)}, 4) AS vol, round(quantile_cont(close, 0.5) OVER {win(14)}, 6) AS med,
  round(quantile_cont(volume, 0.95) OVER {win(14)}, 5) AS p95 FROM bars"""
)
def rolling_partial(spark, sf_dir):
    f = last_n(W(), 14)
    return feeds.bars(spark, sf_dir).select(
        "symbol", "ts", rnd(F.avg("close").over(f)).alias("sma"), rnd(F.stddev_samp("close").over(f), 5).alias("sd"),
        rnd(F.sum("volume").over(f), 4).alias("vol"), rnd(F.percentile("close", F.lit(0.5)).over(f)).alias("med"),
        rnd(F.percentile("volume", F.lit(0.95)).over(f), 5).alias("p95"),
    )


@query(
    f"""WITH {B}, s AS (SELECT symbol, ts, close,
  CASE WHEN count(close) OVER {past(64)} >= 16 THEN avg(close) OVER {past(64)} END AS m,
  CASE WHEN count(close) OVER {past(64)} >= 16 THEN stddev_pop(close) OVER {past(64)} END AS p,
  avg(close) OVER {win(30)} AS mi, stddev_samp(close) OVER {win(30)} AS si FROM bars)
SELECT symbol, ts, round(CASE WHEN (close - m) / nullif(p, 0) IS NOT NULL THEN greatest(least((close - m) / nullif(p, 0), 8.0), -8.0) END, 5) AS z_past, round(coalesce((close - mi) / nullif(si, 0), 0), 5) AS z_incl FROM s"""
)
def zscores(spark, sf_dir):
    p, f = past_n(W(), 64), last_n(W(), 30)
    z = sdiv(F.col("close") - gated(F.avg, "close", p, 16), gated(F.stddev_pop, "close", p, 16), None)
    zi = sdiv(F.col("close") - F.avg("close").over(f), F.stddev_samp("close").over(f))
    return feeds.bars(spark, sf_dir).select("symbol", "ts", rnd(clip(z, -8.0, 8.0), 5).alias("z_past"), rnd(zi, 5).alias("z_incl"))


@query(
    f"""WITH {B} SELECT symbol, ts,
  round(avg(close) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW), 6) AS mean_7d,
  count(*) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS n_7d FROM bars"""
)
def time_range_7d(spark, sf_dir):
    """(t - 7 days, t], as Spark's closed frame less a microsecond."""
    bars = feeds.bars(spark, sf_dir)
    bars.createOrReplaceTempView("tm_bars")
    frame = "(PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '6 23:59:59.999999' DAY TO SECOND PRECEDING AND CURRENT ROW)"
    return bars.select("symbol", "ts", F.expr(f"round(avg(close) OVER {frame}, 6) + 0.0").alias("mean_7d"), F.expr(f"count(*) OVER {frame}").alias("n_7d"))


@query(
    f"""WITH {B}, r AS (SELECT *, ln(close) - ln(lag(close) OVER {ORD}) AS r, volume - lag(volume) OVER {ORD} AS dv FROM bars)
SELECT symbol, ts,
  round(CASE WHEN count(r) OVER {win(24)} >= 24 THEN corr(r, dv) OVER {win(24)} END, 4) AS corr_24,
  round(CASE WHEN count(r) OVER {win(30)} >= 30 THEN skewness(r) OVER {win(30)} END, 4) AS skew_30,
  round(CASE WHEN count(r) OVER {win(30)} >= 30 THEN kurtosis(r) OVER {win(30)} END, 3) AS kurt_30 FROM r"""
)
def moments(spark, sf_dir):
    r = feeds.bars(spark, sf_dir).select(
        "symbol", "ts", "seq", (F.ln("close") - F.ln(F.lag("close").over(W()))).alias("r"), (F.col("volume") - F.lag("volume").over(W())).alias("dv")
    )
    f24, f30 = last_n(W(), 24), last_n(W(), 30)
    return r.select(
        "symbol", "ts", rnd(F.when(F.count("r").over(f24) >= 24, corr("r", "dv", f24)), 4).alias("corr_24"),
        rnd(skew("r", f30, 30), 4).alias("skew_30"), rnd(kurt("r", f30, 30), 3).alias("kurt_30"),
    )


@query(
    f"""WITH {B}, s AS (SELECT symbol, ts, seq, close, count(*) OVER {win(20)} AS n, regr_slope(close, seq) OVER {win(20)} AS b,
  regr_intercept(close, seq) OVER {win(20)} AS a FROM bars)
SELECT symbol, ts, round(CASE WHEN n >= 20 THEN b END, 4) AS slope, round(CASE WHEN n >= 20 THEN a + b * seq END, 3) AS lsma,
  round(CASE WHEN n >= 20 THEN close - (a + b * seq) END, 3) AS residual FROM s"""
)
def ols(spark, sf_dir):
    f = last_n(W(), 20)
    s = feeds.bars(spark, sf_dir).select(
        "symbol", "ts", "seq", "close", F.count("*").over(f).alias("n"), F.regr_slope("close", "seq").over(f).alias("b"), F.regr_intercept("close", "seq").over(f).alias("a")
    )
    line = F.col("a") + F.col("b") * F.col("seq")
    full = F.col("n") >= 20
    return s.select(
        "symbol", "ts", rnd(F.when(full, F.col("b")), 4).alias("slope"), rnd(F.when(full, line), 3).alias("lsma"), rnd(F.when(full, F.col("close") - line), 3).alias("residual")
    )


def wma_sql(c: str, n: int) -> str:
    return "(" + " + ".join(f"{k + 1}.0 * lag({c}, {n - 1 - k}) OVER {ORD}" for k in range(n)) + f") / {n * (n + 1) / 2}"


@query(
    f"""WITH {B}, a AS (SELECT symbol, ts, seq, {wma_sql('close', 16)} AS w16, {wma_sql('close', 8)} AS w8 FROM bars),
h AS (SELECT *, 2 * w8 - w16 AS d FROM a) SELECT symbol, ts, round(w16, 5) AS wma_16, round({wma_sql('d', 4)}, 5) AS hma_16 FROM h"""
)
def wma_hma(spark, sf_dir):
    a = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", weighted_mean("close", W(), 16).alias("w16"), weighted_mean("close", W(), 8).alias("w8"))
    h = a.withColumn("d", 2 * F.col("w8") - F.col("w16"))
    return h.select("symbol", "ts", rnd("w16", 5).alias("wma_16"), rnd(weighted_mean("d", W(), 4), 5).alias("hma_16"))


@query(
    f"""WITH {B}, l AS (SELECT symbol, ts, close, list(close) OVER {win(20)} AS xs FROM bars)
SELECT symbol, ts, round(CASE WHEN len(xs) = 20 THEN list_avg(list_transform(xs, lambda x: abs(x - list_avg(xs)))) END, 5) AS mad,
  round(CASE WHEN len(xs) = 20 THEN (len(list_filter(xs, lambda x: x < close)) + (len(list_filter(xs, lambda x: x = close)) + 1) / 2.0) / 20 END, 5) AS pct_rank,
  round(CASE WHEN len(xs) = 20 THEN coalesce((close - list_min(xs)) / nullif(list_max(xs) - list_min(xs), 0), 0) END, 5) AS iv_rank FROM l"""
)
def mad_and_ranks(spark, sf_dir):
    xs = F.collect_list("close").over(last_n(W(), 20))
    l = feeds.bars(spark, sf_dir).select("symbol", "ts", "close", xs.alias("xs"))  # noqa: E741
    mean = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x) / 20.0
    mad = F.aggregate(F.transform("xs", lambda x: F.abs(x - F.col("m"))), F.lit(0.0), lambda a, x: a + x) / 20.0
    below, same = F.size(F.filter("xs", lambda x: x < F.col("close"))), F.size(F.filter("xs", lambda x: x == F.col("close")))
    full = F.size("xs") == 20
    rank = sdiv(F.col("close") - F.array_min("xs"), F.array_max("xs") - F.array_min("xs"))
    return l.withColumn("m", mean).select(
        "symbol", "ts", rnd(F.when(full, mad), 5).alias("mad"), rnd(F.when(full, (below + (same + 1) / 2.0) / 20.0), 5).alias("pct_rank"),
        rnd(F.when(full, rank), 5).alias("iv_rank"),
    )


@query(
    f"""WITH {B}, r AS (SELECT *, close / lag(close) OVER {ORD} - 1 AS r FROM bars),
g AS (SELECT symbol, ts, seq, r, lag(r) OVER {ORD} AS r1, count(r) OVER {win(20)} AS n,
  count(*) FILTER (r > 0) OVER {win(20)} / 20.0 AS u, count(*) FILTER (r < 0) OVER {win(20)} / 20.0 AS d, count(*) FILTER (r = 0) OVER {win(20)} / 20.0 AS z FROM r)
SELECT symbol, ts, round(CASE WHEN n >= 20 THEN -(CASE WHEN u > 0 THEN u * log2(u) ELSE 0 END + CASE WHEN d > 0 THEN d * log2(d) ELSE 0 END
  + CASE WHEN z > 0 THEN z * log2(z) ELSE 0 END) / log2(3) END, 5) AS entropy,
  round(CASE WHEN n >= 20 THEN corr(r1, r) OVER {win(19)} END, 4) AS autocorr FROM g"""
)
def entropy_autocorr(spark, sf_dir):
    r = feeds.bars(spark, sf_dir).select("symbol", "ts", "seq", (F.col("close") / F.lag("close").over(W()) - 1).alias("r"))
    f = last_n(W(), 20)
    parts = []
    for cond in (F.col("r") > 0, F.col("r") < 0, F.col("r") == 0):
        p = F.count(F.when(cond, 1)).over(f) / 20.0
        parts.append(F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    entropy = -(parts[0] + parts[1] + parts[2]) / F.log2(F.lit(3.0))
    g = r.select("symbol", "ts", "seq", "r", F.lag("r").over(W()).alias("r1"), F.count("r").over(f).alias("n"), entropy.alias("e"))
    full = F.col("n") >= 20
    return g.select("symbol", "ts", rnd(F.when(full, F.col("e")), 5).alias("entropy"), rnd(F.when(full, corr("r1", "r", last_n(W(), 19))), 4).alias("autocorr"))


@query(
    f"""WITH {B} SELECT symbol, ts, round(close - lag(close) OVER {ORD}, 6) AS diff, round(close / lag(close, 12) OVER {ORD} - 1, 6) AS pct_12,
  round(ln(close) - ln(lag(close) OVER {ORD}), 6) AS log_return, round(lead(close, 2) OVER {ORD} / close - 1, 6) AS forward_2,
  round(sum(close * volume) OVER {CUM} / sum(volume) OVER {CUM}, 5) AS vwap, round(close / max(close) OVER {CUM} - 1, 6) AS drawdown,
  (high > max(high) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
   AND high > max(high) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) IS TRUE AS peak,
  round((lead(close) OVER {ORD} - lag(close) OVER {ORD}) / 2, 6) AS gradient FROM bars"""
)
def differences(spark, sf_dir):
    """Lags, leads, cumulative values, strict local peaks (edges excluded)."""
    c = F.col("close")
    return feeds.bars(spark, sf_dir).select(
        "symbol", "ts", rnd(c - F.lag("close").over(W())).alias("diff"), rnd(c / F.lag("close", 12).over(W()) - 1).alias("pct_12"),
        rnd(F.ln(c) - F.ln(F.lag("close").over(W()))).alias("log_return"), rnd(F.lead("close", 2).over(W()) / c - 1).alias("forward_2"),
        rnd(F.sum(c * F.col("volume")).over(so_far(W())) / F.sum("volume").over(so_far(W())), 5).alias("vwap"),
        rnd(c / F.max("close").over(so_far(W())) - 1).alias("drawdown"),
        F.coalesce((F.col("high") > F.max("high").over(W().rowsBetween(-3, -1))) & (F.col("high") > F.max("high").over(W().rowsBetween(1, 3))), F.lit(False)).alias("peak"),
        rnd((F.lead("close").over(W()) - F.lag("close").over(W())) / 2).alias("gradient"),
    )


@query(
    f"""WITH {TRADES_SQL}, h AS (SELECT symbol, ts, seq, CASE WHEN seq % 7 <> 0 THEN price END AS price FROM trades)
SELECT symbol, seq, round(last_value(price IGNORE NULLS) OVER {CUM}, 6) AS ffilled, round(coalesce(last_value(price IGNORE NULLS) OVER {CUM}, 0), 6) AS ffill_zero,
  round(first_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bfilled,
  round(coalesce(price, 0), 6) AS zeroed, round(coalesce(price, 1), 6) AS oned,
  round(CASE WHEN count(price) OVER {win(10)} >= 5 THEN avg(price) OVER {win(10)} END, 6) AS mean_mp5 FROM h"""
)
def null_handling(spark, sf_dir):
    h, x = feeds.holed(spark, sf_dir), F.col("price")
    return h.select(
        "symbol", "seq", rnd(ffill("price", W())).alias("ffilled"), rnd(F.coalesce(ffill("price", W()), F.lit(0.0))).alias("ffill_zero"),
        rnd(bfill("price", "symbol")).alias("bfilled"), rnd(F.coalesce(x, F.lit(0.0))).alias("zeroed"), rnd(F.coalesce(x, F.lit(1.0))).alias("oned"),
        rnd(gated(F.avg, "price", last_n(W(), 10), 5)).alias("mean_mp5"),
    )


@query(
    f"""WITH {TRADES_SQL}, c AS (SELECT symbol, ts, seq, aggressor, count(*) FILTER (aggressor = 1) OVER {win(5)} AS u,
  count(*) FILTER (aggressor = 0) OVER {win(5)} AS z, count(*) FILTER (aggressor = -1) OVER {win(5)} AS d FROM trades)
SELECT symbol, seq, CAST(CASE WHEN u >= z AND u >= d THEN 1 WHEN z >= d THEN 0 ELSE -1 END AS INTEGER) AS vote FROM c"""
)
def majority(spark, sf_dir):
    """Most frequent of the last five sides; ties go to the larger side."""
    f = last_n(W(), 5)
    n = {s: F.count(F.when(F.col("aggressor") == s, 1)).over(f) for s in (1, 0, -1)}
    vote = F.when((n[1] >= n[0]) & (n[1] >= n[-1]), 1).when(n[0] >= n[-1], 0).otherwise(-1)
    return feeds.trades(spark, sf_dir).select("symbol", "seq", vote.cast("int").alias("vote"))


@query(
    f"""WITH {TRADES_SQL}, d AS (SELECT symbol, ts, seq, size * aggressor AS x FROM trades),
s AS (SELECT *, sum(x) OVER {CUM} AS c FROM d) SELECT symbol, seq, round(c - least(0, min(c) OVER {CUM}), 4) AS oi FROM s"""
)
def clamp_oi(spark, sf_dir):
    """Running sum clamped at zero, by the running minimum: no recursion."""
    s = feeds.trades(spark, sf_dir).withColumn("c", F.sum(F.col("size") * F.col("aggressor")).over(so_far(W())))
    return s.select("symbol", "seq", rnd(F.col("c") - F.least(F.lit(0.0), F.min("c").over(so_far(W()))), 4).alias("oi"))


@query(
    f"""WITH {B}, m AS (SELECT symbol, ts, close, high, low, volume FROM bars)
SELECT symbol, round(stddev_pop(close), 5) AS sd, round(avg(close), 5) AS mean, round(quantile_cont(close, 0.75), 5) AS q75, round(median(volume), 4) AS med_vol,
  round(covar_pop(close, volume), 3) AS cov, round(covar_pop(close, volume) / var_pop(volume), 5) AS beta, round(arg_max(close, ts) - arg_min(close, ts), 5) AS decay,
  count(DISTINCT CAST(ts AS DATE)) AS days, max(high) - min(low) AS span FROM m GROUP BY symbol"""
)
def column_statistics(spark, sf_dir):
    return feeds.bars(spark, sf_dir).groupBy("symbol").agg(
        rnd(F.stddev_pop("close"), 5).alias("sd"), rnd(F.avg("close"), 5).alias("mean"), rnd(F.percentile("close", F.lit(0.75)), 5).alias("q75"),
        rnd(F.percentile("volume", F.lit(0.5)), 4).alias("med_vol"), rnd(F.covar_pop("close", "volume"), 3).alias("cov"),
        rnd(F.covar_pop("close", "volume") / F.var_pop("volume"), 5).alias("beta"), rnd(F.max_by("close", "ts") - F.min_by("close", "ts"), 5).alias("decay"),
        F.countDistinct(F.to_date("ts")).alias("days"), (F.max("high") - F.min("low")).alias("span"),
    )


@query(
    f"""WITH {B}, x AS (SELECT *, CASE WHEN hour(ts) < 7 THEN 1 WHEN hour(ts) < 13 THEN 2 ELSE 3 END AS session FROM bars)
SELECT symbol, ts, CAST(session AS INTEGER) AS session, round(volume / sum(volume) OVER (PARTITION BY symbol, session), 6) AS participation,
  round(coalesce((volume - avg(volume) OVER (PARTITION BY symbol, session)) / nullif(stddev_samp(volume) OVER (PARTITION BY symbol, session), 0), 0), 5) AS score FROM x"""
)
def session_stats(spark, sf_dir):
    """Whole-sample statistics by trading session (they look ahead)."""
    s = Window.partitionBy("symbol", "session")
    session = F.when(F.hour("ts") < 7, 1).when(F.hour("ts") < 13, 2).otherwise(3)
    return feeds.bars(spark, sf_dir).withColumn("session", session.cast("int")).select(
        "symbol", "ts", "session", rnd(F.col("volume") / F.sum("volume").over(s)).alias("participation"),
        rnd(sdiv(F.col("volume") - F.avg("volume").over(s), F.stddev_samp("volume").over(s)), 5).alias("score"),
    )
