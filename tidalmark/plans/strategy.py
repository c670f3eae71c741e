"""Labels, policies, exits and performance figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import last_n, ordered, rnd, sdiv, so_far
from ..operators import prepare
from ..sources import feeds
from ..sources.feeds import BARS_SQL, TRADES_SQL
from .registry import query


def W():
    return ordered("symbol")


@query(
    f"""WITH {BARS_SQL}, m AS (SELECT symbol, seq, close, avg(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3,
  avg(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS s21 FROM bars), t AS (SELECT symbol, 0.001 * median(close) AS band FROM bars GROUP BY symbol)
SELECT m.symbol, seq, CAST(CASE WHEN s3 - s21 > band THEN 1 WHEN s3 - s21 < -band THEN 2 ELSE 0 END AS INTEGER) AS regime,
  CASE WHEN s3 - s21 > band THEN 'CALL_LONG' WHEN s3 - s21 < -band THEN 'PUT_LONG' ELSE 'FLAT' END AS action FROM m JOIN t USING (symbol)"""
)
def policy_action(spark, sf_dir):
    """Trend label with a dead band of 0.1 % of the median, and its action."""
    b = feeds.bars(spark, sf_dir)
    gap = F.avg("close").over(last_n(W(), 3)) - F.avg("close").over(last_n(W(), 21))
    band = F.percentile("close", F.lit(0.5)).over(Window.partitionBy("symbol")) * 0.001
    label = F.when(gap > band, 1).when(gap < -band, 2).otherwise(0)
    return b.select("symbol", "seq", label.alias("regime")).withColumn("action", F.when(F.col("regime") == 1, "CALL_LONG").when(F.col("regime") == 2, "PUT_LONG").otherwise("FLAT"))


LEDGER_SQL = (
    TRADES_SQL
    + """, ledger AS (SELECT symbol, ts, seq, CAST(ts AS DATE) AS day, (price - 125) / 10 * aggressor AS pnl, (price - 125) / 10 * aggressor > 0 AS win,
  CASE seq % 3 WHEN 0 THEN 'scalp' WHEN 1 THEN 'runner' ELSE 'trend' END AS profile FROM trades WHERE seq % 5 = 0 AND aggressor <> 0)"""
)


def ledger(spark, sf_dir):
    pnl = (F.col("price") - 125) / 10 * F.col("aggressor")
    kind = F.when(F.col("seq") % 3 == 0, "scalp").when(F.col("seq") % 3 == 1, "runner").otherwise("trend")
    t = feeds.trades(spark, sf_dir).where("seq % 5 = 0 AND aggressor <> 0")
    return t.select("symbol", "ts", "seq", F.to_date("ts").alias("day"), pnl.alias("pnl"), (pnl > 0).alias("win"), kind.alias("profile"))


@query(
    f"""WITH {LEDGER_SQL}, e AS (SELECT symbol, pnl, win, 1000 + sum(pnl) OVER w AS equity, sum(pnl) OVER w AS run, ts, seq FROM ledger WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT *, coalesce(equity - lag(equity) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) AS r, max(run) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM e)
SELECT symbol, count(*) AS trades, round(sum(pnl), 4) AS net, round(avg(CAST(win AS INTEGER)), 6) AS hit_rate, round(coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) * sqrt(1440), 4) AS sharpe,
  round(min(CASE WHEN peak = 0 THEN 0 ELSE (run - peak) / peak END), 5) AS max_drawdown, round(coalesce(avg(pnl) FILTER (pnl > 0) / nullif(avg(pnl) FILTER (pnl < 0), 0), 0), 5) AS avg_rr FROM d GROUP BY symbol"""
)
def kpis(spark, sf_dir):
    run = so_far(W())
    e = ledger(spark, sf_dir).withColumn("run", F.sum("pnl").over(run))
    d = e.select("symbol", "pnl", "win", "run", F.coalesce(F.col("run") - F.lag("run").over(W()), F.lit(0.0)).alias("r"), F.max("run").over(run).alias("peak"))
    fall = F.when(F.col("peak") == 0, 0.0).otherwise((F.col("run") - F.col("peak")) / F.nullif(F.col("peak"), F.lit(0.0)))
    return d.groupBy("symbol").agg(
        F.count("*").alias("trades"), rnd(F.sum("pnl"), 4).alias("net"), rnd(F.avg(F.col("win").cast("int"))).alias("hit_rate"),
        rnd(sdiv(F.avg("r"), F.stddev_pop("r")) * F.sqrt(F.lit(1440.0)), 4).alias("sharpe"), rnd(F.min(fall), 5).alias("max_drawdown"),
        rnd(sdiv(F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.avg(F.when(F.col("pnl") < 0, F.col("pnl")))), 5).alias("avg_rr"),
    )


@query(
    f"""WITH {LEDGER_SQL}, d AS (SELECT day, sum(pnl) AS p, count(*) AS n, count(*) FILTER (win) AS w, count(*) FILTER (profile = 'scalp') AS scalp, count(*) FILTER (profile = 'runner') AS runner,
  count(*) FILTER (profile = 'trend') AS trend FROM ledger GROUP BY day)
SELECT CAST(count(*) AS BIGINT) AS days, CAST(sum(n) AS BIGINT) AS trades, CAST(count(*) FILTER (p > 0) AS BIGINT) AS winning_days, CAST(count(*) FILTER (p < 0) AS BIGINT) AS losing_days,
  round(max(p), 4) AS best_day, round(min(p), 4) AS worst_day, round(avg(p), 5) AS mean_day, round(sum(w) / sum(n), 6) AS win_rate, CAST(sum(scalp) AS BIGINT) AS scalp, CAST(sum(runner) AS BIGINT) AS runner, CAST(sum(trend) AS BIGINT) AS trend FROM d"""
)
def ledger_metrics(spark, sf_dir):
    """Two levels: by day, then over the days."""
    of = lambda p: F.count(F.when(F.col("profile") == p, 1)).alias(p)
    d = ledger(spark, sf_dir).groupBy("day").agg(F.sum("pnl").alias("p"), F.count("*").alias("n"), F.count(F.when(F.col("win"), 1)).alias("w"), of("scalp"), of("runner"), of("trend"))
    return d.agg(
        F.count("*").alias("days"), F.sum("n").alias("trades"), F.count(F.when(F.col("p") > 0, 1)).alias("winning_days"), F.count(F.when(F.col("p") < 0, 1)).alias("losing_days"),
        rnd(F.max("p"), 4).alias("best_day"), rnd(F.min("p"), 4).alias("worst_day"), rnd(F.avg("p"), 5).alias("mean_day"), rnd(F.sum("w") / F.sum("n")).alias("win_rate"),
        F.sum("scalp").alias("scalp"), F.sum("runner").alias("runner"), F.sum("trend").alias("trend"),
    )


@query(
    f"""WITH {LEDGER_SQL} SELECT symbol, seq, round(avg(CAST(win AS INTEGER)) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW), 6) AS win_rate_1d FROM ledger"""
)
def rolling_winrate(spark, sf_dir):
    frame = "(PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '0 23:59:59.999999' DAY TO SECOND PRECEDING AND CURRENT ROW)"
    return ledger(spark, sf_dir).select("symbol", "seq", F.expr(f"round(avg(cast(win as int)) OVER {frame}, 6) + 0.0").alias("win_rate_1d"))


@query(
    f"""WITH {LEDGER_SQL}, r AS (SELECT *, sum(pnl) OVER w AS day_pnl, sum(CASE WHEN win THEN 1 ELSE 0 END) OVER w AS island FROM ledger WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, sum(CASE WHEN win THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, day, island ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS losses FROM r)
SELECT symbol, seq, CAST(losses AS BIGINT) AS losses, max(CASE WHEN day_pnl <= -5 OR losses >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS halted FROM s"""
)
def kill_switch(spark, sf_dir):
    """Halts for the day at -5 or after three losses in a row."""
    w = Window.partitionBy("symbol", "day").orderBy("ts", "seq")
    r = ledger(spark, sf_dir).withColumns({"day_pnl": F.sum("pnl").over(so_far(w)), "island": F.sum(F.col("win").cast("int")).over(so_far(w))})
    s = r.withColumn("losses", F.sum((~F.col("win")).cast("int")).over(so_far(Window.partitionBy("symbol", "day", "island").orderBy("ts", "seq"))))
    halt = F.max(((F.col("day_pnl") <= -5) | (F.col("losses") >= 3)).cast("int")).over(so_far(w)) == 1
    return s.select("symbol", "seq", "losses", halt.alias("halted"))


@query(
    f"""WITH {BARS_SQL}, e AS (SELECT symbol, seq AS entry, ts AS t0, close AS p0, avg(high - low) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM bars),
j AS (SELECT e.symbol, entry, p0, atr, b.ts, b.close, max(greatest(b.close, p0)) OVER (PARTITION BY e.symbol, entry ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best
  FROM e JOIN bars b ON b.symbol = e.symbol AND b.ts > t0 AND b.ts <= t0 + INTERVAL 12 HOUR WHERE entry % 20 = 0),
x AS (SELECT *, CASE WHEN best - close >= 0.75 * atr THEN 'trail' WHEN close <= p0 - 0.5 * atr THEN 'stop' WHEN close >= p0 + atr THEN 'take' END AS why FROM j)
SELECT symbol, entry, coalesce(arg_min(why, ts) FILTER (why IS NOT NULL), 'hold') AS reason, round(coalesce(arg_min(close, ts) FILTER (why IS NOT NULL), arg_max(close, ts)) - p0, 5) AS pnl
FROM x GROUP BY symbol, entry, p0"""
)
def exits(spark, sf_dir):
    """First of trailing stop, stop and take within twelve hours of an entry:
    a range join on half-day slots, then the first hit."""
    b = feeds.bars(spark, sf_dir)
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (12 * 3600 * 1_000_000))
    atr = F.avg(F.col("high") - F.col("low")).over(last_n(W(), 14))
    e = b.select("symbol", F.col("seq").alias("entry"), F.col("ts").alias("t0"), F.col("close").alias("p0"), atr.alias("atr"), slot.alias("slot")).where("entry % 20 = 0")
    e = e.withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1)))  # after the window, which must not see a bar twice
    j = e.join(b.select("symbol", "ts", "close", slot.alias("slot")), ["symbol", "slot"]).where("ts > t0 AND ts <= t0 + interval 12 hours")
    best = F.max(F.greatest("close", "p0")).over(so_far(Window.partitionBy("symbol", "entry").orderBy("ts")))
    c = F.col("close")
    why = F.when(F.col("best") - c >= 0.75 * F.col("atr"), "trail").when(c <= F.col("p0") - 0.5 * F.col("atr"), "stop").when(c >= F.col("p0") + F.col("atr"), "take")
    x = j.withColumn("best", best).withColumn("why", why).withColumn("hit", F.when(F.col("why").isNotNull(), F.col("ts")))
    return x.groupBy("symbol", "entry", "p0").agg(
        F.coalesce(F.min_by("why", "hit"), F.lit("hold")).alias("reason"), rnd(F.coalesce(F.min_by("close", "hit"), F.max_by("close", "ts")) - F.col("p0"), 5).alias("pnl")
    ).drop("p0")


@query(
    f"""WITH {BARS_SQL}, r AS (SELECT symbol, seq, close, volume, close / lag(close) OVER (PARTITION BY symbol ORDER BY seq) - 1 AS roc, abs(signed) AS aggr,
  median(abs(signed)) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS med,
  high = max(high) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) OR low = min(low) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS ext FROM bars)
SELECT symbol, seq, aggr > med * 1.5 + 1e-12 AS spike, coalesce(aggr > med * 1.5 + 1e-12 AND (ext OR (abs(roc) >= 0.004 AND aggr > 2.5 * med)), false) AS reversal FROM r"""
)
def reversal_labels(spark, sf_dir):
    """Aggression spike next to a local extremum (looks ten bars ahead)."""
    b = feeds.bars(spark, sf_dir)
    around = W().rowsBetween(-10, 10)
    aggr = F.abs("signed")
    med = F.percentile(aggr, F.lit(0.5)).over(last_n(W(), 20))
    ext = (F.col("high") == F.max("high").over(around)) | (F.col("low") == F.min("low").over(around))
    r = b.select("symbol", "seq", aggr.alias("a"), med.alias("m"), ext.alias("ext"), (F.col("close") / F.lag("close").over(W()) - 1).alias("roc"))
    spike = F.col("a") > F.col("m") * 1.5 + 1e-12
    return r.select("symbol", "seq", spike.alias("spike"), F.coalesce(spike & (F.col("ext") | ((F.abs("roc") >= 0.004) & (F.col("a") > 2.5 * F.col("m")))), F.lit(False)).alias("reversal"))


@query()
def direction_model(spark, sf_dir):
    """Imputed and scaled features, logistic regression on the older 80 %, and
    the area under its curve on the newer 20 %."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    b = feeds.bars(spark, sf_dir)
    names = ["r1", "r3", "imb", "gap"]
    rows = b.select(
        "symbol", "ts", "seq", (F.col("close") / F.lag("close").over(W()) - 1).alias("r1"), (F.col("close") / F.lag("close", 3).over(W()) - 1).alias("r3"),
        sdiv("signed", "volume").alias("imb"), (F.col("close") / F.avg("close").over(last_n(W(), 20)) - 1).alias("gap"),
        (F.lead("close").over(W()) > F.col("close")).cast("double").alias("label"),
    ).where("label IS NOT NULL")
    at = rows.agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0.8))).first()[0]
    older = F.unix_micros(F.col("ts").cast("timestamp")) <= at
    stages = [Imputer(inputCols=names, outputCols=names), VectorAssembler(inputCols=names, outputCol="v"), StandardScaler(inputCol="v", outputCol="features", withMean=True), LogisticRegression(maxIter=20)]
    model = Pipeline(stages=stages).fit(rows.where(older))
    auc = BinaryClassificationEvaluator().evaluate(model.transform(rows.where(~older)))
    return model.transform(rows).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("prediction").alias("share_up")).withColumn("auc", F.lit(auc))


def bar_features(spark, sf_dir):
    """Returns over one and three bars, imbalance, distance to the mean, range and logarithm of the volume; null where there is no past."""
    c = F.col("close")
    return feeds.bars(spark, sf_dir).select(
        "symbol", "seq", (c / F.lag("close").over(W()) - 1).alias("r1"), (c / F.lag("close", 3).over(W()) - 1).alias("r3"), sdiv("signed", "volume").alias("imb"),
        (c / F.avg("close").over(last_n(W(), 20)) - 1).alias("gap"), ((F.col("high") - F.col("low")) / c).alias("span"), F.ln("volume").alias("heft"),
    )


BAR_FEATURES = ["r1", "r3", "imb", "gap", "span", "heft"]
BAR_FEATURES_SQL = BARS_SQL + """, x AS (SELECT symbol, seq, close / lag(close) OVER w - 1 AS r1, close / lag(close, 3) OVER w - 1 AS r3, coalesce(signed / nullif(volume, 0), 0) AS imb,
  close / avg(close) OVER (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING) - 1 AS gap, (high - low) / close AS span, ln(volume) AS heft FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq))"""


@query()
def principal_components(spark, sf_dir):
    """Median fills, scales, and as many components as keep 0.99 of the variance."""
    rows = bar_features(spark, sf_dir)
    made = prepare.fit(rows, BAR_FEATURES, components=0.99)
    return made.transform(rows, ["symbol", "seq"])


@query(
    f"""WITH {BAR_FEATURES_SQL}, f AS (SELECT median(r1) AS r1, median(r3) AS r3, median(imb) AS imb, median(gap) AS gap, median(span) AS span, median(heft) AS heft FROM x),
y AS (SELECT symbol, seq, """
    + ", ".join(f"coalesce(x.{c}, f.{c}) AS {c}" for c in BAR_FEATURES)
    + """ FROM x CROSS JOIN f) SELECT symbol, seq, """
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in BAR_FEATURES)
    + " FROM y"
)
def scaled_features(spark, sf_dir):
    rows = bar_features(spark, sf_dir)
    made = prepare.fit(rows, BAR_FEATURES).transform(rows, ["symbol", "seq"])
    return made.select("symbol", "seq", *[rnd(c).alias(c) for c in BAR_FEATURES])


@query(f"""WITH {BAR_FEATURES_SQL} SELECT symbol, seq, round(1 / (1 + exp(-(0.05 + 2.5 * r1 - 1.25 * imb + 0.5 * gap))), 6) AS probability FROM x""")
def linear_predictions(spark, sf_dir):
    made = prepare.linear_score(bar_features(spark, sf_dir), {"bias": 0.05, "weights": {"r1": 2.5, "imb": -1.25, "gap": 0.5}})
    return made.select("symbol", "seq", rnd("probability").alias("probability"))
