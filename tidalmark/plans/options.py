"""Option features by instrument row: premium, greeks, implied-volatility ranks, term slope, skew, crush and open interest."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import norm_cdf, norm_cdf_sql, norm_pdf, norm_pdf_sql, rnd, sdiv
from ..operators.blocks import ROWS, joined, windowed, written
from ..operators.ordered import window_ranks
from ..sources import feeds
from ..sources.feeds import CHAIN_SQL
from .registry import query

LOOKBACKS = (30, 90, 252)
#: Differences of means under this are rounding, not changes.
TINY = 1e-12
#: An order's lines can share a number.
ORDER = ("ts", "seq", "strike", "premium")


def frames(x: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` values of each row, NaN before the first."""
    return sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def _over(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.full(len(top), np.nan), where=np.abs(bottom) > TINY)


def _spread(w: np.ndarray) -> np.ndarray:
    n = (~np.isnan(w)).sum(1)
    total = np.nansum((w - (np.nansum(w, 1) / np.maximum(n, 1))[:, None]) ** 2, 1)
    return np.sqrt(np.divide(total, n - 1, out=np.full(len(w), np.nan), where=n > 1))


def _mean(w: np.ndarray) -> np.ndarray:
    return np.nansum(w, 1) / np.maximum((~np.isnan(w)).sum(1), 1)


def option_windows(lookbacks: tuple[int, ...] = LOOKBACKS, short: int = 5, long: int = 30, unusual: float = 3.0):
    """The kernel of all windowed features, over one block."""

    def kernel(x, pos, own):
        iv, ratio, oi, seconds = x["iv"], x["ratio"], x["oi"], x["seconds"]
        out = []
        for n in lookbacks:
            low, high, share = window_ranks(iv, n)
            out += [_over(iv - low, high - low), share]
        wide = frames(ratio, long)
        out.append(_over(ratio - _mean(wide), _spread(wide)))
        near, far = _mean(frames(iv, short)), _mean(frames(iv, long))
        for change in (far - near, near - far):
            moved = np.nan_to_num(_over(change, far))
            moved = np.where(moved > TINY, moved, 0.0)
            out.append(np.nan_to_num(_over(moved, np.nanmax(frames(moved, long), 1))))
        change = np.diff(oi, prepend=np.nan)
        gap = np.diff(seconds, prepend=np.nan)
        gap[np.isnan(gap) | (gap == 0)] = 1.0
        full = frames(oi, long)
        usual = np.where(np.isnan(full).any(1), 0.0, _spread(full))
        out += [change, np.nan_to_num(change) / gap, (np.abs(np.nan_to_num(change)) > unusual * usual).astype(np.int32)]
        return tuple(c[own] for c in out)

    return kernel


def d1_of(quotes: DataFrame) -> tuple[Column, Column, Column]:
    """The first argument of the normal distribution, the deviation over the rest of
    the time, and that time in years; ``tte`` is in months."""
    t = F.greatest(F.col("tte") / 12.0, F.lit(1e-12))
    sigma = F.greatest("iv", F.lit(1e-12))
    return (F.ln(F.col("spot") / F.col("strike")) + 0.5 * sigma * sigma * t) / (sigma * F.sqrt(t)), sigma * F.sqrt(t), t


def option_features(quotes: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS, notional: float = 1e6, rows: int = ROWS) -> DataFrame:
    """``quotes`` with the features of each row; ``tte`` is in months.  The series of a symbol are its rows
    in ``ORDER``, whatever the instrument; term slope, skew and total gamma
    exposure are those of the row's symbol and time."""
    q = quotes.withColumns({"ratio": F.coalesce(sdiv("premium", "spot", None), F.lit(0.0)), "seconds": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    ranks = ", ".join(f"iv_rank_{n} double, iv_pct_{n} double" for n in lookbacks)
    schema = f"{ranks}, prem_z double, iv_crush double, iv_expand double, oi_change double, oi_per_sec double, unusual_oi int"
    # The crush is compared with those of 30 rows, each of which looks back 30 rows.
    back = max(60, max(lookbacks) - 1)
    made = windowed(q, ["iv", "ratio", "oi", "seconds"], schema, option_windows(lookbacks), order=ORDER, back=back, rows=max(rows, back))
    call = F.col("kind") == "call"
    made = with_greeks(made).drop("seconds")
    by_expiry = quotes.groupBy("symbol", "ts", "tte").agg(F.avg("iv").alias("iv"))
    first = F.sort_array(F.collect_list(F.struct("tte", "iv")))
    slope = by_expiry.groupBy("symbol", "ts").agg(first.alias("e")).select("symbol", "ts", F.when(F.size("e") > 1, F.col("e")[1]["iv"] - F.col("e")[0]["iv"]).alias("term_slope"))
    # Of the quotes themselves: their greeks need no windows, which would run a second time for this.
    at_time = with_greeks(quotes).groupBy("symbol", "ts").agg(
        (F.avg(F.when(call, F.col("iv"))) - F.avg(F.when(~call, F.col("iv")))).alias("skew_index"), F.sum(F.col("gex") * F.col("oi")).alias("gex_total")
    )
    both = joined(at_time, slope, ["symbol", "ts"]).withColumn("gex_norm", F.col("gex_total") / notional)
    # Written, so that its size is known: a small one is broadcast and the rows are not shuffled to meet it.
    return joined(made, written(both), ["symbol", "ts"])


def with_greeks(quotes: DataFrame) -> DataFrame:
    """``quotes`` with the greeks of each row and its gamma exposure for an interest of one."""
    d1, root, t = d1_of(quotes)
    made = quotes.withColumns({"root": root, "d1": d1, "t": t})
    made = made.withColumns({"nd": norm_cdf(F.col("d1")), "pdf": norm_pdf(F.col("d1"))})
    made = made.withColumns({
        "delta": F.when(F.col("kind") == "call", F.col("nd")).otherwise(F.col("nd") - 1.0), "gamma": F.col("pdf") / (F.col("spot") * F.col("root")),
        "vega": F.col("spot") * F.col("pdf") * F.sqrt("t"), "theta": -F.col("spot") * F.col("pdf") * F.col("iv") / (2 * F.sqrt("t")),
    })
    return made.withColumn("gex", F.col("gamma") * F.col("spot")).drop("root", "d1", "nd", "pdf", "t")


def _ranks_sql() -> str:
    part = "round((iv - min(iv) OVER w{n}) / nullif(max(iv) OVER w{n} - min(iv) OVER w{n}, 0), 6) AS iv_rank_{n}, round((len(list_filter(list(iv) OVER w{n}, lambda v: v < iv)) + (len(list_filter(list(iv) OVER w{n}, lambda v: v = iv)) + 1) / 2) / count(iv) OVER w{n}, 6) AS iv_pct_{n}"
    return ",\n  ".join(part.format(n=n) for n in LOOKBACKS)


def around_spot(chain: DataFrame) -> DataFrame:
    """Five times the strikes, which then lie around the spot."""
    return chain.withColumn("strike", F.col("strike") * 5)


@query(
    f"""WITH {CHAIN_SQL},
a AS (SELECT *, coalesce(premium / nullif(spot, 0), 0) AS ratio, greatest(tte / 12.0, 1e-12) AS t, avg(iv) OVER w5 AS near, avg(iv) OVER w30 AS far,
  oi - lag(oi) OVER w AS oi_change, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS gap, CASE WHEN count(oi) OVER w30 >= 30 THEN stddev_samp(oi) OVER w30 ELSE 0 END AS usual,
  {_ranks_sql()}
  FROM chain WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq, strike, premium), w5 AS (PARTITION BY symbol ORDER BY ts, seq, strike, premium ROWS 4 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY ts, seq, strike, premium ROWS 29 PRECEDING),
  w90 AS (PARTITION BY symbol ORDER BY ts, seq, strike, premium ROWS 89 PRECEDING), w252 AS (PARTITION BY symbol ORDER BY ts, seq, strike, premium ROWS 251 PRECEDING)),
b AS (SELECT *, CASE WHEN (far - near) / far > 1e-12 THEN (far - near) / far ELSE 0 END AS crush, CASE WHEN (near - far) / far > 1e-12 THEN (near - far) / far ELSE 0 END AS expand,
  (ratio - avg(ratio) OVER w30) / CASE WHEN stddev_samp(ratio) OVER w30 > 1e-12 THEN stddev_samp(ratio) OVER w30 END AS z,
  (ln(spot / (strike * 5)) + 0.5 * iv * iv * t) / (iv * sqrt(t)) AS d1 FROM a WINDOW w30 AS (PARTITION BY symbol ORDER BY ts, seq, strike, premium ROWS 29 PRECEDING)),
c AS (SELECT *, {norm_cdf_sql('d1')} AS nd, {norm_pdf_sql('d1')} AS pdf, max(crush) OVER w30 AS mc, max(expand) OVER w30 AS me FROM b WINDOW w30 AS (PARTITION BY symbol ORDER BY ts, seq, strike, premium ROWS 29 PRECEDING)),
e AS (SELECT symbol, ts, tte, avg(iv) AS iv, row_number() OVER (PARTITION BY symbol, ts ORDER BY tte) AS k FROM chain GROUP BY symbol, ts, tte),
s AS (SELECT symbol, ts, max(iv) FILTER (WHERE k = 2) - max(iv) FILTER (WHERE k = 1) AS slope FROM e GROUP BY symbol, ts),
x AS (SELECT symbol, ts, avg(iv) FILTER (WHERE kind = 'call') - avg(iv) FILTER (WHERE kind = 'put') AS skew, sum(pdf / (iv * sqrt(t)) * oi) AS gex FROM c GROUP BY symbol, ts)
SELECT c.symbol, c.seq, round(ratio, 6) AS prem_pct, round(z, 5) AS prem_z, iv_rank_30, iv_rank_90, iv_rank_252, iv_pct_30, iv_pct_90, iv_pct_252,
  round(CASE WHEN mc > 0 THEN crush / mc ELSE 0 END + 1e-9, 6) AS iv_crush, round(CASE WHEN me > 0 THEN expand / me ELSE 0 END + 1e-9, 6) AS iv_expand, oi_change,
  round(coalesce(oi_change, 0) / CASE WHEN gap IS NULL OR gap = 0 THEN 1 ELSE gap END, 8) AS oi_per_sec, CAST(coalesce(abs(oi_change), 0) > 3 * usual AS INTEGER) AS unusual_oi,
  round(CASE WHEN kind = 'call' THEN nd ELSE nd - 1 END, 6) AS delta, round(pdf / (spot * iv * sqrt(t)), 8) AS gamma, round(spot * pdf * sqrt(t), 4) AS vega, round(-spot * pdf * iv / (2 * sqrt(t)), 4) AS theta,
  round(pdf / (iv * sqrt(t)), 6) AS gex, round(x.gex, 4) AS gex_total, round(x.gex / 1e6, 8) AS gex_norm, round(s.slope, 6) AS term_slope, round(x.skew, 6) AS skew_index
FROM c JOIN s ON s.symbol = c.symbol AND s.ts = c.ts JOIN x ON x.symbol = c.symbol AND x.ts = c.ts"""
)
def opt_features(spark, sf_dir):
    r = option_features(around_spot(feeds.chain(spark, sf_dir)))
    digits = {"prem_z": 5, "oi_per_sec": 8, "gamma": 8, "vega": 4, "theta": 4, "gex_total": 4, "gex_norm": 8}
    names = ["prem_z", *[f"iv_{k}_{n}" for n in LOOKBACKS for k in ("rank", "pct")], "oi_change", "oi_per_sec", "delta", "gamma", "vega", "theta", "gex", "gex_total", "gex_norm", "term_slope", "skew_index"]
    return r.select(
        "symbol", "seq", rnd("ratio").alias("prem_pct"), *[rnd(c, digits.get(c, 6)).alias(c) for c in names],
        *[rnd(F.col(c) + 1e-9).alias(c) for c in ("iv_crush", "iv_expand")],  # many are exact halves of the last digit
        "unusual_oi",
    )
