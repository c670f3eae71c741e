"""Column expressions that the feature plans share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(num: Column | str, den: Column | str, fill: float | None = 0.0) -> Column:
    """``num / den``; ``fill`` where the denominator is 0 or either is null."""
    out = F.try_divide(col(num), F.nullif(col(den), F.lit(0.0)))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def no_inf(x: Column) -> Column:
    """Null for infinite and NaN values."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rnd(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col(x), digits) + F.lit(0.0)


def ordered(*keys: str, by: tuple[str, ...] = ("ts", "seq")) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def past_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n, -1)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def gated(agg: Callable[[Column], Column], x: Column | str, frame: WindowSpec, least: int) -> Column:
    """``agg`` over the frame where it has ``least`` non-null values, else null."""
    x = col(x)
    return F.when(F.count(x).over(frame) >= least, agg(x).over(frame))


def ffill(x: Column | str, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(so_far(w))


def bfill(x: Column | str, *keys: str, by: tuple[str, ...] = ("ts", "seq")) -> Column:
    """The next non-null value: the last one so far in reversed order, as a
    frame that reaches to the end would be read anew for every row."""
    return ffill(x, Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by]))


def corr(x: Column | str, y: Column | str, frame: WindowSpec) -> Column:
    """Correlation over the frame, of rows that have both; null where one does not
    vary (Spark's own divides by zero there)."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return F.try_divide(F.covar_pop(a, b).over(frame), F.when(spread > 0, spread))


def skew(x: Column | str, frame: WindowSpec, n: int) -> Column:
    """Bias-corrected skewness over a full window of ``n``."""
    return F.when(F.count(col(x)).over(frame) >= n, F.skewness(col(x)).over(frame) * math.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: Column | str, frame: WindowSpec, n: int) -> Column:
    """Bias-corrected excess kurtosis over a full window of ``n``."""
    k = F.kurtosis(col(x)).over(frame)
    return F.when(F.count(col(x)).over(frame) >= n, ((n + 1) * k + 6) * (n - 1) / ((n - 2) * (n - 3)))


def weighted_mean(x: Column | str, w: WindowSpec, n: int) -> Column:
    """Weights 1..n over the last n values, null before n of them."""
    parts = [F.lag(col(x), n - 1 - k).over(w) * float(k + 1) for k in range(n)] if n > 1 else [col(x) * 1.0]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / (n * (n + 1) / 2)


#: Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911)


def erf(x: Column) -> Column:
    a1, a2, a3, a4, a5, p = ERF
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / math.sqrt(2.0)))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def erf_sql(x: str) -> str:
    a1, a2, a3, a4, a5, p = ERF
    t = f"(1.0/(1.0+{p}*abs({x})))"
    return f"(sign({x})*(1.0-((((({a5}*{t}+{a4})*{t}+{a3})*{t}+{a2})*{t}+{a1})*{t})*exp(-({x})*({x}))))"


def norm_cdf_sql(x: str) -> str:
    return f"(0.5*(1.0+{erf_sql(f'(({x})/{math.sqrt(2.0)!r})')}))"


def norm_pdf_sql(x: str) -> str:
    return f"(exp(-({x})*({x})/2.0)/{math.sqrt(2.0 * math.pi)!r})"
