"""Preprocessing that is fitted once, kept as data, and applied as expressions.

Fitting takes aggregates only: fills, then location and scale, then the
covariance, which each task sums for its own rows; the driver gets as many
numbers as there are pairs of columns.  Applying adds columns of plain
arithmetic to a query, so it costs no pass and no Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prepared:
    """What was fitted: by column its fill, centre and scale; ``components`` has a
    row of loadings for each component (none: no components), ``shares`` their
    shares of the variance."""

    columns: list[str]
    fills: list[float]
    centres: list[float]
    scales: list[float]
    means: list[float] | None = None
    components: list[list[float]] | None = None
    shares: list[float] | None = None

    def names(self) -> list[str]:
        return self.columns if self.components is None else [f"PC_{k}" for k in range(len(self.components))]

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The columns ``keep`` and the prepared ones; a missing column raises."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        scaled = [(_value(c, fill) - centre) / scale for c, fill, centre, scale in zip(self.columns, self.fills, self.centres, self.scales, strict=True)]
        if self.components is None:
            return df.select(*keep, *[x.alias(c) for x, c in zip(scaled, self.columns, strict=True)])
        # Scaled values are columns of their own, or each component would write them out.
        inner = [f"_x{k}" for k in range(len(scaled))]
        made = df.select(*keep, *[(x - m).alias(c) for x, c, m in zip(scaled, inner, self.means, strict=True)])
        dots = [sum((F.col(c) * w for c, w in zip(inner[1:], row[1:], strict=True)), F.col(inner[0]) * row[0]) for row in self.components]
        return made.select(*keep, *[d.alias(n) for d, n in zip(dots, self.names(), strict=True)])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "prepared string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Prepared:
    return Prepared(**json.loads(spark.read.text(path).first()[0]))


def _value(column: str, fill: float) -> Column:
    x = F.col(f"`{column}`").cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(fill)).otherwise(x)


def _fills(df: DataFrame, columns: list[str], impute: str, constant: float) -> list[float]:
    known = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"c{k}") for k, c in enumerate(columns)])
    names = known.columns
    if impute == "constant":
        return [constant] * len(columns)
    if impute in ("mean", "median"):
        agg = F.avg if impute == "mean" else F.median
        got = known.agg(*[agg(c).alias(c) for c in names]).first()
        return [constant if got[c] is None else got[c] for c in names]
    if impute == "most_frequent":
        pairs = known.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(names)])).alias("p"))
        counts = pairs.select("p.*").where("v IS NOT NULL").groupBy("k", "v").agg(F.count("*").alias("n"))
        got = {r["k"]: r["v"] for r in counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()}
        return [got.get(k, constant) for k in range(len(columns))]
    raise ValueError(f"no such way to fill: {impute!r}")


def covariance(df: DataFrame, means: list[float]) -> tuple[np.ndarray, int]:
    """The covariance of all columns, and the number of rows.  A task sends a row of
    sums for each column, which are added up by column before they come here."""
    k = len(df.columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, k)), 0
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() - means[i] for i in range(k)], axis=1)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array([n] * k, pa.int64())], ["i", "row", "n"])

    parts = df.mapInArrow(sums, "i int, row array<double>, n long")
    lines = parts.select("i", "n", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    out = np.zeros((k, k))
    for r in lines:
        out[r["i"], r["j"]] = r["v"]
    n = lines[0]["n"] if lines else 0
    return out / max(1, n - 1), n


def fit(
    df: DataFrame, columns: list[str], impute: str = "median", scaler: str = "standard", components: int | float | None = None, constant: float = 0.0
) -> Prepared:
    """Fills (mean, median, most_frequent: the smallest of the commonest, constant),
    then scales (standard: mean 0 and deviation 1; minmax: 0 to 1; a column that
    does not vary is only moved).  ``components``: a number of them, or the share
    of the variance that they keep together, or none at all.

    A null or NaN is filled; a column without any value is filled with ``constant``.
    An empty table gives fills of ``constant`` and no change of scale.
    """
    if scaler not in ("standard", "minmax"):
        raise ValueError(f"no such scaler: {scaler!r}")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    fills = _fills(df, columns, impute, constant)
    names = [f"c{k}" for k in range(len(columns))]
    filled = df.select(*[_value(c, fill).alias(n) for c, n, fill in zip(columns, names, fills, strict=True)])
    low, high = (F.avg, F.stddev_pop) if scaler == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
    got = filled.agg(*[low(c).alias(f"{c}_l") for c in names], *[high(c).alias(f"{c}_h") for c in names], *[F.avg(c).alias(f"{c}_m") for c in names]).first()
    centres, scales = [got[f"{c}_l"] or 0.0 for c in names], [got[f"{c}_h"] or 1.0 for c in names]
    if components is None:
        return Prepared(list(columns), fills, centres, scales)
    means = [((got[f"{c}_m"] or 0.0) - centre) / scale for c, centre, scale in zip(names, centres, scales, strict=True)]
    scaled = filled.select(*[((F.col(c) - centre) / scale).alias(c) for c, centre, scale in zip(names, centres, scales, strict=True)])
    values, vectors = np.linalg.eigh(covariance(scaled, means)[0])
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    shares = values / values.sum() if values.sum() > 0 else np.zeros(len(values))
    if isinstance(components, float) and 0 < components < 1:
        n = min(len(values), int(np.searchsorted(np.cumsum(shares), components, side="right")) + 1)
    else:
        n = min(int(components), len(values))
    # A component's direction is free; its largest loading is positive.
    turn = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return Prepared(list(columns), fills, centres, scales, means, (vectors * turn[:, None])[:n].tolist(), shares[:n].tolist())


def linear_score(df: DataFrame, model: dict) -> DataFrame:
    """``df`` with ``probability``: the sigmoid of a bias and weighted columns, from
    ``{"bias": b, "weights": {column: weight}}``.  Null where a column is."""
    missing = [c for c in model.get("weights", {}) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    z = sum((F.col(f"`{c}`") * float(w) for c, w in model.get("weights", {}).items()), F.lit(float(model.get("bias", 0.0))))
    return df.withColumn("probability", 1 / (1 + F.exp(-z)))
