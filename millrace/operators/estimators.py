"""Estimators of densities and probabilities, fitted by aggregations and applied as expressions.

Kernel estimates keep the distinct values, rounded to the precision, with their weights: as many as the
precision leaves, at most ``MOST_POINTS``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.special import column, ln_factorial

MOST_POINTS = 50_000


def normal_density(x: Column, mean, deviation) -> Column:
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * math.sqrt(2 * math.pi))


def fit_normal(df: DataFrame, value: str, by: str | None = None, weight: str | None = None, least: float = 1e-6) -> DataFrame:
    """``(by,) n, mean, deviation``: weighted moments, with a least deviation."""
    w, x = F.col(weight) if weight else F.lit(1.0), F.col(value).cast("double")
    known = df.where(x.isNotNull() & (F.col(by).isNotNull() if by else F.lit(True)))
    found = known.groupBy(*([by] if by else [])).agg(F.sum(w).alias("n"), (F.sum(w * x) / F.sum(w)).alias("mean"), (F.sum(w * x * x) / F.sum(w)).alias("square"))
    spread = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return found.select(*([by] if by else []), "n", "mean", F.greatest(spread, F.lit(least)).alias("deviation"))


def poisson(df: DataFrame, value: str, name: str = "probability") -> DataFrame:
    """The probability of each row's count, by the mean of all."""
    mean = df.agg(F.avg(value)).first()[0] or 0.0
    x = F.col(value).cast("double")
    return df.withColumn(name, F.exp(-mean + x * math.log(mean) - column(ln_factorial)(x)) if mean > 0 else F.when(x == 0, 1.0).otherwise(0.0))


def bivariate_normal(df: DataFrame, x: str, y: str, name: str = "density") -> DataFrame:
    """The density of each row under the normal distribution of two columns, by their covariance."""
    m = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"), F.covar_samp(x, y).alias("xy")).first()
    if m["xx"] is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    det = m["xx"] * m["yy"] - m["xy"] ** 2
    a, b = F.col(x) - m["mx"], F.col(y) - m["my"]
    distance = (a * a * m["yy"] - 2 * a * b * m["xy"] + b * b * m["xx"]) / det
    return df.withColumn(name, F.exp(-distance / 2) / (2 * math.pi * math.sqrt(det)))


def conditional_normal(df: DataFrame, x: str, given: str, name: str = "density") -> DataFrame:
    """The density of ``x`` given another number, under their joint normal distribution."""
    m = df.agg(F.avg(x).alias("mx"), F.avg(given).alias("my"), F.var_samp(x).alias("xx"), F.var_samp(given).alias("yy"), F.covar_samp(x, given).alias("xy")).first()
    if not m["yy"]:
        return df.withColumn(name, F.lit(None).cast("double"))
    mean = m["mx"] + m["xy"] / m["yy"] * (F.col(given) - m["my"])
    return df.withColumn(name, normal_density(F.col(x), mean, math.sqrt(max(m["xx"] - m["xy"] ** 2 / m["yy"], 1e-12))))


def normal_given_discrete(df: DataFrame, x: str, given: str, name: str = "density") -> DataFrame:
    """The density of a number in its row's class: moments by class, joined back."""
    moments = fit_normal(df, x, given).select(F.col(given).alias("_g"), F.col("mean").alias("_m"), F.col("deviation").alias("_d"))
    held = df.join(moments, F.col(given) == F.col("_g"), "left")
    return held.select(*df.columns, normal_density(F.col(x), F.col("_m"), F.col("_d")).alias(name))


def discrete_given_normal(df: DataFrame, y: str, given: str, name: str = "probability") -> DataFrame:
    """The probability of a row's class given a number, normal in each class. The classes come as literals."""
    found = fit_normal(df, given, y).orderBy(y).collect()
    total = sum(r["n"] for r in found)
    parts = [(r[y], normal_density(F.col(given), r["mean"], r["deviation"]) * (r["n"] / total)) for r in found]
    whole = sum((p for _, p in parts), F.lit(0.0))
    own = F.coalesce(*[F.when(F.col(y) == F.lit(v), p) for v, p in parts], F.lit(0.0))
    return df.withColumn(name, F.when(whole > 0, own / whole).otherwise(F.lit(1.0 / max(len(parts), 1))))


def _erf(z: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erf, z.ravel().tolist()), float, z.size).reshape(z.shape)


class Kernel:
    """Sums of normal bins around distinct values: the probability of ``x`` is that of its range of ``precision``."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, precision: float):
        self.values, self.weights, self.precision = values, weights, precision
        spread = values.max() - values.min() if len(values) else 0.0
        self.deviation = max(spread / math.sqrt(max(weights.sum(), 1e-12)), precision / 6)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(x))
        scale = self.deviation * math.sqrt(2)
        out = np.zeros(len(x))
        for at in range(0, len(x), 256):
            z = x[at : at + 256, None] - self.values[None]
            mass = (_erf((z + self.precision / 2) / scale) - _erf((z - self.precision / 2) / scale)) / 2
            out[at : at + 256] = mass @ self.weights / self.weights.sum()
        return out


def fit_kernels(df: DataFrame, value: str, by: str | None = None, precision: float = 0.01) -> dict:
    """A ``Kernel`` of each class, or of all rows under None."""
    rounded = F.round(F.col(value) / precision) * precision
    known = df.where(F.col(value).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True)))
    points = known.groupBy((F.col(by) if by else F.lit(0)).alias("g"), rounded.alias("v")).count()
    held = points.limit(MOST_POINTS + 1).toPandas()
    if len(held) > MOST_POINTS:
        raise ValueError(f"{value} has more than {MOST_POINTS} distinct values; use a coarser precision")
    found = {g: Kernel(p["v"].to_numpy(float), p["count"].to_numpy(float), precision) for g, p in held.sort_values(["g", "v"]).groupby("g")}
    return found if by else {None: found.get(0, Kernel(np.zeros(0), np.zeros(0), precision))}


def kernel(df: DataFrame, value: str, precision: float = 0.01, name: str = "probability") -> DataFrame:
    """The probability of each row's value under the kernel estimate of all."""
    model = fit_kernels(df, value, None, precision)[None]

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), np.nan, model.probability(x.fillna(0.0).to_numpy(float))))

    return df.withColumn(name, F.when(F.col(value).isNotNull(), of(F.col(value).cast("double"))))


def kernel_given_discrete(df: DataFrame, value: str, given: str, precision: float = 0.01, name: str = "probability") -> DataFrame:
    """The probability of a number under the kernel estimate of its row's class."""
    models = fit_kernels(df, value, given, precision)

    @F.pandas_udf("double")
    def of(x: pd.Series, g: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        for k in g.dropna().unique():
            here = ((g == k) & x.notna()).to_numpy()
            if k in models:
                out[here] = models[k].probability(x[here].to_numpy(float))
        return pd.Series(out)

    return df.withColumn(name, of(F.col(value).cast("double"), F.col(given)))


def discrete_given_kernel(df: DataFrame, y: str, given: str, precision: float = 0.01, name: str = "probability") -> DataFrame:
    """The probability of a row's class given a number, by kernel estimates of the number in each class."""
    models = fit_kernels(df, given, y, precision)
    total = sum(m.weights.sum() for m in models.values())

    @F.pandas_udf("double")
    def of(x: pd.Series, g: pd.Series) -> pd.Series:
        v = x.fillna(0.0).to_numpy(float)
        parts = {k: m.probability(v) * m.weights.sum() / total for k, m in models.items()}
        whole = sum(parts.values()) if parts else np.zeros(len(v))
        own = np.array([parts[k][i] if k in parts else 0.0 for i, k in enumerate(g)])
        out = np.where(whole > 0, own / np.where(whole > 0, whole, 1), 1.0 / max(len(parts), 1))
        return pd.Series(np.where(x.isna(), np.nan, out))

    return df.withColumn(name, of(F.col(given).cast("double"), F.col(y)))


def kernel_given_kernel(df: DataFrame, value: str, given: str, precision: float = 0.01, name: str = "probability") -> DataFrame:
    """The probability of a number given another: kernels around the distinct pairs, weighted by how near the given one is."""
    r = lambda c: F.round(F.col(c) / precision) * precision
    held = df.where(F.col(value).isNotNull() & F.col(given).isNotNull()).groupBy(r(value).alias("v"), r(given).alias("g")).count().limit(MOST_POINTS + 1).toPandas()
    if len(held) > MOST_POINTS:
        raise ValueError("too many distinct pairs; use a coarser precision")
    v, g, w = (held[c].to_numpy(float) for c in ("v", "g", "count"))
    near, far = Kernel(v, w, precision), Kernel(g, w, precision)

    def bins(k: Kernel, x: np.ndarray) -> np.ndarray:
        z, scale = x[:, None] - k.values[None], k.deviation * math.sqrt(2)
        return (_erf((z + precision / 2) / scale) - _erf((z - precision / 2) / scale)) / 2

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        known = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        for at in range(0, len(known), 256):
            some = known[at : at + 256]
            share = bins(far, y.iloc[some].to_numpy(float)) * w
            whole = share.sum(1)
            out[some] = np.where(whole > 0, (bins(near, x.iloc[some].to_numpy(float)) * share).sum(1) / np.where(whole > 0, whole, 1), 0.0)
        return pd.Series(out)

    return df.withColumn(name, of(F.col(value).cast("double"), F.col(given).cast("double")))
