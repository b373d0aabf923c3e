"""Statistics of daily series and of fitted linear models: autocorrelation, unit-root test, significance, feature audit."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import collected


def autocorrelation(series: DataFrame, order: str, value: str, lags: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, lag, acf) for lags 1 to `lags`: the sum of products of deviations a lag apart over that of their squares.

    The deviations are from the mean of the whole series, rows without a value are left out, and a series without
    variance has null.  One window and one aggregation serve all lags; without groups a series is one task's work, so it
    must be an aggregated one, such as that of the days.
    """
    w = Window.partitionBy(*groups or [F.lit(0)])
    dev = series.filter(F.col(value).isNotNull()).withColumn("__d", F.col(value) - F.avg(value).over(w))
    ahead = w.orderBy(order)
    pairs = dev.select(*groups, "__d", *[(F.col("__d") * F.lag("__d", k).over(ahead)).alias(f"__p{k}") for k in range(1, lags + 1)])
    square = F.sum(F.col("__d") * F.col("__d"))
    one = pairs.groupBy(*groups).agg(*[F.when(square > 0, F.coalesce(F.sum(f"__p{k}"), F.lit(0.0)) / square).alias(f"__a{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__a{k}").alias("acf")) for k in range(1, lags + 1)])
    return one.select(*groups, F.inline(rows))


def unit_root(series: DataFrame, order: str, value: str) -> DataFrame:
    """(n, slope, statistic): the Dickey-Fuller regression of a series' change on its last value, with a constant.

    The statistic is the slope over its standard error; compare it with the Dickey-Fuller tables (-2.86 at 5 % for long
    series).  Sums suffice, so nothing but one row leaves the executors; fewer than four rows have null.
    """
    x = F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(order))
    xy = series.filter(F.col(value).isNotNull()).select(x.alias("x"), (F.col(value) - x).alias("y")).filter("x is not null")
    s = xy.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    slope = F.when((F.col("n") > 2) & (F.col("xx") > 0), F.col("xy") / F.col("xx"))
    error = F.sqrt((F.col("yy") - slope * F.col("xy")) / ((F.col("n") - 2) * F.col("xx")))
    return s.select("n", slope.alias("slope"), F.when(error > 0, slope / error).alias("statistic"))


def significance(spark: SparkSession, model: LinearRegressionModel, names: list[str]) -> DataFrame:
    """(name, coefficient, std_error, t_value, p_value, stars), the intercept last; a model without summary is refused.

    Standard errors exist for the normal solver only; elsewhere they are null, as are what follows from them.
    """
    s = model.summary
    beta = [float(b) for b in np.append(model.coefficients.toArray(), model.intercept)]
    try:
        error, t, p = s.coefficientStandardErrors, s.tValues, s.pValues
    except Exception:  # the solver gives no inverse of the Gram matrix
        error = t = p = [None] * len(beta)
    label = [*names, "(intercept)"]
    stars = lambda q: None if q is None or math.isnan(q) else "***" if q < 0.001 else "**" if q < 0.01 else "*" if q < 0.05 else ""
    rows = [(n, b, e, tv, q, stars(q)) for n, b, e, tv, q in zip(label, beta, error, t, p, strict=False)]
    return spark.createDataFrame(rows, "name string, coefficient double, std_error double, t_value double, p_value double, stars string")


def feature_audit(df: DataFrame, features: tuple[str, ...], label: str) -> DataFrame:
    """(feature, n, n_null, mean, sd, low, high, corr) of numeric features in one pass; corr is Pearson's with the label."""
    num = lambda c: F.col(c).cast("double")
    one = df.agg(*[
        F.struct(
            F.count(c).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("n_null"), F.avg(num(c)).alias("mean"), F.stddev(num(c)).alias("sd"),
            F.min(num(c)).alias("low"), F.max(num(c)).alias("high"), F.corr(num(c), num(label)).alias("corr"),
        ).alias(f"__{i}") for i, c in enumerate(features)
    ])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__{i}.*")) for i, c in enumerate(features)])
    return one.select(F.inline(rows))


def collected_series(series: DataFrame, order: str, value: str, most: int = 100_000) -> np.ndarray:
    """An aggregated series, such as that of the days, in order on the driver; ValueError beyond `most` rows."""
    rows = collected(series.filter(F.col(value).isNotNull()).select(F.col(order).alias("o"), F.col(value).cast("double").alias("v")), most)
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["o"])], float)


def partial_autocorrelation(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations for lags 1.. from the autocorrelations for lags 1.., by Durbin and Levinson."""
    out, phi = [], np.zeros(0)
    for k in range(1, len(acf) + 1):
        past = acf[: k - 1]
        top, low = acf[k - 1] - phi @ past[::-1], 1 - phi @ past
        new = top / low if low else 0.0
        phi = np.append(phi - new * phi[::-1], new)
        out.append(new)
    return np.array(out)


def ljung_box(acf: np.ndarray, n: int) -> np.ndarray:
    """The statistic for lags up to each lag; under no autocorrelation it is chi-square with as many degrees of freedom."""
    k = np.arange(1, len(acf) + 1)
    return n * (n + 2) * np.cumsum(acf**2 / (n - k))


def kpss(x: np.ndarray, trend: bool = True, lags: int | None = None) -> float:
    """The KPSS statistic of stationarity around a trend (or a level), with Bartlett weights; lags default to 12 (n / 100) ^ 1/4."""
    n = len(x)
    t = np.stack([np.ones(n), np.arange(n)], axis=1)[:, : 2 if trend else 1]
    e = x - t @ np.linalg.lstsq(t, x, rcond=None)[0]
    lags = int(np.ceil(12 * (n / 100) ** 0.25)) if lags is None else lags
    s = e @ e / n + 2 / n * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, min(lags, n - 1) + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * s))


def cointegration(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """(slope, statistic): the Engle-Granger test by a Dickey-Fuller regression without constant on what y ~ 1 + x leaves.

    Compare the statistic with tables for two series (-3.34 at 5 %).
    """
    t = np.stack([np.ones(len(x)), x], axis=1)
    beta = np.linalg.lstsq(t, y, rcond=None)[0]
    e = y - t @ beta
    last, change = e[:-1], np.diff(e)
    b = last @ change / (last @ last)
    left = change - b * last
    return float(beta[1]), float(b / np.sqrt(left @ left / (len(change) - 1) / (last @ last)))


def seasonal_split(x: np.ndarray, period: int, rounds: int = 2, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, season, rest): a moving mean over the period and the mean of each place in it, by turns; robust rounds weigh outliers down."""
    n = len(x)
    weight, season = np.ones(n), np.zeros(n)
    place = np.arange(n) % period
    for _ in range(max(1, rounds)):
        w = np.convolve(weight, np.ones(period), "same")
        trend = np.convolve((x - season) * weight, np.ones(period), "same") / np.maximum(w, 1e-12)
        total = np.bincount(place, (x - trend) * weight, period) / np.maximum(np.bincount(place, weight, period), 1e-12)
        season = (total - total.mean())[place]
        rest = x - trend - season
        if robust:
            u = np.abs(rest) / max(6 * np.median(np.abs(rest)), 1e-12)
            weight = np.where(u < 1, (1 - u * u) ** 2, 1e-6)
    return trend, season, rest


def flag_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows where both numbers are known, where they differ, and the share of those; mean absolute difference."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    differ = F.count_if(both & (F.col(a) != F.col(b)))
    n = F.count_if(both)
    return df.agg(n.alias("n"), differ.alias("differ"), F.when(n > 0, differ / n).alias("share"), F.avg(F.when(both, F.abs(F.col(a).cast("double") - F.col(b).cast("double")))).alias("mean_difference"))


def rank_distribution(df: DataFrame, rank: str = "lineage_rank", k: int = 20) -> DataFrame:
    """(rank, n) of the k ranks that most rows have."""
    return df.groupBy(rank).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), rank).limit(k)
