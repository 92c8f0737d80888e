"""Quantiles that Spark lacks: the beta distribution's by a continued fraction and bisection, the normal one's."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction on the side where it converges."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = total
        for term in (even, odd):
            c, d = 1 + term / c, 1 / (1 + term * d)
            total *= c * d
        if abs(total - before) < 1e-16 * abs(total):
            break
    return front * total


def beta_quantile(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if beta_cdf(middle, a, b) < q else (low, middle)
    return (low + high) / 2


def upper_rate(k: int, n: int, conf: float = 0.95) -> float:
    """One-sided Clopper-Pearson upper bound of a rate with k of n; 1 where nothing speaks against it."""
    return 1.0 if n <= 0 or k >= n else beta_quantile(conf, k + 1, n - k)


def rate_interval(k: int, n: int, conf: float = 0.95) -> tuple[float, float]:
    """Two-sided Clopper-Pearson interval."""
    if n <= 0:
        return 0.0, 1.0
    low = beta_quantile((1 - conf) / 2, k, n - k + 1) if k > 0 else 0.0
    return low, beta_quantile((1 + conf) / 2, k + 1, n - k) if k < n else 1.0


def normal_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def welch_p(t: float, df: float) -> float:
    """Two-sided p of a t statistic."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def _upper_rates(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([upper_rate(int(a), int(b)) for a, b in zip(k, n, strict=True)])


def _intervals(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rate_interval(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["low", "high"])


def _welch_ps(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([welch_p(a, b) if a == a and b == b else None for a, b in zip(t, df, strict=True)])


def upper_rate_udf(k: str, n: str) -> Column:
    """upper_rate of two columns of counts; few rows, as counts are aggregates."""
    return F.pandas_udf(_upper_rates, "double")(k, n)


def rate_interval_udf(k: str, n: str) -> Column:
    return F.pandas_udf(_intervals, "low double, high double")(k, n)


def welch_p_udf(t: str, df: str) -> Column:
    return F.pandas_udf(_welch_ps, "double")(t, df)
