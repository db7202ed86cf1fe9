"""Tail probabilities for one row per test; the statistics themselves come from aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def gamma_tail(s: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - s
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        b += 2
        d = 1 / (-i * (i - s) * d + b)
        c = b - i * (i - s) / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _p_of_r(r, n):
    if r is None or math.isnan(r) or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else beta_tail((n - 2) / 2, 0.5, 1 - r * r)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation coefficient over ``n`` pairs."""
    return pd.Series([_p_of_r(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([gamma_tail(k / 2, v / 2) for v, k in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal statistic."""
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype="float64")
