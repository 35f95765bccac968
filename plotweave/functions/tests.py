"""Tail probabilities of test statistics: plain functions on numbers, and Arrow functions on columns of small result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_1_p(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def correlation_p(r: float, n: float) -> float:
    return 0.0 if abs(r) >= 1 else t_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def _column(f):
    def many(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*cols)], dtype="float64")

    return many


@F.pandas_udf(T.DoubleType())
def normal_p_col(z: pd.Series) -> pd.Series:
    return _column(normal_p)(z)


@F.pandas_udf(T.DoubleType())
def chi2_1_p_col(x: pd.Series) -> pd.Series:
    return _column(chi2_1_p)(x)


@F.pandas_udf(T.DoubleType())
def correlation_p_col(r: pd.Series, n: pd.Series) -> pd.Series:
    return _column(correlation_p)(r, n)
