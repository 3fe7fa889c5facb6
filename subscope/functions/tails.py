"""Tail probabilities of the test statistics.

They are applied to finished statistics, one value per test or feature, never to
input rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from subscope.session import ship


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_p(z: str) -> Column:
    """Two-sided normal p-value of finished z statistics."""
    ship(SparkSession.active())

    @F.pandas_udf(DoubleType())
    def p_value(values: pd.Series) -> pd.Series:
        return values.map(normal_two_sided, na_action="ignore")

    return p_value(z)


def student_p(t: str, df: str) -> Column:
    """Two-sided Student p-value of finished t statistics."""
    ship(SparkSession.active())

    @F.pandas_udf(DoubleType())
    def p_value(values: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(a) or pd.isna(b) else student_two_sided(a, b) for a, b in zip(values, freedom)],
            dtype="float64",
        )

    return p_value(t, df)


def kolmogorov_p(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    a, b = n1.cast("double"), n2.cast("double")
    root = F.sqrt(a * b / (a + b))
    lam = (root + 0.12 + F.lit(0.11) / root) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, j: total
        + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    # the alternating series is slow where the probability is one anyway
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.least(series * 2, F.lit(1.0)), F.lit(0.0)))
