"""Scalar column expressions shared by the reports and operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def integer_div(a: Column, b: Column) -> Column:
    """Truncating division, null when the divisor is zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("decimal(1,0)")))


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` rounded half away from zero, exactly.

    Works on integer or decimal operands, so no binary fraction can push a tie to
    the wrong side. Null when the denominator is null or zero.
    """
    num = numerator.cast("decimal(28,2)")
    den = denominator.cast("decimal(24,2)")
    scaled = F.abs(num) * F.lit(2 * 10**digits) + F.abs(den)
    steps = integer_div(scaled, F.abs(den) * F.lit(2))
    return F.signum(num) * F.signum(den) * steps / F.lit(float(10**digits))


def whole(amount: Column) -> Column:
    """Money rounded to whole units."""
    return F.round(amount, 0).cast("double")


def date_key(day: Column) -> Column:
    """Integer key YYYYMMDD."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def year_month(year: Column, month: Column) -> Column:
    return (year.cast("int") * 100 + month.cast("int")).cast("int")


def months_between_keys(later: Column, earlier: Column) -> Column:
    """Whole months between two YYYYMM keys."""
    def ordinal(key: Column) -> Column:
        return F.call_function("div", key, F.lit(100)) * 12 + key % 100

    return (ordinal(later) - ordinal(earlier)).cast("int")


def full_months(as_of: Column, start: Column) -> Column:
    """Completed months from ``start`` to ``as_of``: a month ends on the day it began, not on its last."""
    months = (F.year(as_of) - F.year(start)) * 12 + F.month(as_of) - F.month(start)
    return (months - F.when(F.dayofmonth(as_of) < F.dayofmonth(start), 1).otherwise(0)).cast("int")


# Limits of the three risk scales.
RATE_HIGH, RATE_MEDIUM = 0.25, 0.15
SCORE_HIGH, SCORE_MEDIUM = 0.7, 0.4
BIN_EDGES = (0.0, 0.3, 0.6, 1.0)


def risk_by_rate(count: Column, total: Column) -> Column:
    """HIGH / MEDIUM / LOW for a churn rate given as two counts."""
    rate = F.try_divide(count.cast("double"), total.cast("double"))
    return F.when(rate > RATE_HIGH, "HIGH").when(rate > RATE_MEDIUM, "MEDIUM").otherwise("LOW")


def risk_by_score(probability: Column) -> Column:
    """high / medium / low for one scored customer."""
    return (
        F.when(probability >= SCORE_HIGH, "high")
        .when(probability >= SCORE_MEDIUM, "medium")
        .otherwise("low")
    )


def risk_by_bins(probability: Column) -> Column:
    """Low / Medium / High for right-closed bins; null outside them, and at zero."""
    low, medium, high, top = BIN_EDGES
    return (
        F.when((probability > low) & (probability <= medium), "Low")
        .when((probability > medium) & (probability <= high), "Medium")
        .when((probability > high) & (probability <= top), "High")
    )


def drift_severity(psi: Column) -> Column:
    return F.when(psi > 0.25, "high").when(psi > 0.1, "medium").otherwise("low")


def seeded_digest(key: Column, seed: int, stream: str) -> Column:
    """Hex digest of a row key; equal on every run and under every partitioning."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(stream)))


def digest_uniform(digest: Column, part: int = 0) -> Column:
    """One of four independent uniforms in [0, 1) held in a digest."""
    word = F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("bigint")
    return word.cast("double") / F.lit(4294967296.0)


def seeded_uniform(key: Column, seed: int, stream: str) -> Column:
    return digest_uniform(seeded_digest(key, seed, stream))


def weighted_pick(u: Column, values: list, weights: list[float]) -> Column:
    """Value whose cumulative weight interval holds the uniform ``u``."""
    edge, picked = 0.0, None
    for value, weight in zip(values[:-1], weights[:-1]):
        edge = round(edge + weight, 10)
        picked = F.when(u < edge, F.lit(value)) if picked is None else picked.when(u < edge, F.lit(value))
    last = F.lit(values[-1])
    return last if picked is None else picked.otherwise(last)


def integer_pick(u: Column, low: int, high: int) -> Column:
    """Integer in [low, high)."""
    return (F.lit(low) + F.floor(u * F.lit(high - low))).cast("int")


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based histogram bin; the last bin is closed on the right."""
    width = (high - low) / F.lit(float(bins))
    raw = F.floor((value - low) / F.nullif(width, F.lit(0.0))).cast("int") + 1
    return F.least(F.coalesce(raw, F.lit(1)), F.lit(bins))
