"""Exact order statistics from distinct values and their running counts.

Quantiles, distribution distances and rank tests all need the data in order. Here the
rows are first reduced to (group, value, counts), which combines on the map side, and
only the distinct values are ordered, in slices that may begin or end inside a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from subscope.operators.ordering import global_order
from subscope.session import lookup, staged


def to_long(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(feature, value) rows of the numeric ``columns``; nulls and NaN are dropped."""
    wide = df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(keep or [], columns, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def cumulative_counts(
    rows: DataFrame,
    group: str,
    counters: dict[str, Column],
    slice_rows: int | None = None,
    label: str = "values",
) -> DataFrame:
    """Counts per distinct (group, value) with inclusive running sums ``cum_<name>``.

    ``counters`` are integer expressions summed per value; the result is staged.
    """
    counts = rows.groupBy(group, "value").agg(
        *[F.sum(expr).cast("bigint").alias(name) for name, expr in counters.items()]
    )
    ordered = global_order(
        counts, [group, "value"], rank=None,
        running={f"cum_{name}": name for name in counters}, slice_rows=slice_rows, label=label,
    ).frame
    ordered = staged(ordered, label)
    # running sums never fall, so the smallest value before a row of the group is its start
    base = lookup(
        ordered.groupBy(group).agg(
            *[F.min(F.col(f"cum_{n}") - F.col(n)).alias(f"_base_{n}") for n in counters],
            *[F.sum(n).alias(f"n_{n}") for n in counters],
        ),
        f"{label}-groups",
    )
    out = ordered.join(base, group)
    for name in counters:
        out = out.withColumn(f"cum_{name}", F.col(f"cum_{name}") - F.col(f"_base_{name}"))
    return out.drop(*[f"_base_{n}" for n in counters])


def quantiles_from_counts(counts: DataFrame, group: str, counter: str, probabilities: list[float]) -> DataFrame:
    """(group, p, quantile) with linear interpolation between order statistics."""
    totals = counts.select(group, F.col(f"n_{counter}").alias("n")).distinct().where("n > 0")
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities]))
    position = F.col("p") * (F.col("n") - 1)
    wanted = lookup(
        totals.select(group, "n", p.alias("p")).select(
            group, "p",
            F.floor(position).alias("low"), F.ceil(position).alias("high"),
            (position - F.floor(position)).alias("part"),
        ),
        "ranks",
    )
    first = F.col(f"cum_{counter}") - F.col(counter)
    held = lambda k: (first <= F.col(k)) & (F.col(k) < F.col(f"cum_{counter}"))
    hits = counts.where(F.col(counter) > 0).join(wanted, group).where(held("low") | held("high"))
    ends = hits.groupBy(group, "p").agg(
        F.first("part").alias("part"),
        F.max(F.when(held("low"), F.col("value"))).alias("a"),
        F.max(F.when(held("high"), F.col("value"))).alias("b"),
    )
    return ends.select(
        group, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile")
    )


def exact_quantiles(
    rows: DataFrame, group: str, probabilities: list[float], slice_rows: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group."""
    counts = cumulative_counts(rows, group, {"c": F.lit(1)}, slice_rows, "quantile")
    return quantiles_from_counts(counts, group, "c", probabilities)


def pair_wins() -> Column:
    """Pairs in which a row of ``a`` exceeds one of ``b``, ties as one half, per value."""
    return F.col("a") * (F.col("cum_b") - F.col("b") + F.col("b") / F.lit(2.0))


def rank_sums(rows: DataFrame, group: str, first: Column, slice_rows: int | None = None) -> DataFrame:
    """Two-sample rank statistics of ``value`` per group.

    ``first`` marks the rows of sample 1. ``u`` counts, over all pairs, how often sample
    1 exceeds sample 2, ties as one half; ``ties`` is the sum of t^3 - t.
    """
    counts = cumulative_counts(
        rows, group, {"a": first.cast("int"), "b": (~first).cast("int")}, slice_rows, "ranks"
    )
    t = (F.col("a") + F.col("b")).cast("double")
    return counts.groupBy(group).agg(
        F.max("n_a").alias("n_a"),
        F.max("n_b").alias("n_b"),
        F.sum(pair_wins()).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
    )
