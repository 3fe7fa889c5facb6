"""Exact order statistics without ordering the data.

A first pass keeps a mergeable quantile sketch per column, whose rank error is bounded; it
brackets the values that stand at the wanted ranks. A second pass counts what lies below each
bracket and keeps the few distinct values inside, and only those are ordered. Columns stay side
by side, so no row is ever multiplied by the number of columns. The same brackets bound the
gap of two distribution functions, so that only stretches that can hold the largest gap are
looked at value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from subscope.operators.distribution import cumulative_counts
from subscope.session import lookup, staged

#: Ranks of the sketch are right within one part in so many.
ACCURACY = 4096
#: Distinct values inside brackets that one window may order.
FEW = 200_000


def numeric(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """``columns`` as doubles with NaN as null, beside the columns to ``keep``."""
    def clean(name: str) -> Column:
        value = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(value), value)

    return df.select(*(keep or []), *[clean(c).alias(c) for c in columns])


def quantiles(wide: DataFrame, columns: list[str], probabilities: list[float], by: str | None = None) -> DataFrame:
    """(by,) feature, p, quantile: exact, with linear interpolation between order statistics.

    ``wide`` holds the columns as ``numeric`` makes them and is staged, as it is read three
    times. A column without values has no quantiles. ``by`` names a column of classes.
    """
    keys = [by] if by else []
    step = 2.0 / ACCURACY
    marks = sorted({min(1.0, max(0.0, p + s)) for p in probabilities for s in (-step, step)})
    at = {p: (marks.index(min(1.0, max(0.0, p - step))), marks.index(min(1.0, max(0.0, p + step)))) for p in probabilities}
    sketched = wide.groupBy(*keys).agg(*[
        F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.percentile_approx(F.col(f"`{c}`"), marks, ACCURACY).alias("s")).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    # one row per class and rank: where the ranks lie, and between which values; a bracket
    # is wider than the sketch's error by two ranks at least, and few values are all kept
    def bracket(i: int, name: str, p: float) -> Column:
        position, s = F.lit(float(p)) * (F.col(f"_{i}.n") - 1), F.col(f"_{i}.s")
        few = F.col(f"_{i}.n") <= 2 * ACCURACY
        low, high = F.lit(float("-inf")), F.lit(float("inf"))
        return F.struct(
            F.lit(name).alias("feature"), F.lit(float(p)).alias("p"), F.col(f"_{i}.n").alias("n"),
            F.floor(position).alias("low"), F.ceil(position).alias("high"), (position - F.floor(position)).alias("part"),
            # the ends of the data are brackets of their own
            (low if p - step <= 0 else F.when(few, low).otherwise(F.get(s, F.lit(at[p][0])))).alias("least"),
            (high if p + step >= 1 else F.when(few, high).otherwise(F.get(s, F.lit(at[p][1])))).alias("most"),
        )

    every = [bracket(i, c, p) for i, c in enumerate(columns) for p in probabilities]
    brackets = lookup(sketched.select(*keys, F.inline(F.array(*every))).where("n > 0"), "brackets")

    # a value below a bracket only counts, one inside is kept
    def told(feature: Column, p: Column, value: Column, least: Column, most: Column) -> Column:
        near = F.when(value >= least, value)
        return F.when(value <= most, F.struct(feature.alias("feature"), p.alias("p"), near.alias("value")))

    if by:
        listed = brackets.groupBy(by).agg(F.collect_list(F.struct("feature", "p", "least", "most")).alias("_brackets"))
        values = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))])
        shared = wide.select(by, values.alias("_values")).join(lookup(listed, "listed"), by)
        marked = F.transform("_brackets", lambda b: told(b["feature"], b["p"], F.element_at("_values", b["feature"]), b["least"], b["most"]))
    else:
        shared, known = wide, brackets.collect()  # one row per column and rank
        if not known:
            return brackets.select("feature", "p", F.lit(None).cast("double").alias("quantile"))
        marked = F.array(*[
            told(F.lit(r["feature"]), F.lit(r["p"]), F.col(f"`{r['feature']}`"), F.lit(r["least"]), F.lit(r["most"])) for r in known
        ])
    near = F.array_compact(marked)
    counted = staged(
        shared.select(*keys, F.inline(near)).groupBy(*keys, "feature", "p", "value").agg(F.count(F.lit(1)).alias("c")), "counted"
    )
    group = [*keys, "feature", "p"]
    if counted.count() <= FEW:
        upto = Window.partitionBy(*group).orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ordered = counted.withColumn("cum_c", F.sum("c").over(upto))
    else:
        name = F.to_json(F.struct(*group))
        below = counted.where("value is null").select(*group, F.col("c").alias("_below"))
        inside = cumulative_counts(
            counted.where("value is not null").withColumn("_group", name), "_group", {"c": F.col("c")}, label="brackets"
        ).drop("n_c")
        known = counted.select(*group).distinct().withColumn("_group", name).join(below, group, "left")
        ordered = inside.join(known, "_group").withColumn("cum_c", F.col("cum_c") + F.coalesce("_below", F.lit(0)))
    first = F.col("cum_c") - F.col("c")
    held = lambda k: (first <= F.col(k)) & (F.col(k) < F.col("cum_c"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"b.{k}")) for k in group]
    hits = ordered.alias("o").join(brackets.alias("b"), same).where(F.col("o.value").isNotNull() & (held("low") | held("high")))
    ends = hits.groupBy(*[F.col(f"b.{k}") for k in group]).agg(
        F.first("part").alias("part"), F.max(F.when(held("low"), F.col("value"))).alias("a"), F.max(F.when(held("high"), F.col("value"))).alias("b")
    )
    return ends.select(*group, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))
