"""Descriptive statistics of the enriched customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from subscope.functions.scalars import equal_width_bin
from subscope.operators.brackets import numeric, quantiles
from subscope.session import lookup, staged

# Columns of the correlation heat map.
CORRELATED = [
    "age", "tenure_months", "has_internet", "has_tv", "has_roaming",
    "recency", "frequency", "monetary", "churn",
]


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per numeric column that has values."""
    wide = staged(numeric(df, columns), "describe")
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = wide.agg(*[f(F.col(f"`{c}`")).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in measures.items()])
    moments = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{name}_{i}").alias(name) for name in measures]) for i, c in enumerate(columns)
    ]))).where("count > 0")
    quartiles = (
        quantiles(wide, columns, [0.25, 0.5, 0.75])
        .groupBy("feature")
        .pivot("p", [0.25, 0.5, 0.75])
        .agg(F.first("quantile"))
        .toDF("feature", "q25", "q50", "q75")
    )
    return moments.join(quartiles, "feature")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every unordered pair of columns, in a single pass."""
    pairs = [(columns[i], columns[j]) for i in range(len(columns)) for j in range(i)]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{n}")
                    for n, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                               F.col(f"c{n}").alias("correlation"))
                      for n, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(cells))


def histogram(df: DataFrame, value: str, by: str, bins: int) -> DataFrame:
    """Counts in equal-width bins over each class's own range."""
    rows = staged(
        df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(
            by, F.col(value).cast("double").alias("v")
        ),
        "histogram",
    )
    limits = lookup(rows.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "limits")
    return (
        rows.join(limits, by)
        .groupBy(by, equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 times the quartile range, and outlier count per class."""
    known = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, F.col(value).alias("value"))
    rows = staged(numeric(known, ["value"], [by]), "box")
    marks = [0.0, 0.25, 0.5, 0.75, 1.0]
    five = (
        quantiles(rows, ["value"], marks, by)
        .groupBy(by)
        .pivot("p", marks)
        .agg(F.first("quantile"))
        .toDF(by, "min", "q1", "median", "q3", "max")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.join(lookup(five, "five"), by)
        .groupBy(by, "min", "q1", "median", "q3", "max")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def summary(enriched: DataFrame, transactions: DataFrame, monthly_contract: str = "monthly") -> DataFrame:
    """Sizes and headline means of the data set."""
    people = enriched.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("churn").alias("churn_rate"),
        F.avg("tenure_months").alias("avg_tenure"),
        (F.avg("monetary") / 12).alias("avg_monthly_spend"),
        F.avg((F.col("contract_type") == monthly_contract).cast("int")).alias("monthly_share"),
    )
    return people.withColumn("transactions", transactions.agg(F.count(F.lit(1))).scalar())
