"""Drift of numeric columns: population stability index and Kolmogorov-Smirnov."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

from subscope.functions.scalars import drift_severity
from subscope.functions.tails import kolmogorov_p
from subscope.operators.distribution import cumulative_counts, quantiles_from_counts, to_long
from subscope.session import lookup

# Share given to an empty bin, and the limits of the drift flag.
EMPTY_SHARE = 1e-6
PSI_LIMIT, KS_ALPHA = 0.2, 0.05


def shared_numeric(reference: DataFrame, current: DataFrame) -> list[str]:
    """Numeric, non-boolean columns of ``reference`` that ``current`` also has."""
    return [
        f.name
        for f in reference.schema.fields
        if isinstance(f.dataType, NumericType)
        and not isinstance(f.dataType, BooleanType)
        and f.name in current.columns
    ]


def compared_counts(
    reference: DataFrame, current: DataFrame, columns: list[str], slice_rows: int | None = None
) -> DataFrame:
    """Counts ``r`` and ``c`` per distinct value of every feature, with running sums."""
    both = to_long(reference, columns).withColumn("side", F.lit(True)).unionByName(
        to_long(current, columns).withColumn("side", F.lit(False))
    )
    counts = cumulative_counts(
        both, "feature",
        {"r": F.col("side").cast("int"), "c": (~F.col("side")).cast("int")},
        slice_rows, "drift",
    )
    # a feature without values on one side cannot be compared
    return counts.where((F.col("n_r") > 0) & (F.col("n_c") > 0))


def psi_by_feature(counts: DataFrame, bins: int = 10) -> DataFrame:
    """PSI over bins between the reference's percentiles; outer bins are open.

    Bins are closed on the left. Repeated edges leave the bins between them empty.
    """
    marks = [i / bins for i in range(1, bins)]
    # one row of bins - 1 edges per feature, used twice
    edges = lookup(
        quantiles_from_counts(counts, "feature", "r", marks)
        .groupBy("feature")
        .agg(F.sort_array(F.collect_list("quantile")).alias("edges")),
        "edges",
    )
    bin_of = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    filled = (
        counts.join(edges, "feature")
        .groupBy("feature", bin_of.alias("bin"))
        .agg((F.sum("r") / F.first("n_r")).alias("e"), (F.sum("c") / F.first("n_c")).alias("a"))
    )
    every = edges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    def share(column: str):
        return F.coalesce(F.nullif(F.col(column), F.lit(0.0)), F.lit(EMPTY_SHARE))

    shares = every.join(filled, ["feature", "bin"], "left").select(
        "feature", share("e").alias("e"), share("a").alias("a")
    )
    return shares.groupBy("feature").agg(
        F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi")
    )


def ks_by_feature(counts: DataFrame) -> DataFrame:
    """Largest distance of the two empirical distribution functions, and its p-value."""
    gap = F.abs(F.col("cum_r") / F.col("n_r") - F.col("cum_c") / F.col("n_c"))
    return (
        counts.groupBy("feature")
        .agg(F.max(gap).alias("ks_statistic"), F.first("n_r").alias("n_r"), F.first("n_c").alias("n_c"))
        .withColumn("ks_pvalue", kolmogorov_p(F.col("ks_statistic"), F.col("n_r"), F.col("n_c")))
    )


def population_stability_index(
    expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10, slice_rows: int | None = None
) -> DataFrame:
    return psi_by_feature(compared_counts(expected, actual, columns, slice_rows), bins)


def ks_test(
    expected: DataFrame, actual: DataFrame, columns: list[str], slice_rows: int | None = None
) -> DataFrame:
    return ks_by_feature(compared_counts(expected, actual, columns, slice_rows))


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    columns: list[str] | None = None,
    psi_limit: float = PSI_LIMIT,
    ks_alpha: float = KS_ALPHA,
    slice_rows: int | None = None,
) -> DataFrame:
    """One row per comparable feature, most drifted first; empty input gives no rows."""
    columns = shared_numeric(reference, current) if columns is None else columns
    if not columns:
        return reference.sparkSession.createDataFrame(
            [], "feature string, psi double, ks_statistic double, ks_pvalue double, "
                "drift_detected boolean, severity string")
    counts = compared_counts(reference, current, columns, slice_rows)
    return (
        psi_by_feature(counts)
        .join(ks_by_feature(counts), "feature")
        .select(
            "feature",
            F.bround("psi", 4).alias("psi"),
            F.bround("ks_statistic", 4).alias("ks_statistic"),
            F.bround("ks_pvalue", 4).alias("ks_pvalue"),
            ((F.col("psi") > psi_limit) | (F.col("ks_pvalue") < ks_alpha)).alias("drift_detected"),
            drift_severity(F.col("psi")).alias("severity"),
        )
        .orderBy(F.desc("psi"), "feature")
    )
