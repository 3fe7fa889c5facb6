"""Statistics of two-group experiments.

Every test is one aggregate over the rows followed by arithmetic on a single result
row per test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from subscope.functions.tails import normal_p, normal_quantile, student_p
from subscope.operators.distribution import rank_sums

CONTROL, TREATMENT = "control", "treatment"
# Fixed value: half width of the 95 % interval in standard errors.
Z95 = 1.96


def group_means(df: DataFrame) -> DataFrame:
    return df.groupBy("group").agg(
        *[F.bround(F.avg(c), 2).alias(c) for c in ("converted", "arpu_before", "arpu_after", "arpu_delta")]
    )


def required_sample_size(baseline: Column, effect: float, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Rows per group for a two-proportion z-test to detect ``baseline + effect``."""
    z_alpha = F.lit(normal_quantile(1 - alpha / 2))
    z_power = F.lit(normal_quantile(power))
    target = baseline + effect
    middle = (baseline + target) / 2
    spread = z_alpha * F.sqrt(middle * 2 * (1 - middle)) + z_power * F.sqrt(
        baseline * (1 - baseline) + target * (1 - target)
    )
    return F.ceil(spread * spread / (effect * effect)).cast("bigint")


def _side(group: str, value: Column) -> Column:
    return F.when(F.col("group") == group, value)


def conversion_test(df: DataFrame, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Two-proportion z-test of ``converted``, over all rows or per ``by`` group."""
    hit = F.col("converted").cast("double")
    counts = df.groupBy(*(by or [])).agg(
        F.count(_side(CONTROL, hit)).alias("n_c"),
        F.count(_side(TREATMENT, hit)).alias("n_t"),
        F.sum(_side(CONTROL, hit)).alias("s_c"),
        F.sum(_side(TREATMENT, hit)).alias("s_t"),
    )
    rates = counts.withColumn("p_c", F.try_divide("s_c", "n_c")).withColumn("p_t", F.try_divide("s_t", "n_t"))
    pooled = (F.col("s_c") + F.col("s_t")) / (F.col("n_c") + F.col("n_t"))
    diff = F.col("p_t") - F.col("p_c")
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_c") + 1 / F.col("n_t")))
    margin = Z95 * F.sqrt(
        F.col("p_c") * (1 - F.col("p_c")) / F.col("n_c") + F.col("p_t") * (1 - F.col("p_t")) / F.col("n_t")
    )
    tested = (
        rates.withColumn("diff", diff)
        .withColumn("margin", margin)
        .withColumn("z", F.try_divide(diff, error))
        .withColumn("p", normal_p("z"))
    )
    return tested.select(
        *(by or []),
        F.bround("p_c", 4).alias("p_control"),
        F.bround("p_t", 4).alias("p_treatment"),
        F.bround("diff", 4).alias("abs_diff"),
        F.bround(F.try_divide("diff", "p_c"), 4).alias("relative_lift"),
        F.bround("z", 4).alias("z_statistic"),
        F.bround("p", 6).alias("p_value"),
        F.bround(F.col("diff") - F.col("margin"), 4).alias("ci_low"),
        F.bround(F.col("diff") + F.col("margin"), 4).alias("ci_high"),
        (F.col("p") < alpha).alias("significant"),
    )


def conversion_intervals(df: DataFrame) -> DataFrame:
    """Conversion rate and error bar per group, in percent."""
    rates = df.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("converted").cast("double")).alias("rate")
    )
    bar = Z95 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return rates.select("group", "n", (F.col("rate") * 100).alias("rate_pct"), (bar * 100).alias("error_pct"))


def arpu_test(
    df: DataFrame, value: str = "arpu_delta", alpha: float = 0.05, slice_rows: int | None = None
) -> DataFrame:
    """Welch t-test, Mann-Whitney test and Cohen's d of ``value``; one row.

    The t statistic is control minus treatment, the effect size treatment minus control.
    """
    v = F.col(value).cast("double")
    rows = df.where(F.col("group").isin(CONTROL, TREATMENT) & F.col(value).isNotNull()).select(
        F.lit(value).alias("test"), "group", v.alias("value")
    )
    x = F.col("value")
    moments = rows.agg(
        F.avg(_side(CONTROL, x)).alias("m_c"),
        F.avg(_side(TREATMENT, x)).alias("m_t"),
        F.var_samp(_side(CONTROL, x)).alias("v_c"),
        F.var_samp(_side(TREATMENT, x)).alias("v_t"),
    ).first()
    ranks = rank_sums(rows, "test", F.col("group") == CONTROL, slice_rows)
    a, b = F.col("v_c") / F.col("n_a"), F.col("v_t") / F.col("n_b")
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    pairs = F.col("n_a").cast("double") * F.col("n_b")
    spread = F.sqrt(pairs / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    top = F.greatest("u", pairs - F.col("u"))
    tested = (
        ranks.withColumns({c: F.lit(v).cast("double") for c, v in moments.asDict().items()})
        .withColumn("t", (F.col("m_c") - F.col("m_t")) / F.sqrt(a + b))
        .withColumn("dof", (a + b) * (a + b) / (a * a / (F.col("n_a") - 1) + b * b / (F.col("n_b") - 1)))
        .withColumn("mw_z", F.greatest((top - pairs / 2 - 0.5) / spread, F.lit(0.0)))
        .withColumn("d", (F.col("m_t") - F.col("m_c")) / F.sqrt((F.col("v_c") + F.col("v_t")) / 2))
        .withColumn("t_p", student_p("t", "dof"))
        .withColumn("mw_p", normal_p("mw_z"))
    )
    return tested.select(
        F.bround("m_c", 2).alias("control_mean_delta"),
        F.bround("m_t", 2).alias("treatment_mean_delta"),
        F.bround("t", 4).alias("t_statistic"),
        F.bround("t_p", 6).alias("t_pvalue"),
        F.col("u").alias("mw_statistic"),
        F.bround("mw_p", 6).alias("mw_pvalue"),
        F.bround("d", 4).alias("cohens_d"),
        (F.col("t_p") < alpha).alias("significant_ttest"),
        (F.col("mw_p") < alpha).alias("significant_mw"),
    )


def bonferroni(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Flag ``reject`` where p is below alpha divided by the number of tests.

    ``tests`` holds one row per test.
    """
    # a report of tests, not of observations
    count = F.count(F.lit(1)).over(Window.partitionBy())
    return tests.withColumn("reject", F.col(p) < F.lit(alpha) / count)
