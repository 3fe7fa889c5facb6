"""The seven analytical reports over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from subscope.functions.scalars import (
    full_months,
    months_between_keys,
    ratio,
    risk_by_rate,
    whole,
    year_month,
)
from subscope.operators.ordering import global_order, neighbour, ntile_of


def _dated(fact: DataFrame, dim_date: DataFrame, *columns: str) -> DataFrame:
    # the calendar holds one row per day of a fixed range
    return fact.join(F.broadcast(dim_date.select("date_sk", *columns)), "date_sk")


def spend_by_customer(fact: DataFrame) -> DataFrame:
    """Spend and row count per customer; everything downstream joins this, not the fact."""
    return fact.groupBy("customer_sk").agg(
        F.sum("amount").alias("total_spend"), F.count(F.lit(1)).alias("months_active")
    )


def monthly_revenue(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Revenue, active customers, month-over-month growth and ARPU per month."""
    months = (
        _dated(fact, dim_date, "year", "month", "month_name")
        .groupBy("year", "month", "month_name")
        .agg(F.sum("amount").alias("revenue"), F.countDistinct("customer_sk").alias("active_customers"))
    )
    # one row per calendar month by now, so a single ordered window is bounded
    before = F.lag("revenue").over(Window.orderBy("year", "month"))
    return months.withColumn("prev", before).select(
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        "month_name",
        whole(F.col("revenue")).alias("revenue"),
        "active_customers",
        ratio((F.col("revenue") - F.col("prev")) * 100, F.col("prev"), 2).alias("mom_growth_pct"),
        ratio(F.col("revenue"), F.col("active_customers"), 2).alias("arpu"),
    ).orderBy("year", "month")


def value_tiers(fact: DataFrame, dim_customer: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Spend quartile and cumulative share per customer, by spend descending."""
    spend = spend_by_customer(fact).join(
        dim_customer.select("customer_sk", "customer_id", "city", "contract_type", "segment_name"),
        "customer_sk",
    ).withColumn("spend_desc", -F.col("total_spend"))
    ordered = global_order(
        spend, ["spend_desc", "customer_id"], running={"running_spend": "total_spend"},
        slice_rows=slice_rows, label="spend",
    )
    total = F.lit(ordered.totals["running_spend"])
    return ordered.frame.select(
        "customer_id",
        "city",
        "contract_type",
        "segment_name",
        whole(F.col("total_spend")).alias("total_spend"),
        "months_active",
        ntile_of(F.col("rn"), ordered.rows, 4).alias("spend_quartile"),
        ratio(F.col("running_spend") * 100, total, 2).alias("cumulative_pct"),
        "rn",
    ).orderBy("rn").drop("rn")


def top_customers_per_city(fact: DataFrame, dim_customer: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` customers by spend in every city.

    Spark keeps only the first ``top`` rows per city in each map task (window group
    limit), so a city with a third of the customers shuffles a handful of rows.
    """
    spend = spend_by_customer(fact).join(
        dim_customer.select("customer_sk", "customer_id", "city"), "customer_sk"
    )
    place = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("total_spend"), "customer_id"))
    return (
        spend.withColumn("rn", place)
        .where(F.col("rn") <= top)
        .orderBy("city", "rn")
        .select("city", "customer_id", whole(F.col("total_spend")).alias("total_spend"))
    )


def tariff_changes(
    fact: DataFrame,
    dim_customer: DataFrame,
    dim_tariff: DataFrame,
    dim_date: DataFrame,
    floor: int | None = None,
) -> DataFrame:
    """Every change of tariff of a customer, as upgrade, downgrade or lateral move."""
    history = neighbour(
        _dated(fact, dim_date, "full_date")
        .select("customer_sk", "transaction_id", "full_date", "tariff_sk"),
        "customer_sk", ["full_date", "transaction_id"], ["tariff_sk"], floor=floor,
    ).select("customer_sk", "full_date", "tariff_sk", F.col("_near.tariff_sk").alias("prev_sk"))
    changed = history.where(F.col("prev_sk").isNotNull() & (F.col("prev_sk") != F.col("tariff_sk")))

    def tariff(prefix: str, key: str) -> DataFrame:
        return dim_tariff.select(
            F.col("tariff_sk").alias(key),
            F.col("tariff_id").alias(f"{prefix}_tariff"),
            F.col("monthly_price").alias(f"{prefix}_amount"),
        )

    now, then = F.col("to_amount"), F.col("from_amount")
    return (
        changed.join(tariff("from", "prev_sk"), "prev_sk")
        .join(tariff("to", "tariff_sk"), "tariff_sk")
        .join(dim_customer.select("customer_sk", "customer_id"), "customer_sk")
        .select(
            "customer_id",
            F.col("full_date").alias("change_date"),
            "from_tariff",
            "to_tariff",
            whole(then).alias("from_price"),
            whole(now).alias("to_price"),
            F.when(now > then, "upgrade").when(now < then, "downgrade").otherwise("lateral").alias(
                "change_type"
            ),
        )
        .orderBy("customer_id", "change_date")
    )


def cohort_retention(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Share of each first-month cohort that is active in every later month.

    The fact is first reduced to distinct (customer, month) pairs, which bounds every
    customer by the length of the calendar; the cohort then needs no self join.
    """
    active = (
        _dated(fact, dim_date, "year", "month")
        .select("customer_sk", year_month(F.col("year"), F.col("month")).alias("activity_ym"))
        .distinct()
    )
    cohort = active.withColumn(
        "cohort_ym", F.min("activity_ym").over(Window.partitionBy("customer_sk"))
    )
    period = months_between_keys(F.col("activity_ym"), F.col("cohort_ym"))
    retained = cohort.groupBy("cohort_ym", period.alias("period_num")).agg(
        F.count(F.lit(1)).alias("retained")
    )
    # every member is active in period 0, so that row carries the cohort size
    size = F.max(F.when(F.col("period_num") == 0, F.col("retained"))).over(Window.partitionBy("cohort_ym"))
    return (
        retained.withColumn("cohort_size", size)
        .select(
            "cohort_ym",
            "cohort_size",
            "period_num",
            "retained",
            ratio(F.col("retained") * 100, F.col("cohort_size"), 1).alias("retention_pct"),
        )
        .orderBy("cohort_ym", "period_num")
    )


def _customer_history(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    return (
        _dated(fact, dim_date, "full_date")
        .groupBy("customer_sk")
        .agg(
            F.sum("amount").alias("spend"),
            F.count(F.lit(1)).alias("n_tx"),
            F.min("full_date").alias("first_date"),
        )
    )


def _segment_report(stats: DataFrame) -> DataFrame:
    rate = F.try_divide(F.col("churned").cast("double"), F.col("n_customers").cast("double"))
    # one row per segment by now
    place = F.rank().over(Window.orderBy(rate.desc_nulls_first()))
    return stats.select(
        "segment_name",
        "n_customers",
        "churned",
        ratio(F.col("churned") * 100, F.col("n_customers"), 1).alias("churn_rate_pct"),
        "avg_monthly_spend",
        "avg_tenure_months",
        place.alias("churn_risk_rank"),
        risk_by_rate(F.col("churned"), F.col("n_customers")).alias("risk_level"),
    ).orderBy("churn_risk_rank", "segment_name")


def churn_by_segment(fact: DataFrame, dim_customer: DataFrame, dim_date: DataFrame, as_of: str) -> DataFrame:
    """Churn rate, spend and tenure per segment, one row per customer."""
    months = full_months(F.lit(as_of).cast("date"), F.col("first_date"))
    stats = (
        _customer_history(fact, dim_date)
        .join(dim_customer.select("customer_sk", "segment_name", "churn_flag"), "customer_sk")
        .groupBy("segment_name")
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            F.count_if("churn_flag").alias("churned"),
            ratio(F.sum("spend"), F.sum("n_tx"), 2).alias("avg_monthly_spend"),
            ratio(F.sum(months), F.count(F.lit(1)), 1).alias("avg_tenure_months"),
        )
    )
    return _segment_report(stats)


def churn_by_segment_per_transaction(
    fact: DataFrame, dim_customer: DataFrame, dim_date: DataFrame, as_of: str
) -> DataFrame:
    """As ``churn_by_segment``, weighting churn and tenure by transactions.

    This is the arithmetic of the original report: churned customers count once per
    transaction (the rate may pass 100 %) and tenure is only the month part, 0 to 11,
    of the age. Computed from per-customer totals, without a fan-out.
    """
    months = full_months(F.lit(as_of).cast("date"), F.col("first_date")) % 12
    stats = (
        _customer_history(fact, dim_date)
        .join(dim_customer.select("customer_sk", "segment_name", "churn_flag"), "customer_sk")
        .groupBy("segment_name")
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            F.sum(F.when(F.col("churn_flag"), F.col("n_tx")).otherwise(0)).alias("churned"),
            ratio(F.sum("spend"), F.sum("n_tx"), 2).alias("avg_monthly_spend"),
            ratio(F.sum(months * F.col("n_tx")), F.sum("n_tx"), 1).alias("avg_tenure_months"),
        )
    )
    return _segment_report(stats)


def days_to_next(
    fact: DataFrame, dim_customer: DataFrame, dim_date: DataFrame, floor: int | None = None
) -> DataFrame:
    """Days from every transaction to the customer's next one."""
    timeline = neighbour(
        _dated(fact, dim_date, "full_date").select("customer_sk", "transaction_id", "full_date", "amount"),
        "customer_sk", ["full_date", "transaction_id"], ["full_date"], direction="next", floor=floor,
    )
    following: Column = F.col("_near.full_date")
    return (
        timeline.join(dim_customer.select("customer_sk", "customer_id"), "customer_sk")
        .select(
            "customer_id",
            F.col("full_date").alias("tx_date"),
            whole(F.col("amount")).alias("amount"),
            following.alias("next_tx_date"),
            F.datediff(following, F.col("full_date")).alias("days_to_next"),
        )
        .orderBy("customer_id", "tx_date")
    )
