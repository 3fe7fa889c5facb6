"""Aggregates behind the overview, segment and churn boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from subscope.functions.scalars import risk_by_bins


def revenue_by_month(transactions: DataFrame) -> DataFrame:
    """Revenue per calendar month of the transaction date."""
    month = F.trunc("transaction_date", "month")
    return (
        transactions.where(F.col("transaction_date").isNotNull())
        .groupBy(month.alias("month"))
        .agg(F.sum("amount").cast("double").alias("revenue"))
        .orderBy("month")
    )


def overview(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Customer count, churn rate, mean monthly revenue and ARPU over all customers."""
    people = customers.agg(F.count(F.lit(1)).alias("customers"), F.avg("churn").alias("churn_rate"))
    revenue = revenue_by_month(transactions).agg(F.avg("revenue")).scalar()
    return people.withColumn("avg_monthly_revenue", revenue).withColumn(
        "arpu", F.col("avg_monthly_revenue") / F.greatest("customers", F.lit(1))
    )


def rate_by(customers: DataFrame, column: str, label: str = "churn") -> DataFrame:
    """Mean of a 0/1 label per category, highest first; null categories are dropped."""
    return (
        customers.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.avg(label).alias("churn_rate"))
        .orderBy(F.desc("churn_rate"), column)
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are dropped."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )


def churn_board(scored: DataFrame) -> DataFrame:
    """Counts of high and medium risk, mean probability and actual churn rate."""
    level = risk_by_bins(F.col("churn_probability"))
    return scored.agg(
        F.count_if(level == "High").alias("high_risk"),
        F.count_if(level == "Medium").alias("medium_risk"),
        F.avg("churn_probability").alias("avg_probability"),
        F.avg("churn").alias("actual_churn"),
    )


def high_risk(scored: DataFrame, threshold: float = 0.6, limit: int = 100) -> DataFrame:
    """The ``limit`` customers with the highest probability at or above ``threshold``."""
    return (
        scored.where(F.col("churn_probability") >= threshold)
        .orderBy(F.desc("churn_probability"), "customer_id")
        .limit(limit)
        .select(
            "customer_id",
            "churn_probability",
            risk_by_bins(F.col("churn_probability")).alias("risk_level"),
            "tenure_months",
            "contract_type",
            "city",
        )
    )


def explore_segment(customers: DataFrame, segment: str, limit: int = 50) -> DataFrame:
    """The first customers of one segment, by id."""
    return (
        customers.where(F.col("segment_name") == segment)
        .orderBy("customer_id")
        .limit(limit)
        .select("customer_id", "age", "city", "tenure_months", "contract_type", "churn")
    )


def segment_board(enriched: DataFrame, segment: str = "segment_name") -> DataFrame:
    """Rounded means of the RFM features and the size of every segment."""
    def mean(column: str) -> Column:
        return F.bround(F.avg(column), 1)

    return (
        enriched.where(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(
            mean("monetary").alias("avg_monetary"),
            mean("recency").alias("avg_recency"),
            mean("frequency").alias("avg_frequency"),
            mean("tenure_months").alias("avg_tenure"),
            F.count(F.lit(1)).alias("count"),
        )
    )
