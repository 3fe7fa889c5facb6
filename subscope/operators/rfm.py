"""Recency, frequency and monetary features per customer."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from subscope.operators.ordering import quantile_scores
from subscope.session import staged

# What a customer without transactions gets.
NO_ACTIVITY = {
    "recency": 999,
    "frequency": 0,
    "monetary": 0.0,
    "avg_data_gb": 0.0,
    "avg_minutes": 0.0,
    "r_score": 1,
    "f_score": 1,
    "m_score": 1,
    "rfm_score": 111,
}


def _mean(column: str) -> Column:
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def rfm_base(transactions: DataFrame, reference: dt.date | dt.datetime | str | None = None) -> DataFrame:
    """Raw features; recency counts full days up to ``reference`` (default: the last date).

    The result is staged, as the scores need several passes over it. ``monetary_exact``
    keeps the type of the amounts, so that decimals rank without rounding.
    """
    # times without a zone: no day of a customer is an hour short
    when = F.col("transaction_date").cast("timestamp_ntz")
    base = staged(
        transactions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.max(when).alias("last_seen"),
            F.count("transaction_id").alias("frequency"),
            F.sum("amount").alias("monetary_exact"),
            _mean("data_gb_used").alias("avg_data_gb"),
            _mean("minutes_used").alias("avg_minutes"),
        ),
        "rfm",
    )
    if reference is None:
        reference = base.agg(F.max("last_seen")).first()[0]
    seconds = F.timestamp_diff("SECOND", F.col("last_seen"), F.lit(str(reference)).cast("timestamp_ntz"))
    return base.select(
        "customer_id",
        F.floor(seconds / 86400).cast("int").alias("recency"),
        "frequency",
        F.col("monetary_exact").cast("double").alias("monetary"),
        "avg_data_gb",
        "avg_minutes",
        "monetary_exact",
    )


def rfm_scores(
    transactions: DataFrame,
    reference: dt.date | dt.datetime | str | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Features plus quintile scores; ties rank by customer id, higher is better."""
    base = rfm_base(transactions, reference).withColumn("recency_desc", -F.col("recency"))
    rows = base.count()

    def score(metric: str) -> Column:
        return quantile_scores(base, [metric, "customer_id"], rows, 5, slice_rows).cast("int")

    # three small independent look-ups, submitted side by side
    with ThreadPoolExecutor(3) as pool:
        r, f, m = pool.map(score, ["recency_desc", "frequency", "monetary_exact"])
    scored = base.withColumns({"r_score": r, "f_score": f, "m_score": m})
    return scored.withColumn(
        "rfm_score", (F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")).cast("int")
    ).drop("recency_desc", "monetary_exact")


def merge_with_customers(customers: DataFrame, rfm: DataFrame) -> DataFrame:
    """All customers with their RFM features; the inactive get fixed defaults."""
    merged = customers.join(rfm, "customer_id", "left")
    return merged.na.fill({k: v for k, v in NO_ACTIVITY.items() if k in merged.columns})
