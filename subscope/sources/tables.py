"""The analytics tables derived from the order-processing tables of a data folder.

Each function returns a lazy DataFrame, so a report reads only the columns it uses:
the usage totals, for example, are joined in from the order lines only when a
report selects them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subscope.functions.scalars import date_key

AS_OF = "2001-08-01"
CHURN_CUTOFF = "2000-09-01"
DRIFT_CUTOFF = "1998-06-01"
EXPERIMENT_START = "1999-01-01"
REFERENCE_END = "2024-01-11"

MONEY = "decimal(12,2)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("transaction_id"))
        .agg(
            F.sum(F.col("l_quantity").cast(MONEY)).alias("data_gb_used"),
            F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).alias("minutes_used"),
        )
    )


def fact_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with measures and the keys of the dimensions."""
    day = F.to_date("o_orderdate")
    base = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_sk"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("tariff_sk"),
        date_key(day).alias("date_sk"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        day.alias("transaction_date"),
    )
    return base.join(usage(spark, folder), "transaction_id", "left")


def places(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("city_sk"),
            F.col("n_name").alias("city_name"),
            F.col("r_name").alias("region"),
        )
    )


def dim_customer(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    spans = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    )
    months_open = (2001 * 12 + 8) - (F.year("first_order") * 12 + F.month("first_order"))
    return (
        table(spark, folder, "customer")
        .join(places(spark, folder), F.col("c_nationkey") == F.col("city_sk"))
        .join(spans, "c_custkey", "left")
        .select(
            key.alias("customer_sk"),
            F.col("c_name").alias("customer_id"),
            (18 + key % 57).cast("int").alias("age"),
            F.when(key % 2 == 0, "M").otherwise("F").alias("gender"),
            F.col("city_name").alias("city"),
            F.col("region").alias("segment_name"),
            F.col("c_mktsegment").alias("contract_type"),
            F.when(key % 4 == 0, "card")
            .when(key % 4 == 1, "bank-transfer")
            .when(key % 4 == 2, "cash")
            .otherwise("e-wallet")
            .alias("payment_method"),
            (key % 7 != 0).alias("paperless"),
            (F.col("c_acctbal") >= 0).alias("has_internet"),
            (key % 3 == 0).alias("has_tv"),
            (key % 5 == 0).alias("has_roaming"),
            F.coalesce(months_open, F.lit(0)).cast("int").alias("tenure_months"),
            F.coalesce(F.col("last_order") < F.lit(CHURN_CUTOFF).cast("timestamp_ntz"), F.lit(True)).alias(
                "churn_flag"
            ),
        )
    )


#: Days on which the customer dimension with history is loaded.
LOADS = ("1997-01-01", "1998-07-01", "2000-01-01", AS_OF)
CUSTOMER_STATE = ["city", "contract_type", "tariff_id", "active"]


def customer_state(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """Customers who ordered before ``day``: their city, contract, last plan, and whether they ordered in the year before."""
    at = F.lit(day).cast("timestamp_ntz")
    last = F.max(F.struct("o_orderdate", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("plan"))).alias("last")
    orders = table(spark, folder, "orders").where(F.col("o_orderdate") < at).groupBy("o_custkey").agg(last)
    return (
        orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places(spark, folder), F.col("c_nationkey") == F.col("city_sk"))
        .select(
            F.col("c_name").alias("customer_id"), F.col("city_name").alias("city"), F.col("c_mktsegment").alias("contract_type"),
            F.concat(F.lit("T0"), F.col("last.plan")).alias("tariff_id"),
            (F.col("last.o_orderdate") >= at - F.expr("interval 365 days")).alias("active"),
        )
    )


def dim_tariff(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT CAST(sk AS INT) AS tariff_sk, id AS tariff_id, name AS tariff_name, category,
               CAST(price AS DECIMAL(10,2)) AS monthly_price,
               CAST(gb AS SMALLINT) AS data_gb, CAST(mins AS SMALLINT) AS minutes
        FROM VALUES (1, 'T01', 'Pro Business', 'pro', 12000, 200, 5000),
                    (2, 'T02', 'Pro Family', 'pro', 8500, 100, 3000),
                    (3, 'T03', 'Smart 500', 'smart', 4000, 25, 500),
                    (4, 'T04', 'Basic 200', 'basic', 2500, 10, 200),
                    (5, 'T05', 'Basic 100', 'basic', 1500, 5, 100)
               AS t(sk, id, name, category, price, gb, mins)
        """
    )


def subscribers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in the layout of the raw customer file (flags as 0/1, label ``churn``)."""
    c = dim_customer(spark, folder)
    favourite = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("customer_sk"))
        .agg(F.max_by(F.substring("o_orderpriority", 1, 1), F.struct("o_orderdate", "o_orderkey")).alias("t"))
    )
    return c.join(favourite, "customer_sk", "left").select(
        F.col("customer_sk").alias("customer_id"),
        "age",
        "gender",
        "city",
        "tenure_months",
        F.concat(F.lit("T0"), F.coalesce("t", F.lit("1"))).alias("tariff_id"),
        "contract_type",
        "payment_method",
        F.col("paperless").cast("int").alias("paperless_billing"),
        F.col("has_internet").cast("int").alias("has_internet"),
        F.col("has_tv").cast("int").alias("has_tv"),
        F.col("has_roaming").cast("int").alias("has_roaming"),
        F.col("churn_flag").cast("int").alias("churn"),
        "segment_name",
    )


def transactions(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """Transactions in the layout of the raw transaction file."""
    fact = fact_transactions(spark, folder)
    if since:
        fact = fact.where(F.col("transaction_date") >= F.lit(since).cast("date"))
    return fact.select(
        "transaction_id",
        F.col("customer_sk").alias("customer_id"),
        "transaction_date",
        "amount",
        "data_gb_used",
        "minutes_used",
        F.concat(F.lit("T0"), F.col("tariff_sk").cast("string")).alias("tariff_id"),
    )


def raw_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers under the textual ids of the raw files."""
    return subscribers(spark, folder).withColumn(
        "customer_id", F.format_string("C%06d", F.col("customer_id") + 1)
    )


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return transactions(spark, folder).withColumns(
        {
            "customer_id": F.format_string("C%06d", F.col("customer_id") + 1),
            "transaction_id": F.format_string("TX%09d", F.col("transaction_id")),
        }
    )


def raw_tariffs(spark: SparkSession) -> DataFrame:
    return dim_tariff(spark).select(
        "tariff_id", F.col("tariff_name").alias("name"), "monthly_price", "data_gb", "minutes", "category"
    )


def scoring_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Churn scoring requests, some of them out of range or incomplete."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("request_id"),
        (key % 120).cast("int").alias("age"),
        F.when(key % 11 != 0, F.when(key % 2 == 0, "M").otherwise("F")).alias("gender"),
        F.lit("Astana").alias("city"),
        (key % 90 - 2).cast("int").alias("tenure_months"),
        F.concat(F.lit("T0"), (key % 5 + 1).cast("string")).alias("tariff_id"),
        F.col("c_mktsegment").alias("contract_type"),
        F.when(key % 4 == 0, "card").otherwise("cash").alias("payment_method"),
        (key % 3).cast("int").alias("paperless_billing"),
        F.when(key % 13 != 0, (key % 2).cast("int")).alias("has_internet"),
        (key % 2).cast("int").alias("has_tv"),
        F.lit(0).alias("has_roaming"),
        F.when(key % 4 != 0, (key % 365).cast("double")).alias("recency"),
        F.when(key % 6 != 0, F.col("c_acctbal") + 1000).alias("monetary"),
    )


def segment_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per customer with some fields left out."""
    key = F.col("c_custkey")
    def given(every: int, value) -> Column:
        return F.when(key % every != 0, value.cast("double"))

    return table(spark, folder, "customer").select(
        key.alias("request_id"), given(13, key % 300).alias("recency"), given(17, key % 40).alias("frequency"),
        given(19, F.col("c_acctbal")).alias("monetary"), given(23, key % 84).alias("tenure_months"), (key % 50).cast("double").alias("avg_data_gb"),
    )


def raw_plans(spark: SparkSession, folder: str) -> DataFrame:
    """The brands as rows of a plan file, data volumes in whole units."""
    return brand_catalog(spark, folder).select(
        "tariff_id", "name", F.col("monthly_price").cast("decimal(10,2)").alias("monthly_price"),
        F.floor("data_gb").cast("int").alias("data_gb"), "minutes", "category",
    )


def brand_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Recommender catalog: one plan per brand."""
    per_brand = table(spark, folder, "part").groupBy("p_brand").agg(
        F.sum(F.col("p_retailprice").cast(MONEY)).alias("price"),
        F.sum("p_size").alias("size"),
        F.count(F.lit(1)).alias("n"),
    )
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return per_brand.select(
        F.col("p_brand").alias("tariff_id"),
        F.concat(F.lit("Plan "), number.cast("string")).alias("name"),
        F.round(F.col("price").cast("double") / F.col("n"), 2).alias("monthly_price"),
        F.round(F.col("size").cast("double") / F.col("n"), 2).alias("data_gb"),
        F.col("n").cast("int").alias("minutes"),
        F.concat(F.lit("G"), (number % 5).cast("string")).alias("category"),
    )


def brand_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Recommender interactions: one row per order line with its brand."""
    return (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_partkey", "l_extendedprice")
        .join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part").select("p_partkey", "p_brand"),
              F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("p_brand").alias("tariff_id"),
            F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"),
        )
    )


def experiment(spark: SparkSession, folder: str) -> DataFrame:
    """A/B frame: two groups of customers, spend per month before and after a date."""
    start = F.lit(EXPERIMENT_START).cast("timestamp_ntz")
    after = F.col("o_orderdate") >= start
    amount = F.col("o_totalprice").cast(MONEY)
    spend = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.when(~after, amount)).alias("before"),
        F.sum(F.when(after, amount)).alias("after"),
        F.max(F.when(after & (F.col("o_orderpriority") == "1-URGENT"), 1).otherwise(0)).alias("urgent"),
    )
    def monthly(column: str, months: int):
        return F.coalesce(F.col(column).cast("double"), F.lit(0.0)) / months

    return (
        table(spark, folder, "customer")
        .select("c_custkey")
        .join(spend, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.when(F.col("c_custkey") % 2 == 0, "control").otherwise("treatment").alias("group"),
            F.coalesce("urgent", F.lit(0)).alias("converted"),
            monthly("before", 48).alias("arpu_before"),
            monthly("after", 31).alias("arpu_after"),
            (monthly("after", 31) - monthly("before", 48)).alias("arpu_delta"),
        )
    )


def drift_sides(spark: SparkSession, folder: str, shift: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Order lines shipped before, and from, the drift cut-off."""
    lines = table(spark, folder, "lineitem").select(
        "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    cut = F.lit(DRIFT_CUTOFF).cast("timestamp_ntz")
    reference = lines.where(F.col("l_shipdate") < cut).drop("l_shipdate")
    current = (
        lines.where(F.col("l_shipdate") >= cut)
        .drop("l_shipdate")
        .withColumn("l_extendedprice", F.col("l_extendedprice") * F.lit(shift))
    )
    return reference, current


def scored_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a fixed score column and their churn label."""
    return dim_customer(spark, folder).select(
        "customer_sk",
        "customer_id",
        "tenure_months",
        "contract_type",
        "city",
        F.col("churn_flag").cast("int").alias("churn"),
        (((F.col("customer_sk") * 7919) % 1000) / F.lit(1000.0)).alias("churn_probability"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    return request_columns(table(spark, folder, "events"))


def request_columns(events: DataFrame) -> DataFrame:
    """Events (batch or stream) as a request log."""
    return events.select(
        "event_id",
        "ts",
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("value") / F.lit(1000.0)).alias("seconds"),
    )
