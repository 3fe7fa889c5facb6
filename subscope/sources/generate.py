"""Synthetic customers, transactions and experiments.

Every draw is a function of the row key, the seed and the name of the column, so the
data do not depend on the number of partitions or on the order of evaluation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subscope.functions.scalars import (
    digest_uniform,
    integer_pick,
    seeded_digest,
    seeded_uniform,
    weighted_pick,
)
from subscope.sources.files import write_csv

# The tariff catalog.
TARIFFS = [
    ("T01", "Basic 100", 1500, 5, 100, "basic"),
    ("T02", "Basic 200", 2500, 10, 200, "basic"),
    ("T03", "Smart 500", 4000, 25, 500, "smart"),
    ("T04", "Smart Unlim", 6000, 50, 1500, "smart"),
    ("T05", "Pro Family", 8500, 100, 3000, "pro"),
    ("T06", "Pro Business", 12000, 200, 5000, "pro"),
    ("T07", "Youth Social", 1800, 15, 50, "youth"),
    ("T08", "Senior Calls", 1200, 2, 400, "senior"),
]
# Categories and their shares.
GENDERS = (["M", "F"], [0.52, 0.48])
CITIES = (["Almaty", "Astana", "Shymkent", "Karaganda", "Aktobe", "Pavlodar"],
          [0.35, 0.25, 0.15, 0.10, 0.08, 0.07])
CONTRACTS = (["monthly", "yearly", "two-year"], [0.55, 0.30, 0.15])
PAYMENTS = (["card", "bank-transfer", "cash", "e-wallet"], [0.45, 0.25, 0.15, 0.15])
# Tariff choice by upper age limit (None: everyone older).
TARIFFS_BY_AGE = [
    (25, ["T07", "T01", "T03"], [0.5, 0.3, 0.2]),
    (40, ["T03", "T04", "T05", "T06"], [0.35, 0.30, 0.20, 0.15]),
    (60, ["T04", "T05", "T06", "T02"], [0.3, 0.3, 0.2, 0.2]),
    (None, ["T08", "T01", "T02"], [0.5, 0.3, 0.2]),
]
# Share of customers with each flag.
FLAGS = {"paperless_billing": 0.70, "has_internet": 0.85, "has_tv": 0.45, "has_roaming": 0.25}
LAST_DAY = "2025-12-01"


def tariff_catalog(spark: SparkSession) -> DataFrame:
    values = ", ".join(str(row) for row in TARIFFS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(tariff_id, name, monthly_price, data_gb, minutes, category)")


def _tariff_choice(age: Column, u: Column) -> Column:
    choice = None
    for limit, ids, weights in TARIFFS_BY_AGE:
        pick = weighted_pick(u, ids, weights)
        if choice is None:
            choice = F.when(age < limit, pick)
        else:
            choice = choice.otherwise(pick) if limit is None else choice.when(age < limit, pick)
    return choice


def _churn_probability() -> Column:
    def extra(condition: Column, amount: float) -> Column:
        return F.when(condition, amount).otherwise(0.0)

    tenure = F.col("tenure_months")
    p = (
        F.lit(0.10)
        + extra(F.col("contract_type") == "monthly", 0.18)
        + extra(tenure < 12, 0.12)
        - extra(tenure > 48, 0.08)
        + extra(F.col("payment_method") == "cash", 0.05)
        - F.col("has_tv") * 0.04
        - F.col("has_internet") * 0.03
    )
    return F.least(F.greatest(p, F.lit(0.01)), F.lit(0.85))


def customers_from(ids: DataFrame, seed: int = 42) -> DataFrame:
    """One generated customer per row of ``ids`` (column ``id``, from 1)."""
    drawn = ids.select("id").withColumns(
        {f"_d{i}": seeded_digest(F.col("id"), seed, f"customer{i}") for i in range(3)}
    )
    # twelve uniforms per customer: four words of three digests
    u = [digest_uniform(F.col(f"_d{i // 4}"), i % 4) for i in range(12)]
    base = drawn.select(
        F.format_string("C%06d", "id").alias("customer_id"),
        integer_pick(u[0], 18, 75).alias("age"),
        weighted_pick(u[1], *GENDERS).alias("gender"),
        weighted_pick(u[2], *CITIES).alias("city"),
        integer_pick(u[3], 1, 84).alias("tenure_months"),
        u[4].alias("_tariff"),
        weighted_pick(u[5], *CONTRACTS).alias("contract_type"),
        weighted_pick(u[6], *PAYMENTS).alias("payment_method"),
        *[(u[7 + i] >= 1 - share).cast("int").alias(flag) for i, (flag, share) in enumerate(FLAGS.items())],
        u[11].alias("_churn"),
    )
    return base.select(
        "customer_id", "age", "gender", "city", "tenure_months",
        _tariff_choice(F.col("age"), F.col("_tariff")).alias("tariff_id"),
        "contract_type", "payment_method", *FLAGS,
        (F.col("_churn") < _churn_probability()).cast("int").alias("churn"),
    )


def generate_customers(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return customers_from(spark.range(1, n + 1), seed)


def generate_transactions(customers: DataFrame, months: int = 12, seed: int = 42) -> DataFrame:
    """One transaction per 30 days, newest first, for at most ``months`` months."""
    steps = F.explode(F.sequence(F.lit(0), F.least(F.lit(months), F.col("tenure_months")) - 1))
    # a sequence to -1 would count down
    active = customers.where((F.col("tenure_months") >= 1) & F.lit(months >= 1))
    rows = active.select("customer_id", "tariff_id", steps.alias("step"))
    key = F.concat_ws("-", "customer_id", "step")
    catalog = tariff_catalog(customers.sparkSession).select("tariff_id", "monthly_price", "data_gb", "minutes")
    priced = rows.withColumn("_d", seeded_digest(key, seed + 1, "transaction")).join(
        F.broadcast(catalog), "tariff_id"  # eight rows
    )

    def scaled(column: str, part: int, low: float, high: float, digits: int) -> Column:
        return F.round(F.col(column) * (low + digest_uniform(F.col("_d"), part) * (high - low)), digits)

    return priced.select(
        F.concat(F.lit("TX"), F.substring("customer_id", 2, 20), F.lpad(F.col("step").cast("string"), 3, "0")).alias(
            "transaction_id"
        ),
        "customer_id",
        F.date_sub(F.lit(LAST_DAY).cast("date"), F.col("step") * 30).alias("transaction_date"),
        scaled("monthly_price", 0, 0.9, 1.4, 2).alias("amount"),
        scaled("data_gb", 1, 0.4, 1.2, 2).alias("data_gb_used"),
        scaled("minutes", 2, 0.3, 1.1, 1).alias("minutes_used"),
        "tariff_id",
    )


def save_all(spark: SparkSession, out: str, n: int = 5000, months: int = 12, seed: int = 42) -> dict[str, int]:
    """Write the three raw files and return their row counts."""
    customers = generate_customers(spark, n, seed)
    made = {
        "customers": customers,
        "transactions": generate_transactions(customers, months, seed),
        "tariffs": tariff_catalog(spark),
    }
    for name, df in made.items():
        write_csv(df, f"{out}/{name}.csv")
    return {name: df.count() for name, df in made.items()}


def experiment_rows(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Simulated experiment for rows of (id, group): conversion and spend before and after."""
    treated = F.col("group") == "treatment"
    u = {c: seeded_uniform(F.concat_ws("-", "group", "id"), seed, c)
         for c in ("convert", "radius", "angle", "uplift", "noise")}
    # Box-Muller; 1 - u keeps the logarithm finite
    normal = F.sqrt(F.lit(-2.0) * F.log(1 - u["radius"])) * F.cos(F.lit(2 * math.pi) * u["angle"])
    drawn = rows.select(
        "id", "group",
        (u["convert"] < F.when(treated, 0.13).otherwise(0.08)).cast("int").alias("converted"),
        (F.lit(4500.0) + 1200.0 * normal).alias("arpu_before"),
        (0.12 + u["uplift"] * 0.13).alias("_uplift"),
        u["noise"].alias("_noise"),
    )
    factor = F.when(
        treated, (1 + F.col("converted") * F.col("_uplift")) * (0.99 + F.col("_noise") * 0.07)
    ).otherwise(0.98 + F.col("_noise") * 0.07)
    after = drawn.withColumn("arpu_after", F.col("arpu_before") * factor)
    return after.select(
        "id", "group", "converted", "arpu_before", "arpu_after",
        (F.col("arpu_after") - F.col("arpu_before")).alias("arpu_delta"),
    )


def generate_experiment(spark: SparkSession, control: int = 1500, treatment: int = 1500, seed: int = 42) -> DataFrame:
    def ids(n: int, group: str) -> DataFrame:
        return spark.range(n).withColumn("group", F.lit(group))

    return experiment_rows(ids(control, "control").unionByName(ids(treatment, "treatment")), seed)
