"""Calendar dimension and the star schema built from raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subscope.functions.scalars import date_key
from subscope.operators.ordering import global_order
from subscope.operators.quality import Constraint


def calendar(spark: SparkSession, start: str = "2024-01-01", end: str = "2026-12-31") -> DataFrame:
    """One row per day; bounded by the two dates, so it may be broadcast."""
    return _days(spark.range(1), F.lit(start).cast("date"), F.lit(end).cast("date"))


def _days(one_row: DataFrame, first: Column, last: Column) -> DataFrame:
    days = one_row.select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("full_date"))
    d = F.col("full_date")
    weekday = F.dayofweek(d) - 1
    return days.select(
        date_key(d).alias("date_sk"),
        "full_date",
        F.year(d).cast("smallint").alias("year"),
        F.quarter(d).cast("smallint").alias("quarter"),
        F.month(d).cast("smallint").alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).cast("smallint").alias("week_of_year"),
        F.dayofmonth(d).cast("smallint").alias("day_of_month"),
        weekday.cast("smallint").alias("day_of_week"),
        weekday.isin(0, 6).alias("is_weekend"),
        (d == F.last_day(d)).alias("is_month_end"),
    )


def with_surrogate(df: DataFrame, natural: str, key: str, key_type: str, **order) -> DataFrame:
    """Add a dense 1-based surrogate key: the rank of the natural key."""
    ranked = global_order(df, [natural], rank=key, label=f"key-{key}", **order).frame
    return ranked.withColumn(key, F.col(key).cast(key_type))


def build_customers(customers: DataFrame, valid_from: str) -> DataFrame:
    """Customer dimension from raw customers; 0/1 flags become booleans."""
    def flag(name: str) -> Column:
        return F.col(name).cast("boolean")

    keyed = with_surrogate(customers, "customer_id", "customer_sk", "int")
    name = F.col("segment_name") if "segment_name" in customers.columns else F.lit(None)
    number = F.col("segment") if "segment" in customers.columns else F.lit(None)
    return keyed.select(
        "customer_sk",
        "customer_id",
        F.col("age").cast("smallint").alias("age"),
        "gender",
        "city",
        "contract_type",
        "payment_method",
        flag("paperless_billing").alias("paperless"),
        flag("has_internet").alias("has_internet"),
        flag("has_tv").alias("has_tv"),
        flag("has_roaming").alias("has_roaming"),
        number.cast("smallint").alias("segment"),
        name.cast("string").alias("segment_name"),
        flag("churn").alias("churn_flag"),
        F.lit(valid_from).cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )


def build_tariffs(tariffs: DataFrame) -> DataFrame:
    keyed = with_surrogate(tariffs, "tariff_id", "tariff_sk", "int")
    return keyed.select(
        "tariff_sk",
        "tariff_id",
        F.col("name").alias("tariff_name"),
        "category",
        F.col("monthly_price").cast("decimal(10,2)").alias("monthly_price"),
        F.col("data_gb").cast("smallint").alias("data_gb"),
        F.col("minutes").cast("smallint").alias("minutes"),
    )


def build_cities(cities: DataFrame, country: str = "Kazakhstan") -> DataFrame:
    """City dimension from (city_name, region); ``country`` is the column default."""
    named = with_surrogate(cities, "city_name", "city_sk", "int")
    return named.select("city_sk", "city_name", "region", F.lit(country).alias("country"))


def _looked_up(
    transactions: DataFrame, dim_customer: DataFrame, dim_tariff: DataFrame, first_day: str, last_day: str
) -> DataFrame:
    """Every transaction with its keys, and in ``reasons`` what it names that is unknown.

    The date key is computed, so the calendar needs no join, only a range test.
    """
    day = F.to_date("transaction_date")
    inside = F.coalesce(day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")), F.lit(False))
    told = (
        transactions.join(dim_customer, "customer_id", "left")
        .join(dim_tariff.select("tariff_id", "tariff_sk"), "tariff_id", "left")
        .withColumn("date_sk", F.when(inside, date_key(day)))
    )
    unknown = [F.when(F.col(f"{c}_sk").isNull(), F.lit(c)) for c in ("customer", "tariff", "date")]
    return told.withColumn("reasons", F.array_compact(F.array(*unknown)))


def rejected_transactions(
    transactions: DataFrame, dim_customer: DataFrame, dim_tariff: DataFrame, first_day: str, last_day: str
) -> DataFrame:
    """The transactions that the fact table leaves out, whole, with the reasons."""
    keys = dim_customer.select("customer_id", "customer_sk")
    told = _looked_up(transactions, keys, dim_tariff, first_day, last_day)
    return told.where(F.size("reasons") > 0).select(*transactions.columns, "reasons")


def build_fact(
    transactions: DataFrame,
    dim_customer: DataFrame,
    dim_tariff: DataFrame,
    dim_city: DataFrame,
    first_day: str,
    last_day: str,
) -> DataFrame:
    """Fact rows with surrogate keys looked up from the natural ones.

    A transaction whose customer, tariff or day is unknown has no place in the fact
    table (``rejected_transactions`` has it); an unknown city leaves a null key.
    """
    where = dim_customer.select("customer_id", "customer_sk", "city").join(
        dim_city.select("city_sk", F.col("city_name").alias("city")), "city", "left"
    )
    known = _looked_up(transactions, where.drop("city"), dim_tariff, first_day, last_day).where(F.size("reasons") == 0)
    keyed = known.select(
        "transaction_id",
        "customer_sk",
        "tariff_sk",
        "date_sk",
        "city_sk",
        F.col("amount").cast("decimal(12,2)").alias("amount"),
        F.col("data_gb_used").cast("decimal(8,2)").alias("data_gb_used"),
        F.col("minutes_used").cast("decimal(10,1)").alias("minutes_used"),
    )
    ranked = with_surrogate(keyed, "transaction_id", "transaction_sk", "bigint")
    return ranked.select("transaction_sk", *keyed.columns)


def write_star(tables: dict[str, DataFrame], out: str) -> None:
    """Store the star schema; the fact table is laid out by year for partition pruning."""
    for name, df in tables.items():
        if name == "fact_transactions":
            year = F.call_function("div", F.col("date_sk"), F.lit(10000)).cast("int")
            df.withColumn("year", year).write.mode("overwrite").partitionBy("year").parquet(f"{out}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{out}/{name}")


def calendar_of(dates: DataFrame, column: str) -> DataFrame:
    """Calendar of whole years that covers the dates of a table; today's year if it has none.

    The years are found inside the query that uses the calendar, without a job before it.
    """
    years = dates.agg(*[F.year(F.coalesce(f(column).cast("date"), F.current_date())).alias(n) for n, f in (("first", F.min), ("last", F.max))])
    return _days(years, F.make_date("first", F.lit(1), F.lit(1)), F.make_date("last", F.lit(12), F.lit(31)))


def years_of(dates: DataFrame, column: str) -> tuple[str, str]:
    """First and last day of the years that the dates of a table fall in; today's year if it has none."""
    span = dates.agg(*[F.year(F.coalesce(f(column).cast("date"), F.current_date())) for f in (F.min, F.max)]).first()
    return f"{span[0]:04d}-01-01", f"{span[1]:04d}-12-31"


def star_constraints() -> list[Constraint]:
    """Keys, references and text lengths of the star schema."""
    def primary(table: str, key: str) -> list[Constraint]:
        return [Constraint("not_null", table, (key,)), Constraint("unique", table, (key,))]

    def natural(table: str, key: str, length: int) -> list[Constraint]:
        return [*primary(table, key), Constraint("length", table, (key,), limit=length)]

    fact = "fact_transactions"
    return [
        *primary("dim_customer", "customer_sk"),
        *natural("dim_customer", "customer_id", 10),
        Constraint("length", "dim_customer", ("city",), limit=50),
        Constraint("not_null", "dim_customer", ("valid_from",)),
        *primary("dim_tariff", "tariff_sk"),
        *natural("dim_tariff", "tariff_id", 5),
        *primary("dim_date", "date_sk"),
        *primary("dim_date", "full_date"),
        *primary("dim_city", "city_sk"),
        *natural("dim_city", "city_name", 50),
        *primary(fact, "transaction_sk"),
        *natural(fact, "transaction_id", 15),
        *[Constraint("not_null", fact, (c,)) for c in ("customer_sk", "tariff_sk", "date_sk", "amount")],
        Constraint("foreign", fact, ("customer_sk",), ("dim_customer", "customer_sk")),
        Constraint("foreign", fact, ("tariff_sk",), ("dim_tariff", "tariff_sk")),
        Constraint("foreign", fact, ("date_sk",), ("dim_date", "date_sk")),
        Constraint("foreign", fact, ("city_sk",), ("dim_city", "city_sk")),
    ]


def build_star(
    customers: DataFrame,
    transactions: DataFrame,
    tariffs: DataFrame,
    cities: DataFrame,
    valid_from: str,
    days: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All tables of the star schema from the raw tables, and what the fact table leaves out.

    The calendar covers the years of the transactions, or else ``days``, first and last.
    """
    spark = customers.sparkSession
    first_day, last_day = days or years_of(transactions, "transaction_date")
    people, plans, towns = build_customers(customers, valid_from), build_tariffs(tariffs), build_cities(cities)
    return {
        "dim_customer": people,
        "dim_tariff": plans,
        "dim_date": calendar(spark, first_day, last_day),
        "dim_city": towns,
        "fact_transactions": build_fact(transactions, people, plans, towns, first_day, last_day),
        "rejected_transactions": rejected_transactions(transactions, people, plans, first_day, last_day),
    }
