"""Readers and sinks of the raw files, the public churn data set, and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from subscope.operators.distribution import exact_quantiles
from subscope.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # a header that differs from the schema is an error, not a silent shift of columns
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("dateFormat", "yyyy-MM-dd").csv(path)


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CUSTOMERS)


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TRANSACTIONS)


def load_tariffs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TARIFFS)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_telco(spark: SparkSession, path: str) -> DataFrame:
    """The public telecom churn file: all columns as text, then normalised."""
    return normalise_telco(spark.read.option("header", True).option("inferSchema", False).csv(path))


def normalise_telco(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Lower-case names, numeric charges with the median for the rest, 0/1 label.

    A label other than yes, a missing one included, counts as 0.
    """
    out = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    if "totalcharges" in out.columns:
        out = out.withColumn("totalcharges", F.expr("try_cast(totalcharges AS double)"))
        known = out.where(F.col("totalcharges").isNotNull()).select(
            F.lit("totalcharges").alias("feature"), F.col("totalcharges").alias("value")
        )
        median = exact_quantiles(known, "feature", [0.5], slice_rows).first()
        if median is not None:
            out = out.na.fill({"totalcharges": median["quantile"]})
    if "churn" in out.columns and dict(out.dtypes)["churn"] == "string":
        out = out.withColumn("churn", F.coalesce(F.lower("churn") == "yes", F.lit(False)).cast("int"))
    if "seniorcitizen" in out.columns:
        out = out.withColumn("seniorcitizen", F.col("seniorcitizen").cast("int"))
    return out


RUN_LOG = "run_name string, kind string, key string, number double, text string, logged_at timestamp"


def log_run(
    spark: SparkSession,
    path: str,
    run_name: str,
    params: dict | None = None,
    metrics: dict | None = None,
) -> None:
    """Append a run's parameters and metrics to the run log.

    Metrics that are not numbers and parameters that are nested are left out.
    """
    rows = [
        (run_name, "metric", k, float(v), None)
        for k, v in (metrics or {}).items()
        if isinstance(v, (int, float))
    ] + [
        (run_name, "param", k, None, str(v))
        for k, v in (params or {}).items()
        if not isinstance(v, (dict, list))
    ]
    if rows:
        schema = "run_name string, kind string, key string, number double, text string"
        spark.createDataFrame(rows, schema).withColumn("logged_at", F.current_timestamp()).write.mode(
            "append"
        ).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).parquet(path)


def best_run(runs: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The run with the highest value of a metric."""
    return (
        runs.where((F.col("kind") == "metric") & (F.col("key") == metric))
        .orderBy(F.desc("number"), "run_name")
        .limit(1)
    )
