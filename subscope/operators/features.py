"""Feature preparation: scaling, one-hot encoding, splits and the feature pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from subscope.functions.scalars import seeded_digest

# The feature lists.
CATEGORICAL = ["gender", "city", "contract_type", "payment_method", "tariff_id"]
NUMERICAL = ["age", "tenure_months", "paperless_billing", "has_internet", "has_tv", "has_roaming"]
RFM_NUMERICAL = ["recency", "frequency", "monetary", "avg_data_gb", "avg_minutes"]


def split_features(df: DataFrame, target: str = "churn", drop: list[str] | None = None) -> DataFrame:
    """Id, target and feature columns, without the excluded ones."""
    excluded = {target, "customer_id", *(drop or [])}
    return df.select("customer_id", target, *[c for c in df.columns if c not in excluded])


@dataclass(frozen=True)
class Scale:
    """Mean and population standard deviation per column; constants scale to zero."""

    moments: dict[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> Scale:
        aggregates = [F.avg(c).alias(f"m_{c}") for c in columns]
        aggregates += [F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        row = df.agg(*aggregates).first()
        return Scale({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns})

    def column(self, name: str) -> Column:
        mean, std = self.moments[name]
        return (F.col(name).cast("double") - F.lit(mean)) / F.lit(std)

    def sql(self, prefix: str) -> str:
        """The same expressions as a select list."""
        return ", ".join(
            f"(CAST({c} AS DOUBLE) - CAST({m!r} AS DOUBLE)) / CAST({s!r} AS DOUBLE) AS `{prefix}{c}`"
            for c, (m, s) in self.moments.items()
        )


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    scale = Scale.fit(df, columns)
    return df.withColumns({c: scale.column(c) for c in columns})


def one_hot_stages(columns: list[str]) -> list:
    """Alphabetical categories; a value unseen in training encodes as all zeros."""
    indexed = [f"_i_{c}" for c in columns]
    encoded = [f"cat__{c}" for c in columns]
    return [
        StringIndexer(inputCols=columns, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
    ]


def one_hot(training: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """0/1 columns ``<column>_<category>`` for the categories seen in ``training``."""
    model = Pipeline(stages=one_hot_stages(columns)).fit(training)
    out, labels = model.transform(df), model.stages[0].labelsArray
    flags = [
        vector_to_array(f"cat__{c}").getItem(i).cast("int").alias(f"{c}_{value}")
        for c, values in zip(columns, labels)
        for i, value in enumerate(values)
    ]
    return out.select(*df.columns, *flags)


def feature_columns(include_rfm: bool = True) -> list[str]:
    """The columns that the feature vector is made of."""
    return NUMERICAL + (RFM_NUMERICAL if include_rfm else []) + CATEGORICAL


def fit_feature_pipeline(training: DataFrame, include_rfm: bool = True) -> PipelineModel:
    """Scaled numeric and one-hot categorical columns in one vector ``features``."""
    numeric = NUMERICAL + (RFM_NUMERICAL if include_rfm else [])
    scaler = SQLTransformer(
        statement=f"SELECT *, {Scale.fit(training, numeric).sql('num__')} FROM __THIS__"
    )
    assembler = VectorAssembler(
        inputCols=[f"num__{c}" for c in numeric] + [f"cat__{c}" for c in CATEGORICAL], outputCol="features"
    )
    return Pipeline(stages=[scaler, *one_hot_stages(CATEGORICAL), assembler]).fit(training)


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the entries of the feature vector, in order."""
    indexer, assembler = model.stages[1], model.stages[3]
    names = [c for c in assembler.getInputCols() if c.startswith("num__")]
    for column, labels in zip(indexer.getInputCols(), indexer.labelsArray):
        names += [f"cat__{column}_{value}" for value in labels]
    return names


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded digest of the key (a top-n, not a full sort)."""
    return (
        df.withColumn("_order", seeded_digest(F.col(key), seed, "sample"))
        .orderBy("_order", key)
        .limit(n)
        .drop("_order")
    )


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add boolean ``is_test``: exactly the rounded share of every class, chosen by digest.

    The digest that separates the two sides of a class is found from counts per digest
    prefix, so a class is never sorted as a whole; only the rows that share the
    deciding prefix are ranked.
    """
    digest = seeded_digest(F.col(key), seed, "split")
    marked = df.withColumn("_digest", digest)
    counts = marked.groupBy(label).count().collect()
    wanted = {r[label]: int(round(r["count"] * test_share)) for r in counts}
    width = 1
    while 16**width * 1000 < sum(r["count"] for r in counts):
        width += 1
    prefix = F.substring("_digest", 1, width)
    # at most 16**width counters per class
    upto = Window.partitionBy(label).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tally = (
        marked.groupBy(label, prefix.alias("_prefix"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
    )
    quota = F.lit(None).cast("bigint")
    for value, number in wanted.items():
        quota = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(number)).otherwise(quota)
    # the prefix at which a class reaches its quota, and how many of its rows still count
    cut = (
        tally.withColumn("_quota", quota)
        .where((F.col("_upto") - F.col("_n") < F.col("_quota")) & (F.col("_upto") >= F.col("_quota")))
        .select(label, "_prefix", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_rest"))
        .collect()
    )
    edge = F.lit(None).cast("string")
    for row in cut:
        pick = (
            marked.where(F.col(label).eqNullSafe(F.lit(row[label])) & (prefix == row["_prefix"]))
            .select("_digest")
            .orderBy("_digest")
            .limit(row["_rest"])
            .agg(F.max("_digest"))
            .first()[0]
        )
        edge = F.when(F.col(label).eqNullSafe(F.lit(row[label])), F.lit(pick)).otherwise(edge)
    return marked.withColumn("is_test", F.coalesce(F.col("_digest") <= edge, F.lit(False))).drop("_digest")


def minmax_catalog(catalog: DataFrame, numeric: list[str], category: str) -> tuple[DataFrame, list[str]]:
    """Catalog features: numbers scaled to [0, 1] and 0/1 columns per category."""
    limits = catalog.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in numeric],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in numeric],
        F.sort_array(F.collect_set(category)).alias("categories"),
    ).first()

    def scaled(c: str) -> Column:
        low, high = limits[f"lo_{c}"], limits[f"hi_{c}"]
        # a constant column scales to zero
        width = (high - low) or 1.0
        return ((F.col(c).cast("double") - F.lit(low)) / F.lit(width)).alias(f"num__{c}")

    flags = [(F.col(category) == value).cast("double").alias(f"cat__{category}_{value}")
             for value in limits["categories"]]
    out = catalog.select("tariff_id", *[scaled(c) for c in numeric], *flags)
    return out, out.columns[1:]
