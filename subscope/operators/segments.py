"""Customer segments: K-means, silhouette, profiles and names."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from subscope.operators import lloyd
from subscope.operators.features import Scale, sample_rows
from subscope.session import ship, staged

# Segmentation features and segment names from the highest spend down.
FEATURES = ["recency", "frequency", "monetary", "tenure_months", "avg_data_gb"]
NAMES = ["Champions", "Loyal", "Potential", "At Risk", "Hibernating"]
SILHOUETTE_SAMPLE = 5000


def _prepared(df: DataFrame, features: list[str]) -> tuple[PipelineModel, DataFrame]:
    scale = Scale.fit(df, features)
    stages = [
        SQLTransformer(statement=f"SELECT *, {scale.sql('_z_')} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="_features"),
    ]
    model = PipelineModel(stages)
    return model, model.transform(df)


def _as_model(spark: SparkSession, centres: np.ndarray, seed: int):
    """A storable model with these centres: K-means of the centres alone leaves each as it is."""
    rows = spark.createDataFrame([(Vectors.dense(c),) for c in centres], ["_features"]).coalesce(1)
    still = KMeans(k=max(2, len(centres)), seed=seed, featuresCol="_features", predictionCol="segment", initMode="random")
    return still.fit(rows)


def _coordinates(prepared: DataFrame, features: list[str]) -> DataFrame:
    return prepared.select(*[F.col(f"_z_{c}") for c in features])


def _best(fits: list[lloyd.Fitted], k: int) -> lloyd.Fitted:
    return min((f for f in fits if f.k == k), key=lambda f: (f.inertia, f.restart))


@dataclass
class Segmenter:
    """K-means on scaled features; the fitted pipeline saves and loads as one model."""

    n_clusters: int = 5
    seed: int = 42
    restarts: int = 10
    model: PipelineModel | None = None
    inertia: float | None = None

    def fit(self, df: DataFrame, features: list[str] | None = None) -> Segmenter:
        features = features or FEATURES
        preparation, prepared = _prepared(df.select(*features), features)
        rows = _coordinates(prepared, features).persist()
        try:
            best = _best(lloyd.fit_all(rows, [self.n_clusters], self.restarts, self.seed), self.n_clusters)
        finally:
            rows.unpersist()
        self.inertia = best.inertia
        self.model = PipelineModel([*preparation.stages, _as_model(df.sparkSession, best.centres, self.seed)])
        return self

    def _fitted(self) -> PipelineModel:
        if self.model is None:
            raise RuntimeError("segmenter is not fitted")
        return self.model

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` (batch or stream) with the column ``segment``."""
        return self._fitted().transform(df).select(*df.columns, "segment")

    def distances(self, df: DataFrame) -> DataFrame:
        """``predict`` with ``distances``: squared, in scaled features, to every centre."""
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self._fitted().stages[-1].clusterCenters()])
        point = F.col("point")

        def to(centre):
            return F.aggregate(F.zip_with(point, centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)

        scored = as_points(self._fitted().transform(df))
        return scored.withColumn("distances", F.transform(centres, to)).select(*df.columns, "segment", "distances")

    def evaluate(self, df: DataFrame, key: str = "customer_id", sample: int = SILHOUETTE_SAMPLE) -> float:
        scored = self._fitted().transform(df).select(key, "_features", "segment")
        return silhouette(as_points(scored), key, "segment", sample).first()["silhouette"]

    def save(self, path: str) -> None:
        self._fitted().write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Segmenter:
        model = PipelineModel.load(path)
        return cls(n_clusters=model.stages[-1].getK(), model=model)


def as_points(df: DataFrame, vector: str = "_features") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("point", vector_to_array(vector)).drop(vector)


def silhouette_rows(points: DataFrame, key: str, label: str, sample: int = SILHOUETTE_SAMPLE) -> DataFrame:
    """(key, label, s): Euclidean silhouette of up to ``sample`` rows, by digest order.

    ``points`` holds the coordinates in the array ``point``. The sample bounds what
    every task compares its rows with; no pair of rows is ever materialised.
    """
    rows = staged(sample_rows(points.select(key, label, "point"), key, sample), "silhouette")
    held = rows.select(label, "point").collect()
    spark = points.sparkSession
    ship(spark)
    names, codes = np.unique([r[label] for r in held], return_inverse=True)
    # at most ``sample`` points
    shared = spark.sparkContext.broadcast((np.array([r["point"] for r in held], dtype=float), names, codes))

    def score(batches):
        matrix, values, code = shared.value
        sizes = np.bincount(code, minlength=len(values)).astype(float)
        for batch in batches:
            out = []
            for own, point in zip(np.searchsorted(values, batch[label].to_numpy()), batch["point"]):
                gaps = np.sqrt(((matrix - np.asarray(point, dtype=float)) ** 2).sum(axis=1))
                totals = np.bincount(code, weights=gaps, minlength=len(values))
                if sizes[own] <= 1 or len(values) < 2:
                    out.append(0.0)
                    continue
                inner = totals[own] / (sizes[own] - 1)
                outer = np.delete(totals / sizes, own).min()
                out.append((outer - inner) / max(inner, outer) if max(inner, outer) > 0 else 0.0)
            yield pd.DataFrame({key: batch[key], label: batch[label], "s": out})

    kinds = dict(rows.dtypes)
    spread = rows.repartition(spark.sparkContext.defaultParallelism)
    return spread.mapInPandas(score, f"{key} {kinds[key]}, {label} {kinds[label]}, s double")


def silhouette(points: DataFrame, key: str, label: str, sample: int = SILHOUETTE_SAMPLE) -> DataFrame:
    return silhouette_rows(points, key, label, sample).agg(
        F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("sampled")
    )


def silhouette_all(points: DataFrame, key: str, label: str) -> DataFrame:
    """Silhouette of every row on squared Euclidean distances, with the number of rows.

    Two passes: sums per cluster, then each row against one summary per cluster, so the
    work grows with rows times clusters. Needs at least two clusters.
    """
    names = points.select(label).distinct().withColumn("_code", F.dense_rank().over(Window.orderBy(label)) - 1.0)
    coded = points.join(names, label).select(key, "_code", array_to_vector("point").alias("_point")).persist()
    try:
        found = ClusteringEvaluator(
            featuresCol="_point", predictionCol="_code", distanceMeasure="squaredEuclidean"
        ).evaluate(coded)
        return points.sparkSession.createDataFrame([(found, coded.count())], "silhouette double, scored bigint")
    finally:
        coded.unpersist()


def auto_k(
    df: DataFrame,
    key: str = "customer_id",
    features: list[str] | None = None,
    ks: range = range(3, 9),
    seed: int = 42,
    restarts: int = 10,
    sample: int = SILHOUETTE_SAMPLE,
) -> DataFrame:
    """Silhouette (of a sample, and of all rows on squared distances) and inertia per number of clusters."""
    features = features or FEATURES
    _, prepared = _prepared(df.select(key, *features), features)
    prepared = prepared.persist()
    found = []
    try:
        fits = lloyd.fit_all(_coordinates(prepared, features), list(ks), restarts, seed)
        for k in ks:
            best = _best(fits, k)
            labelled = as_points(_as_model(df.sparkSession, best.centres, seed).transform(prepared))
            score = silhouette(labelled, key, "segment", sample).first()["silhouette"]
            every = silhouette_all(labelled, key, "segment").first()["silhouette"]
            found.append((k, float(score), float(every), best.inertia))
    finally:
        prepared.unpersist()
    return df.sparkSession.createDataFrame(found, "k int, silhouette double, silhouette_all double, inertia double")


def profile(df: DataFrame, features: list[str], label: str = "segment") -> DataFrame:
    """Mean and count of every feature per segment."""
    aggregates = [a for c in features for a in (F.avg(c).alias(f"{c}_mean"), F.count(c).alias(f"{c}_count"))]
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(*aggregates)


def segment_names(profiles: DataFrame, label: str = "segment") -> DataFrame:
    """Name per segment by falling mean spend; without spend, by number."""
    if "monetary_mean" not in profiles.columns:
        return profiles.select(label, F.concat(F.lit("Segment "), F.col(label)).alias("segment_name"))
    # one row per segment
    place = F.row_number().over(Window.orderBy(F.desc("monetary_mean"), label)) - 1
    names = F.array(*[F.lit(n) for n in NAMES])
    return profiles.select(label, place.alias("_place")).select(
        label,
        F.when(F.col("_place") < len(NAMES), F.get(names, "_place"))
        .otherwise(F.concat(F.lit("Other "), F.col("_place")))
        .alias("segment_name"),
    )


def with_names(df: DataFrame, names: DataFrame, label: str = "segment") -> DataFrame:
    """Attach segment names; a segment without a name gets ``Segment <id>``."""
    named = df.join(names, label, "left")
    return named.withColumn(
        "segment_name", F.coalesce("segment_name", F.concat(F.lit("Segment "), F.col(label)))
    )
