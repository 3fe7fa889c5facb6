"""Churn classifiers: training, evaluation, explanation and scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from subscope.functions.scalars import risk_by_score
from subscope.operators.attributions import (
    Ensemble,
    attribution_column,
    mean_importance,
    read_ensemble,
    top_factors,
)
from subscope.operators.distribution import cumulative_counts, pair_wins
from subscope.operators.features import feature_columns, feature_names, fit_feature_pipeline, stratified_split
from subscope.session import staged

BOOSTED, FOREST = "boosted_trees", "random_forest"
# Size of both contenders, and the step of the boosted one.
TREES, DEPTH, STEP = 300, 6, 0.05
CUTOFF = 0.5


def binary_metrics(
    df: DataFrame, label: str = "churn", probability: str = "churn_probability", slice_rows: int | None = None
) -> DataFrame:
    """One row: accuracy, ROC-AUC, precision, recall, F1 and the confusion counts.

    Precision, recall and F1 are 0 where their divisor is. All of it comes from one table
    of label counts per distinct score.
    """
    positive = F.col("actual")
    scores = df.select(
        F.lit("score").alias("test"), F.col(probability).cast("double").alias("value"),
        (F.col(label) == 1).alias("actual"),
    )
    counts = cumulative_counts(
        scores, "test", {"a": positive.cast("int"), "b": (~positive).cast("int")}, slice_rows, "scores"
    )
    predicted = F.col("value") >= CUTOFF
    summed = counts.groupBy("test").agg(
        F.max("n_a").alias("n_a"),
        F.max("n_b").alias("n_b"),
        F.sum(pair_wins()).alias("u"),
        F.sum(F.when(predicted, F.col("a")).otherwise(0)).alias("tp"),
        F.sum(F.when(predicted, F.col("b")).otherwise(0)).alias("fp"),
    )
    found = summed.withColumns({"fn": F.col("n_a") - F.col("tp"), "tn": F.col("n_b") - F.col("fp")})
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def share(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return found.select(
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        F.try_divide(F.col("u"), F.col("n_a").cast("double") * F.col("n_b")).alias("roc_auc"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "tn", "fp", "fn", "tp",
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion"),
    )


@dataclass
class ChurnModel:
    """Feature pipeline and tree ensemble; saves and loads as one pipeline model."""

    kind: str = BOOSTED
    include_rfm: bool = True
    trees: int = TREES
    depth: int = DEPTH
    step: float = STEP
    seed: int = 42
    model: PipelineModel | None = None
    _ensemble: Ensemble | None = field(default=None, repr=False)

    def _classifier(self, label: str):
        common = {"labelCol": label, "featuresCol": "features", "maxDepth": self.depth, "seed": self.seed}
        if self.kind == BOOSTED:
            return GBTClassifier(maxIter=self.trees, stepSize=self.step, weightCol="copies", **common)
        if self.kind == FOREST:
            return RandomForestClassifier(numTrees=self.trees, **common)
        raise ValueError(f"unknown kind of model: {self.kind}")

    def fit(self, df: DataFrame, label: str = "churn") -> ChurnModel:
        classifier = self._classifier(label)
        preparation = fit_feature_pipeline(df, self.include_rfm)
        wanted = ["features", F.col(label).cast("double").alias(label)]
        if self.kind == BOOSTED:
            # rows that agree in everything a tree sees weigh like as many; the forest draws each by itself
            seen = feature_columns(self.include_rfm)
            df = staged(df.groupBy(*seen, label).agg(F.count(F.lit(1)).cast("double").alias("copies")), "copies")
            wanted.append("copies")
        rows = preparation.transform(df).select(*wanted).persist()
        try:
            fitted = classifier.fit(rows)
        finally:
            rows.unpersist()
        self.model = PipelineModel([*preparation.stages, fitted])
        return self

    def _fitted(self) -> PipelineModel:
        if self.model is None:
            raise RuntimeError("model is not fitted")
        return self.model

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` (batch or stream) with ``churn_probability`` and ``churn_predicted``."""
        chance = vector_to_array("probability")[1]
        out = self._fitted().transform(df).withColumn("churn_probability", chance)
        return out.select(
            *df.columns, "churn_probability", (F.col("churn_probability") >= CUTOFF).cast("int").alias("churn_predicted")
        )

    def evaluate(self, df: DataFrame, label: str = "churn") -> DataFrame:
        return binary_metrics(staged(self.predict_proba(df).select(label, "churn_probability"), "scores"), label)

    @property
    def feature_names(self) -> list[str]:
        return feature_names(self._fitted())

    def ensemble(self, spark: SparkSession) -> Ensemble:
        if self._ensemble is None:
            self._ensemble = read_ensemble(spark, self._fitted().stages[-1], len(self.feature_names))
        return self._ensemble

    def attributed(self, df: DataFrame) -> DataFrame:
        """``df`` with the attribution array ``phi``.

        Boosted trees explain the margin (probability is sigmoid of twice the margin),
        the forest explains the probability.
        """
        spark = df.sparkSession
        phi = attribution_column(spark, self.ensemble(spark))
        return self._fitted().transform(df).withColumn("phi", phi).select(*df.columns, "phi")

    def explain(self, df: DataFrame, key: str = "customer_id", sample: int | None = None) -> DataFrame:
        """(feature, importance) over all rows, or over the first ``sample`` rows by key."""
        rows = df if sample is None else df.orderBy(key).limit(sample)
        return mean_importance(self.attributed(rows), self.feature_names)

    def score(self, df: DataFrame, factors: int = 5) -> DataFrame:
        """Scoring response per row: probability, decision, risk level and top factors."""
        spark = df.sparkSession
        chance = vector_to_array("probability")[1]
        scored = (
            self._fitted().transform(df)
            .withColumn("_p", chance)
            .withColumn("phi", attribution_column(spark, self.ensemble(spark)))
        )
        return scored.select(
            *df.columns,
            F.bround("_p", 4).alias("churn_probability"),
            (F.col("_p") >= CUTOFF).alias("churn_predicted"),
            risk_by_score(F.col("_p")).alias("risk_level"),
            top_factors(self.feature_names, n=factors).alias("top_factors"),
        )

    def save(self, path: str) -> None:
        self._fitted().write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> ChurnModel:
        model = PipelineModel.load(path)
        last, assembler = model.stages[-1], model.stages[3]
        boosted = last.__class__.__name__.startswith("GBT")
        return cls(
            kind=BOOSTED if boosted else FOREST,
            include_rfm="num__recency" in assembler.getInputCols(),
            trees=last.getNumTrees,
            depth=last.getOrDefault("maxDepth"),
            model=model,
        )


METRICS = ["accuracy", "roc_auc", "precision", "recall", "f1"]


@dataclass
class Comparison:
    models: dict[str, ChurnModel]
    metrics: dict[str, dict[str, float]]

    @property
    def best(self) -> str:
        return max(self.metrics, key=lambda k: self.metrics[k]["roc_auc"])


def train_and_compare(
    df: DataFrame,
    key: str = "customer_id",
    label: str = "churn",
    test_share: float = 0.2,
    seed: int = 42,
    include_rfm: bool = True,
    trees: int = TREES,
) -> Comparison:
    """Fit both contenders on one stratified split and measure them on the rest."""
    split = staged(stratified_split(df, key, label, test_share, seed), "split")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    models, metrics = {}, {}
    for kind in (BOOSTED, FOREST):
        models[kind] = ChurnModel(kind, include_rfm, trees, seed=seed).fit(train, label)
        row = models[kind].evaluate(test, label).first()
        metrics[kind] = {m: row[m] for m in METRICS}
    return Comparison(models, metrics)
