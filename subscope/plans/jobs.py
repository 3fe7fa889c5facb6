"""End-to-end jobs: make data, train everything, and build the star schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from subscope.operators import churn, recommend, rfm, segments
from subscope.session import staged
from subscope.sources import files, star


@dataclass
class Settings:
    """Defaults of the training job."""

    clusters: int = 5
    search: range = field(default_factory=lambda: range(3, 9))
    restarts: int = 10
    test_share: float = 0.2
    trees: int = churn.TREES
    rank: int = 50
    epochs: int = 20
    seed: int = 42


NOT_FEATURES = ["segment", "segment_name", "r_score", "f_score", "m_score", "rfm_score"]


def load_raw(spark: SparkSession, raw: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        files.load_customers(spark, f"{raw}/customers.csv"),
        files.load_transactions(spark, f"{raw}/transactions.csv"),
        files.load_tariffs(spark, f"{raw}/tariffs.csv"),
    )


def train_segments(enriched: DataFrame, out: str, settings: Settings) -> DataFrame:
    """Search, fit, name and store the segments; returns customers with their segment."""
    spark, log = enriched.sparkSession, f"{out}/runs"
    base = staged(enriched.select("customer_id", *segments.FEATURES).na.fill(0), "segment-rows")
    found = segments.auto_k(base, ks=settings.search, seed=settings.seed, restarts=settings.restarts).collect()
    segmenter = segments.Segmenter(settings.clusters, settings.seed, settings.restarts).fit(base)
    labels = staged(segmenter.predict(base), "segments")
    names = staged(segments.segment_names(segments.profile(labels, segments.FEATURES)), "segment-names")
    metrics = {f"silhouette_k{r['k']}": r["silhouette"] for r in found}
    metrics["silhouette"] = segmenter.evaluate(base)
    # one parameter per segment
    params = {f"segment_{r['segment']}_name": r["segment_name"] for r in names.collect()}
    files.log_run(spark, log, "segmentation_kmeans", {"n_clusters": settings.clusters, **params}, metrics)
    segmenter.save(f"{out}/segmenter")
    names.write.mode("overwrite").parquet(f"{out}/segment_names")
    return segments.with_names(enriched.join(labels.select("customer_id", "segment"), "customer_id"), names)


def train_churn(segmented: DataFrame, out: str, settings: Settings) -> str:
    """Compare the churn models, store both and the better one; returns its kind."""
    spark, log = segmented.sparkSession, f"{out}/runs"
    rows = staged(segmented.drop(*NOT_FEATURES), "churn-rows")
    compared = churn.train_and_compare(
        rows, test_share=settings.test_share, seed=settings.seed, trees=settings.trees
    )
    for kind, model in compared.models.items():
        params = {"trees": settings.trees, "depth": model.depth}
        files.log_run(spark, log, f"churn_{kind}", params, compared.metrics[kind])
        model.save(f"{out}/churn_{kind}")
    compared.models[compared.best].save(f"{out}/churn_best")
    return compared.best


def train_recommender(transactions: DataFrame, tariffs: DataFrame, out: str, settings: Settings):
    spark = transactions.sparkSession
    fitted = recommend.Recommender(settings.rank, settings.epochs, settings.seed).fit(transactions, tariffs)
    fitted.save(f"{out}/recommender")
    params = {"rank": settings.rank, "epochs": settings.epochs, "alpha": fitted.alpha,
              "n_ratings": fitted.users.agg(F.sum("interactions")).first()[0]}
    files.log_run(spark, f"{out}/runs", "recommender", params)
    return fitted


def train_all(spark: SparkSession, raw: str, out: str, settings: Settings | None = None) -> dict[str, object]:
    """Raw files to enriched and segmented customers, fitted models and the run log."""
    settings = settings or Settings()
    customers, transactions, tariffs = load_raw(spark, raw)
    enriched = staged(rfm.merge_with_customers(customers, rfm.rfm_scores(transactions)), "enriched")
    files.write_csv(enriched, f"{out}/customers_enriched.csv")
    segmented = staged(train_segments(enriched, out, settings), "segmented")
    files.write_csv(segmented, f"{out}/customers_segmented.csv")
    best = train_churn(segmented, out, settings)
    train_recommender(transactions, tariffs, out, settings)
    return {"customers": segmented.count(), "best_churn_model": best}


def load_star(spark: SparkSession, raw: str, out: str, valid_from: str) -> dict[str, DataFrame]:
    """Star schema from the raw files; returns the stored tables."""
    customers, transactions, tariffs = load_raw(spark, raw)
    cities = customers.select(F.col("city").alias("city_name")).distinct().withColumn(
        "region", F.lit(None).cast("string"))
    tables = star.build_star(customers, transactions, tariffs, cities, valid_from)
    star.write_star(tables, out)
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}
