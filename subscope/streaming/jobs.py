"""Streaming jobs: request counters, scoring, and drift per micro-batch.

Every job reads files as they arrive and keeps its progress in a checkpoint folder. With
``available_now`` a job handles what is there and stops, which is how it is scheduled in
batch windows and how it is tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from subscope.operators.drift import drift_report
from subscope.operators.quality import split_valid, validate_features, validate_segment_requests
from subscope.plans.scoring import score_from_lists

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_files(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_request_counts(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests per tumbling window, endpoint and status.

    The watermark bounds the state: a window is emitted, and forgotten, once event time
    has passed its end by ``late``.
    """
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a zoned time
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window), "endpoint", "status")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "endpoint", "status", "requests")
    )


def running_counts(spark: SparkSession, out: str) -> DataFrame:
    """The latest count of every window, open ones included, from what ``upsert_counts`` wrote."""
    schema = "window_start timestamp_ntz, endpoint string, status string, requests bigint, batch bigint"
    return (
        spark.read.schema(schema).parquet(out)
        .groupBy("window_start", "endpoint", "status").agg(F.max_by("requests", "batch").alias("requests"))
    )


def upsert_counts(log: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Every change of a window's count, open windows included; ``running_counts`` reads the latest."""
    return per_batch(
        windowed_request_counts(log), lambda batch, number: batch, out, checkpoint, available_now, mode="update"
    )


def to_parquet(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append-only, exactly-once file sink."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)


def per_batch(
    stream: DataFrame,
    job: Callable[[DataFrame, int], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = True,
    mode: str = "append",
) -> StreamingQuery:
    """Write ``job(batch, number)`` under ``batch=<number>``; a repeated batch overwrites itself.

    The batch is kept for the passes of its job and released once the result is written.
    """
    def handle(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            job(kept, number).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def score_churn_stream(requests: DataFrame, model) -> DataFrame:
    """Scoring responses for the valid requests of a stream; stateless."""
    valid, _ = split_valid(validate_features(requests))
    return model.score(valid)


def segment_stream(requests: DataFrame, segmenter) -> DataFrame:
    """Segment per valid request of a stream; stateless."""
    valid, _ = split_valid(validate_segment_requests(requests))
    return segmenter.predict(valid)


def recommend_stream(requests: DataFrame, lists: DataFrame) -> DataFrame:
    """Recommendations for the requests of a stream, from lists worked out before; stateless."""
    return score_from_lists(lists, requests)


def drift_stream(
    stream: DataFrame, reference: DataFrame, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Drift report of every micro-batch against a fixed reference."""
    def report(batch: DataFrame, number: int) -> DataFrame:
        return drift_report(reference, batch)

    return per_batch(stream, report, out, checkpoint, available_now)
