"""Counters of a stream that last: additive runs, merged in tiers, late rows counted apart.

Every micro-batch writes its own counts as a run. Whenever ``fan_in`` runs of one tier are
complete, the last of them is followed by a run that holds their sums, so a count is
rewritten once per tier, and a reader adds up at most ``fan_in - 1`` runs per tier. Runs are
named by the batches they cover and depend on nothing but those: a batch that is
repeated after a failure overwrites its runs with the same rows. A run that a larger one covers is dropped
a batch later.

There is no watermark, hence no state in memory and no row lost: a row of any age goes to its
own window. ``late`` counts the rows older than the newest time of all earlier batches by
more than the lateness allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from subscope.plans.scoring import cumulative_buckets, latency_bucket

RUN = re.compile(r"from=(\d+)/upto=(\d+)/_SUCCESS$")
MEASURES = "requests bigint, late bigint"
REQUESTS = "window_start timestamp_ntz, endpoint string, status string"
LATENCIES = "endpoint string, bucket int"


def _found(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def _runs(spark: SparkSession, out: str) -> dict[tuple[int, int], str]:
    """(first batch, last batch) of every complete run, and its folder."""
    paths = _found(spark, f"{out}/from=*/upto=*/_SUCCESS")
    return {tuple(map(int, RUN.search(p).groups())): p.rsplit("/", 1)[0] for p in paths}


def _cover(runs) -> list[tuple[int, int]]:
    """The fewest runs that hold every batch once, from the last one down."""
    kept: list[tuple[int, int]] = []
    for first, last in sorted(runs, key=lambda r: (-r[1], r[0])):
        if not kept or last < kept[-1][0]:
            kept.append((first, last))
    return kept


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("requests").alias("requests"), F.sum("late").alias("late"))


def totals(spark: SparkSession, out: str, keys: str) -> DataFrame:
    """``keys`` (as a schema) with ``requests`` and ``late`` over all batches so far."""
    runs = _runs(spark, out)
    schema, names = f"{keys}, {MEASURES}", [part.split()[0] for part in keys.split(", ")]
    if not runs:
        return spark.createDataFrame([], schema)
    return _sums(spark.read.schema(schema).parquet(*[runs[r] for r in _cover(runs)]), names)


def _newest_before(spark: SparkSession, out: str, number: int):
    marks = {int(p.rsplit("=", 1)[1].split("/")[0]): p for p in _found(spark, f"{out}/marks/batch=*/_SUCCESS")}
    earlier = [n for n in marks if n < number]
    if not earlier:
        return None
    return spark.read.schema("newest timestamp_ntz").parquet(marks[max(earlier)].rsplit("/", 1)[0]).first()[0]


def _drop_covered(spark: SparkSession, out: str, number: int) -> None:
    runs = _runs(spark, out)
    settled = {r: p for r, p in runs.items() if r[1] < number}
    files = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for run in set(settled) - set(_cover(settled)):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(settled[run]), True)


def add_batch(
    batch: DataFrame, number: int, out: str, keys: dict[str, Column], lateness: str = "10 minutes", fan_in: int = 8
) -> None:
    """Count one batch, merge the tiers it completes, and drop what earlier batches left covered."""
    spark = batch.sparkSession
    newest = _newest_before(spark, out, number)
    late = F.lit(False)
    if newest is not None:
        late = F.col("ts") < F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {lateness}")
    kept = batch.persist()
    try:
        counts = kept.groupBy(*[column.alias(name) for name, column in keys.items()]).agg(
            F.count(F.lit(1)).alias("requests"), F.count_if(late).alias("late")
        )
        counts.write.mode("overwrite").parquet(f"{out}/from={number}/upto={number}")
        mark = F.greatest(F.max(F.col("ts").cast("timestamp_ntz")), F.lit(newest).cast("timestamp_ntz")).alias("newest")
        kept.agg(mark).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")
    finally:
        kept.unpersist()
    width = fan_in
    while (number + 1) % width == 0:
        first = number + 1 - width
        runs = _runs(spark, out)
        held = [r for r in _cover(r for r in runs if r[0] >= first and r[1] <= number and r != (first, number))]
        merged = _sums(spark.read.schema(counts.schema).parquet(*[runs[r] for r in held]), list(keys))
        merged.write.mode("overwrite").parquet(f"{out}/from={first}/upto={number}")
        width *= fan_in
    _drop_covered(spark, out, number)


def count_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: dict[str, Column],
    lateness: str = "10 minutes",
    fan_in: int = 8,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the counts of a stream with a time ``ts`` in ``out``; ``totals`` reads them."""
    if fan_in < 2:
        raise ValueError("a tier needs at least two runs")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: add_batch(batch, number, out, keys, lateness, fan_in)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def request_keys(window: str = "hour") -> dict[str, Column]:
    start = F.date_trunc(window, "ts").cast("timestamp_ntz")
    return {"window_start": start, "endpoint": F.col("endpoint"), "status": F.col("status")}


def latency_keys() -> dict[str, Column]:
    return {"endpoint": F.col("endpoint"), "bucket": latency_bucket()}


def latency_totals(spark: SparkSession, out: str) -> DataFrame:
    """The cumulative histogram of ``latency_buckets`` from what ``count_stream`` kept."""
    counts = totals(spark, out, LATENCIES).where(F.col("bucket").isNotNull())
    return cumulative_buckets(counts.select("endpoint", "bucket", F.col("requests").alias("n")))
