"""Drift per event-time window: a stream keeps counts of reference bins, a report reads them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from subscope.functions.scalars import drift_severity
from subscope.functions.tails import kolmogorov_p
from subscope.operators.brackets import numeric, quantiles
from subscope.operators.drift import EMPTY_SHARE, KS_ALPHA, PSI_LIMIT
from subscope.session import staged
from subscope.streaming.jobs import per_batch


@dataclass(frozen=True)
class Bins:
    """Edges between the reference's percentiles per feature, and its share of each bin."""

    edges: dict[str, list[float]]
    shares: dict[str, list[float]]
    rows: dict[str, int]


def reference_bins(reference: DataFrame, columns: list[str], bins: int = 10) -> Bins:
    """The reference is read once for all windows to come; features without values are left out."""
    wide = staged(numeric(reference, columns), "reference")
    found = quantiles(wide, columns, [i / bins for i in range(1, bins)]).collect()  # columns * (bins - 1)
    edges = {c: sorted(r["quantile"] for r in found if r["feature"] == c) for c in columns}
    edges = {c: e for c, e in edges.items() if e}
    if not edges:
        return Bins({}, {}, {})
    counts = _binned(wide, edges).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # columns * bins
    held = {c: [0] * bins for c in edges}
    for r in counts:
        held[r["feature"]][r["bin"]] = r["n"]
    rows = {c: sum(n) for c, n in held.items()}
    return Bins(edges, {c: [x / rows[c] for x in n] for c, n in held.items()}, rows)


def _binned(df: DataFrame, edges: dict[str, list[float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per value: its feature and bin. Bins are closed on the left, the outer ones open."""
    def bin_of(name: str):
        value = F.col(f"`{name}`")
        at = F.size(F.filter(F.array(*[F.lit(e) for e in edges[name]]), lambda e: e <= value))
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("feature"), at.alias("bin")))

    return df.select(*keep, F.inline(F.array_compact(F.array(*[bin_of(c) for c in edges]))))


def windowed_bin_counts(stream: DataFrame, bins: Bins, time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, feature, bin, n) of a batch or a stream.

    State is one number per open window, feature and bin, whatever the stream's volume; the
    watermark lets a window go ``late`` after its end.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    clean = numeric(timed, list(bins.edges), [time])
    return (
        _binned(clean, bins.edges, (time,))
        .groupBy(F.window(time, window), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "feature", "bin", "n")
    )


def window_drift(counts: DataFrame, bins: Bins, psi_limit: float = PSI_LIMIT, ks_alpha: float = KS_ALPHA) -> DataFrame:
    """One report per window and feature from its bin counts.

    ``ks_statistic`` is the largest gap of the two distributions at the bins' edges.
    """
    spark = counts.sparkSession
    rows = [(c, k, x, bins.rows[c]) for c, shares in bins.shares.items() for k, x in enumerate(shares)]
    expected = spark.createDataFrame(rows, "feature string, bin int, expected double, reference_rows bigint")
    seen = counts.groupBy("window_start", "feature").agg(F.sum("n").alias("rows"))
    every = seen.join(F.broadcast(expected), "feature").join(counts, ["window_start", "feature", "bin"], "left")  # one row per bin
    upto = Window.partitionBy("window_start", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.coalesce("n", F.lit(0)) / F.col("rows")
    told = every.withColumn("actual", share).withColumn("gap", F.abs(F.sum("expected").over(upto) - F.sum("actual").over(upto)))

    def filled(name: str):
        return F.coalesce(F.nullif(F.col(name), F.lit(0.0)), F.lit(EMPTY_SHARE))

    a, e = filled("actual"), filled("expected")
    report = told.groupBy("window_start", "feature").agg(
        F.first("rows").alias("rows"), F.sum((a - e) * F.log(a / e)).alias("psi"), F.max("gap").alias("ks_statistic"),
        F.first("reference_rows").alias("_reference"),
    )
    p = kolmogorov_p(F.col("ks_statistic"), F.col("_reference"), F.col("rows"))
    return report.withColumn("ks_pvalue", p).withColumn(
        "drift_detected", (F.col("psi") > psi_limit) | (F.col("ks_pvalue") < ks_alpha)
    ).withColumn("severity", drift_severity(F.col("psi"))).drop("_reference")


def upsert_bins(stream: DataFrame, bins: Bins, out: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Every change of a window's counts, open windows included; ``latest_bins`` reads the newest."""
    counts = windowed_bin_counts(stream, bins, **options)
    return per_batch(counts, lambda batch, number: batch, out, checkpoint, available_now, mode="update")


def latest_bins(spark, out: str) -> DataFrame:
    schema = "window_start timestamp_ntz, feature string, bin int, n bigint, batch bigint"
    return spark.read.schema(schema).parquet(out).groupBy("window_start", "feature", "bin").agg(F.max_by("n", "batch").alias("n"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was let go, over the batches that the query still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
