"""Streaming jobs against their batch results."""

import pytest
from pyspark.sql import functions as F

from subscope.operators import churn, drift, rfm, segments
from subscope.session import staged
from subscope.sources import generate, tables as t
from subscope.streaming import jobs


def split_files(df, path, n=3):
    """Several files in event order, so that the stream takes several batches."""
    for i in range(n):
        df.where(F.pmod(F.col("_part"), F.lit(n)) == i).drop("_part").coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def people(spark):
    made = generate.generate_customers(spark, 200, seed=4)
    moves = generate.generate_transactions(made, 4, 4)
    return staged(rfm.merge_with_customers(made, rfm.rfm_scores(moves)), "people")


def test_window_counts_survive_a_restart(spark, small, tmp_path):
    events = t.table(spark, small, "events")
    cut = events.agg(F.min("ts") + F.expr("interval 10 days")).first()[0]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    events.where(F.col("ts") < cut).write.parquet(source)

    def run():
        log = t.request_columns(jobs.read_files(spark, source, jobs.EVENTS))
        jobs.to_parquet(jobs.windowed_request_counts(log), out, progress).awaitTermination()
        return spark.read.parquet(out)

    first = run().count()
    events.where(F.col("ts") >= cut).write.mode("append").parquet(source)
    result = run()
    assert result.count() > first
    last = events.agg(F.max("ts")).first()[0]
    want = (
        t.request_log(spark, small)
        .groupBy(F.window("ts", "1 hour").alias("w"), "endpoint", "status").agg(F.count("*").alias("requests"))
        .where(F.col("w.end") <= F.lit(last).cast("timestamp_ntz") - F.expr("interval 10 minutes"))
        .select(F.col("w.start").alias("window_start"), "endpoint", "status", "requests")
    )
    assert sorted(result.select(want.columns).collect()) == sorted(want.collect())


def test_running_counts_hold_every_event(spark, small, tmp_path):
    events = t.table(spark, small, "events")
    cut = events.agg(F.min("ts") + F.expr("interval 10 days")).first()[0]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        events.where(part).write.mode("append").parquet(source)
        log = t.request_columns(jobs.read_files(spark, source, jobs.EVENTS))
        jobs.upsert_counts(log, out, progress).awaitTermination()
    result = jobs.running_counts(spark, out)
    assert result.agg(F.sum("requests")).first()[0] == events.count()
    assert result.count() == result.select("window_start", "endpoint", "status").distinct().count()


def test_scoring_streams_equal_batch_scoring(spark, people, tmp_path):
    rows = people.drop("r_score", "f_score", "m_score", "rfm_score")
    source = str(tmp_path / "requests")
    split_files(rows.withColumn("_part", F.col("age")), source)
    schema = spark.read.parquet(source).schema.simpleString()[7:-1].replace(":", " ")
    model = churn.ChurnModel(trees=3, depth=3).fit(rows)
    segmenter = segments.Segmenter(3, restarts=1).fit(people)
    pairs = [
        ("churn", lambda s: jobs.score_churn_stream(s, model).drop("top_factors"), model.score(rows).drop("top_factors")),
        ("segment", lambda s: jobs.segment_stream(s, segmenter), segmenter.predict(rows)),
    ]
    for name, build, batch in pairs:
        out = str(tmp_path / name)
        stream = build(jobs.read_files(spark, source, schema))
        jobs.to_parquet(stream, out, f"{out}-progress").awaitTermination()
        got = spark.read.parquet(out)
        columns = ["customer_id", *[c for c in batch.columns if c not in rows.columns]]
        assert sorted(got.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_drift_per_batch(spark, small, tmp_path):
    reference, current = t.drift_sides(spark, small, 1.3)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    current.coalesce(1).write.parquet(source)
    schema = "l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    jobs.drift_stream(jobs.read_files(spark, source, schema), reference, out, str(tmp_path / "p")).awaitTermination()
    got = spark.read.parquet(out).where("batch = 0").drop("batch")
    assert sorted(got.collect()) == sorted(drift.drift_report(reference, current).collect())
