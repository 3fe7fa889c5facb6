"""Drift per event-time window and recommendations from lists, as streams and as batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subscope.operators import drift
from subscope.plans import scoring
from subscope.sources import tables as t
from subscope.streaming import jobs, windows


def test_reference_bins_are_its_percentiles(spark, small):
    events = t.table(spark, small, "events")
    bins = windows.reference_bins(events, ["value", "user_id"])
    values = [r.value for r in events.select("value").collect() if r.value is not None]
    assert bins.edges["value"] == pytest.approx(np.quantile(values, [i / 10 for i in range(1, 10)]).tolist())
    assert sum(bins.shares["value"]) == pytest.approx(1) and bins.rows["value"] == len(values)
    assert windows.reference_bins(events.where("false"), ["value"]).edges == {}


def test_windows_equal_the_batch_report(spark, small, tmp_path):
    """Psi of a window is that of the plain report on the window's rows; counts survive restarts."""
    events = t.table(spark, small, "events").where("ts is not null")
    reference, cut = events.where("ts < '2024-01-11'"), "2024-01-20"
    bins = windows.reference_bins(reference, ["value"])
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in (f"ts < '{cut}'", f"ts >= '{cut}'"):
        events.where(part).write.mode("append").parquet(source)
        query = windows.upsert_bins(jobs.read_files(spark, source, jobs.EVENTS), bins, out, progress)
        query.awaitTermination()
        assert windows.late_rows(query) == 0
    counts = windows.latest_bins(spark, out)
    assert counts.agg(F.sum("n")).first()[0] == events.where("value is not null").count()
    report = {r.window_start: r for r in windows.window_drift(counts, bins).collect()}
    for day in ("2024-01-05", "2024-01-25"):
        rows = events.where(F.to_date("ts") == day)
        plain = drift.population_stability_index(reference, rows, ["value"]).first()["psi"]
        held = next(r for k, r in report.items() if str(k).startswith(day))
        assert held.psi == pytest.approx(plain, abs=1e-9) and held.rows == rows.where("value is not null").count()
        exact = drift.ks_test(reference, rows, ["value"]).first()["ks_statistic"]
        assert 0 <= held.ks_statistic <= exact + 1e-9


def test_late_rows_are_counted_apart(spark, tmp_path):
    bins = windows.Bins({"value": [1.0]}, {"value": [0.5, 0.5]}, {"value": 10})
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    late = 0
    for k, (day, n) in enumerate([("2024-01-01", 4), ("2024-01-10", 3), ("2024-01-11", 1), ("2024-01-01", 2)]):
        spark.range(n).selectExpr("id AS event_id", f"timestamp_ntz'{day} 12:00:00' AS ts", "id AS user_id", "'x' AS event_type", "double(id) AS value", "'' AS props").write.mode("append").parquet(source)
        query = windows.upsert_bins(jobs.read_files(spark, source, jobs.EVENTS), bins, out, progress)
        query.awaitTermination()
        late += windows.late_rows(query)
    counts = windows.latest_bins(spark, out)
    assert late > 0 and counts.agg(F.sum("n")).first()[0] == 8


def test_lists_answer_as_the_batch_does(spark, small, tmp_path):
    from subscope.operators import recommend

    purchases = t.brand_purchases(spark, small)
    model = recommend.Recommender(rank=2, epochs=2).fit(purchases, t.brand_catalog(spark, small))
    asked = spark.createDataFrame([
        (1, 7, None, None, "hybrid", 2), (2, 7, None, None, "collaborative", 3), (3, None, "Brand#3", None, "similar", 4),
        (4, None, None, "G1", "cold_start", 2), (5, None, None, None, "hybrid", 3), (6, 999_999, None, None, "hybrid", 2),
        (7, None, "nowhere", None, "similar", 2), (8, None, "Brand#1", "G2", "other", 10), (9, 7, None, None, "hybrid", 99),
        (10, 7, None, None, "hybrid", 0), (11, None, None, None, "cold_start", None), (12, None, None, "no such", "cold_start", 3),
        (13, 999_999, None, None, "collaborative", 4), (1, 7, None, None, "hybrid", 2),
    ], "request_id int, customer_id bigint, current_tariff string, category string, mode string, n int")
    lists = scoring.recommendation_lists(model)
    from subscope.session import staged

    lists = staged(lists, "lists")
    order = ["request_id", "rank", "tariff_id", "mode", "route", "name", "monthly_price", "data_gb", "category", "score", "status"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(map(tuple, scoring.score_recommendations(model, asked).select(*order).collect()), key=key)
    assert sorted(map(tuple, scoring.score_from_lists(lists, asked).select(*order).collect()), key=key) == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    asked.repartition(3).write.parquet(source)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    jobs.to_parquet(jobs.recommend_stream(jobs.read_files(spark, source, kinds), lists), out, str(tmp_path / "progress")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select(*order).collect()), key=key) == want
    assert math.isfinite(sum(r[9] for r in want if r[9] is not None))
