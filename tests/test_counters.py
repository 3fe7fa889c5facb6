"""Counters of a stream: merged runs, late rows, repeated batches."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from subscope.streaming import counters

START = dt.datetime(2024, 3, 1)


def batches(n):
    """Batch ``i`` holds rows of hour ``i`` and, in every third one, two rows of hour 0."""
    out = []
    for i in range(n):
        rows = [(START + dt.timedelta(hours=i, minutes=m), "a" if m % 2 else "b", "200", 0.01 * m) for m in range(i % 4 + 1)]
        if i % 3 == 2:
            rows += [(START, "a", "500", None)] * 2
        out.append(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, endpoint string, status string, seconds double")


def state(spark, out):
    found = counters.totals(spark, out, counters.REQUESTS).collect()
    return {(r["window_start"], r["endpoint"], r["status"]): (r["requests"], r["late"]) for r in found}


def expected(parts):
    total, late = Counter(), Counter()
    newest = None
    for rows in parts:
        for ts, endpoint, status, _ in rows:
            key = (ts.replace(minute=0), endpoint, status)
            total[key] += 1
            late[key] += newest is not None and ts < newest - dt.timedelta(minutes=10)
        newest = max([r[0] for r in rows] + ([newest] if newest else []))
    return {k: (n, late[k]) for k, n in total.items()}


def test_sums_hold_after_every_batch(spark, tmp_path):
    out, parts = str(tmp_path / "runs"), batches(10)
    for i, rows in enumerate(parts):
        counters.add_batch(frame(spark, rows), i, out, counters.request_keys(), fan_in=3)
        if i in (0, 2, 5, 8, 9):
            assert state(spark, out) == expected(parts[: i + 1])
    runs = counters._runs(spark, out)
    assert sorted(runs) == [(0, 8), (9, 9)]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    out, parts = str(tmp_path / "runs"), batches(4)
    for i in (0, 1, 1, 2, 3, 3):
        counters.add_batch(frame(spark, parts[i]), i, out, counters.request_keys(), fan_in=2)
    assert state(spark, out) == expected(parts)


def test_an_unfinished_run_is_not_read(spark, tmp_path):
    out, parts = str(tmp_path / "runs"), batches(3)
    for i, rows in enumerate(parts):
        counters.add_batch(frame(spark, rows), i, out, counters.request_keys(), fan_in=8)
    broken = tmp_path / "runs" / "from=0" / "upto=2"
    broken.mkdir(parents=True)
    assert state(spark, out) == expected(parts)


@pytest.mark.parametrize("runs, kept", [
    ([(0, 0), (1, 1), (0, 1), (2, 2)], [(2, 2), (0, 1)]),
    ([(0, 0), (2, 2)], [(2, 2), (0, 0)]),
    ([(i, i) for i in range(4)] + [(0, 1), (2, 3), (0, 3)], [(0, 3)]),
])
def test_cover(runs, kept):
    assert counters._cover(runs) == kept


def test_nothing_counted_and_null_times(spark, tmp_path):
    out = str(tmp_path / "runs")
    assert state(spark, out) == {}
    counters.add_batch(frame(spark, [(None, None, "200", 1.0), (None, None, "200", 2.0)]), 0, out, counters.request_keys())
    counters.add_batch(frame(spark, [(START, "a", "200", 1.0)]), 1, out, counters.request_keys())
    assert state(spark, out) == {(None, None, "200"): (2, 0), (START, "a", "200"): (1, 0)}
    with pytest.raises(ValueError):
        counters.count_stream(frame(spark, []), out, out, {}, fan_in=1)
