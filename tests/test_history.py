"""Dimensions with history: keys stay, versions close and open, facts meet the version of their day."""

import datetime as dt

import pytest

from subscope.sources import history

COLUMNS = ["city", "plan"]


def load(spark, rows, day, known=None, **options):
    frame = spark.createDataFrame(rows, "id string, city string, plan string")
    return history.load_dimension(frame, "id", "sk", COLUMNS, day, known, **options)


def rows_of(dimension):
    return {(r.sk, r.id, r.city, r.plan, str(r.valid_from), r.valid_to and str(r.valid_to)) for r in dimension.collect()}


def test_two_loads(spark):
    first = load(spark, [("a", "x", None), ("b", "x", "1"), ("c", "y", "1"), (None, "z", "1")], "2024-01-01")
    assert rows_of(first) == {(1, "a", "x", None, "2024-01-01", None), (2, "b", "x", "1", "2024-01-01", None), (3, "c", "y", "1", "2024-01-01", None)}
    second = load(spark, [("a", "x", ""), ("b", "x", "1"), ("aa", "x", "1")], "2024-03-01", first)
    assert rows_of(second) == {
        (1, "a", "x", None, "2024-01-01", "2024-03-01"), (2, "b", "x", "1", "2024-01-01", None), (3, "c", "y", "1", "2024-01-01", None),
        (4, "a", "x", "", "2024-03-01", None), (5, "aa", "x", "1", "2024-03-01", None),
    }
    again = load(spark, [("a", "x", ""), ("b", "x", "1"), ("aa", "x", "1")], "2024-03-01", second)
    assert rows_of(again) == rows_of(second)  # a repeated load changes nothing
    fixed = load(spark, [("a", "w", "2"), ("b", "x", "1"), ("aa", "x", "1")], "2024-03-01", second)
    assert (4, "a", "w", "2", "2024-03-01", None) in rows_of(fixed) and len(rows_of(fixed)) == 5
    closed = load(spark, [("b", "x", "1")], "2024-05-01", second, close_missing=True)
    assert {r[0] for r in rows_of(closed) if r[5] is None} == {2}
    back = load(spark, [("a", "x", "")], "2024-06-01", closed)
    assert (6, "a", "x", "", "2024-06-01", None) in rows_of(back)
    with pytest.raises(ValueError, match="after one of"):
        load(spark, [("a", "x", "")], "2024-02-01", second)


def test_repeated_and_empty_loads(spark):
    once = load(spark, [("a", "x", "1"), ("a", "y", "1"), ("a", "x", "1")], "2024-01-01")
    assert once.count() == 1
    assert rows_of(load(spark, [], "2024-02-01", once)) == rows_of(once)
    assert load(spark, [], "2024-02-01").count() == 0


def test_facts_meet_the_version_of_their_day(spark):
    loads = [("2024-01-01", [("a", "x", "1"), ("b", "x", "1")]), ("2024-02-01", [("a", "y", "1")]), ("2024-03-01", [("a", "x", "1"), ("b", "z", "1")])]
    made = history.load_history([(day, spark.createDataFrame(r, "id string, city string, plan string")) for day, r in loads], "id", "sk", COLUMNS)
    days = [dt.date(2023, 12, 31) + dt.timedelta(days=k) for k in range(100)]
    facts = spark.createDataFrame([(i, d, n) for n, (i, d) in enumerate((i, d) for i in ("a", "b", "q", None) for d in days)], "id string, day date, n int")
    versions = made.collect()
    for start in (False, True):
        got = {r.n: r.sk for r in history.with_version(facts, made, "id", "sk", "day", from_the_start=start).collect()}
        assert len(got) == 400
        for r in facts.collect():
            mine = [v for v in versions if v.id == r.id]
            valid = [v.sk for v in mine if v.valid_from <= r.day and (v.valid_to is None or r.day < v.valid_to)]
            first = min((v.sk for v in mine), default=None) if start else None
            assert got[r.n] == (valid[0] if valid else first)
    assert {(v.id, v.city) for v in history.as_of(made, "2024-02-15").collect()} == {("a", "y"), ("b", "x")}


def test_stored_states(spark, tmp_path):
    path = str(tmp_path / "customers")
    assert history.latest(spark, path) is None
    for day, rows in (("2024-01-01", [("a", "x", "1")]), ("2024-02-01", [("a", "y", "1")])):
        history.store(load(spark, rows, day, history.latest(spark, path)), path, day)
    assert {(r.sk, r.city) for r in history.latest(spark, path).collect()} == {(1, "x"), (2, "y")}
