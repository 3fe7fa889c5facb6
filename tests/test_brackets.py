"""Exact quantiles from sketches and brackets."""

import random

import numpy as np
import pytest

from subscope.operators import brackets
from subscope.session import staged

MARKS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("few", [200_000, 3])
def test_equals_sorting(spark, monkeypatch, few):
    """``few``: with 3, even the rows inside the brackets are ordered in slices."""
    monkeypatch.setattr(brackets, "FEW", few)
    monkeypatch.setattr(brackets, "ACCURACY", 64)  # brackets hold many values
    rnd = random.Random(6)
    rows = []
    for k in range(6000):
        same = 7.5 if k % 3 == 0 else rnd.gauss(0, 100)  # a third of all rows are one value
        rows.append((k % 2 if k % 50 else 2, same, None if k % 4 else float(k), float("nan") if k % 5 == 0 else rnd.choice([1.0, 2.0]), None))
    frame = spark.createDataFrame(rows, "g int, a double, `b c` double, d double, e double")
    columns = ["a", "b c", "d", "e"]
    wide = staged(brackets.numeric(frame, columns, ["g"]), "wide")

    def want(part):
        out = {}
        for i, c in enumerate(columns):
            values = [r[i + 1] for r in part if r[i + 1] is not None and r[i + 1] == r[i + 1]]
            for p in MARKS if values else []:
                out[c, p] = float(np.quantile(values, p))
        return out

    whole = {(r.feature, r.p): r.quantile for r in brackets.quantiles(wide, columns, MARKS).collect()}
    assert whole == pytest.approx(want(rows), abs=1e-9)
    classes = {}
    for r in brackets.quantiles(wide, columns, MARKS, "g").collect():
        classes.setdefault(r.g, {})[r.feature, r.p] = r.quantile
    for g in (0, 1, 2):
        assert classes[g] == pytest.approx(want([r for r in rows if r[0] == g]), abs=1e-9)


def test_few_rows_stay_in_the_brackets(spark):
    frame = spark.range(200_000).selectExpr("double(xxhash64(id) % 1000003) AS v")
    wide = staged(brackets.numeric(frame, ["v"]), "wide")
    (row,) = brackets.quantiles(wide, ["v"], [0.5]).collect()
    assert row.quantile == float(np.median([r.v for r in frame.collect()]))


def test_nothing_to_rank(spark):
    frame = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert brackets.quantiles(staged(brackets.numeric(frame, ["v"]), "wide"), ["v"], [0.5]).collect() == []
