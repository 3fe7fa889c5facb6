import numpy as np
import pytest
from pyspark.ml.recommendation import ALS

from subscope.operators import factors


def made(spark, customers, plans):
    rng = np.random.default_rng(4)
    rows = [
        (u, int(c), float(rng.normal()))
        for u in range(1, customers + 1)
        for c in rng.choice(np.arange(1, plans + 1), rng.integers(1, plans), replace=False)
        if c != 3  # a plan of the catalog that nobody rated
    ]
    return spark.createDataFrame(rows, "user int, code int, rest double")


def by_id(table):
    return {r["id"]: np.array(r["features"]) for r in table.collect()}


@pytest.mark.parametrize("cells", [1_000_000, 50])
def test_few_plans_get_the_factors_of_the_library(spark, monkeypatch, cells):
    residual, rounds = made(spark, 90, 9), []

    def noted(**given):
        rounds.append(given["maxIter"])
        return ALS(**given)

    monkeypatch.setattr(factors, "ALS", noted)
    monkeypatch.setattr(factors, "CELLS", cells)
    users, codes = factors.factorise(residual, 9, 12, 6, 0.1, 42)
    assert rounds == [1]  # the rounds that move the factors of all customers
    want = ALS(rank=12, maxIter=6, regParam=0.1, seed=42, userCol="user", itemCol="code", ratingCol="rest").fit(residual)
    for got, told in ((by_id(users), by_id(want.userFactors)), (by_id(codes), by_id(want.itemFactors))):
        assert got.keys() == told.keys()
        assert max(np.abs(got[k] - told[k]).max() for k in told) < 1e-4


def test_a_larger_catalog_is_fitted_by_the_library(spark, monkeypatch):
    monkeypatch.setattr(factors, "FEW_PLANS", 8)
    users, codes = factors.factorise(made(spark, 30, 9), 9, 4, 2, 0.1, 42)
    assert 0 < users.count() <= 30
    assert set(by_id(codes)) == {1, 2, 4, 5, 6, 7, 8, 9}
