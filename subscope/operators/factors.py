"""Alternating least squares of many customers with few plans, without moving customer factors.

The rounds are those of ``pyspark.ml.recommendation.ALS``, which sends every customer's
factors to every block of plans in each of them. With few plans their factors go to the
customers instead: a task solves its customers and keeps only what the plans' equations
need of them, sums whose size depends on the number of plans.

A customer's factors are a mix of the factors of the rated plans, x = a Y, where a solves
(Y Y' + penalty * ratings) a = ratings over the rated plans. So the sums are over the
short a, and plan i solves (Y' (sum of a a') Y + penalty * ratings) y = Y' (sum of rating * a).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from subscope.session import ship, staged

#: Catalogs of at most so many plans are fitted this way; sums grow with their cube.
FEW_PLANS = 64
# doubles that a task holds at once for the systems of a run of customers
CELLS = 1_000_000


def _mixes(batch: pa.RecordBatch, codes: np.ndarray, near: np.ndarray, penalty: float) -> Iterator[tuple]:
    """(slice, rated, ratings, mixes) of runs of customers; the last three are customer by plan."""
    step = max(1, CELLS // len(codes) ** 2)
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        count = part.column("codes").value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(count)), count)
        place = np.searchsorted(codes, part.column("codes").flatten().to_numpy())
        rated, rest = np.zeros((2, len(count), len(codes)))
        rated[row, place] = 1.0
        rest[row, place] = part.column("rests").flatten().to_numpy()
        system = near * rated[:, :, None] * rated[:, None, :]
        own = np.arange(len(codes))
        system[:, own, own] += (penalty * count)[:, None]
        yield slice(start, start + len(count)), rated, rest, np.linalg.solve(system, rest[:, :, None])[:, :, 0]


def _next_plans(held: DataFrame, codes: np.ndarray, plans: np.ndarray, penalty: float) -> np.ndarray:
    """The factors of the plans after the customers took theirs from ``plans``."""
    size, near = len(codes), plans @ plans.T

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, mixed, ratings = np.zeros((size, size, size)), np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for _, rated, rest, mix in _mixes(batch, codes, near, penalty):
                for i in range(size):
                    mine = mix[rated[:, i] > 0]
                    squares[i] += mine.T @ mine
                mixed += rest.T @ mix
                ratings += rated.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(squares.reshape(size, -1)), pa.list_(pa.float64())),
             pa.array(list(mixed), pa.list_(pa.float64())), pa.array(ratings, pa.float64())],
            names=["plan", "squares", "mixed", "ratings"],
        )

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(part["squares"].to_list(), axis=0).reshape(size, size)
        system = plans.T @ total @ plans + penalty * part["ratings"].sum() * np.eye(plans.shape[1])
        found = np.linalg.solve(system, plans.T @ np.sum(part["mixed"].to_list(), axis=0))
        return pd.DataFrame({"plan": part["plan"].iloc[:1], "factors": [found]})

    sums = held.mapInArrow(summed, "plan int, squares array<double>, mixed array<double>, ratings double")
    rows = sums.groupBy("plan").applyInPandas(solved, "plan int, factors array<double>").orderBy("plan").collect()
    # one row per plan; stored as single floats, as the library's factors are
    return np.array([r["factors"] for r in rows], dtype=np.float32).astype(float)


def factorise(residual: DataFrame, plans: int, rank: int, epochs: int, penalty: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, features) of users and of codes for ``residual`` (user, code, rest), of ``plans`` codes.

    The first round, with its random start, is the library's; for a larger catalog all are.
    """
    few = 0 < plans <= FEW_PLANS and epochs > 1
    als = ALS(
        rank=rank, maxIter=1 if few else epochs, regParam=penalty, seed=seed,
        userCol="user", itemCol="code", ratingCol="rest",
    )
    model = als.fit(residual)
    if not few:
        return model.userFactors, model.itemFactors
    spark = residual.sparkSession
    ship(spark)
    first = model.itemFactors.orderBy("id").collect()  # at most FEW_PLANS
    codes = np.array([r["id"] for r in first])
    factors = np.array([r["features"] for r in first], dtype=float)
    pair = F.struct("code", F.col("rest").cast("float").alias("rest"))
    held = staged(
        residual.groupBy(F.col("user").alias("id")).agg(F.collect_list(pair).alias("own"))  # at most one per plan
        .select("id", F.col("own.code").alias("codes"), F.col("own.rest").alias("rests")),
        "own-ratings",
    )
    for _ in range(epochs - 1):
        factors = _next_plans(held, codes, factors, penalty)
    near = factors @ factors.T

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, _, _, mix in _mixes(batch, codes, near, penalty):
                made = pa.array(list((mix @ factors).astype(np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("id")[run.start : run.stop], made], names=["id", "features"])

    kinds = "id int, features array<float>"
    listed = [(int(c), [float(v) for v in f]) for c, f in zip(codes, factors)]
    return held.mapInArrow(taken, kinds), spark.createDataFrame(listed, kinds)
