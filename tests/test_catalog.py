"""Top-n search over a catalog in blocks: exact, pruned, and bounded in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subscope.operators import catalog, recommend
from subscope.session import staged


def frame_of(spark, vectors, bias=None, clip=None):
    rows = [(f"p{k:05d}", v.tolist(), float(bias[k]) if bias is not None else 0.0) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "tariff_id string, factors array<double>, bias double")


def inner_products():
    """Made inside a function, so that it travels to the workers by value."""

    def inner(batch, block):
        values = catalog.matrix(batch["factors"]) @ catalog.matrix(block["factors"]).T + block["bias"].to_numpy()[None, :]
        return np.clip(values, -1.0, 1.0), np.ones_like(values, dtype=bool)

    return inner


def expected(users, items, bias, n):
    values = np.round(np.clip(users @ items.T + bias[None, :], -1.0, 1.0), catalog.DIGITS)
    return {u: [(f"p{k:05d}", row[k]) for k in sorted(range(len(row)), key=lambda k: (-row[k], k))[:n]] for u, row in enumerate(values)}


@pytest.mark.parametrize("spread", [0.2, 3.0])  # 3.0: most of the best scores are clipped and tie
def test_falling_norms_stop_early(spark, spread):
    rng = np.random.default_rng(2)
    items = rng.normal(size=(600, 4)) * (spread / (1 + np.arange(600)))[:, None]
    items, bias = items[rng.permutation(600)], rng.normal(size=600) * 0.001
    users = rng.normal(size=(50, 4))
    table = frame_of(spark, items, bias).withColumn("_fall", -F.sqrt(F.aggregate("factors", F.lit(0.0), lambda t, v: t + v * v)))
    laid, blocks = catalog.cut(table, ["_fall", "tariff_id"], "block", 40, "laid")
    limits = catalog.reach(laid, "block", "factors", "bias")
    assert blocks == len(limits) == 15 and laid.groupBy("block").count().where("count <> 40").isEmpty()
    rows = staged(spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(users)], "u int, factors array<double>"), "users")
    got = catalog.best(
        rows, "u", laid, "block", blocks, inner_products(), 5, 100, first=F.lit(0), limits=limits,
        vector=lambda b: (catalog.matrix(b["factors"]), np.zeros(len(b))), between=(-1.0, 1.0),
    )
    made = {}
    for r in got.orderBy("u", "rank").collect():
        made.setdefault(r.u, []).append((r.tariff_id, r.score))
    assert made == expected(users, items, bias, 5)
    # a bound is never below a score, and leaves most blocks of short vectors out
    held = {r.tariff_id: r.block for r in laid.collect()}
    bounds = limits.bounds(users)
    scores = users @ items.T + bias[None, :]
    assert all(scores[u, k] <= bounds[u, held[f"p{k:05d}"]] + 1e-9 for u in range(50) for k in range(600))
    if spread < 1:
        least = np.array([made[u][-1][1] for u in range(50)])
        assert (bounds >= least[:, None] - catalog.SLACK).mean() < 0.5


def test_neighbours_by_pivots(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 6))
    raw = np.repeat(middles, 40, axis=0) + rng.normal(size=(480, 6)) * 0.02
    raw[7] = 0
    raw[9] = raw[8]  # a tie
    vectors = np.where(np.linalg.norm(raw, axis=1)[:, None] > 0, raw / np.maximum(np.linalg.norm(raw, axis=1)[:, None], 1e-300), 0)
    items = staged(spark.createDataFrame([(f"p{k:05d}", v.tolist()) for k, v in enumerate(vectors)], "tariff_id string, vec array<double>"), "items")
    values = np.round(vectors @ vectors.T, catalog.DIGITS)
    for with_self in (False, True):
        got = {}
        for r in recommend.similar_plans(items, 4, block_items=40, with_self=with_self).orderBy("anchor", "rank").collect():
            got.setdefault(r.anchor, []).append(r.tariff_id)
        for a in range(480):
            order = sorted((k for k in range(480) if with_self or k != a), key=lambda k: (-values[a, k], k))[:4]
            assert got[f"p{a:05d}"] == [f"p{k:05d}" for k in order]
    laid, _ = catalog.cut(catalog.by_pivots(items, "vec", "tariff_id", 12), ["pivot", "tariff_id"], "cell", 40, "cells")
    bounds = catalog.reach(laid, "cell", "vec").bounds(vectors)
    fourth = -np.sort(-values, axis=1)[:, 4]
    assert (bounds >= fourth[:, None] - catalog.SLACK).mean() < 0.6


def test_a_million_plans(spark):
    """No unit ever holds more than a group of rows and one block."""
    angle = F.col("id") * 0.37
    items = spark.range(1_000_000).select(
        F.format_string("p%07d", "id").alias("tariff_id"), F.lit(0.0).alias("bias"), (F.lit(-1.0) / (1 + F.col("id"))).alias("_fall"),
        F.array(F.sin(angle) / (1 + F.col("id")), F.cos(angle) / (1 + F.col("id"))).alias("factors"),
    )
    laid, blocks = catalog.cut(items, ["_fall", "tariff_id"], "block", 50_000, "million")
    assert blocks == 20
    limits = catalog.reach(laid, "block", "factors", "bias")
    seen, inner, most = spark.sparkContext.accumulator(0), inner_products(), recommend.CELLS

    def scorer(batch: pd.DataFrame, block: pd.DataFrame):
        seen.add(1)
        assert len(block) <= 50_000 and len(batch) * len(block) <= most
        return inner(batch, block)

    rows = spark.range(200).select(F.col("id").alias("u"), F.array(F.sin("id"), F.cos("id")).alias("factors"))
    got = catalog.best(
        rows, "u", laid.select("tariff_id", "factors", "bias", "block"), "block", blocks, scorer, 3, recommend.CELLS, first=F.lit(0), limits=limits,
        vector=lambda b: (catalog.matrix(b["factors"]), np.zeros(len(b))), between=(-1.0, 1.0),
    ).collect()
    k = np.arange(1_000_000)
    for u in (0, 57, 199):
        score = np.round(np.clip((np.sin(u) * np.sin(0.37 * k) + np.cos(u) * np.cos(0.37 * k)) / (1 + k), -1, 1), 9)
        want = sorted(np.argsort(-score, kind="stable")[:3].tolist(), key=lambda i: (-score[i], i))
        assert [r.tariff_id for r in sorted((r for r in got if r.u == u), key=lambda r: r["rank"])] == [f"p{i:07d}" for i in want]
    assert 0 < seen.value <= 10  # a first block in three pieces, and nothing that cannot help
