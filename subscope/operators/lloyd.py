"""K-means of many models in one loop: all restarts and all numbers of clusters together.

Every pass over the rows serves all models that still move. A task multiplies its rows with
the centres of all models at once, adds up its own rows and sends one row per centre, so a
pass shuffles centres, never points, and the driver sees models times clusters rows. Models
that stand still leave the loop.

Seeding follows k-means|| (Bahmani et al., 2012): each step adds ``2 k`` rows per model, drawn
by squared distance as the smallest of -log(u) / distance (Efraimidis and Spirakis, 2006), in
one pass without the total. u is a digest of the coordinates, so the draw is the same
under any partitioning. Candidates, weighted by the rows nearest to them, shrink to k centres
by weighted k-means++ on the driver, which holds 2 k STEPS + 1 candidates per model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from subscope.session import ship

#: Seeding passes; movement of a centre below which a model stands still; passes at most.
STEPS, STILL, PASSES = 2, 1e-4, 300
#: Distances a task holds at a time.
CELLS = 2_000_000


@dataclass(frozen=True)
class Fitted:
    """One model: its centres, the rows per centre, and the squared distances summed."""

    k: int
    restart: int
    centres: np.ndarray
    sizes: np.ndarray
    inertia: float


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _draws(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) per row, by its coordinates."""
    mixed = np.full(len(x), seed, dtype=np.uint64)
    for column in (x + 0.0).T:  # -0.0 and 0.0 are one value
        mixed ^= np.ascontiguousarray(column).view(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
    return ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _blocks(batches, centres: int):
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if not np.isfinite(x).all():
            raise ValueError("rows with a null or non-finite feature; fill or drop them first")
        step = max(1, CELLS // max(1, centres))
        for start in range(0, len(x), step):
            yield x[start : start + step]


def _first(points: DataFrame, seeds: list[int]) -> list[np.ndarray]:
    """One row per seed, by smallest digest."""
    row = F.array(*points.columns)
    found = points.agg(*[
        F.min(F.struct(F.xxhash64(F.lit(s), *points.columns).alias("h"), row.alias("p"))).alias(f"s{i}")
        for i, s in enumerate(seeds)
    ]).first()
    if found[0] is None:
        raise ValueError("no rows to cluster")
    return [np.array([found[f"s{i}"]["p"]], dtype=float) for i in range(len(seeds))]


def _drawn(points: DataFrame, models: list[np.ndarray], wanted: list[int], seeds: list[int]) -> list[np.ndarray]:
    """Up to ``wanted`` new rows per model, by squared distance from its candidates."""
    width = len(points.columns)

    def draw(batches):
        best = [np.empty((0, width + 1)) for _ in models]
        for x in _blocks(batches, max(len(m) for m in models)):
            for i, (candidates, n, seed) in enumerate(zip(models, wanted, seeds)):
                gap = _gaps(x, candidates).min(axis=1)
                keys = np.full(len(x), np.inf)
                far = gap > 1e-12
                keys[far] = -np.log(_draws(x[far], seed)) / gap[far]
                low = keys < (best[i][-1, 0] if len(best[i]) == n else np.inf)
                met = np.vstack([best[i], np.column_stack([keys[low], x[low]])])
                # equal rows have equal keys and count once
                best[i] = met[np.unique(met[:, 0], return_index=True)[1][:n]]
        rows = [(i, row[0], row[1:].tolist()) for i, found in enumerate(best) for row in found]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["model", "key", "point"])

    sent = points.mapInArrow(draw, "model int, key double, point array<double>").distinct()
    # a task sends at most ``wanted`` rows per model
    place = F.row_number().over(Window.partitionBy("model").orderBy("key", "point"))
    kept = sent.withColumn("place", place).where(F.col("place") <= max(wanted)).collect()
    out: list[list] = [[] for _ in models]
    for row in sorted(kept, key=lambda r: (r["model"], r["place"])):
        if row["place"] <= wanted[row["model"]]:
            out[row["model"]].append(row["point"])
    return [np.array(found, dtype=float).reshape(-1, width) for found in out]


def _pass(points: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per model: sums and rows per nearest centre (ties to the smaller), and the inertia."""
    width = len(points.columns)
    starts = np.cumsum([0, *[len(m) for m in models]])
    stacked = np.vstack(models)

    def add(batches):
        totals = np.zeros((len(stacked), width + 2))
        for x in _blocks(batches, len(stacked)):
            gaps = _gaps(x, stacked)
            for start, centres in zip(starts, models):
                near = gaps[:, start : start + len(centres)].argmin(axis=1)
                own = (near[:, None] == np.arange(len(centres))).astype(float).T
                cost = ((x - centres[near]) ** 2).sum(axis=1)
                totals[start : start + len(centres)] += own @ np.column_stack([x, np.ones(len(x)), cost])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(stacked)), pa.int32()), *[pa.array(c) for c in totals.T]],
            names=["centre", *[f"t{i}" for i in range(width + 2)]])

    columns = [f"t{i}" for i in range(width + 2)]
    sent = points.mapInArrow(add, "centre int, " + ", ".join(f"{c} double" for c in columns))
    totals = np.zeros((len(stacked), width + 2))
    for row in sent.groupBy("centre").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        totals[row["centre"]] = [row[c] for c in columns]
    split = [totals[a:b] for a, b in zip(starts, starts[1:])]
    return [(part[:, :width], part[:, width], float(part[:, width + 1].sum())) for part in split]


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ among the candidates of one model."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    gap = _gaps(candidates, candidates[chosen])[:, 0]
    while len(chosen) < min(k, len(candidates)):
        odds = weights * gap
        if odds.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=odds / odds.sum())))
        gap = np.minimum(gap, _gaps(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def fit_all(points: DataFrame, ks: list[int], restarts: int, seed: int = 42) -> list[Fitted]:
    """Every model of ``restarts`` for each of ``ks``; ``points`` has finite doubles only.

    ``points`` is read once per pass, so callers persist or stage it. With fewer distinct rows than
    k a model has fewer centres. A centre that loses all rows stays where it is.
    """
    ship(points.sparkSession)
    names = [(k, i) for k in ks for i in range(restarts)]
    firsts = _first(points, [seed + i for i in range(restarts)])
    models = [firsts[i] for _, i in names]
    for step in range(STEPS):
        seeds = [hash((seed, step, k, i)) % 2**63 for k, i in names]
        fresh = _drawn(points, models, [2 * k for k, _ in names], seeds)
        models = [np.vstack(pair) for pair in zip(models, fresh)]
    weighed = _pass(points, models)
    models = [_reduced(m, rows, k, seed + i) for m, (_, rows, _), (k, i) in zip(models, weighed, names)]

    moving = list(range(len(models)))
    for _ in range(PASSES):
        moved = []
        for i, (sums, rows, _) in zip(moving, _pass(points, [models[i] for i in moving])):
            centres = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], models[i])
            if ((centres - models[i]) ** 2).sum(axis=1).max() > STILL**2:
                moved.append(i)
            models[i] = centres
        moving = moved
        if not moving:
            break
    return [
        Fitted(k, i, centres, rows.astype(int), cost)
        for (k, i), centres, (_, rows, cost) in zip(names, models, _pass(points, models))
    ]
