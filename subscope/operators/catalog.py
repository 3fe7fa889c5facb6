"""Exact top-n search over a catalog of any size, kept as a table of blocks.

The catalog is cut into blocks of equal size along an order that puts like with like: by
falling norm for inner products, by nearest pivot for similarities. A block is known by
its centre and radius, so the score of a row with anything in it is at most
``row . centre + |row| * radius`` (Cauchy-Schwarz). Rows meet one promising block first; their
n-th best score there is a threshold, and of the other blocks only those whose bound
reaches it are met. Rows and blocks meet in units (group of rows, block) that are
shuffled together; neither the catalog nor the rows ever pass through the driver, which
sees the centre and radius of each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from subscope.operators.ordering import global_order
from subscope.session import ship, staged

#: Rows that meet a block in one task.
GROUP_ROWS = 8192
#: Scores are ranked at this precision, and bounds have room for it.
DIGITS = 9
SLACK = 1e-7

#: Scores of a batch of rows with a block of items, and which pairs count.
Scorer = Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray]]


def matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """A column of equally long arrays; nulls are rows of zeros."""
    given = column.notna().to_numpy()
    if width is None:
        width = len(column[given].iloc[0]) if given.any() else 1
    out = np.zeros((len(column), width))
    if given.any():
        out[given] = np.stack(column[given].to_numpy())
    return out


@dataclass(frozen=True)
class Blocks:
    """How far each block reaches: its centre, its radius and the largest offset of its items."""

    centres: np.ndarray
    radii: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.radii)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """The most that each vector can score with an item of each block."""
        length = np.linalg.norm(vectors, axis=1)[:, None]
        return vectors @ self.centres.T + length * self.radii[None, :] + self.offsets[None, :]


def cut(items: DataFrame, order: list[str], block: str, size: int, label: str) -> tuple[DataFrame, int]:
    """``items`` with ``block``: runs of ``size`` along ``order``; and the number of blocks."""
    placed = global_order(items, order, rank="_rank", label=label)
    made = placed.frame.withColumn(block, F.floor((F.col("_rank") - 1) / F.lit(size)).cast("int")).drop("_rank")
    return staged(made, label), -(-placed.rows // size)


def reach(items: DataFrame, block: str, vector: str, offset: str | None = None) -> Blocks:
    """Centre, radius and largest offset of every block; a block is one group of its fixed size."""

    def measured(part: pd.DataFrame) -> pd.DataFrame:
        vectors = matrix(part["vector"])
        centre = vectors.mean(axis=0)
        radius = float(np.linalg.norm(vectors - centre, axis=1).max())
        return pd.DataFrame({"block": [part["block"].iloc[0]], "centre": [centre], "radius": [radius], "offset": [part["offset"].max()]})

    held = items.select(F.col(block).alias("block"), F.col(vector).alias("vector"), (F.col(offset) if offset else F.lit(0.0)).cast("double").alias("offset"))
    rows = held.groupBy("block").applyInPandas(measured, "block int, centre array<double>, radius double, offset double").orderBy("block").collect()
    width = max(len(r["centre"]) for r in rows)
    centres = np.array([[*r["centre"], *[0.0] * (width - len(r["centre"]))] for r in rows])
    return Blocks(centres, np.array([r["radius"] for r in rows]), np.array([r["offset"] for r in rows]))


def by_pivots(items: DataFrame, vector: str, key: str, pivots: int) -> DataFrame:
    """``items`` with ``pivot``, the nearest of a few items chosen by a hash of their key."""
    chosen = items.orderBy(F.xxhash64(key), key).limit(pivots).select(vector).collect()
    points = np.array([r[0] for r in chosen], dtype=float)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    ship(items.sparkSession)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = matrix(batch[vector], points.shape[1])
            far = (points * points).sum(axis=1)[None, :] - 2 * vectors @ points.T
            yield batch.assign(pivot=far.argmin(axis=1).astype("int32"))

    return items.mapInPandas(near, f"{fields}, pivot int")


def top(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, item) of the ``n`` largest values of every row, ties to the first item."""
    n = min(n, values.shape[1])
    least = -np.partition(-values, n - 1, axis=1)[:, n - 1]
    row, item = np.nonzero((values >= least[:, None]) & (values > -np.inf))
    order = np.lexsort((item, -values[row, item], row))
    row, item = row[order], item[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], place[place < n], item[place < n]


def meet(
    rows: DataFrame, key: str, wanted: Column, items: DataFrame, block: str, blocks: int,
    task: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, cells: int,
) -> DataFrame:
    """``task`` over pieces of every group of ``rows`` and every block in its array ``wanted``.

    A block's items come in order of their tariff_id; a piece has at most ``cells`` scores.
    """
    ship(rows.sparkSession)
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    unit = ["_group", "_block"]
    asking = rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).withColumn("_block", F.explode(wanted))
    if blocks == 1:
        offered = items.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("_b", F.lit(0))
    else:  # only units that some row asks for get their block
        asked = asking.select(F.col("_group").alias("_g"), F.col("_block").alias("_b")).distinct()
        offered = items.withColumnRenamed(block, "_part").join(asked, F.col("_part") == F.col("_b"))

    def run(_, batch: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        names = [f.split()[0] for f in schema.split(", ")]
        if batch.empty or part.empty:
            return pd.DataFrame(columns=names)
        part = part.sort_values("tariff_id", ignore_index=True)
        step = max(1, cells // len(part))
        made = [x for low in range(0, len(batch), step) for x in task(batch.iloc[low : low + step].reset_index(drop=True), part)]
        return pd.concat(made) if made else pd.DataFrame(columns=names)

    return asking.groupBy(*unit).cogroup(offered.groupBy("_g", "_b")).applyInPandas(run, schema)


def best(
    rows: DataFrame, key: str, items: DataFrame, block: str, blocks: int, scorer: Scorer, n: int, cells: int,
    first: Column | None = None, limits: Blocks | None = None, vector: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]] | None = None,
    between: tuple[float, float] = (-np.inf, np.inf),
) -> DataFrame:
    """(key, rank, tariff_id, score): the best ``n`` allowed items of every row, exactly.

    With ``limits`` a row first meets block ``first``; ``vector`` gives a batch's vectors
    and what is added to their scores, and blocks whose bound, clipped as the scores are to
    ``between``, stays below the row's n-th best score are left out. Without, every row
    meets every block.
    """
    kind = dict(rows.dtypes)[key]

    def scored(batch: pd.DataFrame, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        values, allowed = scorer(batch, part)
        values = np.where(allowed, np.round(values, DIGITS), -np.inf)
        row, place, item = top(values, n)
        yield pd.DataFrame({
            key: batch[key].to_numpy()[row], "rank": (place + 1).astype("int32"),
            "tariff_id": part["tariff_id"].to_numpy()[item], "score": values[row, item],
        })

    schema = f"{key} {kind}, rank int, tariff_id string, score double"
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    if blocks == 1:
        return meet(rows, key, every, items, block, blocks, scored, schema, cells)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "tariff_id"))
    if limits is None:
        found = meet(rows, key, every, items, block, blocks, scored, schema, cells)
        return found.withColumn("rank", place).where(F.col("rank") <= n)

    rows = staged(rows.withColumn("_first", first.cast("int")), "asking")
    early = staged(meet(rows, key, F.array("_first"), items, block, blocks, scored, schema, cells), "early")
    least = early.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least"))
    told = rows.join(least, key, "left").withColumn("_least", F.when(F.col("_n") >= n, F.col("_least")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields)

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, base = vector(batch)
            bound = np.clip(limits.bounds(vectors) + base[:, None], *between)
            reached = bound >= batch["_least"].fillna(-np.inf).to_numpy(dtype=float)[:, None] - SLACK
            reached[np.arange(len(batch)), batch["_first"].to_numpy()] = False
            yield batch.assign(_blocks=[np.flatnonzero(r).astype("int32") for r in reached])

    rest = staged(told.mapInPandas(needed, f"{fields}, _blocks array<int>").where(F.size("_blocks") > 0), "rest")
    late = meet(rest, key, F.col("_blocks"), items, block, blocks, scored, schema, cells)
    return early.unionByName(late).withColumn("rank", place).where(F.col("rank") <= n)
