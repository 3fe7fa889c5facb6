"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; of each, the mean and the deviation are kept, at several
resolutions. For a query and a candidate, the distance between their segment means and
deviations, weighted by the segments' widths, never exceeds the distance itself
(Cauchy-Schwarz within each segment); with the two norms it bounds the inner product
from above. Coarse to fine, candidates whose bound stays below a query's k-th best score
drop out, and exact scores are computed for the survivors only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from subscope.llm.common import staged
from subscope.session import ship

LEVELS = (1, 4, 16)
#: Queries that a task holds, and candidates that it streams past them.
QUERIES = 4096
CANDIDATES = 32_768
#: Share of surviving pairs above which a matrix product costs less than gathered rows.
DENSE = 0.03


def _segments(x: np.ndarray, parts: int) -> np.ndarray:
    """Per segment sqrt(width) * mean and sqrt(width) * deviation: inner products bound those of x."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    width = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1)
    spread = np.add.reduceat(x * x, cuts[:-1], axis=1) - sums * sums / width
    return np.hstack([sums / np.sqrt(width), np.sqrt(np.maximum(spread, 0))])


def _dot(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of ``a[q]`` with ``b[c]``, pair by pair."""
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        if len(q) > DENSE * len(a) * len(b):
            return (a @ b.T)[q, c].astype(np.int64)
        return np.einsum("ij,ij->i", a[q], b[c]).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a[i], b[j])) for i, j in zip(q, c)]
    return np.array([max(-(1 << 63) + 1, min((1 << 63) - 1, x)) for x in whole], np.int64)


class _Best:
    """The k best candidates so far of every query of a block."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.levels = [_segments(vectors, parts) for parts in LEVELS]
        self.score = self.found = np.empty((len(ids), 0), np.int64)

    def _least(self) -> np.ndarray:
        """The score a candidate must reach, per query."""
        return self.score[:, -1].astype(float) if self.score.shape[1] else np.full(len(self.ids), -np.inf)

    def offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        at = 0
        while at < len(ids):  # a few candidates first, for bounds to compare with
            step = 1024 if self.score.shape[1] else 64
            for low in range(0, len(self.ids), 1024):  # limits the matrices of one step
                self._offer(slice(low, low + 1024), rows[at : at + step], ids[at : at + step], vectors[at : at + step])
            at += step

    def _offer(self, block: slice, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        least, queries = self._least()[block], self.vectors[block]
        q = c = None
        for level, parts in zip(self.levels, LEVELS):
            mine, theirs = level[block], _segments(vectors, parts)
            # room for rounding, so that no bound is too low
            slack = 1e-9 * (np.linalg.norm(mine, axis=1)[:, None] * np.linalg.norm(theirs, axis=1)[None, :] + 1)
            if q is None:
                q, c = np.nonzero((mine @ theirs.T + slack >= least[:, None]) & (self.rows[block][:, None] != rows[None, :]))
            elif len(q):
                dense = len(q) > DENSE * slack.size
                bound = (mine @ theirs.T)[q, c] if dense else np.einsum("ij,ij->i", mine[q], theirs[c])
                keep = bound + slack[q, c] >= least[q]
                q, c = q[keep], c[keep]
        if not len(q):
            return
        exact = _dot(queries, vectors, q, c)
        better = exact >= least[q]
        q, c, exact = q[better], c[better], exact[better]
        for row in np.unique(q):
            a, b = np.searchsorted(q, [row, row + 1])
            self._merge(block.start + int(row), ids[c[a:b]], exact[a:b])

    def _merge(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not self.score.shape[1]:  # empty places rank last
            self.score = np.full((len(self.ids), self.k), -(1 << 63), np.int64)
            self.found = np.full((len(self.ids), self.k), (1 << 63) - 1, np.int64)
        scores, ids = np.concatenate([self.score[row], scores]), np.concatenate([self.found[row], ids])
        order = np.lexsort((ids, ~scores))[: self.k]
        self.score[row], self.found[row] = scores[order], ids[order]

    def batch(self) -> pa.RecordBatch:
        real = self.found != (1 << 63) - 1
        row, _ = np.nonzero(real)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows[row]), pa.array(self.ids[row]), pa.array(self.found[real]), pa.array(self.score[real])],
            ["query_row", "query_id", "vec_id", "score"],
        )


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The ``k`` candidates with the highest inner product for every query of ``vectors``.

    ``vectors`` has vec_id and embedding; components become floor(scale * x). Every row is a
    candidate, rows where ``is_query`` holds are queries; a query is not its own candidate.
    Ties go to the smaller vec_id. Rows with a null vec_id or a vector that is null, empty
    or holds null or non-finite components take no part; rows that share a vec_id are
    queries and candidates of their own, and only a query's own row is kept from it;
    queries meet candidates of their own dimension only.
    Queries are dealt out in blocks of ``QUERIES``; each meets all candidates in slices,
    streamed in batches, so a task's memory is bounded. Scores beyond a long saturate.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = staged(
        vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
        .withColumn("asks", is_query)
        .select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), "asks",
            F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).alias("vector"),
        ),
        "vectors",
    )
    slices = max(16, ceil(rows.count() / CANDIDATES))
    blocks = max(1, ceil(rows.where("asks").count() / QUERIES))
    place = F.xxhash64("row")
    asked = rows.where("asks").select(
        "dim", F.pmod(place, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"),
        F.lit(0).alias("kind"), "row", "vec_id", "vector",
    )
    offered = rows.select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(place, F.lit(slices)).alias("slice"),
        F.lit(1).alias("kind"), "row", "vec_id", "vector",
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, ids, held, best = None, [], [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "block", "slice", "kind")], axis=1)
            bounds = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = batch.slice(a, b - a)
                if unit != tuple(keys[a, :3]):
                    if best is not None:
                        yield best.batch()
                    unit, rows, ids, held, best = tuple(keys[a, :3]), [], [], [], None
                found, own = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                matrix = part.column("vector").flatten().to_numpy().reshape(b - a, int(keys[a, 0]))
                if keys[a, 3] == 0:
                    rows.append(own)
                    ids.append(found)
                    held.append(matrix)
                elif ids:
                    best = best or _Best(np.concatenate(rows), np.concatenate(ids), np.concatenate(held), k)
                    best.offer(own, found, matrix)
        if best is not None:
            yield best.batch()

    unit = ["dim", "block", "slice"]
    partial = (
        asked.unionByName(offered).repartition(*unit).sortWithinPartitions(*unit, "kind", "row")
        .mapInArrow(searched, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    )
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
