"""Centroid clustering with a vantage-point tree over the centroids.

Every round the driver builds a vantage-point tree over the centroids, whose number is a
parameter, and broadcasts it. A vector searches it best first: the subtree with the
smallest lower bound is opened next, a vantage point's distance and the range of
distances below it bound the subtrees by the triangle inequality, and a subtree goes
only when its bound lies strictly beyond the best distance so far, so that equally near
centroids with smaller numbers are still met. Vectors of a batch search side by side, each
with a frontier of its own. Distances to centroids are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from subscope.llm.common import staged
from subscope.session import ship

#: Centroids that a leaf of the tree holds at most.
LEAF = 4
#: Vectors that search side by side.
BLOCK = 4096
#: The largest float: a component beyond it counts as infinite.
LARGEST = 3.4028234663852886e38
MOST = (1 << 63) - 1
#: Totals are carried in two parts of this base, each well within 38 digits.
BASE = 10**30


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows; both hold whole numbers.

    Doubles are exact while every partial sum stays below 2^53, else Python's integers are used.
    """
    reach = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    if 4 * reach * reach * max(1, a.shape[-1]) < 2.0**53:
        gap = a - b
        return np.einsum("...i,...i->...", gap, gap)
    gap = np.vectorize(int, otypes=[object])(a) - np.vectorize(int, otypes=[object])(b)
    return (gap * gap).sum(axis=-1)


@dataclass
class Tree:
    """A vantage-point tree in arrays; node 0 is the root, -1 no node."""

    points: np.ndarray
    #: Of an inner node its vantage point, of a leaf -1.
    vantage: list[int] = field(default_factory=list)
    #: Nearer and farther subtree, and the least and largest distance (not squared) in each.
    below: list[tuple[int, int]] = field(default_factory=list)
    reach: list[tuple[float, float, float, float]] = field(default_factory=list)
    leaves: list[list[int]] = field(default_factory=list)

    @classmethod
    def over(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        tree = cls(points)
        if len(points):
            tree._grow(np.arange(len(points)), max(2, leaf))
        return tree

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        node = len(self.vantage)
        self.vantage.append(-1)
        self.below.append((-1, -1))
        self.reach.append((0.0, 0.0, 0.0, 0.0))
        self.leaves.append([])
        if len(members) <= leaf:
            self.leaves[node] = members.tolist()
            return node
        # the member farthest from the first one lies at the rim and cuts best
        start = np.sqrt(squared(self.points[members], self.points[members[:1]]).astype(float))
        at = int(start.argmax())
        vantage, rest = int(members[at]), np.delete(members, at)
        far = np.sqrt(squared(self.points[rest], self.points[[vantage]]).astype(float))
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        near_ones, far_ones = order[:half], order[half:]
        self.vantage[node] = vantage
        self.reach[node] = (far[near_ones].min(), far[near_ones].max(), far[far_ones].min(), far[far_ones].max())
        self.below[node] = (self._grow(rest[near_ones], leaf), self._grow(rest[far_ones], leaf))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest point, exact squared distance) per vector, ties to the smaller number."""
        found = [self._search(vectors[at : at + BLOCK]) for at in range(0, len(vectors), BLOCK)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vantage, below = np.array(self.vantage), np.array(self.below)
        reach = np.array(self.reach)
        number = np.full(len(vectors), len(self.points))
        best: np.ndarray | None = None
        radius = np.full(len(vectors), np.inf)
        # the frontier: bounds and nodes of the subtrees that a vector has yet to open
        bound = np.zeros((len(vectors), 1))
        node = np.zeros((len(vectors), 1), int)
        active = np.arange(len(vectors))

        def meet(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            """Offer one point to each of ``rows``; its distances, not squared."""
            nonlocal best
            exact = squared(vectors[rows], self.points[numbers])
            if best is None:
                best = np.full(len(vectors), -1, exact.dtype)
            elif exact.dtype == object and best.dtype != object:
                best = np.array([int(x) for x in best], object)
            fresh = number[rows] == len(self.points)
            better = fresh | np.array(exact < best[rows], bool) | (np.array(exact == best[rows], bool) & (numbers < number[rows]))
            won = rows[better]
            best[won], number[won] = exact[better], numbers[better]
            radius[won] = np.sqrt(exact[better].astype(float))
            return np.sqrt(exact.astype(float))

        while len(active):
            first = bound[active].argmin(axis=1)
            least = bound[active, first]
            # inclusive: a subtree that may hold an equally near point is still opened
            going = least <= radius[active] * (1 + 1e-9) + 1e-9
            active, first, least = active[going], first[going], least[going]
            if not len(active):
                break
            opened = node[active, first]
            bound = np.hstack([bound, np.full((len(vectors), 1), np.inf)])
            node = np.hstack([node, np.zeros((len(vectors), 1), int)])
            bound[active, first] = np.inf
            inner = vantage[opened] >= 0
            if inner.any():
                rows, nodes = active[inner], opened[inner]
                far = meet(rows, vantage[nodes])
                low1, high1, low2, high2 = reach[nodes].T
                slack = 1e-9 * (far + high2) + 1e-9
                for side, (low, high), place in ((0, (low1, high1), first[inner]), (1, (low2, high2), np.full(len(rows), bound.shape[1] - 1))):
                    bound[rows, place] = np.maximum(least[inner], np.maximum(low - far, far - high) - slack)
                    node[rows, place] = below[nodes, side]
            for leaf in np.unique(opened[~inner]).tolist():
                rows = active[opened == leaf]
                for point in self.leaves[leaf]:
                    meet(rows, np.full(len(rows), point))
            used = np.isfinite(bound[active]).any(axis=1)
            active = active[used]
            if len(active):
                keep = np.isfinite(bound[active]).any(axis=0)
                bound, node = bound[:, keep], node[:, keep]
        return number, best


def _whole(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)


def _round(rows: DataFrame, tree, dims: int) -> list:
    """(cluster, dimension, rows, total) of the vectors nearest to each centroid.

    A task adds up its own vectors first, so what is shuffled depends on tasks and
    centroids only; the driver gets one row per component of the centroids.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.value.points)
        totals, counts = [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            if not len(batch):
                continue
            vectors = _whole(batch, dims)
            number, _ = tree.value.nearest(vectors)
            exact = float(np.abs(vectors).max(initial=0)) * len(vectors) < 2.0**53
            for c in np.unique(number).tolist():
                mine = vectors[number == c]
                added = mine.sum(axis=0).tolist() if exact else [sum(map(int, x)) for x in mine.T]
                totals[c] = [a + int(b) for a, b in zip(totals[c], added)]
                counts[c] += len(mine)
        made = [(c, d, counts[c], *divmod(totals[c][d], BASE)) for c in range(k) if counts[c] for d in range(dims)]
        wide = pa.decimal128(38, 0)
        kinds = [pa.int32(), pa.int32(), pa.int64(), wide, wide]
        columns = list(zip(*made)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["cluster", "at", "n", "high", "low"])

    parts = rows.select("vector").mapInArrow(summed, "cluster int, at int, n bigint, high decimal(38,0), low decimal(38,0)")
    return parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()


def _starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = rows.withColumn("_hash", F.sha2(name, 256)).orderBy("_hash", "vector").limit(k)
    return np.array([r["vector"] for r in first.select("vector").collect()], float)


def centroid_clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, leaf: int = LEAF,
) -> DataFrame:
    """One row per vector of ``vectors`` (vec_id, embedding): its cluster after ``rounds`` of Lloyd's rule.

    A vector takes part if it has exactly ``dims`` components, none null or non-finite;
    components become floor(scale * x). The first centroids are the ``k`` vectors with the
    smallest SHA-256 of ``seed:vec_id`` (null as ``null``; of equal ids the smaller vector
    first), fewer if there are fewer. Each round assigns every vector to the nearest
    centroid, ties to the smaller number, and replaces each centroid that has vectors by
    the floor of their mean; rounds end early once nothing moves, which changes no result.
    Repeated rows count as often as they come; other columns are ignored; an empty table, or
    one without a sound vector, gives an empty result. ``distance`` is squared and, like the
    inertias, saturates at the largest long. ``k`` centroids go through the driver.

    Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= F.lit(LARGEST)))

    def whole(x: Column) -> Column:  # from 2^53 on every double is a whole number
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    rows = staged(
        vectors.where((F.size("embedding") == dims) & sound).select("vec_id", F.transform("embedding", whole).alias("vector")), "vectors"
    )
    points = _starts(rows, k, seed)
    for _ in range(rounds if len(points) else 0):
        tree = spark.sparkContext.broadcast(Tree.over(points, leaf))
        moved = np.vectorize(int, otypes=[object])(points)
        for r in _round(rows, tree, dims):
            moved[r["cluster"], r["at"]] = (int(r["high"]) * BASE + int(r["low"])) // r["n"]
        tree.unpersist()
        if max(map(abs, moved.flat)) < 2**53:  # doubles hold them exactly
            moved = moved.astype(float)
        if (moved == points).all():
            break
        points = moved
    last = spark.sparkContext.broadcast(Tree.over(points, leaf))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            number, exact = last.value.nearest(_whole(batch, dims))
            distance = pa.array([min(MOST, int(x)) for x in exact.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), distance], ["vec_id", "cluster", "distance"])

    near = staged(rows.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    held = lambda total: F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    inertia = near.groupBy("cluster").agg(wide.alias("_sum")).collect()  # one row per centroid
    total = min(MOST, sum(int(r["_sum"]) for r in inertia))
    own = {r["cluster"]: min(MOST, int(r["_sum"])) for r in inertia}
    names = [",".join(str(int(x)) for x in point) for point in points]
    numbers = F.array(*[F.lit(own.get(c, 0)).cast("long") for c in range(len(points))])
    digests = F.array(*[F.sha2(F.lit(name), 256) for name in names])
    return near.select(
        "vec_id", "cluster", "distance",
        (F.get(numbers, F.col("cluster")) if names else F.lit(None).cast("long")).alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"),
        (F.get(digests, F.col("cluster")) if names else F.lit(None).cast("string")).alias("centroid_sha256"),
    )
