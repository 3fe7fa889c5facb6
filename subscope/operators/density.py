"""DBSCAN on a grid, exact, without listing the pairs of a dense neighbourhood.

The cell side is eps / sqrt(d), so two points of one cell are always neighbours: a
cell with ``min_samples`` points consists of core points of one cluster, whatever its
size. Only relations between different cells need distances.

Points with equal coordinates are one *place* with their number as its weight: they share
cluster and kind, so distances are measured between places only.

Places of small cells, and the tight bounding boxes of larger ones, are the *items* that
points are compared with. They meet in blocks a little wider than eps; a crowded block
is cut into chunks, so that a task never holds more than two chunks, and compares them
as arrays. What leaves a task is one count per point, or a spanning forest of the cells
it found linked, but no pairs. A box that is neither wholly in nor wholly out of reach
is cut into smaller boxes, down to single points.

Where places are many, most comparisons are spared, and none that could change the result.
A point is compared with a growing share of the items only until it has neighbours enough.
Cells are first linked by one core point each; then only cells of different groups are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from subscope.operators.components import components
from subscope.operators.features import Scale
from subscope.operators.ordering import global_order
from subscope.session import ship, staged

LEAF = 64
CHUNK = 2048
#: Items that the first round of counting meets at most; all rounds so far meet FAN times as many as before.
FIRST, FAN = 40_000, 4
# rows of a chunk that are compared at once, so that the arrays stay in the cache
_BAND = 64
_SPLIT = 4
_DEEPEST = 20


def _squares(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


class _Grid:
    """Cells, boxes and blocks of points with coordinates x0, x1, ..."""

    def __init__(self, d: int, eps: float, leaf: int, chunk: int):
        self.d, self.eps, self.leaf, self.chunk = d, eps, leaf, chunk
        self.limit = eps * eps
        # slightly smaller than eps / sqrt(d): rounding must not separate a cell
        self.side = eps / math.sqrt(d) * (1 - 1e-9)
        self.x = [f"x{i}" for i in range(d)]
        self.lo = [f"lo{i}" for i in range(d)]
        self.hi = [f"hi{i}" for i in range(d)]
        self.blocked = range(min(d, 3))

    def index(self, level: int) -> Column:
        """Position of a point in the grid that cuts every cell side 4**level times."""
        step = F.lit(self.side / _SPLIT**level)
        return F.array(*[F.floor(F.col(c) / step) for c in self.x])

    def block(self, cell: str = "cell") -> Column:
        """Origins of cells in reach differ by less than one block width."""
        width = self.eps + self.side
        return F.array(*[F.floor(F.col(cell)[i] * F.lit(self.side) / F.lit(width)) for i in self.blocked])

    def boxes(self, points: DataFrame, level: int) -> DataFrame:
        """(cell_id, idx, up, n, weight, lo.., hi..): occupied boxes of a level, with tight limits, places and points."""
        up = F.transform("idx", lambda v: F.floor(v / F.lit(_SPLIT)))
        return (
            points.withColumn("idx", self.index(level))
            .groupBy("cell_id", "idx")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum("weight").alias("weight"),
                *[F.min(x).alias(lo) for x, lo in zip(self.x, self.lo)],
                *[F.max(x).alias(hi) for x, hi in zip(self.x, self.hi)],
            )
            .withColumn("up", up)
        )

    def items(self, points: DataFrame, *carried: str) -> DataFrame:
        """What points are compared with: (cell_id, block, weight, lo.., hi.., crowd, _salt).

        A cell with more than ``leaf`` places is one box, ``weight`` is its number of points.
        ``carried`` columns are constant within a cell.
        """
        sized = points.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_n"))
        held = points.join(sized, "cell_id")
        single = held.where(F.col("_n") <= self.leaf).select(
            "cell_id", "cell", *carried, "weight",
            *[F.col(x).alias(lo) for x, lo in zip(self.x, self.lo)],
            *[F.col(x).alias(hi) for x, hi in zip(self.x, self.hi)],
            F.lit(False).alias("crowd"), F.xxhash64("key").alias("_salt"),
        )
        crowded = (
            held.where(F.col("_n") > self.leaf)
            .groupBy("cell_id", "cell", *carried)
            .agg(
                F.sum("weight").alias("weight"),
                *[F.min(x).alias(lo) for x, lo in zip(self.x, self.lo)],
                *[F.max(x).alias(hi) for x, hi in zip(self.x, self.hi)],
            )
            .withColumns({"crowd": F.lit(True), "_salt": F.xxhash64("cell_id")})
        )
        return single.unionByName(crowded).withColumn("block", self.block()).drop("cell")

    # squared distances between a point x and a box lo..hi, as columns

    def gap(self) -> Column:
        return _squares([
            F.greatest(F.lit(0.0), F.col(lo) - F.col(x), F.col(x) - F.col(hi))
            for x, lo, hi in zip(self.x, self.lo, self.hi)
        ])

    def reach(self) -> Column:
        return _squares([
            F.greatest(F.col(hi) - F.col(x), F.col(x) - F.col(lo))
            for x, lo, hi in zip(self.x, self.lo, self.hi)
        ])

    # the same between arrays of boxes, rows of the left against rows of the right

    @staticmethod
    def gaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        (llo, lhi), (rlo, rhi) = left, right
        total = np.zeros((len(llo), len(rlo)))
        for i in range(llo.shape[1]):
            part = np.maximum(rlo[None, :, i] - lhi[:, None, i], llo[:, None, i] - rhi[None, :, i])
            total += np.square(np.maximum(part, 0.0))
        return total

    @staticmethod
    def reaches(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        (llo, lhi), (rlo, rhi) = left, right
        total = np.zeros((len(llo), len(rlo)))
        for i in range(llo.shape[1]):
            part = np.maximum(rhi[None, :, i] - llo[:, None, i], lhi[:, None, i] - rlo[None, :, i])
            total += np.square(part)
        return total

    def near(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which rows of the left and the right lie wholly in reach of each other."""
        out = np.empty((len(left[0]), len(right[0])), dtype=bool)
        for start in range(0, len(out), _BAND):
            band = slice(start, start + _BAND)
            out[band] = self.reaches((left[0][band], left[1][band]), right) <= self.limit
        return out

    def limits(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf[self.lo].to_numpy(dtype=float), pdf[self.hi].to_numpy(dtype=float)

    @staticmethod
    def wide(limits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which items are boxes of more than one place."""
        return (limits[0] != limits[1]).any(axis=1)

    def places(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        at = pdf[self.x].to_numpy(dtype=float)
        return at, at

    def meet(self, left: DataFrame, right: DataFrame, work: Callable, schema: str, half: bool = False, apart: str | None = None) -> DataFrame:
        """Apply ``work(left, right)`` to all chunks of neighbouring blocks.

        Both sides carry block and _salt. The left side visits the neighbours of its
        block, with ``half`` only those not before it, with ``apart`` only those where that
        column has another value.
        """
        ship(left.sparkSession)
        shifts = [s for s in product((-1, 0, 1), repeat=len(self.blocked)) if not half or s >= (0,) * len(s)]
        targets = F.array(*[
            F.concat_ws("_", *[(F.col("block")[i] + F.lit(s[i])).cast("string") for i in self.blocked])
            for s in shifts
        ])
        moving = left.withColumn("_at", F.explode(targets)).drop("block")
        # both sides may come from one table; renewed columns keep them apart
        resting = right.select(*[F.col(c).alias(c) for c in right.columns])
        resting = resting.withColumn("_at", F.concat_ws("_", F.col("block").cast("array<string>"))).drop("block")
        if apart:
            held = resting.groupBy("_at").agg(F.min(apart).alias("_low"), F.max(apart).alias("_high"))
            elsewhere = (F.col("_low") != F.col(apart)) | (F.col("_high") != F.col(apart))
            moving = moving.join(held, "_at").where(elsewhere).drop("_low", "_high")

        def chunks(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("_at").agg(F.ceil(F.count(F.lit(1)) / F.lit(self.chunk)).cast("int").alias(name))

        sizes = staged(chunks(moving, "_nl").join(chunks(resting, "_nr"), "_at"), "blocks")

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            return (
                df.join(sizes, "_at")
                .withColumn(f"_c{own}", F.pmod("_salt", F.col(f"_n{own}")).cast("int"))
                .withColumn(f"_c{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)))
                .drop("_salt", "_nl", "_nr")
            )

        keys = ["_at", "_cl", "_cr"]
        return (
            dealt(moving, "l", "r").groupBy(*keys)
            .cogroup(dealt(resting, "r", "l").groupBy(*keys))
            .applyInPandas(work, schema)
        )


def _refined(grid: _Grid, todo: DataFrame, points: DataFrame, carried: list[str]) -> DataFrame:
    """(key, cell_id, carried.., within): points of undecided boxes within eps of a probe.

    ``todo`` holds probes (key, x..) with the cell_id of a box neither in nor out of reach.
    """
    keep = ["key", *grid.x, *carried]
    level = 1
    open_boxes = todo.join(
        _children(grid, points, 1).drop("up"), "cell_id"
    ).where(grid.gap() <= grid.limit)
    found = []
    while True:
        open_boxes = staged(open_boxes, "boxes")
        inside = grid.reach() <= grid.limit
        found.append(
            open_boxes.where(inside).groupBy("key", "cell_id", *carried).agg(F.sum("weight").alias("within"))
        )
        rest = open_boxes.where(~inside)
        small = (F.col("n") <= grid.leaf) | F.lit(level >= _DEEPEST)
        members = points.select(
            "cell_id", grid.index(level).alias("idx"), "weight",
            *[F.col(x).alias(lo) for x, lo in zip(grid.x, grid.lo)],
            *[F.col(x).alias(hi) for x, hi in zip(grid.x, grid.hi)],
        )
        found.append(
            rest.where(small)
            .select("cell_id", "idx", *keep)
            .join(members, ["cell_id", "idx"])
            .where(grid.reach() <= grid.limit)
            .groupBy("key", "cell_id", *carried)
            .agg(F.sum("weight").alias("within"))
        )
        large = rest.where(~small)
        if level >= _DEEPEST or large.isEmpty():
            break
        level += 1
        open_boxes = (
            large.select("cell_id", F.col("idx").alias("up"), *keep)
            .join(_children(grid, points, level), ["cell_id", "up"])
            .drop("up")
            .where(grid.gap() <= grid.limit)
        )
    return reduce(DataFrame.unionByName, found).groupBy("key", "cell_id", *carried).agg(
        F.sum("within").alias("within")
    )


def _children(grid: _Grid, points: DataFrame, level: int) -> DataFrame:
    return grid.boxes(points, level).select("cell_id", "idx", "up", "n", "weight", *grid.lo, *grid.hi)


def _neighbour_counts(grid: _Grid, probes: DataFrame, points: DataFrame, key_type: str, min_samples: int) -> DataFrame:
    """(key, within): points of other cells within eps of every probe, all of them where ``n`` and they are too few.

    Items come in rounds; a probe that has ``min_samples`` points within eps meets no further ones.
    """
    def counted(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "within": []})
        other = left["cell_id"].to_numpy()[:, None] != right["cell_id"].to_numpy()[None, :]
        inside = grid.near(grid.places(left), grid.limits(right)) & other
        within = inside.astype(np.int64) @ right["weight"].to_numpy()
        found = within > 0
        return pd.DataFrame({"key": left["key"].to_numpy()[found], "within": within[found]})

    def unsure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "cell_id": []})
        mine, boxes, cells = grid.places(left), grid.limits(right), right["cell_id"].to_numpy()
        other = left["cell_id"].to_numpy()[:, None] != cells[None, :]
        row, box = np.nonzero(other & ~grid.near(mine, boxes) & (grid.gaps(mine, boxes) <= grid.limit))
        return pd.DataFrame({"key": left["key"].to_numpy()[row], "cell_id": cells[box]})

    items = staged(grid.items(points), "items")
    total, slices = items.where(~F.col("crowd")).count(), 1
    while total > FIRST * slices:
        slices *= FAN
    # boxes hold most points and come first
    items = items.withColumn(
        "_slice", F.when(F.col("crowd"), 0).otherwise(F.pmod(F.xxhash64("_salt", F.lit("slice")), F.lit(slices)))
    )
    rest = probes.select("key", "cell_id", "block", "_salt", "n", *grid.x)
    parts, done = [], 0
    while done < slices:
        upto = max(1, done * FAN)
        met = items.where(F.col("_slice").between(done, upto - 1)).drop("_slice", "crowd")
        counts = grid.meet(rest.drop("n"), met, counted, f"key {key_type}, within bigint")
        parts.append(staged(counts.groupBy("key").agg(F.sum("within").alias("within")), "counts"))
        done = upto
        rest = rest.join(parts[-1], "key", "left").withColumn("n", F.col("n") + F.coalesce("within", F.lit(0))).drop("within")
        rest = staged(rest.where(F.col("n") < min_samples), "rest")
        if rest.isEmpty():
            break
    boxes = items.where("crowd").drop("_slice", "crowd")
    # how far a probe is in a box matters only where it has too few points so far
    undecided = staged(grid.meet(rest.drop("n"), boxes, unsure, f"key {key_type}, cell_id bigint"), "undecided")
    if not undecided.isEmpty():
        todo = undecided.join(rest.select("key", *grid.x), "key")
        parts.append(_refined(grid, todo, points, []).select("key", "within"))
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("within").alias("within"))


def _roots(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest cell id connected with each left and each right cell by the given links."""
    names = np.unique(np.concatenate([left, right]))
    label = np.arange(len(names))
    li, ri = np.searchsorted(names, left), np.searchsorted(names, right)
    far = len(names)
    while True:
        before = label.copy()
        low = np.where(adjacent, label[li][:, None], far).min(axis=0, initial=far)
        np.minimum.at(label, ri, low)
        low = np.where(adjacent, label[ri][None, :], far).min(axis=1, initial=far)
        np.minimum.at(label, li, low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return names[label[li]], names[label[ri]]


def _cell_links(grid: _Grid, core: DataFrame) -> DataFrame:
    """(src, dst) edges that connect the cells with core points in reach of each other."""
    def by_cell(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("cell_id")
        cells, starts, code = np.unique(pdf["cell_id"].to_numpy(), return_index=True, return_inverse=True)
        return pdf, cells, starts, code

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"src": [], "dst": [], "sure": []})
        left, left_cells, left_starts, left_code = by_cell(left)
        right, right_cells, right_starts, right_code = by_cell(right)
        mine, theirs = grid.limits(left), grid.limits(right)
        near = grid.near(mine, theirs)
        if "group" in left:
            near &= left["group"].to_numpy()[:, None] != right["group"].to_numpy()[None, :]
        adjacent = np.logical_or.reduceat(near, right_starts, axis=1)
        adjacent = np.logical_or.reduceat(adjacent, left_starts, axis=0)
        left_root, right_root = _roots(adjacent, left_cells, right_cells)
        # boxes that may hold points in reach, unless they are connected already
        wide = grid.wide(mine)[:, None] | grid.wide(theirs)[None, :]
        if "group" in left:
            wide &= left["group"].to_numpy()[:, None] != right["group"].to_numpy()[None, :]
        parted = left_root[left_code][:, None] != right_root[right_code][None, :]
        row, column = np.nonzero(wide & parted & ~near & (grid.gaps(mine, theirs) <= grid.limit))
        src = np.concatenate([left_cells, right_cells, left_cells[left_code[row]]])
        dst = np.concatenate([left_root, right_root, right_cells[right_code[column]]])
        sure = np.arange(len(src)) < len(left_cells) + len(right_cells)
        edges = pd.DataFrame({"src": np.minimum(src, dst), "dst": np.maximum(src, dst), "sure": sure})
        return edges[edges["src"] != edges["dst"]].drop_duplicates()

    kinds = "src bigint, dst bigint, sure boolean"
    # one core point of each cell links most of them; a link between cells of one group adds nothing
    first = core.groupBy("cell_id", "block").agg(F.min_by(F.struct(*grid.x), "key").alias("at"))
    first = staged(first.select(
        "cell_id", "block", F.xxhash64("cell_id").alias("_salt"),
        *[F.col(f"at.{x}").alias(n) for names in (grid.lo, grid.hi) for x, n in zip(grid.x, names)],
    ), "first")
    links = staged(grid.meet(first, first, work, kinds, half=True), "links").where("sure").select("src", "dst")
    grouped = staged(components(links, first.select(F.col("cell_id").alias("node"))).toDF("cell_id", "group"), "groups")
    items = staged(grid.items(core).drop("crowd").join(grouped, "cell_id"), "items")
    largest = items.groupBy("group").count().orderBy(F.desc("count"), "group").first()
    asking = items.where(F.col("group") != largest["group"]) if largest else items
    seen = staged(grid.meet(asking, items, work, kinds, apart="group"), "links")
    sure = links.unionByName(seen.where("sure").select("src", "dst")).distinct()
    undecided = seen.where(~F.col("sure")).select("src", "dst").distinct()
    if undecided.isEmpty():
        return sure
    # pairs that other links connect need no further look
    nodes = undecided.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    group = staged(components(sure, nodes), "groups")
    todo = (
        undecided.join(group.toDF("src", "src_group"), "src")
        .join(group.toDF("dst", "dst_group"), "dst")
        .where("src_group <> dst_group")
        .select("src", "dst")
    )
    return sure.unionByName(_linked_boxes(grid, todo, core))


def _linked_boxes(grid: _Grid, pairs: DataFrame, core: DataFrame) -> DataFrame:
    """The pairs of cells that hold two points within eps, by splitting both boxes."""
    found, level = [], 1

    def side(df: DataFrame, prefix: str, key: str) -> DataFrame:
        names = {"cell_id": key, "idx": f"{prefix}idx", "up": f"{prefix}up", "n": f"{prefix}n"}
        return df.select(*[F.col(c).alias(names.get(c, f"{prefix}{c}")) for c in df.columns])

    def apart(kind: str) -> Column:
        parts = []
        for lo, hi in zip(grid.lo, grid.hi):
            left, right = (F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.col(f"a_{lo}") - F.col(f"b_{hi}"))
            if kind == "reach":
                left, right = (F.col(f"b_{hi}") - F.col(f"a_{lo}"), F.col(f"a_{hi}") - F.col(f"b_{lo}"))
                parts.append(F.greatest(left, right))
            else:
                parts.append(F.greatest(F.lit(0.0), left, right))
        return _squares(parts)

    finer = _children(grid, core, 1)
    todo = (
        pairs.join(side(finer, "a_", "src").drop("a_up"), "src")
        .join(side(finer, "b_", "dst").drop("b_up"), "dst")
        .where(apart("gap") <= grid.limit)
    )
    while True:
        todo = staged(todo, "box-pairs")
        near = apart("reach") <= grid.limit
        sure = staged(todo.where(near).select("src", "dst").distinct(), "linked")
        rest = todo.where(~near).join(sure, ["src", "dst"], "left_anti")
        small = (F.col("a_n") * F.col("b_n") <= grid.leaf * grid.leaf) | F.lit(level >= _DEEPEST)
        points = core.withColumn("idx", grid.index(level)).select(
            "cell_id", "idx",
            *[F.col(x).alias(lo) for x, lo in zip(grid.x, grid.lo)],
            *[F.col(x).alias(hi) for x, hi in zip(grid.x, grid.hi)],
        )
        compared = staged(
            rest.where(small)
            .select("src", "dst", "a_idx", "b_idx", *[f"b_{c}" for c in (*grid.lo, *grid.hi)])
            # a point out of reach of the other box has no partner in it
            .join(side(points, "a_", "src"), ["src", "a_idx"])
            .where(apart("gap") <= grid.limit)
            .drop(*[f"b_{c}" for c in (*grid.lo, *grid.hi)])
            .join(side(points, "b_", "dst"), ["dst", "b_idx"])
            .where(apart("reach") <= grid.limit)
            .select("src", "dst")
            .distinct(),
            "linked",
        )
        found += [sure, compared]
        large = rest.where(~small).join(compared, ["src", "dst"], "left_anti")
        if level >= _DEEPEST or large.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        level += 1
        finer = _children(grid, core, level)
        todo = (
            large.select("src", "dst", F.col("a_idx").alias("a_up"), F.col("b_idx").alias("b_up"))
            .join(side(finer, "a_", "src"), ["src", "a_up"])
            .join(side(finer, "b_", "dst"), ["dst", "b_up"])
            .drop("a_up", "b_up")
            .where(apart("gap") <= grid.limit)
        )


def _border_labels(grid: _Grid, rest: DataFrame, core: DataFrame, key_type: str) -> DataFrame:
    """(key, label): smallest cluster with a core point within eps of a point."""
    none = np.iinfo(np.int64).max

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "cell_id": [], "label": []})
        mine, theirs = grid.places(left), grid.limits(right)
        labels, keys = right["label"].to_numpy(), left["key"].to_numpy()
        inside = grid.near(mine, theirs)
        low = np.where(inside, labels[None, :], none).min(axis=1)
        crowded = np.flatnonzero(grid.wide(theirs))
        boxes = (theirs[0][crowded], theirs[1][crowded])
        row, box = np.nonzero(
            ~inside[:, crowded] & (labels[crowded][None, :] < low[:, None])
            & (grid.gaps(mine, boxes) <= grid.limit)
        )
        found = low < none
        return pd.DataFrame({
            "key": np.concatenate([keys[found], keys[row]]),
            "cell_id": np.concatenate([
                np.full(found.sum(), -1), right["cell_id"].to_numpy()[crowded[box]]
            ]).astype(np.int64),
            "label": np.concatenate([low[found], labels[crowded[box]]]),
        })

    seen = staged(
        grid.meet(
            rest.select("key", "block", "_salt", *grid.x), grid.items(core, "label").drop("crowd"), work,
            f"key {key_type}, cell_id bigint, label bigint",
        ), "border",
    )
    sure = seen.where("cell_id < 0").select("key", "label")
    undecided = seen.where("cell_id >= 0")
    if not undecided.isEmpty():
        todo = undecided.join(rest.select("key", *grid.x), "key")
        touched = _refined(grid, todo, core, ["label"]).where("within > 0")
        sure = sure.unionByName(touched.select("key", "label"))
    return sure.groupBy("key").agg(F.min("label").alias("label"))


def dbscan(
    df: DataFrame,
    key: str,
    features: list[str],
    eps: float = 0.8,
    min_samples: int = 30,
    scale: bool = True,
    leaf: int = LEAF,
    chunk: int = CHUNK,
) -> DataFrame:
    """(key, label, is_core) with label -1 for noise.

    A point counts itself among its neighbours. Clusters are numbered by their smallest
    core key; a border point joins the smallest cluster it touches.
    """
    grid = _Grid(len(features), eps, leaf, chunk)
    key_type = df.schema[key].dataType.simpleString()
    moments = Scale.fit(df, features) if scale else None
    x = [(moments.column(c) if moments else F.col(c).cast("double")).alias(n) for c, n in zip(features, grid.x)]
    located = staged(df.select(F.col(key).alias("key"), *x), "located")
    # copies of a place weigh like as many points and share its label
    places = located.groupBy(*grid.x).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    places = staged(places.withColumn("cell", grid.index(0)), "places")
    cells = places.groupBy("cell").agg(F.sum("weight").alias("n"), F.min("key").alias("first_key"))
    numbered = global_order(cells, ["first_key"], rank="cell_id", label="cells").frame
    points = staged(
        places.join(numbered.select("cell", "cell_id", "n"), "cell")
        .withColumn("block", grid.block())
        .withColumn("_salt", F.xxhash64("key")),
        "points",
    )

    probes = points.where(F.col("n") < min_samples)
    within = _neighbour_counts(grid, probes, points, key_type, min_samples)
    enough = probes.join(within, "key", "left").where(
        F.col("n") + F.coalesce("within", F.lit(0)) >= min_samples
    ).drop("within")
    core = staged(points.where(F.col("n") >= min_samples).unionByName(enough), "core")

    nodes = staged(core.groupBy(F.col("cell_id").alias("node")).agg(F.min("key").alias("low_key")), "nodes")
    joined = staged(components(_cell_links(grid, core), nodes.select("node")).join(nodes, "node"), "joined")
    clusters = global_order(
        joined.groupBy("component").agg(F.min("low_key").alias("low_key")), ["low_key"], rank="label", label="clusters"
    ).frame.select("component", (F.col("label") - 1).alias("label"))
    labels = joined.join(clusters, "component").select(F.col("node").alias("cell_id"), "label")
    labelled = staged(core.join(labels, "cell_id"), "labelled")

    rest = points.join(core.select("key"), "key", "left_anti")
    border = _border_labels(grid, rest, labelled, key_type)
    noise = rest.join(border, "key", "left").select(
        *grid.x, F.coalesce("label", F.lit(-1).cast("bigint")).alias("label"), F.lit(False).alias("is_core")
    )
    found = labelled.select(*grid.x, "label", F.lit(True).alias("is_core")).unionByName(noise)
    place = F.array(*grid.x).alias("place")
    told = located.select("key", place).join(found.select(place, "label", "is_core"), "place")
    return told.select(F.col("key").alias(key), F.col("label").cast("bigint").alias("label"), "is_core")


def cluster_summary(labels: DataFrame) -> DataFrame:
    """Number of clusters, noise excluded, and number of noise points."""
    return labels.agg(
        F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"),
        F.count_if(F.col("label") == -1).alias("n_noise"),
    )
