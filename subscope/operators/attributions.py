"""Additive feature attributions of tree ensembles (path-dependent Shapley values).

Lundberg et al., "Consistent Individualized Feature Attribution for Tree Ensembles",
2018. For one leaf only the features on its path matter: each either lets the row pass
or not, and otherwise passes with the share of training rows that did. The weight of a
subset of k out of m - 1 others, k! (m - 1 - k)! / m!, is the integral of
u^k (1 - u)^(m - 1 - k) over [0, 1]; summed over all subsets, a leaf's attribution is the
integral of a product with one factor per feature, share * (1 - u) + passed * u. That is a
polynomial, so Gauss-Legendre nodes integrate it exactly, and products are carried down a
tree once for all leaves below (Yu et al., "Linear TreeSHAP", 2022). Work per row is nodes
times half the depth, at any depth; rows of a batch go through a tree together.

A row meets a leaf only by which features of its path let it pass. Where the leaves below a
node depend on few such answers, what they add is worked out once for every pattern of
answers, and a row looks its pattern up: trees of usual depth are such tables altogether.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from subscope.session import ship, stage_path


#: Products held per level of a tree: rows that go through it together times integration nodes.
PRODUCTS = 32_768
#: Answers that a table of patterns depends on; at most 8, as a pattern is a byte.
ANSWERS = 8
#: Splits whose answers are kept at once for a batch.
SPLITS = 1024


@dataclass(frozen=True)
class Node:
    """A split (``limit`` or ``categories`` go left) or a leaf (``feature`` is -1)."""

    share: float
    output: float = 0.0
    feature: int = -1
    limit: float = 0.0
    categories: tuple | None = None
    children: tuple = ()


@dataclass(frozen=True)
class Tree:
    root: Node
    features_on_path: int


@dataclass(frozen=True)
class Ensemble:
    """``base`` is the mean output over training rows."""

    trees: list[Tree]
    base: float
    width: int


def _tree(nodes: dict, weight: float, value, count=lambda node: node["rawCount"]) -> tuple[Tree, float]:
    root, most, base = nodes[0], 0, 0.0

    def built(node, above: int, seen: frozenset) -> Node:
        nonlocal most, base
        if count(node) <= 0:
            raise ValueError("a tree node without training rows has no share")
        share = count(node) / above
        if node["leftChild"] < 0:
            most = max(most, len(seen))
            output = weight * value(node)
            base += output * count(node) / count(root)
            return Node(share, output)
        split = node["split"]
        feature, limits = split["featureIndex"], split["leftCategoriesOrThreshold"]
        children = tuple(
            built(nodes[node[side]], count(node), seen | {feature}) for side in ("leftChild", "rightChild")
        )
        if split["numCategories"] >= 0:
            return Node(share, feature=feature, categories=tuple(limits), children=children)
        return Node(share, feature=feature, limit=limits[0], children=children)

    return Tree(built(root, count(root), frozenset()), most), base


def read_ensemble(spark: SparkSession, model, width: int) -> Ensemble:
    """Node tables of a fitted boosted-tree or forest classifier.

    Their size is bounded by the model: trees times nodes of the maximal depth.
    """
    path = stage_path(spark, "trees")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict] = {}
    for row in rows:
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    forest = model.__class__.__name__.startswith("RandomForest")
    weights = [1.0 / len(trees)] * len(trees) if forest else list(model.treeWeights)

    def value(node) -> float:
        stats = node["impurityStats"]
        return stats[1] / sum(stats) if forest else node["prediction"]

    def count(node) -> float:
        # a boosted tree's rows have weights, whose sum is the first of its statistics
        return node["rawCount"] if forest else node["impurityStats"][0]

    built = [_tree(trees[t], weights[t], value, count) for t in sorted(trees)]
    return Ensemble([tree for tree, _ in built], sum(base for _, base in built), width)


def _add_tree(tree: Tree, u: np.ndarray, weights: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Add the attributions of one tree; ``out`` is features by rows."""

    def visit(node: Node, product: np.ndarray, known: dict) -> np.ndarray:
        """Sum over the leaves below of output times product, per integration node and row."""
        if node.feature < 0:
            return product * node.output
        column = x[:, node.feature]
        left = np.isin(column, node.categories) if node.categories is not None else column <= node.limit
        before = known.get(node.feature)
        total = 0.0
        for child, goes in zip(node.children, (left, ~left)):
            if before is None:
                share, passed = child.share, goes
            else:
                share, passed = before[0] * child.share, before[1] & goes
            factor = share * (1 - u) + u * passed
            below = product * factor if before is None else product / before[2] * factor
            found = visit(child, below, {**known, node.feature: (share, passed, factor)})
            out[node.feature] += (passed - share) * (weights @ (found / factor))
            total = total + found
        if before is not None:
            # the split above counted this feature with its shorter path
            out[node.feature] -= (before[1] - before[0]) * (weights @ (total / before[2]))
        return total

    visit(tree.root, np.ones((len(u), len(x))), {})


@dataclass(frozen=True)
class Table:
    """What the leaves below a node add to ``features`` (rows of ``values``) by pattern of answers.

    The first answers are whether the features of the path let a row pass, those from
    ``first`` on whether it goes left at ``splits``.
    """

    first: int
    splits: tuple
    features: tuple
    values: np.ndarray


@dataclass(frozen=True)
class Branch:
    """A split above the tables; its feature has the answer at ``place``, maybe given already."""

    split: tuple
    place: int
    given: bool
    children: tuple


def _split(node: Node) -> tuple:
    return node.feature, node.limit, node.categories


def _inner(node: Node) -> list[Node]:
    """The splits below and at a node, in preorder."""
    return [node, *[n for child in node.children for n in _inner(child)]] if node.feature >= 0 else []


def _table(node: Node, shares: dict, splits: list[Node]) -> Table:
    patterns = np.arange(1 << (len(shares) + len(splits)))
    answers = [(patterns >> j & 1).astype(bool) for j in range(len(shares) + len(splits))]
    added, numbered = {}, iter(answers[len(shares) :])

    def add(leaf: Node, shares: dict, passed: dict) -> None:
        at, weights = np.polynomial.legendre.leggauss(max(1, (len(shares) + 1) // 2))
        u, weights = (at[:, None] + 1) / 2, weights / 2
        factors = {f: share * (1 - u) + u * passed[f] for f, share in shares.items()}
        product = leaf.output * np.prod(list(factors.values()), axis=0)
        for f, share in shares.items():
            added[f] = added.get(f, 0.0) + (passed[f] - share) * (weights @ (product / factors[f]))

    def visit(node: Node, shares: dict, passed: dict) -> None:
        if node.feature < 0:
            return add(node, shares, passed)
        f, left = node.feature, next(numbered)
        for child, goes in zip(node.children, (left, ~left)):
            visit(child, {**shares, f: shares.get(f, 1.0) * child.share}, {**passed, f: passed.get(f, True) & goes})

    visit(node, shares, dict(zip(shares, answers)))
    values = np.array([added[f] for f in added]).reshape(len(added), len(patterns))
    return Table(len(shares), tuple(_split(n) for n in splits), tuple(added), values)


def tabled(tree: Tree) -> Table | Branch | Tree:
    """The tree as tables below branches; a tree with a longer path than a table can hold as it is."""
    if tree.features_on_path > ANSWERS:
        return tree

    def built(node: Node, shares: dict) -> Table | Branch:
        splits = _inner(node)
        if len(shares) + len(splits) <= ANSWERS:
            return _table(node, shares, splits)
        f = node.feature
        children = tuple(built(c, {**shares, f: shares.get(f, 1.0) * c.share}) for c in node.children)
        return Branch(_split(node), list(shares).index(f) if f in shares else len(shares), f in shares, children)

    return built(tree.root, {})


def _look_up(tree: Table | Branch, goes_left, rows: int, out: np.ndarray) -> None:
    """Add the attributions of a tree of tables; ``goes_left`` answers a split for every row."""

    def visit(node: Table | Branch, pattern: np.ndarray) -> None:
        if isinstance(node, Table):
            for j, split in enumerate(node.splits, node.first):
                pattern = pattern | goes_left(split) << np.uint8(j)
            place = pattern.astype(np.intp)
            for f, values in zip(node.features, node.values):
                out[f] += values.take(place)
            return
        left, bit = goes_left(node.split), np.uint8(1 << node.place)
        for child, goes in zip(node.children, (left, 1 - left)):
            answer = goes << np.uint8(node.place)
            visit(child, pattern & (answer | ~bit) if node.given else pattern | answer)

    visit(tree, np.zeros(rows, dtype=np.uint8))


def shapley_values(ensemble: Ensemble, x: np.ndarray, trees: list | None = None) -> np.ndarray:
    """Rows by features; ``trees`` are those of the ensemble as ``tabled``, if at hand."""
    out, columns, answered = np.zeros((ensemble.width, len(x))), np.ascontiguousarray(x.T), {}

    def goes_left(split: tuple) -> np.ndarray:
        if split not in answered:
            if len(answered) >= SPLITS:
                answered.clear()
            feature, limit, categories = split
            column = columns[feature]
            left = np.isin(column, categories) if categories is not None else column <= limit
            answered[split] = left.astype(np.uint8)
        return answered[split]

    for tree in trees or [tabled(t) for t in ensemble.trees]:
        if not isinstance(tree, Tree):
            _look_up(tree, goes_left, len(x), out)
            continue
        # n nodes are exact up to degree 2n - 1; the degree is the number of features less one
        at, weights = np.polynomial.legendre.leggauss(max(1, (tree.features_on_path + 1) // 2))
        step = PRODUCTS // len(at)
        for start in range(0, len(x), step):
            rows = slice(start, start + step)
            _add_tree(tree, (at[:, None] + 1) / 2, weights / 2, x[rows], out[:, rows])
    return out.T


def attribution_column(spark: SparkSession, ensemble: Ensemble, features: str = "features") -> Column:
    """Array of attributions, in the order of the feature vector."""
    ship(spark)
    shared = spark.sparkContext.broadcast((ensemble, [tabled(tree) for tree in ensemble.trees]))

    @F.pandas_udf(ArrayType(DoubleType()))
    def attribute(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        ensemble, trees = shared.value
        return pd.Series(list(shapley_values(ensemble, np.array(vectors.tolist(), dtype=float), trees)))

    return attribute(vector_to_array(features))


def mean_importance(df: DataFrame, names: list[str], attributions: str = "phi") -> DataFrame:
    """(feature, importance): mean absolute attribution, largest first."""
    means = df.agg(*[F.avg(F.abs(F.col(attributions)[i])).alias(f"f{i}") for i in range(len(names))])
    cells = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"f{i}").alias("importance")) for i, n in enumerate(names)
    ])
    return means.select(F.inline(cells)).orderBy(F.desc("importance"), "feature")


def top_factors(names: list[str], attributions: str = "phi", n: int = 5) -> Column:
    """The ``n`` features with the largest absolute attribution of a row."""
    labels = F.array(*[F.lit(name) for name in names])
    factors = F.zip_with(
        F.col(attributions), labels,
        lambda v, name: F.struct((-F.abs(v)).alias("order"), name.alias("feature")),
    )
    return F.transform(
        F.slice(F.array_sort(factors), 1, n),
        lambda s: F.struct(s["feature"].alias("feature"), F.bround(-s["order"], 4).alias("importance")),
    )
