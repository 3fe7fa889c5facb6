"""Plan recommendations: popularity, content, collaborative and hybrid.

Customers and plans stay distributed: the catalog is a table of blocks of BLOCK_ITEMS plans
(``operators/catalog.py``), and a task scores a group of customers against a block as one
matrix product and keeps the best n, so neither pairs of plans nor pairs of customer
and plan are ever written out. Collaborative and content searches leave out the
blocks that cannot hold anything better; a blend has to meet them all for its scaling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from subscope.operators import catalog as plans
from subscope.operators.catalog import DIGITS, Scorer, matrix as _matrix
from subscope.operators.factors import factorise
from subscope.operators.features import minmax_catalog
from subscope.operators.ordering import global_order
from subscope.session import staged

# Rows needed to trust collaborative scores, and the rating range.
MIN_INTERACTIONS = 3
LOW, HIGH = 1.0, 5.0
NUMERIC = ["monthly_price", "data_gb", "minutes"]
BLOCK_ITEMS = 20_000
# scores that a task holds at once, per array
CELLS = 4_000_000
# shrinkage of the bias means, and of the latent factors
BIAS_WEIGHT, FACTOR_PENALTY = 5.0, 0.1


def ratings(transactions: DataFrame) -> DataFrame:
    """Spend per (customer, plan) scaled to 1..5 within each customer; constant gives 1."""
    spend = (
        transactions.where(F.col("customer_id").isNotNull() & F.col("tariff_id").isNotNull())
        .groupBy("customer_id", "tariff_id")
        .agg(F.sum("amount").cast("double").alias("total_spend"), F.count("transaction_id").alias("months"))
    )
    # at most one row per plan and customer
    own = Window.partitionBy("customer_id")
    low, high = F.min("total_spend").over(own), F.max("total_spend").over(own)
    share = F.coalesce(F.try_divide(F.col("total_spend") - low, high - low), F.lit(0.0))
    return spend.select("customer_id", "tariff_id", (LOW + (HIGH - LOW) * share).alias("rating"), "months")


def popularity(transactions: DataFrame) -> DataFrame:
    """Distinct customers per plan, most popular first."""
    return (
        transactions.where(F.col("tariff_id").isNotNull())
        .groupBy("tariff_id")
        .agg(F.countDistinct("customer_id").alias("popularity"))
        .orderBy(F.desc("popularity"), "tariff_id")
    )


def current_tariff(rated: DataFrame) -> DataFrame:
    """The plan with the most months per customer."""
    order = F.struct(-F.col("months"), F.col("tariff_id"))
    return rated.groupBy("customer_id").agg(F.min_by("tariff_id", order).alias("current_tariff"))


def catalog_vectors(catalog: DataFrame) -> DataFrame:
    """(tariff_id, vec): catalog features of length one."""
    features, names = minmax_catalog(catalog, NUMERIC, "category")
    raw = features.select("tariff_id", F.array(*names).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda t, v: t + v * v))
    return raw.select("tariff_id", F.transform("raw", lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias("vec"))


def catalog_with_popularity(catalog: DataFrame, popular: DataFrame) -> DataFrame:
    return catalog.join(popular, "tariff_id", "left").withColumn(
        "popularity", F.coalesce("popularity", F.lit(0)).cast("bigint")
    )


def most_popular(catalog: DataFrame, n: int = 5, category: str | None = None) -> DataFrame:
    """Top ``n`` plans of a catalog with popularity, of one category if given."""
    chosen = catalog.where(F.col("category") == category) if category else catalog
    return (
        chosen.orderBy(F.desc("popularity"), "tariff_id")
        .limit(n)
        .select("tariff_id", F.col("popularity").cast("double").alias("score"))
    )


def _member(lists: pd.Series, block: pd.DataFrame) -> np.ndarray:
    """Row by item: is the item in the row's list?"""
    out = np.zeros((len(lists), len(block)), dtype=bool)
    each = lists.reset_index(drop=True).explode().dropna()
    place = pd.Index(block["tariff_id"]).get_indexer(each.to_numpy())
    out[each.index.to_numpy()[place >= 0], place[place >= 0]] = True
    return out


def _other(batch: pd.DataFrame, block: pd.DataFrame) -> np.ndarray:
    return batch["anchor_id"].to_numpy()[:, None] != block["tariff_id"].to_numpy()[None, :]


def _cosine(batch: pd.DataFrame, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    vectors = _matrix(block["vec"])
    return _matrix(batch["anchor"], vectors.shape[1]) @ vectors.T, _other(batch, block)


def _cosine_with_self(batch: pd.DataFrame, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    values, _ = _cosine(batch, block)
    return values, np.ones_like(values, dtype=bool)


def item_table(catalog: DataFrame, popular: DataFrame | None = None) -> DataFrame:
    """Catalog with position, feature vector and popularity, staged; no model columns yet."""
    place = global_order(catalog.select("tariff_id"), ["tariff_id"], rank="item", label="items").frame
    listed = catalog if popular is None else catalog_with_popularity(catalog, popular)
    if popular is None:
        listed = listed.withColumn("popularity", F.lit(0).cast("bigint"))
    return staged(
        listed.join(place.withColumn("item", F.col("item") - 1), "tariff_id")
        .join(catalog_vectors(catalog), "tariff_id")
        .withColumns({"bias": F.lit(0.0), "factors": F.lit(None).cast("array<double>")}),
        "items",
    )


def similar_plans(
    items: DataFrame, n: int, block_items: int = BLOCK_ITEMS, with_self: bool = False, anchors: DataFrame | None = None
) -> DataFrame:
    """(anchor, rank, tariff_id, score): the ``n`` plans nearest in cosine to each plan of ``anchors``, all by default.

    Plans are laid out by the nearest of a few pivots; an anchor meets its own block
    first and then the blocks that reach as near as its n-th neighbour.
    """
    total = items.count()
    scorer = _cosine_with_self if with_self else _cosine
    if total <= block_items:
        laid, blocks, limits = items.withColumn("cell", F.lit(0)), 1, None
    else:
        near = plans.by_pivots(items, "vec", "tariff_id", -(-total // block_items))
        laid, blocks = plans.cut(near, ["pivot", "tariff_id"], "cell", block_items, "cells")
        limits = plans.reach(laid, "cell", "vec")
    asked = laid if anchors is None else laid.join(anchors.select("tariff_id"), "tariff_id", "left_semi")
    rows = asked.select(F.col("tariff_id").alias("anchor_id"), F.col("vec").alias("anchor"), F.col("cell").alias("_own"))

    def vector(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(batch["anchor"]), np.zeros(len(batch))

    best = plans.best(
        rows, "anchor_id", laid.select("tariff_id", "vec", "cell"), "cell", blocks, scorer, n, CELLS,
        first=F.col("_own"), limits=limits, vector=vector,
    )
    return best.withColumnRenamed("anchor_id", "anchor")


def _predicted(batch: pd.DataFrame, block: pd.DataFrame) -> np.ndarray:
    width = max((len(c[c.notna()].iloc[0]) for c in (batch["factors"], block["factors"]) if c.notna().any()), default=1)
    base = batch["base"].to_numpy(dtype=float)[:, None] + block["bias"].to_numpy(dtype=float)[None, :]
    return np.clip(base + _matrix(batch["factors"], width) @ _matrix(block["factors"], width).T, LOW, HIGH)


def _unseen(batch: pd.DataFrame, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _predicted(batch, block), ~_member(batch["seen"], block)


def _any(batch: pd.DataFrame, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    values = _predicted(batch, block)
    return values, np.ones_like(values, dtype=bool)


def _hybrid_parts(batch: pd.DataFrame, block: pd.DataFrame):
    """Collaborative and content scores, each with the items it covers."""
    trusted = batch["trusted"].to_numpy(dtype=bool)[:, None]
    collab = np.where(trusted, _predicted(batch, block), block["popularity"].to_numpy(dtype=float)[None, :])
    in_collab = ~trusted | ~_member(batch["seen"], block)
    content, other = _cosine(batch, block)
    anchored = batch["anchor"].notna().to_numpy()[:, None]
    return (np.round(collab, DIGITS), in_collab), (np.round(content, DIGITS), other & anchored)


def _limits(values: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.where(covered, values, np.inf).min(axis=1),
        np.where(covered, values, -np.inf).max(axis=1),
    )


def _scaled(values: np.ndarray, covered: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Min-max scaling over the covered items; a constant list scales to one half."""
    with np.errstate(invalid="ignore", divide="ignore"):
        flat = (high <= low)[:, None]
        share = np.where(flat, 0.5, (values - low[:, None]) / (high - low)[:, None])
    return np.where(covered, share, 0.0)


_LIMIT_COLUMNS = ["c_low", "c_high", "b_low", "b_high"]


def _hybrid_scorer(alpha: float) -> Scorer:
    def score(batch: pd.DataFrame, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        (collab, in_c), (content, in_b) = _hybrid_parts(batch, block)
        if "c_low" in batch:
            c_low, c_high, b_low, b_high = (batch[c].to_numpy(dtype=float) for c in _LIMIT_COLUMNS)
        else:
            (c_low, c_high), (b_low, b_high) = _limits(collab, in_c), _limits(content, in_b)
        blend = alpha * _scaled(collab, in_c, c_low, c_high) + (1 - alpha) * _scaled(content, in_b, b_low, b_high)
        return blend, _other(batch, block)

    return score


def _hybrid_limits(rows: DataFrame, key: str, items: DataFrame, blocks: int) -> DataFrame:
    """Score limits per row over all blocks, for a catalog of more than one block."""
    kind = dict(rows.dtypes)[key]

    def measure(batch: pd.DataFrame, block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        (collab, in_c), (content, in_b) = _hybrid_parts(batch, block)
        yield pd.DataFrame({key: batch[key], **dict(zip(_LIMIT_COLUMNS, [*_limits(collab, in_c), *_limits(content, in_b)]))})

    schema = f"{key} {kind}, " + ", ".join(f"{c} double" for c in _LIMIT_COLUMNS)
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    merged = plans.meet(rows, key, every, items, "block", blocks, measure, schema, CELLS)
    return merged.groupBy(key).agg(
        *[(F.min if c.endswith("low") else F.max)(c).alias(c) for c in _LIMIT_COLUMNS]
    )


@dataclass
class Recommender:
    """Fitted tables: ``items`` (one row per plan) and ``users`` (one row per customer)."""

    rank: int = 50
    epochs: int = 20
    seed: int = 42
    alpha: float = 0.6
    min_interactions: int = MIN_INTERACTIONS
    collaborative_model: bool = True
    block_items: int = BLOCK_ITEMS
    items: DataFrame | None = field(default=None, repr=False)
    users: DataFrame | None = field(default=None, repr=False)

    # ---------------------------------------------------------------- fitting

    def fit(self, transactions: DataFrame, tariffs: DataFrame) -> Recommender:
        rated = staged(ratings(transactions), "ratings")
        # a customer has one rating per plan, so ratings count customers
        popular = rated.groupBy("tariff_id").agg(F.count(F.lit(1)).alias("popularity"))
        items = item_table(tariffs, popular)
        mean = 0.0
        if self.collaborative_model:
            mean, item_bias, user_bias = self._biases(rated)
            user_factors, item_factors = self._factors(rated, tariffs, mean, item_bias, user_bias)
            items = staged(
                items.drop("bias", "factors")
                .join(item_bias, "tariff_id", "left")
                .join(item_factors, "tariff_id", "left")
                .na.fill({"bias": 0.0}),
                "items",
            )
        self.items = items
        own = rated.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("interactions"),
            F.collect_set("tariff_id").alias("seen"),  # at most the catalog
            F.min_by("tariff_id", F.struct(-F.col("months"), F.col("tariff_id"))).alias("anchor_id"),
        )
        if self.collaborative_model:
            own = (
                own.join(user_bias, "customer_id", "left")
                .join(user_factors, "customer_id", "left")
                .withColumn("base", F.lit(mean) + F.coalesce("user_bias", F.lit(0.0)))
                .drop("user_bias")
            )
        else:
            own = own.withColumns({"base": F.lit(mean), "factors": F.lit(None).cast("array<double>")})
        self.users = staged(own, "users")
        return self

    @staticmethod
    def _biases(rated: DataFrame) -> tuple[float, DataFrame, DataFrame]:
        """Global mean and shrunken mean deviations per plan and per customer."""
        mean = rated.agg(F.avg("rating")).first()[0] or 0.0

        def shrunk(value: Column) -> Column:
            return F.sum(value) / (F.lit(BIAS_WEIGHT) + F.count(F.lit(1)))

        item_bias = staged(
            rated.groupBy("tariff_id").agg(shrunk(F.col("rating") - mean).alias("bias")), "item-bias"
        )
        user_bias = rated.join(item_bias, "tariff_id").groupBy("customer_id").agg(
            shrunk(F.col("rating") - mean - F.col("bias")).alias("user_bias")
        )
        return mean, item_bias, staged(user_bias, "user-bias")

    def _factors(self, rated, tariffs, mean, item_bias, user_bias) -> tuple[DataFrame, DataFrame]:
        """Latent factors of the residuals that the biases leave."""
        known = tariffs.select("tariff_id").unionByName(rated.select("tariff_id")).distinct()
        numbered = global_order(known, ["tariff_id"], rank="code", label="plans").frame
        numbered = staged(numbered.select("tariff_id", F.col("code").cast("int").alias("code")), "plans")
        people = global_order(
            rated.select("customer_id").distinct(), ["customer_id"], rank="user", label="people"
        ).frame
        people = staged(people.select("customer_id", F.col("user").cast("int").alias("user")), "people")
        residual = (
            rated.join(item_bias, "tariff_id").join(user_bias, "customer_id").join(numbered, "tariff_id")
            .join(people, "customer_id")
            .select("user", "code", (F.col("rating") - mean - F.col("bias") - F.col("user_bias")).alias("rest"))
        )
        customers, plan_factors = factorise(
            staged(residual, "residual"), numbered.count(), self.rank, self.epochs, FACTOR_PENALTY, self.seed
        )

        def factors(table: DataFrame, keys: DataFrame, number: str) -> DataFrame:
            return table.join(keys, F.col("id") == F.col(number)).select(
                keys.columns[0], F.col("features").cast("array<double>").alias("factors")
            )

        return factors(customers, people, "user"), factors(plan_factors, numbered, "code")

    # ---------------------------------------------------------------- scoring

    def _fitted(self) -> DataFrame:
        if self.items is None:
            raise RuntimeError("recommender is not fitted")
        return self.items

    def _described(self, recommended: DataFrame) -> DataFrame:
        about = self._fitted().select(
            "tariff_id", "name", F.col("monthly_price").cast("int").alias("monthly_price"),
            F.col("data_gb").cast("int").alias("data_gb"), "category",
        )
        return recommended.join(about, "tariff_id", "left")

    def _anchored(self, rows: DataFrame) -> DataFrame:
        return rows.join(
            self._fitted().select(F.col("tariff_id").alias("anchor_id"), F.col("vec").alias("anchor")),
            "anchor_id", "left",
        )

    def cold_start(self, n: int = 5, category: str | None = None) -> DataFrame:
        """Most popular plans, overall or of one category."""
        return self._described(most_popular(self._fitted(), n, category)).orderBy(F.desc("score"), "tariff_id")

    def similar(self, n: int = 5) -> DataFrame:
        """(anchor, rank, tariff_id, score): the plans most like each plan."""
        best = similar_plans(self._fitted(), n, self.block_items)
        return self._described(best)

    def similar_to(self, tariff_id: str, n: int = 5) -> DataFrame:
        anchor = self._fitted().where(F.col("tariff_id") == tariff_id)
        if anchor.isEmpty():
            raise ValueError(f"unknown tariff: {tariff_id}")
        best = similar_plans(self._fitted(), n, self.block_items, anchors=anchor)
        return self._described(best).drop("anchor").orderBy("rank")

    def _laid_out(self) -> tuple[DataFrame, int]:
        """The catalog in blocks by falling length of the factors, and the number of blocks."""
        items = self._fitted().select("tariff_id", "vec", "popularity", "bias", "factors")
        total = items.count()
        if total <= self.block_items:
            return items.withColumn("block", F.lit(0)), 1
        length = F.sqrt(F.aggregate(F.coalesce("factors", F.array().cast("array<double>")), F.lit(0.0), lambda t, v: t + v * v))
        return plans.cut(items.withColumn("_fall", -length), ["_fall", "tariff_id"], "block", self.block_items, "catalog")

    def _customers(self, customers: DataFrame | None) -> DataFrame:
        """User rows, of the given ids if any; an unknown id has no ratings."""
        self._fitted()
        users = self.users
        if customers is not None:
            users = customers.select("customer_id").distinct().join(users, "customer_id", "left")
        trusted = F.coalesce(F.col("interactions"), F.lit(0)) >= self.min_interactions
        return users.withColumn("trusted", trusted & F.lit(self.collaborative_model)).na.fill({"base": 0.0})

    def _popular_for(self, customers: DataFrame, n: int) -> DataFrame:
        """The ``n`` most popular plans for every customer."""
        top = most_popular(self._fitted(), n).collect()  # n rows
        listed = F.array(*[
            F.struct(F.lit(i + 1).alias("rank"), F.lit(r["tariff_id"]).alias("tariff_id"),
                     F.lit(r["score"]).alias("score"))
            for i, r in enumerate(top)
        ])
        return customers.select("customer_id", F.inline(listed))

    def collaborative(self, n: int = 5, customers: DataFrame | None = None, exclude_current: bool = True) -> DataFrame:
        """Best plans per customer, unseen ones unless told otherwise; popular ones for customers with few ratings."""
        users = self._customers(customers)
        cold = self._popular_for(users.where(~F.col("trusted")), n)
        if self.collaborative_model:
            laid, blocks = self._laid_out()

            def vector(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
                return _matrix(batch["factors"], limits.centres.shape[1]), batch["base"].to_numpy(dtype=float)

            limits = plans.reach(laid, "block", "factors", "bias") if blocks > 1 else None
            best = plans.best(
                users.where("trusted").select("customer_id", "base", "factors", "seen"), "customer_id", laid, "block", blocks,
                _unseen if exclude_current else _any, n, CELLS, first=F.lit(0), limits=limits, vector=vector, between=(LOW, HIGH),
            )
            cold = best.unionByName(cold)
        return self._described(cold)

    def hybrid(self, n: int = 5, customers: DataFrame | None = None) -> DataFrame:
        """Blend of scaled collaborative and content scores, without the current plan."""
        rows = self._anchored(self._customers(customers)).select(
            "customer_id", "base", "factors", "seen", "trusted", "anchor_id", "anchor"
        )
        laid, blocks = self._laid_out()
        if blocks > 1:
            rows = staged(rows, "hybrid")
            rows = rows.join(_hybrid_limits(rows, "customer_id", laid, blocks), "customer_id")
        best = plans.best(rows, "customer_id", laid, "block", blocks, _hybrid_scorer(self.alpha), n, CELLS)
        return self._described(best)

    # ---------------------------------------------------------------- storage

    def save(self, path: str) -> None:
        settings = {k: v for k, v in vars(self).items() if k not in ("items", "users")}
        spark = self._fitted().sparkSession
        spark.createDataFrame([settings]).write.mode("overwrite").json(f"{path}/settings")
        self.items.write.mode("overwrite").parquet(f"{path}/items")
        self.users.write.mode("overwrite").parquet(f"{path}/users")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recommender:
        settings = spark.read.json(f"{path}/settings").first().asDict()
        return cls(
            **settings, items=spark.read.parquet(f"{path}/items"), users=spark.read.parquet(f"{path}/users")
        )
