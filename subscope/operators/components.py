"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from subscope.session import staged


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of every source, or the source itself if smaller."""
    return edges.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (
        both.join(_smallest(both), "src")
        .where(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = _smallest(down)
    moved = down.join(low, "src").where(F.col("dst") != F.col("low")).select(
        F.col("dst").alias("src"), F.col("low").alias("dst")
    )
    return moved.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node connected with every node.

    ``edges`` has columns src and dst, ``nodes`` has column node. Every round is staged,
    so the plan does not grow and a lost executor repeats at most one round.
    """
    current = staged(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        current = staged(_small_star(_large_star(current)), "edges")
        after = _mark(current)
        if after == mark:
            break
        mark = after
    found = current.select(F.col("src").alias("node"), F.col("dst").alias("_low"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("_low", "node").alias("component"))
