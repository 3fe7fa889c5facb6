"""Exact deduplication by a tree-merge of sorted digest runs.

Every document becomes one thin row (digest, check values, identifier) of one of R runs.
A run is sorted and reduced to its distinct digests; then, in binomial rounds, groups of
``fan_in`` runs are merged, each keeping the best identifier of every digest, until one
run is left. The winners travel back down the same tree, so a text that a third of all
documents share meets at most ``fan_in`` rows per merge and one small group per run at
the leaves. Runs are tables partitioned by (run, digest): no task ever holds a whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from subscope.llm.common import keep_rows, mark, numbered, staged

WHITE = r"[\x20\x09-\x0D]+"
KEY = ["digest", "check", "points"]


def _runs(df: DataFrame, fan_in: int) -> int:
    wanted, runs = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan_in
    while runs < wanted:
        runs *= fan_in
    return runs


def exact_dedup(docs: DataFrame, fan_in_bits: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its class of equal texts and who stays.

    Texts are equal when identical after white space is deleted; a null text counts as
    empty. Equality is the SHA-256 of the normalised text, verified at every level by
    its length and a second hash of another family. Of equal texts the one with most code
    points stays, then the smallest doc_id (null last), then one of identical rows.
    Other columns are ignored; an empty table gives an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256, _mark.
    """
    fan_in = 1 << fan_in_bits
    runs = _runs(docs, fan_in)
    text = F.coalesce(F.col("text"), F.lit(""))
    leaves = staged(
        numbered(docs.select("doc_id", "text"), runs)
        .withColumn("normal", F.regexp_replace(text, WHITE, ""))
        .select(
            "doc_id", "_row", F.col("_salt").alias("run"), mark().alias("_mark"), F.length(text).alias("size"),
            F.unhex(F.sha2("normal", 256)).alias("digest"), F.xxhash64("normal").alias("check"),
            F.length("normal").alias("points"),
        ),
        "leaves",
    )
    best = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    level = staged(
        leaves.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")), "run"
    )
    levels = [level]
    while runs > 1:
        runs //= fan_in
        merged = (
            level.withColumn("run", F.shiftright("run", fan_in_bits))
            .groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
        level = staged(merged, "run")
        levels.append(level)

    # back down: only classes of two and more have anything to tell
    winners = level.where("n > 1").select("run", *KEY, "best", "n")
    for below in reversed(levels[:-1]):
        above = winners.withColumnRenamed("run", "parent")
        winners = (
            below.select("run", *KEY).withColumn("parent", F.shiftright("run", fan_in_bits))
            .join(above, ["parent", *KEY]).drop("parent")
        )
    return leaves.join(winners, ["run", *KEY], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best._row") == F.col("_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "_mark",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_dedup`` keeps."""
    return keep_rows(docs, exact_dedup(docs).select("doc_id", "_mark", "kept"))
