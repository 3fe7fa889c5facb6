"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over the training time t in [0, 1]. Its demand for
words up to t is the integral of the schedule, scaled to the source's target; inverting
it gives the time at which a document's words are due. Documents of a source are dealt
in a fixed random order, as often as the target asks for, and the mix is the documents
sorted by range of their positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from subscope.llm.common import lines_of, mark, numbered_in, spot, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Tilt of the schedules 1 + tilt * (2 t - 1): sources that begin strong, level, and late ones.
TILTS = (-0.5, 0.0, 0.5)


def words(text: str = "text") -> Column:
    """Number of words, runs of anything but white space; null has none."""
    inner = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(inner == "", F.lit(0)).otherwise(
        F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def named(source: str = "source") -> Column:
    """A source as text that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words per source of ``sizes`` (_source, source_size); one row per source.

    Weights go round the sources by code point, null last. The targets share
    ``share`` times all words; none passes ``most`` times its source, and what it cannot
    take is shared anew among the others. That fixed point is found in one sorted
    pass: sources fill up in the order of capacity over weight, so the level is the
    remaining demand over the remaining weight at the first source that stays below it.
    The table has one row per source, as many as there are names to weigh.
    """
    by_name = W.orderBy("_source")
    ranked = sizes.withColumn("_nth", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_nth", F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "_nth")
    filled = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / F.sum(
        "weight"
    ).over(rest)
    levelled = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("weight") < F.col("cap"))
    # all sources after the first open one take the same level
    shared = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        by_fill.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return levelled.withColumn("_shared", shared).select(
        "_source", "source_size", "_nth",
        F.coalesce(F.least(F.col("_shared") * F.col("weight"), "cap"), "cap").alias("target"),
    )


def mixture(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    tilts: Sequence[float] = TILTS, seed: int = 7, row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): how often it is taken, and when.

    A document enters once for every whole time its source fits into its target, and once
    more if its middle word lies before what is left; ``taken`` counts its words with
    repeats, at most twice its size. The order of documents within a source depends on
    doc_id, text and seed; identical rows follow each other, each with a place and a fate of its
    own, so that a doc_id which many rows share is taken as far as the target goes. Null
    sources form a source of their own, null texts have no words. ``positions`` are the
    training times of its copies, in [0, 1]. Other columns are ignored, an empty table
    gives an empty result.

    Returns doc_id, size, source_size, target, taken, copies, positions, _mark, _source, _row.
    """
    # staged, as the sort by range reads it twice
    thin = staged(docs.select(
        "doc_id", mark().alias("_mark"), words().alias("size"), named().alias("_source"),
        spot("doc_id", F.lit(seed)).alias("_spot"), spot("text").alias("_tie"), (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"),
    ), "sized")
    # ``row`` or a row number tells identical rows apart, and only those
    placed = numbered_in(thin, "_source", [F.col("_spot"), F.col("_tie"), F.col("_row")], "mix", "size")
    sums = placed.groupBy("_source").agg(F.sum("size").alias("source_size"))
    goal = staged(targets(sums, weights, share, most), "goal")
    n = len(tilts)
    tilt = F.element_at(F.array(*[F.lit(float(x)) for x in tilts]), (F.pmod("_nth", F.lit(n)) + 1).cast("int"))
    middle = F.col("before") + F.col("size") / F.lit(2.0)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    planned = (
        placed.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, "_source")
        .withColumn("_rounds", rounds)
        .withColumn("_tilt", tilt)
        .withColumn(
            "copies",
            F.least(
                F.lit(int(most)),
                F.col("_rounds") + F.when(middle <= F.col("target") - F.col("_rounds") * F.col("source_size"), 1).otherwise(0),
            ).cast("int"),
        )
        .withColumn("_middle", middle)
    )

    def due(copy: Column) -> Column:
        # t with t + tilt * (t^2 - t) = u, the share of the source's target used up so far
        used = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("_middle")) / F.col("target"))
        level = F.lit(1.0) - F.col("_tilt")
        root = F.sqrt(level * level + F.lit(4.0) * F.col("_tilt") * used)
        return F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("_tilt") == 0, used).otherwise(
            (root - level) / (F.lit(2.0) * F.col("_tilt"))
        )

    return planned.select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies",
        F.expr("if(copies > 0, sequence(0, copies - 1), array())").alias("_nth"), "_tilt", "_middle", "_mark", "_source", "_row",
    ).withColumn("positions", F.transform("_nth", due)).drop("_nth", "_tilt", "_middle")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs``, whole, each row as often as the mix takes it, sorted by training position.

    Every row keeps its own plan, identical rows as well; a row is known by its place in
    the files that ``docs`` are read from. All columns stay, whatever their names.
    """
    told = lines_of(docs, "unmixed").withColumn("_own", F.concat_ws(":", "_file", "_line"))
    given = told.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), F.col("_doc.source").alias("source"), "_own")
    plans = staged(mixture(given, row="_own", **options).where("copies > 0").select("_row", "positions"), "plans")
    due = told.join(plans, F.col("_own") == F.col("_row")).select("_doc", F.explode("positions").alias("_position"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("_doc.doc_id")
    return due.repartitionByRange(parts, "_position", key).sortWithinPartitions("_position", key).select("_doc.*")
