"""Dimensions with history: versions by change digest, stable keys, look-ups by day.

A load compares what comes in with the open versions only, by a digest of the attributes. An
unchanged row keeps its version and its key; a changed one closes its version at the day of
the load and opens another; new keys continue above the largest one given out so far. So no
load ever changes a key that a fact already holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from subscope.operators.ordering import global_order
from subscope.session import staged

VALIDITY = ("valid_from", "valid_to")
FOREVER = "9999-12-31"


def change_digest(attributes: list[str]) -> Column:
    """SHA-256 of the attributes as text with their lengths, null apart from empty."""
    def told(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[told(a) for a in attributes]), 256)


def _incoming(rows: DataFrame, natural: str, attributes: list[str], day: str) -> DataFrame:
    """One row per natural key, null keys left out; of several rows the smallest digest stays."""
    state = F.struct(change_digest(attributes).alias("digest"), *attributes)
    return (
        rows.where(F.col(natural).isNotNull())
        .groupBy(natural).agg(F.min(state).alias("_state"))
        .select(natural, "_state.*", F.lit(day).cast("date").alias("_day"))
    )


def load_dimension(
    rows: DataFrame, natural: str, key: str, attributes: list[str], day: str,
    known: DataFrame | None = None, close_missing: bool = False,
) -> DataFrame:
    """The dimension after loading ``rows`` on ``day``, staged.

    ``known`` is the dimension before (key, natural, attributes, digest, valid_from,
    valid_to), none on the first load. Versions hold from valid_from until the day before
    valid_to; the open one has no valid_to. A version opened on ``day`` itself is
    corrected in place, so a load may be repeated; a load older than the newest version is
    refused. With ``close_missing`` keys that no longer come in are closed.
    """
    fresh = staged(_incoming(rows, natural, attributes, day), f"{key}-incoming")
    columns = [key, natural, *attributes, "digest", *VALIDITY]
    if known is None:
        empty = fresh.sparkSession.createDataFrame([], "k bigint, f date, t date")
        known = fresh.limit(0).join(empty, F.lit(True)).select(
            F.col("k").alias(key), natural, *attributes, "digest", F.col("f").alias("valid_from"), F.col("t").alias("valid_to")
        )
    before = known.agg(F.max(key).alias("top"), F.max(F.greatest("valid_from", "valid_to")).cast("string").alias("newest")).first()
    if before["newest"] and before["newest"] > day:
        raise ValueError(f"{key}: a load of {day} after one of {before['newest']}")

    # only open versions meet the load; closed ones are history
    open_ = known.where("valid_to is null").select(
        F.col(natural).alias("_natural"), F.col(key).alias("_key"), F.col("digest").alias("_digest"),
        F.col("valid_from").alias("_from"), F.struct(*attributes).alias("_held"),
    )
    met = staged(open_.join(fresh, F.col("_natural") == F.col(natural), "full_outer"), f"{key}-met")
    today = F.lit(day).cast("date")
    gone, same = F.col(natural).isNull(), F.col("_digest") == F.col("digest")
    corrected = ~gone & F.col("_key").isNotNull() & ~same & (F.col("_from") == today)
    stays = F.col("_key").isNotNull() & (same | (gone & F.lit(not close_missing)))
    opens = ~gone & (F.col("_key").isNull() | (~same & (F.col("_from") < today)))

    held = [F.col(f"_held.{a}").alias(a) for a in attributes]
    none = F.lit(None).cast("date")
    left = met.where(F.coalesce(stays, F.lit(False))).select(
        F.col("_key").alias(key), F.col("_natural").alias(natural), *held, F.col("_digest").alias("digest"), F.col("_from").alias("valid_from"), none.alias("valid_to")
    )
    fixed = met.where(F.coalesce(corrected, F.lit(False))).select(
        F.col("_key").alias(key), natural, *attributes, "digest", F.col("_from").alias("valid_from"), none.alias("valid_to")
    )
    ended = F.col("_key").isNotNull() & ~F.coalesce(stays, F.lit(False)) & ~F.coalesce(corrected, F.lit(False))
    closed = met.where(ended).select(
        F.col("_key").alias(key), F.col("_natural").alias(natural), *held, F.col("_digest").alias("digest"), F.col("_from").alias("valid_from"), today.alias("valid_to")
    )
    new = global_order(met.where(F.coalesce(opens, F.lit(False))).select(natural, *attributes, "digest"), [natural], rank="_rank", label=f"{key}-new").frame
    opened = new.select(
        (F.col("_rank") + F.lit(before["top"] or 0)).cast("bigint").alias(key), natural, *attributes, "digest",
        today.alias("valid_from"), none.alias("valid_to"),
    )
    result = known.where("valid_to is not null").select(*columns)
    for part in (left, fixed, closed, opened):
        result = result.unionByName(part.select(*columns))
    return staged(result, f"{key}-versions")


def load_history(loads: list[tuple[str, DataFrame]], natural: str, key: str, attributes: list[str], **options) -> DataFrame:
    """The dimension after all ``loads`` (day, rows), in their order."""
    dimension = None
    for day, rows in loads:
        dimension = load_dimension(rows, natural, key, attributes, day, dimension, **options)
    if dimension is None:
        raise ValueError("no load")
    return dimension


def as_of(dimension: DataFrame, day: str) -> DataFrame:
    """The versions valid on ``day``, at most one per natural key."""
    at = F.lit(day).cast("date")
    return dimension.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def with_version(facts: DataFrame, dimension: DataFrame, natural: str, key: str, day: str, from_the_start: bool = False) -> DataFrame:
    """``facts`` with ``key``: the version of their natural key valid on their ``day``, else null.

    One join on the natural key with the interval beside it; a natural key has as many
    versions as it changed, so a fact meets few rows. Intervals do not overlap, so no fact
    is doubled. With ``from_the_start`` the first version also covers the days before it.
    """
    start = F.col("valid_from")
    versions = dimension.select(natural, key, *VALIDITY)
    if from_the_start:
        first = dimension.groupBy(natural).agg(F.min("valid_from").alias("_first"))
        versions = versions.join(first, natural)
        start = F.when(F.col("valid_from") == F.col("_first"), F.lit("0001-01-01").cast("date")).otherwise(F.col("valid_from"))
    versions = versions.select(
        F.col(natural).alias("_natural"), F.col(key).alias("_version"), start.alias("_from"),
        F.coalesce("valid_to", F.lit(FOREVER).cast("date")).alias("_to"),
    )
    at = F.col(day).cast("date")
    told = facts.join(versions, (F.col(natural) == F.col("_natural")) & (at >= F.col("_from")) & (at < F.col("_to")), "left")
    return told.select(*facts.columns, F.col("_version").alias(key))


def store(dimension: DataFrame, path: str, day: str) -> None:
    """Write the dimension as the state after ``day``; a repeated load replaces its state."""
    dimension.write.mode("overwrite").parquet(f"{path}/load={day}")


def latest(spark, path: str) -> DataFrame | None:
    """The newest state under ``path``, none before the first load."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    states = sorted(f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().startswith("load="))
    return spark.read.parquet(f"{path}/{states[-1]}") if states else None
