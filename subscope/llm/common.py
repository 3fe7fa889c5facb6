"""Helpers shared by the corpus operators: row identity, running sums, joins on hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil, isqrt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from subscope.session import lookup, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spot(*columns: str | Column) -> Column:
    """A 60-bit position that looks random but depends on the columns alone.

    The leading 15 hex digits of an MD5, so SQL engines order by it as well; nulls count
    as the text ``null``.
    """
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, salts: int = 64) -> DataFrame:
    """``df`` with ``_row``, a number of its own for every row, and ``_salt`` = 0 to salts - 1.

    The numbers follow the input split, so the result must be staged before it is used
    twice; nothing that the operators return depends on which row got which number,
    except which of several identical rows stands for them.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "_salt", F.pmod("_row", F.lit(salts)).cast("int")
    )


def attach(rows: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """Left join of ``rows`` (with ``_salt``) to ``values``, unique on the non-null ``keys``.

    A key that a third of the rows share meets its value once per salt, then every
    (key, salt) is a small group of its own.
    """
    cells = rows.select(*keys, "_salt").distinct().join(values, keys)
    return rows.join(cells, [*keys, "_salt"], "left")


def running(df: DataFrame, keys: list[str], place: str, ties: list[str], amount: str | None = None) -> DataFrame:
    """``rank`` (from 0) and ``before`` (sum of ``amount`` over earlier rows) within ``keys``.

    Rows are ordered by ``place``, a ``spot``, then ``ties``. The range of spots is cut into
    as many buckets as a bucket has rows (1,024 at least): bucket totals are summed up
    per key, and windows run inside (key, bucket) only, so a key with a third of all rows
    is spread like the others. ``df`` is staged and its keys are not null.
    """
    rows = df.count()
    buckets = max(1, ceil(rows / max(1024, isqrt(rows))))
    value = F.col(amount) if amount else F.lit(0)
    cut = df.withColumn("_bucket", F.shiftright(F.shiftright(place, 30) * F.lit(buckets), 30))
    totals = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(place, *ties)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        cut.join(starts, [*keys, "_bucket"])
        .withColumn("rank", F.col("_n0") + F.row_number().over(inside) - 1)
        .withColumn("before", F.col("_sum0") + F.sum(value).over(upto) - value)
        .drop("_bucket", "_n0", "_sum0")
    )


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside hand their rows to Python in batches of about ``most`` bytes.

    The default bounds a batch by rows alone, and rows are whole texts here.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def numbered_in(rows: DataFrame, key: str, order: list[Column], label: str, amount: str | None = None) -> DataFrame:
    """``rows``, staged, with ``position``: the place (from 0) within ``key`` in ``order``.

    With ``amount`` also ``before``, its sum over earlier rows of the key.

    Rows are sorted by range of (key, order), so a key that holds a third of them is cut into
    many ranges; a row's place is its place in its range's share of the key, which the
    range's own row numbers give, plus the rows of earlier ranges. Only one row per
    (range, key) is looked at across ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(key).asc_nulls_first(), *order]
    cut = staged(
        rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()),
        label,
    )
    value = F.col(amount) if amount else F.lit(0)
    shares = cut.groupBy(key, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"))
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = lookup(
        shares.select(F.col(key).alias("_same_key"), F.col("_range").alias("_in"), (upto("_n") - F.col("_first")).alias("_shift"), upto("_sum").alias("_sum0")),
        f"{label}-starts",
    )
    same = F.col(key).eqNullSafe(F.col("_same_key")) & (F.col("_range") == F.col("_in"))
    placed = cut.join(starts, same).withColumn("position", F.col("_place") + F.col("_shift"))
    if amount:
        inside = W.partitionBy(key, "_range").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = placed.withColumn("before", F.col("_sum0") + F.sum(value).over(inside) - value)
    return placed.drop("_same_key", "_in", "_range", "_place", "_shift", "_sum0")


def whole(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``_doc``, so that no name of theirs meets a name of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def lines_of(docs: DataFrame, label: str) -> DataFrame:
    """``whole(docs)`` with ``_file`` and ``_line``, where each row stands in its files.

    The pair names a row, identical ones apart, and sorts in the order the rows were
    written in; it is the same on every read. ``docs`` that are no plain file scan are staged.
    """
    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_line")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    try:
        return docs.select(row, *place)
    except AnalysisException:
        return staged(docs, label).select(row, *place)


def mark(text: str = "text") -> Column:
    """With the doc_id, identifies a row: the hash of its text, null and empty apart."""
    return F.xxhash64(F.col(text))


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (doc_id, _mark, kept; one row per row) keep.

    Only what goes is joined: as a broadcast up to a counted number of rows, else as a
    shuffled join. Of rows with the same doc_id and text one stays if one is kept.
    """
    same = verdicts.groupBy("doc_id", "_mark").agg(F.max("kept").alias("_any"), F.count(F.lit(1)).alias("_n"))
    odd = same.where("not _any or _n > 1").select(
        F.col("doc_id").alias("_id"), F.col("_mark").alias("_m"), F.when(F.col("_any"), "repeat").otherwise("drop").alias("_fate")
    )
    fates = lookup(odd, "fates")
    seen = whole(docs).withColumn("_mark", mark("_doc.text")).join(
        fates, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m")), "left"
    )
    kept = seen.where(F.col("_fate").isNull()).select("_doc.*")
    if fates.where("_fate = 'repeat'").isEmpty():
        return kept
    once = seen.where("_fate = 'repeat'").dropDuplicates(["_id", "_m"]).select("_doc.*")
    return kept.unionByName(once)


__all__ = ["arrow_batches", "attach", "keep_rows", "lines_of", "lookup", "mark", "numbered", "numbered_in", "running", "spot", "staged", "table", "whole"]
