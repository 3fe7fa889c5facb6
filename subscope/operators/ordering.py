"""Total orders, running sums and neighbour rows that no single task has to hold.

A window without ``partitionBy`` sends every row to one task, and a window over a
customer who owns a third of the rows is hardly better. The operators here cut an
ordered set of rows into slices at explicit split points, run the window inside
each slice, and carry the slice totals (or edge rows) across the cuts. Split points
come from a hash sample, so they depend only on the data; they steer the balance of
the slices and never the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from subscope.session import staged

SLICE_ROWS = 250_000
HOT_ROWS = 500_000
MAX_SLICES = 4096
SAMPLE_PER_SLICE = 64
_FAN = 64


def _slice_of(bounds: list, key: Column) -> Column:
    """Number of split points that are <= ``key``, by a two-level search."""
    fine = F.array(*bounds)
    if len(bounds) <= _FAN:
        return F.size(F.filter(fine, lambda b: b <= key))
    coarse = F.array(*bounds[_FAN - 1 :: _FAN])
    block = F.size(F.filter(coarse, lambda b: b <= key))
    return block * _FAN + F.size(
        F.filter(F.slice(fine, block * _FAN + 1, _FAN), lambda b: b <= key)
    )


def _literal(row, types) -> Column:
    return F.struct(*[F.lit(v).cast(t) for v, t in zip(row, types)])


def with_slices(df: DataFrame, keys: list[str], rows: int, slice_rows: int) -> tuple[DataFrame, int]:
    """Add ``_slice``: 0-based range of the total order ``keys`` (ascending, not null)."""
    wanted = min(MAX_SLICES, -(-rows // slice_rows)) if rows else 1
    if wanted <= 1:
        return df.withColumn("_slice", F.lit(0)), 1
    modulus = max(1, rows // (wanted * SAMPLE_PER_SLICE))
    types = [df.schema[k].dataType for k in keys]
    # at most MAX_SLICES * SAMPLE_PER_SLICE keys in expectation
    sample = (
        df.select(*keys)
        .where(F.pmod(F.xxhash64(*keys), F.lit(modulus)) == 0)
        .orderBy(*keys)
        .collect()
    )
    step = max(1, len(sample) // wanted)
    picked = sample[step::step][: wanted - 1]
    if not picked:
        return df.withColumn("_slice", F.lit(0)), 1
    bounds = [_literal(row, types) for row in picked]
    key = _struct(keys, types)
    return df.withColumn("_slice", _slice_of(bounds, key)), len(picked) + 1


def _struct(keys: list[str], types: list) -> Column:
    return F.struct(*[F.col(k).cast(t) for k, t in zip(keys, types)])


@dataclass
class Ordered:
    """An ordered table with its row count and column totals."""

    frame: DataFrame
    rows: int
    totals: dict[str, object]


def global_order(
    df: DataFrame,
    keys: list[str],
    rank: str | None = "rn",
    running: dict[str, str] | None = None,
    slice_rows: int | None = None,
    label: str = "ordered",
) -> Ordered:
    """Global row number and running sums over the ascending total order ``keys``.

    ``keys`` must identify a row. ``running`` maps output names to columns; each
    output is the sum over all rows up to and including the current one.
    """
    running = running or {}
    slice_rows = slice_rows or SLICE_ROWS
    base = staged(df, label)
    totals = base.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(o) for o, c in running.items()]
    ).first()
    rows = totals["_rows"]
    sliced, slices = with_slices(base, keys, rows, slice_rows)
    inside = Window.partitionBy("_slice").orderBy(*keys)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced
    if rank:
        out = out.withColumn(rank, F.row_number().over(inside).cast("bigint"))
    for name, column in running.items():
        out = out.withColumn(name, F.sum(column).over(upto))
    if slices > 1:
        before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        # one row per slice, at most MAX_SLICES
        offsets = (
            sliced.groupBy("_slice")
            .agg(
                F.count(F.lit(1)).alias("_n"),
                *[F.sum(c).alias(f"_sum_{o}") for o, c in running.items()],
            )
            .select(
                "_slice",
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                *[F.sum(f"_sum_{o}").over(before).alias(f"_before_{o}") for o in running],
            )
        )
        out = out.join(F.broadcast(offsets), "_slice")
        if rank:
            out = out.withColumn(rank, F.col(rank) + F.col("_before"))
        for name in running:
            # a slice or its predecessors may hold only nulls in the column
            carried = F.col(f"_before_{name}")
            out = out.withColumn(
                name,
                F.when(F.col(name).isNull(), carried).otherwise(
                    F.col(name) + F.coalesce(carried, F.lit(0))
                ),
            )
        out = out.drop("_before", *[f"_before_{o}" for o in running])
    return Ordered(out.drop("_slice"), rows, {o: totals[o] for o in running})


def ntile_of(rank: Column, rows: int, tiles: int) -> Column:
    """SQL NTILE from a global row number."""
    size, extra = divmod(rows, tiles)
    if size == 0:
        return rank.cast("int")
    edge = extra * (size + 1)
    head = F.call_function("div", rank - 1, F.lit(size + 1)) + 1
    tail = extra + F.call_function("div", rank - 1 - edge, F.lit(size)) + 1
    return F.when(rank <= edge, head).otherwise(tail).cast("int")


def rows_at_ranks(
    base: DataFrame, keys: list[str], rows: int, ranks: list[int], slice_rows: int | None = None
) -> list:
    """The key rows at the given 1-based ranks of the ascending total order ``keys``.

    ``base`` should be staged, it is read a few times. Only the slices that hold a
    wanted rank are sorted.
    """
    sliced, slices = with_slices(base.select(*keys), keys, rows, slice_rows or SLICE_ROWS)
    start = {0: 0}
    if slices > 1:
        sizes = {r["_slice"]: r["count"] for r in sliced.groupBy("_slice").count().collect()}
        start, seen = {}, 0
        for number in range(slices):
            start[number] = seen
            seen += sizes.get(number, 0)
    wanted = {}
    for rank in ranks:
        home = max((n for n, first in start.items() if first < rank), key=lambda n: (start[n], -n))
        wanted[rank] = (home, rank - start[home])
    places = F.array(*[F.struct(F.lit(h).cast("int"), F.lit(p).cast("int")) for h, p in set(wanted.values())])
    found = (
        sliced.where(F.col("_slice").isin(*{h for h, _ in wanted.values()}))
        .withColumn("_place", F.row_number().over(Window.partitionBy("_slice").orderBy(*keys)))
        .where(F.array_contains(places, F.struct(F.col("_slice").cast("int"), F.col("_place").cast("int"))))
        .collect()
    )
    by_place = {(r["_slice"], r["_place"]): tuple(r[k] for k in keys) for r in found}
    return [by_place[wanted[rank]] for rank in ranks]


def quantile_scores(
    base: DataFrame, keys: list[str], rows: int, bins: int = 5, slice_rows: int | None = None
) -> Column:
    """Score 1..bins by equal-count quantile cut of the global ranks.

    Quantile edges lie at interpolated ranks and bins are closed on the right, so this
    is not NTILE: rank r scores at most j exactly when r <= 1 + j*(rows-1)/bins. Only
    the rows at those ranks are looked up; the score is then a comparison per row.
    """
    if rows == 0:
        return F.lit(1)
    ranks = [1 + j * (rows - 1) // bins for j in range(1, bins)]
    types = [base.schema[k].dataType for k in keys]
    key = _struct(keys, types)
    score = F.lit(1)
    for row in rows_at_ranks(base, keys, rows, ranks, slice_rows):
        score = score + (key > _literal(row, types)).cast("int")
    return score


def heavy_keys(df: DataFrame, key: str, floor: int) -> list:
    """The keys with more than ``floor`` rows, at most MAX_SLICES of them.

    A key beyond the limit owns less than 1/MAX_SLICES of the rows, which is a fair
    share of the work, so leaving it whole costs no balance.
    """
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > floor)
        .orderBy(F.desc("n"), key)
        .limit(MAX_SLICES)
        .collect()
    )


def neighbour(
    df: DataFrame,
    key: str,
    order: list[str],
    values: list[str],
    direction: str = "previous",
    floor: int | None = None,
) -> DataFrame:
    """Add struct ``_near``: ``values`` of the previous or next row of the same key.

    ``order`` must identify a row within its key. Ordinary keys take one window; a key
    with more than ``floor`` rows is cut into slices, and the row next to a cut takes
    its neighbour from the edge table.
    """
    floor = floor or HOT_ROWS
    previous = direction == "previous"
    step = F.lag if previous else F.lead
    hot = heavy_keys(df, key, floor)
    payload = F.struct(*values)
    if not hot:
        return df.withColumn("_near", step(payload).over(Window.partitionBy(key).orderBy(*order)))

    spark = df.sparkSession
    total = sum(r["n"] for r in hot)
    target = max(floor, total // MAX_SLICES)
    key_type = df.schema[key].dataType.simpleString()
    plan = spark.createDataFrame(
        [(r[key], max(1, target // SAMPLE_PER_SLICE)) for r in hot],
        f"{key} {key_type}, _modulus bigint",
    )
    ordinal = F.struct(*order)
    # bounded: about SAMPLE_PER_SLICE keys per slice and 2 * MAX_SLICES slices
    bounds = staged(
        df.join(F.broadcast(plan), key)
        .where(F.pmod(F.xxhash64(key, *order), F.col("_modulus")) == 0)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(ordinal)).alias("_all"))
        .select(
            key,
            F.filter("_all", lambda _, i: i % SAMPLE_PER_SLICE == SAMPLE_PER_SLICE - 1).alias("_bounds"),
        ),
        "bounds",
    )
    cut = df.join(F.broadcast(bounds), key, "left").withColumn(
        "_slice",
        F.coalesce(F.size(F.filter("_bounds", lambda b: b <= ordinal)), F.lit(0)),
    )
    cut = cut.withColumn("_hot", F.col("_bounds").isNotNull()).drop("_bounds")
    pick = F.max_by if previous else F.min_by
    edges = (
        cut.where("_hot")
        .groupBy(key, "_slice")
        .agg(pick(payload, ordinal).alias("_edge"))
        .withColumn("_edge", step("_edge").over(Window.partitionBy(key).orderBy("_slice")))
        .where(F.col("_edge").isNotNull())
    )
    local = cut.withColumn(
        "_near", step(payload).over(Window.partitionBy(key, "_slice").orderBy(*order))
    )
    return (
        local.join(F.broadcast(edges), [key, "_slice"], "left")
        .withColumn("_near", F.coalesce("_near", "_edge"))
        .drop("_slice", "_hot", "_edge")
    )
