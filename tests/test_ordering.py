import pytest
from pyspark.sql import Window, functions as F

from subscope.operators.ordering import (
    global_order,
    neighbour,
    ntile_of,
    quantile_scores,
    rows_at_ranks,
)
from subscope.session import staged


@pytest.fixture(scope="module")
def skewed(spark):
    """5000 rows; one key owns a third of them, one value repeats a third of the time."""
    k = F.col("id")
    return staged(
        spark.range(5000).select(
            k.alias("row_id"),
            F.when(k % 3 == 0, 7).otherwise(k % 400).cast("bigint").alias("owner"),
            F.when(k % 3 == 1, 50).otherwise(F.pmod(F.xxhash64(k), F.lit(900))).cast("decimal(12,2)").alias("amount"),
            F.date_add(F.lit("2024-01-01").cast("date"), (k * 37 % 90).cast("int")).alias("day"),
        ),
        "skewed",
    )


@pytest.mark.parametrize("slice_rows", [10_000_000, 700, 60])
@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_rank_and_running_sum_equal_a_plain_window(skewed, slice_rows, partitions):
    got = global_order(
        skewed.repartition(partitions), ["amount", "row_id"], running={"run": "amount"}, slice_rows=slice_rows
    )
    w = Window.orderBy("amount", "row_id")
    want = skewed.select(
        "row_id",
        F.row_number().over(w).alias("rn"),
        F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.ntile(7).over(w).alias("tile"),
    )
    assert got.rows == 5000
    tiled = got.frame.withColumn("tile", ntile_of(F.col("rn"), got.rows, 7)).select("row_id", "rn", "run", "tile")
    assert sorted(map(tuple, tiled.collect())) == sorted(map(tuple, want.collect()))


def test_slices_share_the_rows_evenly(skewed):
    from subscope.operators.ordering import with_slices

    sliced, n = with_slices(skewed, ["amount", "row_id"], 5000, 250)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert n >= 10 and max(sizes) < 3 * 250  # although one amount holds a third of the rows


def test_running_sum_survives_null_values(spark):
    df = spark.range(300).select(
        "id", F.when(F.col("id") % 5 != 0, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("v")
    )
    got = global_order(df, ["id"], rank=None, running={"run": "v"}, slice_rows=20).frame
    want = {i: (sum(j for j in range(0, i + 1, 5))) for i in range(300)}
    assert {r["id"]: r["run"] for r in got.collect()} == want


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 399, 1500])
@pytest.mark.parametrize("slice_rows", [10_000_000, 50])
def test_quantile_scores_follow_the_closed_form(spark, rows, slice_rows):
    df = staged(spark.range(rows).select("id", (F.col("id") * 13 % 101).alias("v")), "scores")
    scored = df.withColumn("score", quantile_scores(df, ["v", "id"], rows, 5, slice_rows)).collect()
    order = sorted(scored, key=lambda r: (r["v"], r["id"]))
    want = [max(1, -(-5 * i // max(rows - 1, 1))) for i in range(rows)]
    assert [r["score"] for r in order] == want


def test_quantile_scores_match_pandas(spark):
    import pandas as pd

    values = [(i * 7919) % 31 for i in range(997)]
    ranks = pd.Series(values).rank(method="first")
    want = pd.qcut(ranks, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    df = staged(spark.createDataFrame(list(enumerate(values)), "id bigint, v bigint"), "scores")
    got = df.withColumn("score", quantile_scores(df, ["v", "id"], 997)).orderBy("id").collect()
    assert [r["score"] for r in got] == want


def test_rows_at_ranks(skewed):
    order = sorted((r["amount"], r["row_id"]) for r in skewed.collect())
    for slice_rows in (10_000_000, 100):
        assert rows_at_ranks(skewed, ["amount", "row_id"], 5000, [1, 2500, 2500, 5000], slice_rows) == [
            order[0], order[2499], order[2499], order[4999]]


@pytest.mark.parametrize("direction", ["previous", "next"])
@pytest.mark.parametrize("floor", [10_000_000, 500, 20])
def test_neighbour_equals_lag_and_lead(skewed, direction, floor):
    got = neighbour(skewed, "owner", ["day", "row_id"], ["day", "amount"], direction, floor)
    step = F.lag if direction == "previous" else F.lead
    w = Window.partitionBy("owner").orderBy("day", "row_id")
    want = skewed.select("row_id", step("day").over(w).alias("d"), step("amount").over(w).alias("a"))
    got = got.select("row_id", F.col("_near.day").alias("d"), F.col("_near.amount").alias("a"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_key_is_cut_into_slices(skewed):
    """The window of a key with a third of the rows runs in pieces of about ``floor`` rows."""
    plan = neighbour(skewed, "owner", ["day", "row_id"], ["day"], floor=200)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in text
