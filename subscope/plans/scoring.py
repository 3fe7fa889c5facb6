"""Batch scoring jobs with the semantics of single requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from subscope.operators.quality import REQUEST_DEFAULTS, REQUEST_RANGE
from subscope.operators.recommend import Recommender
from subscope.session import lookup

# Upper limits of the latency buckets, in seconds; the last one is open.
LATENCY_LIMITS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def route() -> Column:
    """How a recommendation request is served; what a mode lacks sends it to cold start."""
    mode = F.col("mode")
    def given(column: str) -> Column:
        return F.coalesce(F.length(column) > 0, F.lit(False))

    return (
        F.when((mode == "similar") & given("current_tariff"), "similar")
        .when((mode == "hybrid") & given("customer_id"), "hybrid")
        .when((mode == "collaborative") & given("customer_id"), "collaborative")
        .otherwise("cold_start")
    )


def score_recommendations(recommender: Recommender, requests: DataFrame) -> DataFrame:
    """One row per request and recommended plan; the requested mode is kept.

    A request for plans similar to an unknown plan is answered by one row without a plan
    and status 500. A request without ``n`` gets the default number of plans; one whose ``n`` is
    out of range is refused by one row without a plan and status 422. Every other request
    has status 200; one that no plan is left for is answered by one row without a plan.
    """
    top = REQUEST_RANGE[1]
    known = requests.withColumn("route", route()).withColumn("n", F.coalesce("n", F.lit(REQUEST_DEFAULTS["n"])))
    fits = F.col("n").between(*REQUEST_RANGE)
    routed, refused = known.where(fits), known.where(~fits)

    def to(name: str) -> DataFrame:
        return routed.where(F.col("route") == name)

    personal = [
        to(name).join(
            getattr(recommender, name)(top, to(name).select("customer_id")), "customer_id", "left"
        )
        for name in ("hybrid", "collaborative")
    ]
    near = recommender.similar(top).withColumnRenamed("anchor", "current_tariff")
    similar = to("similar").join(near, "current_tariff", "left")
    cold = to("cold_start")
    offers = popular_offers(recommender, top)
    wanted = F.when(F.length("category") > 0, F.col("category")).otherwise("")
    popular = cold.withColumn("_list", wanted).join(offers, "_list", "left").drop("_list")
    served = [*personal, similar, popular]
    columns = ["request_id", "mode", "route", "n", "rank", "tariff_id", "name", "monthly_price", "data_gb",
               "plan_category", "score"]
    merged = reduce(DataFrame.unionByName, [_labelled(df).select(*columns) for df in served])
    answered = _answers(merged.where(F.col("rank").isNull() | (F.col("rank") <= F.col("n"))), "200")
    given = {"monthly_price": F.lit(0), "data_gb": F.lit(0), "category": F.lit(""), "status": F.lit("422")}
    told = {"request_id", "mode", "route"}
    return answered.unionByName(refused.select(*[
        (F.col(f.name) if f.name in told else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in answered.schema.fields
    ]))


def _answers(merged: DataFrame, status: str | Column) -> DataFrame:
    """Response columns from one row per request and plan; ``status`` is that of a request with plans or none left."""
    served = F.lit(status) if isinstance(status, str) else status
    return merged.select(
        "request_id", "mode", "route", "rank", "tariff_id",
        F.coalesce("name", "tariff_id").alias("name"),
        F.coalesce("monthly_price", F.lit(0)).alias("monthly_price"),
        F.coalesce("data_gb", F.lit(0)).alias("data_gb"),
        F.coalesce("plan_category", F.lit("")).alias("category"),
        F.bround("score", 4).alias("score"),
        F.when((served == "200") & (F.col("route") == "similar") & F.col("tariff_id").isNull(), "500").otherwise(served).alias("status"),
    )


#: The list of a route for keys that it does not know.
UNKNOWN = ""


def recommendation_lists(recommender: Recommender, top: int = REQUEST_RANGE[1]) -> DataFrame:
    """(route, key, plans): every list that a request can ask for, worked out once.

    Keys are customers, plans and categories as text. Lists of customers without ratings,
    and the overall ranking of the cold start, have the key ``UNKNOWN``; an unknown plan has none.
    """
    spark = recommender.items.sparkSession
    kind = dict(recommender.users.dtypes)["customer_id"]
    nobody = spark.range(1).select(F.lit(None).cast(kind).alias("customer_id"))
    parts = []
    for name in ("hybrid", "collaborative"):
        lists = getattr(recommender, name)
        for found in (lists(top), lists(top, nobody)):
            parts.append(found.withColumns({"route": F.lit(name), "key": F.coalesce(F.col("customer_id").cast("string"), F.lit(UNKNOWN))}))
    parts.append(recommender.similar(top).withColumns({"route": F.lit("similar"), "key": F.col("anchor")}))
    parts.append(popular_offers(recommender, top).withColumns({"route": F.lit("cold_start"), "key": F.col("_list")}))
    plan = F.struct("rank", "tariff_id", "name", "monthly_price", "data_gb", F.col("category").alias("plan_category"), "score")
    merged = reduce(DataFrame.unionByName, [p.select("route", "key", plan.alias("plan")) for p in parts])
    return merged.groupBy("route", "key").agg(F.array_sort(F.collect_list("plan")).alias("plans"))  # at most ``top`` each


def score_from_lists(lists: DataFrame, requests: DataFrame) -> DataFrame:
    """The answers of ``score_recommendations`` from stored lists, for a batch or a stream of requests.

    Stateless: a request meets the list of its route and key, else the route's list for unknown
    keys. ``lists`` is staged. The few lists that very many requests share, those of unknown keys and of
    the cold start, are broadcast when their number allows it and never shuffled
    against the requests; customers' lists are joined by customer.
    """
    small = lookup(lists.where((F.col("key") == UNKNOWN) | F.col("route").isin("cold_start", "similar")), "shared-lists")
    own = lists.where((F.col("key") != UNKNOWN) & F.col("route").isin("hybrid", "collaborative"))
    text = F.when(F.col("route").isin("hybrid", "collaborative"), F.col("customer_id").cast("string")).when(
        F.col("route") == "similar", F.col("current_tariff")
    ).otherwise(F.coalesce("category", F.lit("")))
    known = requests.withColumn("route", route()).withColumn("n", F.coalesce("n", F.lit(REQUEST_DEFAULTS["n"]))).withColumn("key", text)
    fits = F.col("n").between(*REQUEST_RANGE)

    def named(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col("route").alias(f"{name}_route"), F.col("key").alias(f"{name}_key"), F.col("plans").alias(name))

    shared, personal = named(small, "shared"), named(own, "personal")
    default = named(small.where(F.col("key") == UNKNOWN), "default")
    told = (
        known.join(personal, (F.col("route") == F.col("personal_route")) & (F.col("key") == F.col("personal_key")), "left")
        .join(shared, (F.col("route") == F.col("shared_route")) & (F.col("key") == F.col("shared_key")), "left")
        .join(F.broadcast(default), (F.col("route") == F.col("default_route")) & (F.col("route") != "cold_start"), "left")  # one per route
    )
    plans = F.when(fits, F.slice(F.coalesce("personal", "shared", "default"), F.lit(1), F.greatest(F.lit(0), F.col("n"))))
    made = told.select("request_id", "mode", "route", F.when(fits, "200").otherwise("422").alias("status"), F.explode_outer(plans).alias("plan"))
    merged = made.select("request_id", "mode", "route", "status", "plan.*")
    return _answers(merged, F.col("status"))


def _labelled(df: DataFrame) -> DataFrame:
    """The plan's category comes after the request's of the same name."""
    names = list(df.columns)
    last = len(names) - 1 - names[::-1].index("category")
    return df.toDF(*[("plan_category" if i == last else n) for i, n in enumerate(names)])


def popular_offers(recommender: Recommender, top: int) -> DataFrame:
    """Most popular plans overall (list '') and per category."""
    about = recommender.items.select(
        "tariff_id", "name", F.col("monthly_price").cast("int").alias("monthly_price"),
        F.col("data_gb").cast("int").alias("data_gb"), "category",
        F.col("popularity").cast("double").alias("score"),
    )
    both = about.withColumn("_list", F.lit("")).unionByName(about.withColumn("_list", F.col("category")))
    place = F.row_number().over(Window.partitionBy("_list").orderBy(F.desc("score"), "tariff_id"))
    return both.withColumn("rank", place).where(F.col("rank") <= top)


def request_counts(log: DataFrame) -> DataFrame:
    """Requests per endpoint and status."""
    return log.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


def latency_bucket() -> Column:
    """Number of the first bucket that holds ``seconds``; null for null."""
    edges = F.array(*[F.lit(x) for x in LATENCY_LIMITS])
    return F.when(F.col("seconds").isNotNull(), F.size(F.filter(edges, lambda e: e < F.col("seconds"))))


def latency_buckets(log: DataFrame) -> DataFrame:
    """Cumulative latency histogram per endpoint, as monitoring systems expect it."""
    counts = log.where(F.col("seconds").isNotNull()).groupBy("endpoint", latency_bucket().alias("bucket"))
    return cumulative_buckets(counts.agg(F.count(F.lit(1)).alias("n")))


def cumulative_buckets(counts: DataFrame) -> DataFrame:
    """(endpoint, le, requests) from counts ``n`` per endpoint and first bucket; the running sum is over buckets."""
    limits = [*LATENCY_LIMITS, float("inf")]
    frame = (
        counts.select("endpoint").distinct()
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(limits) - 1))))
        .join(counts, ["endpoint", "bucket"], "left")
    )
    upto = Window.partitionBy("endpoint").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    label = F.get(F.array(*[F.lit("+Inf" if x == float("inf") else str(x)) for x in limits]), F.col("bucket"))
    return frame.select(
        "endpoint", label.alias("le"), F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("requests")
    )
