"""Every query by name, as a function of a session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from subscope.functions.scalars import risk_by_bins, risk_by_score
from subscope.operators import (
    churn,
    density,
    drift,
    eda,
    experiments,
    features,
    kpis,
    quality,
    recommend,
    rfm,
    segments,
)
from subscope.plans import reports, scoring
from subscope.session import stage_path, staged
from subscope.sources import files, generate, history, star, tables as t
from subscope.streaming import counters, jobs, windows

Query = Callable[[SparkSession, str], DataFrame]


def _calendar(spark: SparkSession, folder: str) -> DataFrame:
    return star.calendar_of(t.table(spark, folder, "orders"), "o_orderdate")


def report_queries() -> dict[str, Query]:
    return {
        "dim_date": _calendar,
        "q1_monthly_revenue": lambda s, d: reports.monthly_revenue(
            t.fact_transactions(s, d), _calendar(s, d)),
        "q2_value_tiers": lambda s, d: reports.value_tiers(
            t.fact_transactions(s, d), t.dim_customer(s, d)),
        "q3_top_customers_per_city": lambda s, d: reports.top_customers_per_city(
            t.fact_transactions(s, d), t.dim_customer(s, d)),
        "q4_tariff_changes": lambda s, d: reports.tariff_changes(
            t.fact_transactions(s, d), t.dim_customer(s, d), t.dim_tariff(s), _calendar(s, d)),
        "q5_cohort_retention": lambda s, d: reports.cohort_retention(
            t.fact_transactions(s, d), _calendar(s, d)),
        "q6_churn_by_segment": lambda s, d: reports.churn_by_segment(
            t.fact_transactions(s, d), t.dim_customer(s, d), _calendar(s, d), t.AS_OF),
        "q6_churn_by_segment_literal": lambda s, d: reports.churn_by_segment_per_transaction(
            t.fact_transactions(s, d), t.dim_customer(s, d), _calendar(s, d), t.AS_OF),
        "q7_days_to_next": lambda s, d: reports.days_to_next(
            t.fact_transactions(s, d), t.dim_customer(s, d), _calendar(s, d)),
    }


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round computed doubles, so that a check does not hang on the order of a sum."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with RFM features and scores."""
    return rfm.merge_with_customers(t.subscribers(spark, folder), rfm.rfm_scores(t.transactions(spark, folder)))


def feature_queries() -> dict[str, Query]:
    means = ("avg_data_gb", "avg_minutes")

    def score_counts(s: SparkSession, d: str) -> DataFrame:
        scores = rfm.rfm_scores(t.transactions(s, d)).select("r_score", "f_score", "m_score")
        long = scores.unpivot([], ["r_score", "f_score", "m_score"], "score", "level")
        return long.groupBy("score", "level").count()

    return {
        "rfm_base": lambda s, d: rounded(
            rfm.rfm_base(t.transactions(s, d)).drop("monetary_exact"), 6, *means),
        "rfm_scores": lambda s, d: rounded(rfm.rfm_scores(t.transactions(s, d)), 6, *means),
        "rfm_merged": lambda s, d: rounded(
            rfm.merge_with_customers(
                t.subscribers(s, d), rfm.rfm_scores(t.transactions(s, d))
            ), 6, *means),
        "rfm_score_counts": score_counts,
    }


def board_queries() -> dict[str, Query]:
    def rates(column: str) -> Query:
        return lambda s, d: rounded(kpis.rate_by(t.subscribers(s, d), column), 6, "churn_rate")

    def counts(column: str) -> Query:
        return lambda s, d: kpis.value_counts(t.subscribers(s, d), column)

    numeric = [
        "age", "tenure_months", "paperless_billing", "has_internet", "has_tv", "has_roaming", "churn",
        "recency", "frequency", "monetary", "avg_data_gb", "avg_minutes",
        "r_score", "f_score", "m_score", "rfm_score",
    ]
    def levelled(s: SparkSession, d: str, scale) -> DataFrame:
        return t.scored_customers(s, d).select(
            "customer_id", "churn_probability", scale(F.col("churn_probability")).alias("risk_level"))

    return {
        "kpi_overview": lambda s, d: rounded(rounded(rounded(
            kpis.overview(t.subscribers(s, d), t.transactions(s, d)),
            6, "churn_rate"), 2, "avg_monthly_revenue"), 4, "arpu"),
        "kpi_monthly_revenue": lambda s, d: kpis.revenue_by_month(t.transactions(s, d)),
        "churn_by_contract": rates("contract_type"),
        "churn_by_segment": rates("segment_name"),
        "churn_by_city": rates("city"),
        "churn_by_payment": rates("payment_method"),
        "customers_by_city": counts("city"),
        "segment_counts": counts("segment_name"),
        "distinct_segments": lambda s, d: t.subscribers(s, d).select("segment_name").distinct().orderBy(
            "segment_name"),
        "segment_explorer": lambda s, d: kpis.explore_segment(t.subscribers(s, d), "ASIA"),
        "risk_level_scoring": lambda s, d: levelled(s, d, risk_by_score),
        "risk_level_bins": lambda s, d: levelled(s, d, risk_by_bins),
        "risk_counts": lambda s, d: kpis.value_counts(levelled(s, d, risk_by_bins), "risk_level"),
        "churn_kpis": lambda s, d: rounded(
            kpis.churn_board(t.scored_customers(s, d)), 6, "avg_probability", "actual_churn"),
        "high_risk_customers": lambda s, d: kpis.high_risk(t.scored_customers(s, d)),
        "segment_profile_dash": lambda s, d: kpis.segment_board(enriched(s, d)),
        "histogram_by_class": lambda s, d: eda.histogram(enriched(s, d), "tenure_months", "churn", 30),
        "histogram_by_risk": lambda s, d: eda.histogram(
            levelled(s, d, risk_by_bins), "churn_probability", "risk_level", 40),
        "box_monetary_by_churn": lambda s, d: rounded(
            eda.box_summary(enriched(s, d), "monetary", "churn"),
            4, "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high"),
        "describe_numeric": lambda s, d: rounded(
            eda.describe(enriched(s, d), numeric), 4, "mean", "std", "min", "q25", "q50", "q75", "max"),
        "corr_matrix": lambda s, d: rounded(
            eda.correlations(enriched(s, d), eda.CORRELATED), 6, "correlation"),
        "eda_summary": lambda s, d: rounded(rounded(
            eda.summary(enriched(s, d), t.transactions(s, d), "BUILDING"),
            6, "churn_rate", "avg_tenure", "monthly_share"), 4, "avg_monthly_spend"),
    }


def statistics_queries() -> dict[str, Query]:
    def sides(s: SparkSession, d: str, shift: float = 1.3):
        reference, current = t.drift_sides(s, d, shift)
        return reference, current, drift.shared_numeric(reference, current)

    def tests(s: SparkSession, d: str) -> DataFrame:
        by = t.experiment(s, d).join(
            t.dim_customer(s, d).select(F.col("customer_sk").alias("customer_id"), "segment_name"), "customer_id")
        return experiments.conversion_test(by, ["segment_name"]).select("segment_name", "p_value")

    def sizes(s: SparkSession, d: str) -> DataFrame:
        rates = kpis.rate_by(t.subscribers(s, d), "contract_type")
        return rates.select(
            "contract_type", F.round("churn_rate", 6).alias("baseline"),
            experiments.required_sample_size(F.col("churn_rate"), 0.04).alias("required"))

    return {
        "psi": lambda s, d: rounded(drift.population_stability_index(*sides(s, d)), 6, "psi"),
        "ks_statistic": lambda s, d: rounded(rounded(
            drift.ks_test(*sides(s, d)), 9, "ks_statistic"), 6, "ks_pvalue"),
        "drift_report": lambda s, d: drift.drift_report(*sides(s, d)),
        "drift_report_stable": lambda s, d: drift.drift_report(*sides(s, d, 1.0)),
        "ab_frame": lambda s, d: rounded(
            t.experiment(s, d), 6, "arpu_before", "arpu_after", "arpu_delta"),
        "ab_group_means": lambda s, d: experiments.group_means(t.experiment(s, d)),
        "ab_sample_size": sizes,
        "ab_conversion_test": lambda s, d: experiments.conversion_test(t.experiment(s, d)),
        "ab_conversion_ci": lambda s, d: rounded(
            experiments.conversion_intervals(t.experiment(s, d)), 6, "rate_pct", "error_pct"),
        "ab_arpu_test": lambda s, d: experiments.arpu_test(t.experiment(s, d)),
        "bonferroni": lambda s, d: experiments.bonferroni(tests(s, d)),
    }


def _customer_history(spark: SparkSession, folder: str) -> DataFrame:
    loads = [(day, t.customer_state(spark, folder, day)) for day in t.LOADS]
    return history.load_history(loads, "customer_id", "customer_sk", t.CUSTOMER_STATE)


def _fact_history(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions and spend by the customer version that was valid when they happened."""
    facts = t.table(spark, folder, "orders").join(t.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("customer_id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast(t.MONEY).alias("amount")
    )
    told = history.with_version(facts, _customer_history(spark, folder), "customer_id", "customer_sk", "day")
    return told.groupBy("customer_id", "customer_sk").agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").cast("decimal(14,2)").alias("spend"))


def _star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return star.build_star(
        t.raw_customers(spark, folder),
        t.raw_transactions(spark, folder),
        t.raw_tariffs(spark),
        t.places(spark, folder).select("city_name", "region"),
        t.AS_OF,
    )


RAW_RULES = [
    quality.Constraint("unique", "lineitem", ("l_orderkey", "l_linenumber")),
    quality.Constraint("foreign", "lineitem", ("l_orderkey",), ("orders", "o_orderkey")),
    quality.Constraint("foreign", "orders", ("o_custkey",), ("customer", "c_custkey")),
    quality.Constraint("length", "customer", ("c_name",), limit=10),
    quality.Constraint("not_null", "raw_transactions", ("transaction_date",)),
    quality.Constraint("foreign", "raw_transactions", ("customer_id",), ("dim_customer", "customer_id")),
    quality.Constraint("foreign", "raw_transactions", ("tariff_id",), ("dim_tariff", "tariff_id")),
    quality.Constraint("not_null", "fact_transactions", ("data_gb_used",)),
]


def source_queries() -> dict[str, Query]:
    def constraints(s: SparkSession, d: str) -> DataFrame:
        stored = {name: staged(df, name) for name, df in _star(s, d).items() if name != "rejected_transactions"}
        raw = {name: t.table(s, d, name) for name in ("lineitem", "orders", "customer")}
        raw["raw_transactions"] = t.raw_transactions(s, d)
        return quality.check_constraints({**stored, **raw}, star.star_constraints() + RAW_RULES)

    def intake(s: SparkSession, d: str) -> DataFrame:
        built = _star(s, d)
        left_out = built["rejected_transactions"].select(F.array_join("reasons", ",").alias("outcome"))
        taken = built["fact_transactions"].select(F.lit("stored").alias("outcome"))
        return taken.unionByName(left_out).groupBy("outcome").agg(F.count(F.lit(1)).alias("transactions"))

    def roundtrip(s: SparkSession, df: DataFrame, load) -> DataFrame:
        path = stage_path(s, "csv")
        files.write_csv(df, path)
        return load(s, path)

    def ids(s: SparkSession, d: str) -> DataFrame:
        return t.table(s, d, "customer").select((F.col("c_custkey") + 1).alias("id"))

    def telco(s: SparkSession, d: str) -> DataFrame:
        key = F.col("c_custkey")
        return files.normalise_telco(t.table(s, d, "customer").select(
            F.col("c_name").alias("customerID"),
            (key % 2 == 0).cast("string").cast("boolean").cast("int").cast("string").alias("SeniorCitizen"),
            F.col("c_acctbal").alias("Monthly Charges"),
            F.when(key % 10 == 0, " ").otherwise(F.col("c_acctbal").cast("string")).alias("TotalCharges"),
            F.when(key % 7 == 0, F.lit(None)).when(key % 3 == 0, "Yes").when(key % 3 == 1, "YES")
            .otherwise("No").alias("Churn"),
        ))

    def generated(s: SparkSession, d: str) -> DataFrame:
        made = generate.customers_from(ids(s, d))
        return generate.generate_transactions(made)

    def summary(s: SparkSession, d: str) -> DataFrame:
        made = staged(generate.customers_from(ids(s, d)), "made")
        tables = {"customers": made, "transactions": generate.generate_transactions(made),
                  "tariffs": generate.tariff_catalog(s)}
        counts = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n, df in tables.items()]
        return counts[0].unionByName(counts[1]).unionByName(counts[2])

    def simulated(s: SparkSession, d: str) -> DataFrame:
        people = t.table(s, d, "customer").select(
            F.col("c_custkey").alias("id"),
            F.when(F.col("c_custkey") % 2 == 0, "control").otherwise("treatment").alias("group"))
        return rounded(generate.experiment_rows(people), 5, "arpu_before", "arpu_after", "arpu_delta")

    def runs(s: SparkSession, d: str) -> DataFrame:
        path = stage_path(s, "runs")
        board = kpis.churn_board(t.scored_customers(s, d)).first().asDict()
        files.log_run(s, path, "board", {"threshold": 0.5, "nested": {"a": 1}}, {**board, "note": "text"})
        return rounded(files.read_runs(s, path).drop("logged_at"), 9, "number")

    def validated(s: SparkSession, d: str) -> DataFrame:
        checked = quality.validate_features(t.scoring_requests(s, d))
        return checked.select("request_id", "recency", "frequency", "monetary", "avg_data_gb", "avg_minutes",
                              F.array_join("violations", ",").alias("violations"))

    return {
        "scan_csv": lambda s, d: roundtrip(
            s, t.raw_customers(s, d).drop("segment_name"), files.load_customers),
        "sink_roundtrip": lambda s, d: roundtrip(s, t.raw_transactions(s, d), files.load_transactions),
        "scan_tariffs": lambda s, d: roundtrip(s, t.raw_plans(s, d), files.load_tariffs),
        "telco_normalise": telco,
        "gen_customers": lambda s, d: generate.customers_from(ids(s, d)),
        "gen_transactions": generated,
        "gen_summary": summary,
        "gen_ab": simulated,
        "star_dim_customer": lambda s, d: star.build_customers(t.raw_customers(s, d), t.AS_OF),
        "star_dim_city": lambda s, d: star.build_cities(t.places(s, d).select("city_name", "region")),
        "star_fact": lambda s, d: _star(s, d)["fact_transactions"],
        "star_intake": intake,
        "star_customer_history": lambda s, d: _customer_history(s, d).drop("digest"),
        "star_customer_as_of": lambda s, d: history.as_of(_customer_history(s, d), "1999-05-17").drop("digest"),
        "star_fact_history": _fact_history,
        "constraint_report": constraints,
        "validate_features": validated,
        "validate_segments": lambda s, d: quality.validate_segment_requests(t.segment_requests(s, d)).withColumn(
            "violations", F.array_join("violations", ",")),
        "run_metrics": runs,
    }


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return enriched(s, d).withColumn("segment", (F.col("customer_id") % 5).cast("int"))


def segment_queries() -> dict[str, Query]:
    means = [f"{c}_mean" for c in segments.FEATURES]

    def fitted(s: SparkSession, d: str) -> tuple[segments.Segmenter, DataFrame]:
        base = staged(enriched(s, d).select("customer_id", *segments.FEATURES), "enriched")
        return segments.Segmenter().fit(base), base

    def kmeans(s: SparkSession, d: str) -> DataFrame:
        segmenter, base = fitted(s, d)
        return segmenter.predict(base)

    def scored(s: SparkSession, d: str) -> DataFrame:
        segmenter, base = fitted(s, d)
        labels = staged(segmenter.predict(base), "labels")
        names = segments.segment_names(segments.profile(labels, segments.FEATURES))
        return segments.with_names(labels, names).select("customer_id", "segment", "segment_name")

    def nearest(s: SparkSession, d: str) -> DataFrame:
        segmenter, base = fitted(s, d)
        return segmenter.distances(base).select(
            "customer_id",
            (F.element_at("distances", F.col("segment") + 1) <= F.array_min("distances") + F.lit(1e-9)).alias("in_nearest"),
            F.size("distances").alias("segments"))

    def balance(s: SparkSession, d: str) -> DataFrame:
        """Squares within the segments and between the stored centres add up to those of all rows,
        which are the customers per feature once scaled; holds only where centres are means."""
        segmenter, base = fitted(s, d)
        scored = segmenter.distances(base)
        n = F.count(F.lit(1))
        centres = segmenter.model.stages[-1].clusterCenters()
        weight = F.element_at(F.array(*[F.lit(float((c * c).sum())) for c in centres]), F.col("segment") + 1)
        return scored.agg(
            n.alias("customers"),
            F.countDistinct("segment").alias("segments"),
            (F.abs(F.sum(F.array_min("distances")) / segmenter.inertia - 1) < 1e-9).alias("inertia_holds"),
            F.round((F.sum(F.array_min("distances")) + F.sum(weight)) / n, 3).alias("squares"))

    def search_check(s: SparkSession, d: str) -> DataFrame:
        """More clusters leave less within, and both silhouettes are shares."""
        before = F.lag("inertia").over(W.orderBy("k"))  # one row per k
        return search(s, d).select(
            "k", (F.coalesce(F.col("inertia") < before, F.col("inertia") > 0)).alias("inertia_falls"),
            (F.abs("silhouette") <= 1).alias("in_range"), (F.abs("silhouette_all") <= 1).alias("all_in_range"))

    def named(s: SparkSession, d: str) -> DataFrame:
        labels = staged(_labelled(s, d).select("customer_id", "segment", "monetary"), "labels")
        return segments.with_names(
            labels.select("customer_id", "segment"),
            segments.segment_names(segments.profile(labels, ["monetary"])))

    def search(s: SparkSession, d: str) -> DataFrame:
        base = staged(enriched(s, d).select("customer_id", *segments.FEATURES), "enriched")
        return segments.auto_k(base)

    def vectors(s: SparkSession, d: str) -> DataFrame:
        return t.table(s, d, "embeddings").select(
            "vec_id", "label", F.col("embedding").cast("array<double>").alias("point"))

    def dense(s: SparkSession, d: str) -> DataFrame:
        base = staged(enriched(s, d).select("customer_id", *segments.FEATURES), "enriched")
        return density.dbscan(base, "customer_id", segments.FEATURES)

    def matrix(s: SparkSession, d: str) -> DataFrame:
        base = staged(enriched(s, d), "enriched")
        vector = vector_to_array("features")
        out = features.fit_feature_pipeline(base).transform(base)
        return rounded(out.select(
            "customer_id", F.size(vector).alias("n_features"),
            F.aggregate(vector, F.lit(0.0), lambda a, v: a + v).alias("total"),
            F.size(F.filter(vector, lambda v: v == 1.0)).alias("n_ones")), 6, "total")

    def encoded(s: SparkSession, d: str) -> DataFrame:
        people = t.subscribers(s, d).select("customer_id", "contract_type", "gender")
        return features.one_hot(people, people, ["contract_type", "gender"]).drop("contract_type", "gender")

    scaled = ["age", "tenure_months", "recency", "frequency", "monetary"]
    return {
        "split_features": lambda s, d: features.split_features(
            t.subscribers(s, d), drop=["segment_name"]),
        "standard_scale": lambda s, d: rounded(features.standard_scale(
            staged(enriched(s, d).select("customer_id", *scaled), "enriched"), scaled), 6, *scaled),
        "one_hot": encoded,
        "feature_matrix": matrix,
        "sample_rfm": lambda s, d: features.sample_rows(
            enriched(s, d).select("customer_id", "recency", "monetary", "segment_name"), "customer_id", 1000),
        "stratified_split": lambda s, d: features.stratified_split(
            staged(t.subscribers(s, d).select("customer_id", "churn"), "people"), "customer_id", "churn"),
        "segment_profile": lambda s, d: rounded(
            segments.profile(_labelled(s, d), segments.FEATURES), 4, *means),
        "segment_names": lambda s, d: segments.segment_names(
            segments.profile(_labelled(s, d), segments.FEATURES)),
        "segment_named": named,
        "silhouette": lambda s, d: rounded(
            segments.silhouette(vectors(s, d), "vec_id", "label"), 6, "silhouette"),
        "silhouette_all": lambda s, d: rounded(
            segments.silhouette_all(vectors(s, d), "vec_id", "label"), 6, "silhouette"),
        "segments_kmeans": kmeans,
        "segments_nearest_check": nearest,
        "segments_balance_check": balance,
        "auto_k_check": search_check,
        "score_segment": scored,
        "auto_k": search,
        "dbscan": dense,
        "dbscan_summary": lambda s, d: density.cluster_summary(dense(s, d)),
    }


def recommendation_queries() -> dict[str, Query]:
    def listed(s: SparkSession, d: str) -> DataFrame:
        return recommend.catalog_with_popularity(
            t.brand_catalog(s, d), recommend.popularity(t.brand_purchases(s, d)))

    def model(s: SparkSession, d: str, collaborative: bool) -> recommend.Recommender:
        return _once(s, d, f"recommender-{collaborative}", lambda: recommend.Recommender(
            collaborative_model=collaborative).fit(t.brand_purchases(s, d), t.brand_catalog(s, d)))

    def requests(s: SparkSession, d: str) -> DataFrame:
        key = F.col("c_custkey")
        mode = F.array(*[F.lit(m) for m in ("cold_start", "similar", "hybrid", "collaborative", "other")])
        return t.table(s, d, "customer").select(
            key.alias("request_id"),
            F.when(key % 7 != 0, key).cast("string").alias("customer_id"),
            F.when(key % 11 == 0, "Brand#99").when(key % 3 != 0, F.concat(F.lit("Brand#"), (key % 25 + 1).cast(
                "string"))).alias("current_tariff"),
            F.when(key % 2 == 0, F.concat(F.lit("G"), (key % 5).cast("string"))).alias("category"),
            F.get(mode, (key % 5).cast("int")).alias("mode"),
            (key % 10 + 1).cast("int").alias("n"),
        )

    def answered(s: SparkSession, d: str, collaborative: bool) -> DataFrame:
        fitted = model(s, d, collaborative)
        by_text = requests(s, d).withColumn("customer_id", F.col("customer_id").cast("bigint"))
        return scoring.score_recommendations(fitted, by_text)

    def vector(s: SparkSession, d: str) -> DataFrame:
        out, names = features.minmax_catalog(t.brand_catalog(s, d), recommend.NUMERIC, "category")
        return rounded(out, 6, *names)

    def cosine(s: SparkSession, d: str, n: int | None = None) -> DataFrame:
        items = recommend.item_table(t.brand_catalog(s, d))
        best = recommend.similar_plans(items, n or items.count(), with_self=n is None)
        return rounded(best, 6, "score")

    def ruled(s: SparkSession, d: str, method: str) -> DataFrame:
        fitted = model(s, d, True)
        listed = getattr(fitted, method)().select("customer_id", "rank", "tariff_id", "score").join(
            fitted.users.select("customer_id", "seen", "anchor_id"), "customer_id")
        own = W.partitionBy("customer_id").orderBy("rank")  # at most n rows
        barred = F.array_contains("seen", F.col("tariff_id"))
        if method == "hybrid":
            barred = F.col("tariff_id") == F.col("anchor_id")
        told = listed.withColumns({
            "_falls": F.coalesce(F.col("score") <= F.lag("score").over(own), F.lit(True)), "_barred": barred})
        return told.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("plans"), F.countDistinct("tariff_id").alias("different"),
            F.max("rank").alias("last_rank"), F.bool_and("_falls").alias("falling"),
            F.count_if("_barred").alias("barred"))

    def saved(s: SparkSession, d: str) -> DataFrame:
        """The lists of a recommender that was stored and read back."""
        path = stage_path(s, "recommender")
        model(s, d, False).save(path)
        return rounded(recommend.Recommender.load(s, path).hybrid().select("customer_id", "rank", "tariff_id", "score"), 6, "score")

    def streamed(s: SparkSession, d: str) -> DataFrame:
        lists = staged(scoring.recommendation_lists(model(s, d, False)), "lists")
        asked = staged(requests(s, d).repartition(3, "request_id"), "requests")
        out, source = stage_path(s, "answers"), asked.inputFiles()[0].rsplit("/", 1)[0]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
        answers = jobs.recommend_stream(jobs.read_files(s, source, kinds), lists)
        jobs.to_parquet(answers, out, stage_path(s, "progress")).awaitTermination()
        return s.read.schema(answers.schema).parquet(out)

    score = ("score",)
    return {
        "ratings": lambda s, d: rounded(recommend.ratings(t.brand_purchases(s, d)), 6, "rating"),
        "tariff_popularity": lambda s, d: recommend.popularity(t.brand_purchases(s, d)),
        "tariff_catalog_popularity": listed,
        "current_tariff": lambda s, d: recommend.current_tariff(recommend.ratings(t.brand_purchases(s, d))),
        "tariff_features": vector,
        "tariff_cosine": lambda s, d: cosine(s, d).drop("rank"),
        "rec_similar": lambda s, d: cosine(s, d, 5),
        "rec_cold_start": lambda s, d: recommend.most_popular(listed(s, d)),
        "rec_cold_start_category": lambda s, d: recommend.most_popular(listed(s, d), 3, "G2"),
        "rec_hybrid_coldstart": lambda s, d: rounded(
            model(s, d, False).hybrid().select("customer_id", "rank", "tariff_id", "score"), 6, *score),
        "rec_saved": saved,
        "rec_collaborative": lambda s, d: model(s, d, True).collaborative(),
        "rec_collaborative_check": lambda s, d: ruled(s, d, "collaborative"),
        "rec_hybrid": lambda s, d: model(s, d, True).hybrid(),
        "rec_hybrid_check": lambda s, d: ruled(s, d, "hybrid"),
        "recommend_routes": lambda s, d: requests(s, d).select(
            "request_id", "mode", scoring.route().alias("route")),
        "score_recommend": lambda s, d: answered(s, d, True),
        "score_recommend_popular": lambda s, d: answered(s, d, False),
        "stream_recommend": streamed,
    }


_made: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, folder: str, name: str, make: Callable[[], object]):
    """One fitted model per session and data folder, shared by the queries that apply it."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def forget_models() -> None:
    """Drop the shared models, for timings that include the fit."""
    _made.clear()


def churn_queries() -> dict[str, Query]:
    def base(s: SparkSession, d: str) -> DataFrame:
        return _once(s, d, "churn-rows", lambda: staged(
            enriched(s, d).drop("segment_name", "r_score", "f_score", "m_score", "rfm_score"), "churn-rows"))

    def model(s: SparkSession, d: str) -> churn.ChurnModel:
        return _once(s, d, "churn-model", lambda: churn.ChurnModel().fit(base(s, d)))

    def compare(s: SparkSession, d: str) -> DataFrame:
        found = _once(s, d, "comparison", lambda: churn.train_and_compare(base(s, d)))
        path = stage_path(s, "runs")
        for kind, metrics in found.metrics.items():
            files.log_run(s, path, f"churn_{kind}", {"trees": found.models[kind].trees}, metrics)
        runs = files.read_runs(s, path).where("kind = 'metric'")
        best = files.best_run(runs).select("run_name", F.lit(True).alias("best"))
        return runs.select("run_name", "key", "number").join(best, "run_name", "left").na.fill({"best": False})

    def measured(s: SparkSession, d: str) -> DataFrame:
        metrics = churn.binary_metrics(t.scored_customers(s, d)).drop("confusion")
        return rounded(metrics, 6, "accuracy", "roc_auc", "precision", "recall", "f1")

    def factors(s: SparkSession, d: str) -> DataFrame:
        scored = model(s, d).score(base(s, d))
        return scored.select("customer_id", F.posexplode("top_factors").alias("place", "factor")).select(
            "customer_id", (F.col("place") + 1).alias("rank"), "factor.feature", "factor.importance")

    def additive(s: SparkSession, d: str) -> DataFrame:
        fitted, p = model(s, d), F.col("churn_probability")
        total = F.aggregate("phi", F.lit(fitted.ensemble(s).base), lambda a, v: a + v)
        gap = F.abs(total - F.ln(p / (F.lit(1.0) - p)) / F.lit(2.0))
        return fitted.predict_proba(fitted.attributed(base(s, d))).select("customer_id", (gap < 1e-6).alias("adds_up"))

    return {
        "binary_metrics": measured,
        "churn_attribution_check": additive,
        "churn_scores": lambda s, d: model(s, d).predict_proba(base(s, d)).select(
            "customer_id", "churn", "churn_probability", "churn_predicted"),
        "churn_importance": lambda s, d: model(s, d).explain(base(s, d), sample=None),
        "churn_top_factors": factors,
        "score_churn": lambda s, d: model(s, d).score(base(s, d)).select(
            "customer_id", "churn_probability", "churn_predicted", "risk_level"),
        "model_compare": compare,
    }


def service_queries() -> dict[str, Query]:
    def streamed(s: SparkSession, d: str) -> DataFrame:
        out, checkpoint = stage_path(s, "stream"), stage_path(s, "progress")
        log = t.request_columns(jobs.read_files(s, d, jobs.EVENTS, "events*.parquet"))
        jobs.upsert_counts(log, out, checkpoint).awaitTermination()
        return jobs.running_counts(s, out)

    def counted(s: SparkSession, d: str, keys) -> str:
        """All events, dealt out to four files that arrive one by one, so that runs are merged twice."""
        source, out = stage_path(s, "arriving"), stage_path(s, "runs")
        t.table(s, d, "events").repartition(4, "event_id").write.parquet(source)
        arriving = s.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        counters.count_stream(t.request_columns(arriving), out, stage_path(s, "progress"), keys, fan_in=2).awaitTermination()
        return out

    def drifting(s: SparkSession, d: str) -> DataFrame:
        """Every day of events against the first ten, from a stream."""
        measured = ["value", "user_id"]
        bins = windows.reference_bins(t.table(s, d, "events").where(F.col("ts") < F.lit(t.REFERENCE_END).cast("timestamp_ntz")), measured)
        out = stage_path(s, "bins")
        windows.upsert_bins(jobs.read_files(s, d, jobs.EVENTS, "events*.parquet"), bins, out, stage_path(s, "progress")).awaitTermination()
        report = windows.window_drift(windows.latest_bins(s, out), bins)
        return rounded(report.select("window_start", "feature", "rows", "psi", "ks_statistic", "severity"), 6, "psi", "ks_statistic")

    return {
        "stream_drift": drifting,
        "request_counts": lambda s, d: scoring.request_counts(t.request_log(s, d)),
        "latency_buckets": lambda s, d: scoring.latency_buckets(t.request_log(s, d)),
        "stream_request_counts": streamed,
        "stream_compacted_counts": lambda s, d: counters.totals(
            s, counted(s, d, counters.request_keys()), counters.REQUESTS).drop("late"),
        "stream_latency_buckets": lambda s, d: counters.latency_totals(s, counted(s, d, counters.latency_keys())),
    }


def queries() -> dict[str, Query]:
    return {
        **report_queries(),
        **feature_queries(),
        **board_queries(),
        **statistics_queries(),
        **source_queries(),
        **segment_queries(),
        **recommendation_queries(),
        **churn_queries(),
        **service_queries(),
    }
