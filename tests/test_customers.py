"""Generators, RFM, quality rules and files."""

import datetime as dt

import pytest
from pyspark.sql import Window as W, functions as F

from subscope.operators import quality, rfm
from subscope.sources import files, generate, star


@pytest.fixture(scope="module")
def people(spark):
    return generate.generate_customers(spark, 500, seed=123).persist()


@pytest.fixture(scope="module")
def moves(people):
    return generate.generate_transactions(people, months=6, seed=123).persist()


def test_generated_customers(people):
    rows = people.collect()
    assert len({r["customer_id"] for r in rows}) == 500
    assert {r["churn"] for r in rows} == {0, 1}
    assert all(18 <= r["age"] < 75 and 1 <= r["tenure_months"] < 84 for r in rows)
    for r in rows:
        allowed = next(ids for limit, ids, _ in generate.TARIFFS_BY_AGE if limit is None or r["age"] < limit)
        assert r["tariff_id"] in allowed


def test_shares_follow_the_weights(spark):
    many = generate.generate_customers(spark, 20000, seed=9)
    row = many.agg(F.avg((F.col("gender") == "M").cast("int")), F.avg("has_internet"), F.avg("age"),
                   F.corr("has_tv", "has_roaming")).first()
    assert abs(row[0] - 0.52) < 0.02 and abs(row[1] - 0.85) < 0.02 and abs(row[2] - 46) < 0.6 and abs(row[3]) < 0.03


def test_same_seed_same_rows_under_any_partitioning(spark, people):
    again = generate.customers_from(spark.range(1, 501).repartition(17), seed=123)
    other = generate.generate_customers(spark, 500, seed=124)
    assert sorted(people.collect()) == sorted(again.collect())
    assert sorted(people.collect()) != sorted(other.collect())


def test_generated_transactions(people, moves):
    count = people.agg(F.sum(F.least(F.lit(6), F.col("tenure_months")))).first()[0]
    rows = moves.collect()
    assert len(rows) == count == len({r["transaction_id"] for r in rows})
    assert all(r["amount"] > 0 for r in rows)
    assert max(r["transaction_date"] for r in rows) == dt.date(2025, 12, 1)
    none = generate.generate_transactions(people.withColumn("tenure_months", F.lit(0)))
    assert none.count() == 0


def test_catalog(spark):
    assert generate.tariff_catalog(spark).count() == 8


def test_experiment_is_reproducible(spark):
    df = generate.generate_experiment(spark, 400, 300, seed=5)
    assert df.count() == 700
    assert sorted(df.collect()) == sorted(generate.generate_experiment(spark, 400, 300, seed=5).collect())
    mean, deviation = df.agg(F.avg("arpu_before"), F.stddev("arpu_before")).first()
    assert abs(mean - 4500) < 150 and abs(deviation - 1200) < 120


def test_rfm_properties(people, moves):
    scores = rfm.rfm_scores(moves)
    rows = scores.collect()
    assert len(rows) == moves.select("customer_id").distinct().count()
    for r in rows:
        assert r["recency"] >= 0 and r["frequency"] > 0 and r["monetary"] > 0
        assert all(1 <= r[c] <= 5 for c in ("r_score", "f_score", "m_score"))
        assert r["rfm_score"] == 100 * r["r_score"] + 10 * r["f_score"] + r["m_score"]
    merged = rfm.merge_with_customers(people, scores.where("r_score > 1"))
    assert merged.count() == 500
    assert merged.where("recency IS NULL OR rfm_score IS NULL").isEmpty()
    assert not merged.where("recency = 999 AND rfm_score = 111").isEmpty()


def test_rfm_takes_a_reference_date_and_times(spark):
    df = spark.createDataFrame(
        [("a", 1, dt.datetime(2025, 1, 1, 18), 10.0, None, 1.0), ("a", 2, dt.datetime(2025, 1, 3, 6), 5.0, 2.0, 3.0)],
        "customer_id string, transaction_id int, transaction_date timestamp, amount double, "
        "data_gb_used double, minutes_used double")
    row = rfm.rfm_scores(df, reference=dt.datetime(2025, 1, 5, 5)).first()
    assert (row["recency"], row["frequency"], row["monetary"], row["avg_data_gb"], row["avg_minutes"]) == (1, 2, 15.0, 2.0, 2.0)
    assert row["rfm_score"] == 111


def test_rfm_slices_do_not_change_scores(moves):
    assert sorted(rfm.rfm_scores(moves).collect()) == sorted(rfm.rfm_scores(moves, slice_rows=40).collect())


def test_csv_files_come_back(spark, people, moves, tmp_path):
    counts = generate.save_all(spark, str(tmp_path), 200, 3, 7)
    assert counts["customers"] == 200 and counts["tariffs"] == 8
    assert files.load_customers(spark, f"{tmp_path}/customers.csv").count() == 200
    back = files.load_transactions(spark, f"{tmp_path}/transactions.csv")
    assert back.count() == counts["transactions"]
    assert dict(back.dtypes)["transaction_date"] == "date"
    assert back.where("amount IS NULL OR transaction_date IS NULL").isEmpty()
    assert files.load_tariffs(spark, f"{tmp_path}/tariffs.csv").where("monthly_price > 0").count() == 8


def test_telco_file(spark, tmp_path):
    path = tmp_path / "telco.csv"
    path.write_text("customerID,Senior Citizen,TotalCharges,Churn\na,0,10.5,Yes\nb,1, ,No\nc,0,20.5,yes\nd,0,30,\n")
    rows = {r["customerid"]: r for r in files.load_telco(spark, str(path)).collect()}
    assert [rows[k]["churn"] for k in "abcd"] == [1, 0, 1, 0]
    assert rows["b"]["totalcharges"] == 20.5
    assert "senior_citizen" in rows["a"].asDict()


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    files.log_run(spark, path, "one", {"depth": 6, "nested": {"x": 1}}, {"roc_auc": 0.7, "confusion": [[1]]})
    files.log_run(spark, path, "two", {}, {"roc_auc": 0.8})
    runs = files.read_runs(spark, path)
    assert runs.count() == 3
    assert files.best_run(runs).first()["run_name"] == "two"


def test_constraints_report_broken_rows(spark):
    tables = {
        "child": spark.createDataFrame([(1, 1, "ab"), (1, 2, None), (2, 9, "abcdef"), (None, 9, "x")],
                                       "id int, parent int, name string"),
        "parent": spark.createDataFrame([(1,), (2,)], "id int"),
    }
    rules = [
        quality.Constraint("not_null", "child", ("id",)),
        quality.Constraint("not_null", "child", ("name",)),
        quality.Constraint("length", "child", ("name",), limit=3),
        quality.Constraint("unique", "child", ("id",)),
        quality.Constraint("unique", "parent", ("id",)),
        quality.Constraint("foreign", "child", ("parent",), ("parent", "id")),
    ]
    got = {r["constraint"]: r["violations"] for r in quality.check_constraints(tables, rules).collect()}
    assert list(got.values()).count(1) == 4 and got["unique:parent(id)"] == 0 and got["foreign:child(parent)"] == 2


def test_request_validation(spark):
    good = {"age": 34, "gender": "M", "city": "Almaty", "tenure_months": 6, "tariff_id": "T01",
            "contract_type": "monthly", "payment_method": "cash", "paperless_billing": 1, "has_internet": 1,
            "has_tv": 0, "has_roaming": 0}
    schema = "age int, gender string, city string, tenure_months int, tariff_id string, contract_type string, " \
             "payment_method string, paperless_billing int, has_internet int, has_tv int, has_roaming int"
    rows = [good, {**good, "age": -5}, {**good, "gender": None, "has_tv": 2}]
    checked = quality.validate_features(spark.createDataFrame(rows, schema))
    assert [r["violations"] for r in checked.collect()] == [[], ["age:range"], ["gender:missing", "has_tv:range"]]
    assert checked.first()["monetary"] == 5000.0
    valid, rejected = quality.split_valid(checked)
    assert (valid.count(), rejected.count()) == (1, 2)
    asked = spark.createDataFrame([("similar", 3), (None, None), ("hybrid", 99)], "mode string, n int")
    checked = quality.validate_recommendation_requests(asked).collect()
    assert [(r["mode"], r["n"], len(r["violations"])) for r in checked] == [
        ("similar", 3, 0), ("cold_start", 5, 0), ("hybrid", 99, 1)]


def test_star_keys_do_not_depend_on_partitions(spark, people, moves):
    def built(n):
        return star.build_star(
            people.repartition(n), moves.repartition(n),
            generate.tariff_catalog(spark), people.select(F.col("city").alias("city_name"), F.lit("KZ").alias("region")).distinct(),
            "2025-01-01", ("2025-01-01", "2025-12-31"))

    one, many = built(1), built(8)
    for name in ("dim_customer", "dim_city", "fact_transactions"):
        assert sorted(map(str, one[name].collect())) == sorted(map(str, many[name].collect()))
    assert quality.check_constraints(many, star.star_constraints()).where("violations > 0").isEmpty()


def test_star_keeps_what_it_leaves_out(spark, people, moves):
    odd = moves.limit(4).withColumn("_n", F.row_number().over(W.orderBy("transaction_id"))).select(
        F.concat(F.lit("ODD"), "_n").alias("transaction_id"),
        F.when(F.col("_n") == 1, "nobody").otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(F.col("_n") <= 2, "T99").otherwise(F.col("tariff_id")).alias("tariff_id"),
        F.when(F.col("_n") == 3, F.lit("2005-06-30").cast("date")).when(F.col("_n") != 4, F.col("transaction_date")).alias(
            "transaction_date"),
        *[c for c in moves.columns if c not in ("transaction_id", "customer_id", "tariff_id", "transaction_date")],
    )
    cities = people.select(F.col("city").alias("city_name"), F.lit("KZ").alias("region")).distinct()
    mixed = moves.unionByName(odd)
    built = star.build_star(people, mixed, generate.tariff_catalog(spark), cities, "2025-01-01")
    left = {r["transaction_id"]: r["reasons"] for r in built["rejected_transactions"].collect()}
    assert left == {"ODD1": ["customer", "tariff"], "ODD2": ["tariff"], "ODD4": ["date"]}
    fact = built["fact_transactions"]
    assert fact.count() + len(left) == mixed.count()
    assert fact.where("transaction_id = 'ODD3'").first()["date_sk"] == 20050630
    assert built["dim_date"].agg(F.min("full_date")).first()[0] == dt.date(2005, 1, 1)
    narrow = star.build_star(people, mixed, generate.tariff_catalog(spark), cities, "2025-01-01", ("2025-01-01", "2025-12-31"))
    assert {r["transaction_id"] for r in narrow["rejected_transactions"].where("reasons = array('date')").collect()} == {"ODD3", "ODD4"}
    assert star.calendar_of(mixed.limit(0), "transaction_date").count() in (365, 366)
