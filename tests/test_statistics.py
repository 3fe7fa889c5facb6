"""Drift, experiments, exact quantiles and tail probabilities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subscope.functions.tails import kolmogorov_p, normal_two_sided, student_two_sided
from subscope.operators import churn, distribution, drift, eda, experiments
from subscope.sources import generate


def frame(spark, **columns):
    names = list(columns)
    rows = list(zip(*[[float(v) for v in columns[n]] for n in names]))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    return {
        "base": rng.normal(0, 1, 5000), "same": rng.normal(0, 1, 5000),
        "near": rng.normal(0.5, 1, 5000), "far": rng.normal(2, 1, 5000),
    }


def numpy_psi(expected, actual, bins=10):
    edges = np.percentile(expected, np.linspace(0, 100, bins + 1))[1:-1]
    shares = []
    for v in (expected, actual):
        counts = np.bincount(np.searchsorted(edges, v, side="right"), minlength=bins)
        shares.append(np.where(counts == 0, 1e-6, counts / len(v)))
    e, a = shares
    return float(((a - e) * np.log(a / e)).sum())


@pytest.mark.parametrize("other", ["same", "near", "far"])
@pytest.mark.parametrize("slice_rows", [None, 700])
def test_psi_and_ks_against_numpy(spark, samples, other, slice_rows):
    a, b = frame(spark, v=samples["base"]), frame(spark, v=samples[other])
    psi = drift.population_stability_index(a, b, ["v"], slice_rows=slice_rows).first()["psi"]
    assert psi == pytest.approx(numpy_psi(samples["base"], samples[other]), abs=1e-9)
    row = drift.ks_test(a, b, ["v"], slice_rows).first()
    grid = np.sort(np.concatenate([samples["base"], samples[other]]))
    cdf = [np.searchsorted(np.sort(samples[k]), grid, side="right") / 5000 for k in ("base", other)]
    assert row["ks_statistic"] == pytest.approx(np.abs(cdf[0] - cdf[1]).max(), abs=1e-12)
    assert (psi < 0.1) == (other == "same") and (psi > 0.2) == (other != "same")
    assert (row["ks_pvalue"] > 0.05) == (other == "same")


def test_psi_with_repeated_values(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 900), rng.integers(0, 6, 800)
    got = drift.population_stability_index(frame(spark, v=a), frame(spark, v=b), ["v"]).first()["psi"]
    assert got == pytest.approx(numpy_psi(a, b), abs=1e-9)


def test_drift_report(spark, samples):
    a = frame(spark, stable=samples["base"], shifted=samples["base"] + 5)
    b = frame(spark, stable=samples["same"], shifted=samples["same"] + 8)
    rows = drift.drift_report(a, b).collect()
    assert [r["feature"] for r in rows] == ["shifted", "stable"]
    assert [r["drift_detected"] for r in rows] == [True, False]
    assert [r["severity"] for r in rows] == ["high", "low"]


def test_drift_of_nothing_keeps_the_columns(spark):
    empty = spark.createDataFrame([], "v double")
    names = ["feature", "psi", "ks_statistic", "ks_pvalue", "drift_detected", "severity"]
    for left, right in ((empty, empty), (frame(spark, v=[1, 2]), empty), (frame(spark, v=[1]), frame(spark, w=[1]))):
        report = drift.drift_report(left, right)
        assert report.columns == names and report.count() == 0


def test_boolean_and_text_columns_are_not_numeric(spark):
    df = spark.createDataFrame([(1, True, "x", 2.0)], "a int, b boolean, c string, d double")
    assert drift.shared_numeric(df, df.drop("d")) == ["a"]


@pytest.mark.parametrize("slice_rows", [None, 50])
def test_exact_quantiles(spark, slice_rows):
    rng = np.random.default_rng(2)
    values = np.round(rng.exponential(3, 1001), 1)
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 4.0)], "g string, value double")
    marks = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["quantile"] for r in distribution.exact_quantiles(rows, "g", marks, slice_rows).collect()}
    for p in marks:
        assert got["a", p] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)
        assert got["b", p] == 4.0


def test_rank_sums_and_auc_against_brute_force(spark):
    rng = np.random.default_rng(4)
    label, score = rng.integers(0, 2, 700), np.round(rng.random(700), 2)
    gap = score[label == 1][:, None] - score[label == 0][None, :]
    auc = ((gap > 0) + 0.5 * (gap == 0)).mean()
    df = frame(spark, churn=label, churn_probability=score)
    for slice_rows in (None, 11):
        row = churn.binary_metrics(df, slice_rows=slice_rows).first()
        assert row["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert row["tp"] + row["fn"] == label.sum() and row["confusion"] == [[row["tn"], row["fp"]], [row["fn"], row["tp"]]]


def test_metrics_without_positive_predictions(spark):
    row = churn.binary_metrics(frame(spark, churn=[0, 1, 1], churn_probability=[0.1, 0.2, 0.3])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, pytest.approx(1 / 3))


def test_known_tail_probabilities(spark):
    # published table values
    assert normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert student_two_sided(12.70620474, 1) == pytest.approx(0.05, abs=1e-8)
    assert student_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    p = spark.range(1).select(kolmogorov_p(F.lit(0.0136), F.lit(20000), F.lit(20000))).first()[0]
    assert p == pytest.approx(0.0494, abs=5e-3)


def test_sample_size(spark):
    n = spark.range(1).select(experiments.required_sample_size(F.lit(0.08), 0.04)).first()[0]
    assert n == 882


def test_conversion_and_arpu_tests_find_the_simulated_effect(spark):
    df = generate.generate_experiment(spark, seed=42).persist()
    conversion = experiments.conversion_test(df).first()
    assert conversion["significant"] and conversion["ci_low"] < conversion["abs_diff"] < conversion["ci_high"]
    arpu = experiments.arpu_test(df).first()
    assert arpu["significant_mw"] and arpu["t_statistic"] < 0 < arpu["cohens_d"]
    assert experiments.arpu_test(df, slice_rows=100).first() == arpu


def test_identical_groups_show_no_effect(spark):
    rows = [(g, 1, float(v)) for g in ("control", "treatment") for v in range(50)]
    df = spark.createDataFrame(rows, "group string, converted int, arpu_delta double")
    row = experiments.arpu_test(df).first()
    assert row["t_pvalue"] == 1.0 and row["mw_pvalue"] == 1.0 and row["cohens_d"] == 0.0


def test_bonferroni(spark):
    df = spark.createDataFrame([("a", 0.02), ("b", 0.03), ("c", 0.2)], "test string, p_value double")
    assert [r["reject"] for r in experiments.bonferroni(df).orderBy("test").collect()] == [False, False, False]
    assert [r["reject"] for r in experiments.bonferroni(df.limit(2)).orderBy("test").collect()] == [True, False]


def test_histogram_covers_every_row(spark):
    df = frame(spark, v=[0, 0.5, 1, 2, 3, 3, 5, 5, 5], c=[0, 0, 0, 0, 0, 0, 1, 1, 1])
    rows = {(r["c"], r["bin"]): r["n"] for r in eda.histogram(df, "v", "c", 3).collect()}
    assert rows == {(0.0, 1): 2, (0.0, 2): 1, (0.0, 3): 3, (1.0, 1): 3}
