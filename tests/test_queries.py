"""Every registered query against its SQL check, and the contract of the entry module."""

import pytest

import __spark_entry__ as contract
from checking import compare, oracle
from subscope.plans import registry

QUERIES, SQL = contract.queries(), contract.oracle_sql()
# fitted models and iterative jobs have property tests of their own
MODELLED = {
    "segments_kmeans", "score_segment", "auto_k", "rec_collaborative", "rec_hybrid",
    "score_recommend", "churn_scores", "churn_importance", "churn_top_factors", "score_churn", "model_compare",
}


@pytest.fixture(scope="module")
def con(small):
    return oracle(small)


def test_every_query_has_a_check_or_is_modelled():
    # the corpus queries, where present, account for theirs in their own tests
    assert set(registry.queries()) - set(SQL) <= MODELLED
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_result_equals_sql(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), con, SQL[name]) == ""


def test_a_wrong_result_is_noticed(spark, small, con):
    wrong = SQL["customers_by_city"].replace("count(*)", "count(*) + 1")
    assert "differ" in compare(QUERIES["customers_by_city"](spark, small), con, wrong)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
