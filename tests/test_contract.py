"""The registered queries against their SQL on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as entry_module
from checks.catalog import QUERIES
from checks.compare import connect, difference
from checks.oracle import ORACLE
from tests.conftest import SMALL

ROWS_ONLY = {
    "cv_forest", "staged_rounds", "score_logistic", "score_forest", "score_boosted", "score_validated",
    "model_report", "tuned_report", "importance_gain", "importance_splits", "importance_forest", "importance_prediction",
    "importance_loss", "permutation", "attributions", "linear_attributions", "ranking_comparison",
}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_only_models_and_hashes_go_without_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)
    # The text operators, if present, come on top.
    assert entry_module.queries().items() >= QUERIES.items() and entry_module.oracle_sql().items() >= ORACLE.items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SMALL, name) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_without_sql_has_rows(spark, con, name):
    assert difference(spark, con, SMALL, name) is None


def test_entry_is_the_feature_table(spark):
    df = entry_module.entry(spark)
    assert df.count() == 150 and df.columns[0] == "CustomerID" and len(df.columns) == 27
