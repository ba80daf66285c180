import pytest
from pyspark.sql import functions as F

from retentia.operators import quality
from tests.conftest import SVC_SCHEMA, at


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_missing_share_is_sorted(tx):
    got = rows(quality.missing_share(tx))
    assert got[0] == ("AmountSpent", pytest.approx(2 / 12)) and got[-1] == ("TransactionID", 0.0)
    assert len(quality.missing_share(tx, top=2).collect()) == 2


def test_duplicates_count_missing_ids_as_equal(svc, tx):
    assert rows(quality.duplicate_count(svc, "InteractionID")) == [(3,)]
    assert rows(quality.duplicate_count(svc, ["CustomerID", "InteractionID"])) == [(2,)]
    assert rows(quality.dedupe_report(tx)) == [(12, 11, 1)]
    assert rows(quality.dedupe_report(tx.limit(0))) == [(0, 0, 0)]


def test_fan_out_and_value_counts(svc):
    assert rows(quality.fan_out(svc)) == [(3.0, 3)]
    got = rows(quality.value_counts(svc, "ResolutionStatus"))
    assert got[0] == ("Unresolved", 3) and (None, 1) in got


def test_valid_counts_skip_missing_groups(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (1, None), (None, 1.0)], "g int, y double")
    assert sorted(rows(quality.valid_counts(df, "g", "y"))) == [(0, 1), (1, 0)]


def test_table_report(tx, svc):
    got = {r["table_name"]: r for r in quality.table_report({"tx": tx, "svc": svc}, at("2024-03-15")).collect()}
    assert (got["tx"]["n_rows"], got["tx"]["n_columns"], got["tx"]["n_keys"], got["tx"]["n_nonpositive"], got["tx"]["n_future"]) == (12, 5, 5, 0, 2)
    assert got["svc"]["n_nonpositive"] is None and got["svc"]["n_future"] == 2


def test_integrity_passes_and_fails(spark, tx, svc):
    good = spark.createDataFrame([("a", 10, 5), ("b", 2, None)], "CustomerID string, txn_count bigint, cs_count bigint")
    report = quality.integrity_report(good, tx, spark.createDataFrame([("a", "i", None, None, None)] * 5, SVC_SCHEMA), expected=2)
    assert report.filter("ok").count() == 4
    quality.enforce(report)
    twice = good.union(good)
    failed = {r["check_name"] for r in quality.integrity_report(twice, tx, svc, expected=2).filter("NOT ok").collect()}
    assert failed == {"one_row_per_customer", "transactions_conserved", "interactions_conserved", "expected_customers"}
    with pytest.raises(quality.IntegrityError, match="transactions_conserved: expected 12, got 24"):
        quality.enforce(quality.integrity_report(twice, tx, svc))


def test_global_stats(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert rows(quality.global_stats(df, {"x": ["mean", "sum", "max", "min", "count"]})) == [(2.0, 4, 3, 1, 2)]
    assert rows(quality.global_stats(df.filter(F.lit(False)), {"x": ["sum", "max"]})) == [(0, None)]
