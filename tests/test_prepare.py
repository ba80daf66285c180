import pytest
from pyspark.sql import functions as F

from retentia.operators import prepare


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("CustomerID").collect()]


def test_fill_counts_and_recency(spark):
    df = spark.createDataFrame([("a", 3, 10), ("b", None, None)], "CustomerID string, txn_count bigint, tx_recency_days bigint")
    got = prepare.fill_recency(prepare.fill_counts(prepare.missing_flags(df)))
    assert values(got, "txn_count", "tx_recency_days", "tx_recency_days_was_missing") == [(3, 10, 0), (0, 11, 1)]


def test_flags_cover_numbers_only(spark):
    df = spark.createDataFrame([("a", 1.0, True, "x")], "CustomerID string, n double, b boolean, s string")
    assert [c for c in prepare.missing_flags(df).columns if c.endswith("_was_missing")] == ["n_was_missing"]
    assert prepare.select_by_type(df, include=["number", "bool"]).columns == ["n", "b"]
    assert prepare.select_by_type(df, exclude=["number", "bool"]).columns == ["CustomerID", "s"]


def test_winsorize_keeps_missing_and_caps_at_the_quantile(spark):
    df = spark.createDataFrame([(k, v) for k, v in zip("abcde", (1.0, 2.0, 3.0, 10.0, None))], "CustomerID string, amount_sum double")
    got = values(prepare.winsorize_upper(df), "amount_sum")
    assert got[4] == (None,) and got[3][0] == pytest.approx(9.79) and got[0] == (1.0,)
    assert values(prepare.winsorize_upper(df, exact=False), "amount_sum")[3] == (10.0,)


def test_one_hot_always_has_a_missing_level(spark):
    df = spark.createDataFrame([("a", "web"), ("b", "app"), ("c", "app")], "CustomerID string, s string")
    full = prepare.one_hot(df, ["s"], "channel")
    assert full.columns == ["CustomerID", "channel_app", "channel_web", "channel_nan"]
    gap = prepare.one_hot(df.union(spark.createDataFrame([("d", None)], df.schema)), ["s"])
    assert values(gap, "s_app", "s_web", "s_nan") == [(0, 1, 0), (1, 0, 0), (1, 0, 0), (0, 0, 1)]
    assert prepare.one_hot(df, ["s"], dummy_na=False).columns == ["CustomerID", "s_app", "s_web"]
    with pytest.raises(ValueError, match="level_dictionary"):
        prepare.one_hot(df, ["CustomerID"], max_levels=2)


def test_duplicate_columns_collapse_to_their_maximum(spark):
    df = spark.range(1).select(F.lit(0).alias("x"), F.lit(1).alias(" x "), F.lit(5).alias("y"), F.lit(None).cast("int").alias("x"))
    got = prepare.collapse_duplicate_columns(df)
    assert got.columns == ["x", "y"] and tuple(got.first()) == (1, 5)
    assert prepare.collapse_duplicate_columns(df, how="first").first()["x"] == 0
    with pytest.raises(ValueError):
        prepare.collapse_duplicate_columns(df, how="min")


def test_median_std_ratio_and_final_fill(spark):
    df = spark.createDataFrame(
        [("a", 4.0, None, 10.0, 2, None), ("b", None, 2.0, 5.0, 0, None), ("c", 8.0, 1.0, None, 3, 1.0)],
        "CustomerID string, tx_avg_gap_days double, amount_std double, amount_sum double, txn_count bigint, x double",
    )
    got = prepare.final_fill(prepare.spend_ratio(prepare.fill_std_zero(prepare.fill_median(df))))
    assert values(got, "tx_avg_gap_days", "amount_std", "avg_spend_per_tx", "x") == [(4.0, 0.0, 5.0, 0.0), (6.0, 2.0, 0.0, 0.0), (8.0, 1.0, 0.0, 1.0)]


def test_activity_flags_use_the_filled_recency(spark):
    df = spark.createDataFrame(
        [("a", None, None, 90), ("b", 2, 1, 91)], "CustomerID string, tx_90 bigint, complaints_90d bigint, lastlogin_recency_days bigint"
    )
    got = values(prepare.activity_flags(df), "no_tx_90d", "no_login_90d", "complained_90d")
    assert got == [(1, 0, 0), (0, 1, 1)]


def test_standardize_uses_the_population_deviation(spark):
    df = spark.createDataFrame([("a", 1.0, 4.0), ("b", 3.0, 4.0)], "CustomerID string, x double, same double")
    assert values(prepare.standardize(df, ["x", "same"]), "x", "same") == [(-1.0, 0.0), (1.0, 0.0)]
