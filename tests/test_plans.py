import re

import pytest
from pyspark.sql import functions as F

from retentia.operators import ordered, prepare, profile, quality, quantiles
from retentia.operators.joins import KeyViolation
from retentia.operators.quality import enforce, integrity_report
from retentia.plans import attrition, customer
from retentia.sources import retention_tables, stage
from tests.conftest import SMALL, SVC_SCHEMA, TX_SCHEMA, at, by_key


@pytest.fixture(scope="module")
def snapshot(tables):
    return customer.snapshot_of(tables)


@pytest.fixture(scope="module")
def features(tables, snapshot):
    return stage(customer.customer_features(tables, snapshot))


@pytest.fixture(scope="module")
def frame(tables, snapshot, features):
    return stage(customer.model_frame(features, tables, snapshot))


def test_labelled_and_all_customers(tables, snapshot):
    assert snapshot == at("2024-03-31")
    assert set(by_key(customer.join_customers(tables, snapshot))) == set("abcde")
    everyone = by_key(customer.join_customers(tables, snapshot, labelled=False))
    assert set(everyone) == set("abcdef") and everyone["f"]["ChurnStatus"] is None


def test_repeated_customers_are_refused(spark, tables, snapshot):
    for name in ("demo", "churn", "online"):
        twice = dict(tables, **{name: tables[name].union(tables[name])})
        with pytest.raises(KeyViolation, match=name):
            customer.join_customers(twice, snapshot)


def test_counts_and_recencies_are_filled(features):
    got = by_key(features)
    assert (got["c"]["cs_count"], got["c"]["complaint_count"], got["c"]["had_service"], got["c"]["had_tx"]) == (0, 0, 0, 1)
    assert got["a"]["lastlogin_recency_days"] == 0 and got["b"]["lastlogin_recency_days"] == 30
    assert got["c"]["lastlogin_recency_days"] == 31, "one more than the largest"
    assert got["b"]["amount_mean"] is None, "amounts stay missing"


def test_order_of_the_steps(frame):
    got = by_key(frame)
    assert got["e"]["txn_count"] == 2 and got["e"]["tx_90"] == 1, "copies count in totals, not in windows"
    a = got["a"]
    # sums are 100, 0, 7, 3 and 8: the 0.99 quantile lies 0.96 of the way from 8 to 100
    assert a["amount_sum"] == pytest.approx(8 + 0.96 * 92), "the largest sum is capped"
    assert a["avg_spend_per_tx"] == a["amount_sum"] / 4, "the ratio uses the capped sum"
    assert got["c"]["no_login_90d"] == 0, "no login at all, yet the filled recency is small"
    assert {r["txn_count_was_missing"] for r in got.values()} == {0}, "flags come after the count fills"
    assert got["c"]["amount_std_was_missing"] == got["c"]["amount_std_missing"] == 1
    assert got["c"]["amount_std"] == 0.0
    assert got["c"]["tx_avg_gap_days"] == 5.5, "median of 0, 1, 10 and 15"
    assert {r["ChurnStatus_was_missing"] for r in got.values()} == {0}


def test_matrices(frame):
    forest = customer.forest_matrix(frame)
    assert len(set(forest.columns)) == len(forest.columns)
    assert {"channel_Website", "channel_nan", "Gender_F", "Gender_nan"} <= set(forest.columns)
    assert "ServiceUsage" not in forest.columns and "LastLoginDate" not in forest.columns
    assert not [c for c in forest.columns if forest.filter(F.col(f"`{c}`").isNull()).count()]
    assert {r[0] for r in forest.select(F.col("channel_Website") + F.col("channel_nan")).collect()} == {1}

    linear = customer.linear_matrix(frame)
    assert not [c for c in linear.columns if c.startswith(("channel_", "tx_30", "no_", "Gender"))]
    assert {"log1p_amount_sum", "txn_count_was_missing", "had_tx"} <= set(linear.columns)

    boosted, texts = customer.boosted_matrix(frame)
    assert texts == ["Gender", "ServiceUsage"] and not [c for c in boosted.columns if c.startswith("channel_")]
    assert boosted.filter("Gender IS NULL").count() == 1


def test_empty_event_tables_give_defaults(spark, tables, snapshot):
    bare = dict(tables, tx=spark.createDataFrame([], TX_SCHEMA), svc=spark.createDataFrame([], SVC_SCHEMA))
    features = customer.customer_features(bare, snapshot)
    frame = customer.model_frame(features, bare, snapshot)
    got = by_key(customer.forest_matrix(frame))
    assert set(got) == set("abcde")
    assert all(r["txn_count"] == r["tx_90"] == r["amount_sum"] == r["had_tx"] == 0 and r["no_tx_90d"] == 1 for r in got.values())
    enforce(integrity_report(customer.join_customers(bare, snapshot), bare["tx"], bare["svc"], expected=5))


def test_names_and_levels_with_dots(spark, tables, snapshot):
    """The whole plan and every matrix with columns and levels that hold dots, blanks and backticks."""
    place = F.when(F.col("CustomerID") == "c", F.lit(None)).when(F.col("CustomerID") < "c", "St. Louis").otherwise("a`b.c")
    demo = tables["demo"].select("*", place.cast("string").alias("home.city"), F.ascii("CustomerID").alias("a.b"), F.lit(None).cast("double").alias("x.y"))
    online = tables["online"].withColumn("ServiceUsage", F.concat("ServiceUsage", F.lit(" v1.0")))
    dotted = dict(tables, demo=demo, online=online)
    features = stage(customer.customer_features(dotted, snapshot))
    frame = stage(customer.model_frame(features, dotted, snapshot))
    forest = customer.forest_matrix(frame)
    assert {"home.city_St. Louis", "home.city_a`b.c", "home.city_nan", "a.b", "channel_Website v1.0"} <= set(forest.columns)
    got = {r["CustomerID"]: r.asDict() for r in forest.collect()}
    assert [got[k]["home.city_St. Louis"] for k in "abcde"] == [1, 1, 0, 0, 0] and got["c"]["home.city_nan"] == 1
    assert all(r["x.y"] == 0 and r["a.b"] == ord(k) for k, r in got.items())
    linear = customer.linear_matrix(frame)
    assert {"a.b", "x.y", "a.b_was_missing"} <= set(linear.columns) and linear.filter("`x.y` <> 0").isEmpty()
    for family in ("logistic", "forest", "wide"):
        table = attrition.training_table(frame, family)
        assert "a.b" in table.names and table.data.count() == 5
    everyone = stage(customer.join_customers(dotted, snapshot, labelled=False))
    assert quality.missing_share(everyone).filter("column_name = 'x.y'").first()[1] == 1
    assert quality.value_counts(demo, ["home.city", "Gender"]).count() > 2 and quality.dedupe_report(demo.union(demo)).first()["rows_removed"] == 6
    assert quality.duplicate_count(demo, "home.city").first()[0] == 3 and quality.global_stats(demo, {"a.b": ["max"]}).first()[0] == ord("f")
    assert quality.valid_counts(demo, "home.city", "a.b").count() == 2 and quality.fan_out(demo, "a.b").first()["max_rows"] == 1
    box = profile.box_summary(demo, "home.city", ["a.b"]).collect()
    assert {r["feature"] for r in box} == {"a.b"} and box[0]["home.city"] in ("St. Louis", "a`b.c")
    assert profile.histogram(demo, "a.b", 5).agg(F.sum("n")).first()[0] == 6
    shares = profile.crosstab_share(demo, "home.city", "Gender")
    assert shares.columns == ["home.city", "share_F", "share_M"] and shares.count() == 2
    assert prepare.standardize(demo, ["a.b"]).agg(F.round(F.avg("`a.b`"), 9)).first()[0] == 0
    assert quantiles.exact_quantiles(demo, "a.b", {"m": 0.5}, ["home.city"]).columns == ["home.city", "n", "m"]
    assert ordered.event_number(demo, ts="a.b", tie="home.city").count() == 6


def test_a_channel_with_many_levels_stays_text(spark, tables, snapshot, monkeypatch):
    monkeypatch.setattr(prepare.narrow_levels, "__defaults__", (0,))
    features = customer.customer_features(tables, snapshot)
    frame = stage(customer.model_frame(features, tables, snapshot))
    assert not [c for c in frame.columns if c.startswith("channel_")]
    matrix = customer.forest_matrix(frame)
    assert {"ServiceUsage", "Gender"} <= set(matrix.columns)
    assert {"ServiceUsage_mean", "ServiceUsage_number", "Gender_mean"} <= set(attrition.training_table(frame, "forest").names)


def test_star_tables_keep_the_invariants(spark):
    t = retention_tables(spark, SMALL)
    at_time = customer.snapshot_of(t)
    frame = stage(customer.model_frame(customer.customer_features(t, at_time), t, at_time))
    assert frame.count() == frame.select("CustomerID").distinct().count() == 150
    assert frame.filter("NOT (tx_30 <= tx_60 AND tx_60 <= tx_90 AND tx_90 <= txn_count)").isEmpty()
    channels = [c for c in frame.columns if c.startswith("channel_")]
    assert frame.filter(sum((F.col(c) for c in channels), F.lit(0)) != 1).isEmpty()
    enforce(integrity_report(customer.join_customers(t, at_time, labelled=False), t["tx"], t["svc"], expected=150))


def test_staged_customers_are_joined_where_they_lie(spark, tables, snapshot):
    """The customer table lies in buckets: what is joined is shuffled to it, it is not."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frame = customer.model_frame(customer.customer_features(tables, snapshot), tables, snapshot)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(CustomerID#\d+, \d+\)", plan)) == 2, "one for each table of recent events"
        assert "Bucketed: true" in plan and frame.count() == 5
        assert "Exchange" not in customer.customer_features(tables, snapshot).groupBy("CustomerID").count()._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_customer_key_partitions_all_joins(spark):
    """Nothing in the joined plan is shuffled to one place or paired without a key."""
    t = retention_tables(spark, SMALL)
    plan = customer.join_customers(t, at("2001-02-01"), validate=False)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
