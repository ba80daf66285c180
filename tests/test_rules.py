"""Faults that must not come back: wrong shares, dotted names, no events, fits that follow the cores."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.operators import models, prepare, profile
from retentia.plans.customer import NO_EVENTS, customer_features, snapshot_of


def test_shares_count_levels_without_a_column(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 2)], "g string, y int")
    row = profile.crosstab_share(df, "g", "y", [0, 1]).first()
    assert (row["share_0"], row["share_1"]) == (0.25, 0.25)


def test_dotted_names_are_names(spark):
    df = spark.createDataFrame([("k1", 0, 1.0, "St. Louis"), ("k2", 1, None, "Rome")], "CustomerID string, ChurnStatus int, `a.b` double, town string")
    flags = prepare.missing_flags(df)
    assert [r["a.b_was_missing"] for r in flags.orderBy("CustomerID").collect()] == [0, 1]
    wide = prepare.fill_with(prepare.one_hot(df, ["town"]), {"a.b": 9.0})
    held, names = models.assemble(wide)
    rows = held.select("CustomerID", vector_to_array("features").alias("f")).orderBy("CustomerID").collect()
    assert names[0] == "a.b" and "town_St. Louis" in names
    assert rows[0]["f"][names.index("town_St. Louis")] == 1.0 and rows[1]["f"][0] == 9.0
    assert prepare.winsorize_upper(df, ["a.b"]).columns == df.columns


def test_no_events_at_all_give_default_features(spark, tables):
    empty = {name: (df.limit(0) if name in ("tx", "svc") else df.withColumn("LastLoginDate", F.lit(None).cast("timestamp_ntz")) if name == "online" else df) for name, df in tables.items()}
    assert snapshot_of(empty) == NO_EVENTS
    assert all(r["txn_count"] == 0 and r["cs_count"] == 0 for r in customer_features(empty, snapshot_of(empty)).collect())


def training(spark, n=600):
    return models.assemble(spark.range(n).select(
        F.col("id").cast("string").alias("CustomerID"), ((F.col("id") * 7 % 11) > 5).cast("int").alias("ChurnStatus"), (F.col("id") * 7 % 11).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("z")))[0]


@pytest.mark.parametrize("fit", [lambda t: models.fit_forest(t, trees=5, max_depth=4), lambda t: models.fit_boosted(t, rounds=3)])
def test_fits_do_not_follow_the_partitions(spark, fit):
    data = training(spark)
    sums = {round(models.score(fit(data.repartition(parts)), data).agg(F.sum("score")).first()[0], 9) for parts in (1, 4, 8)}
    assert len(sums) == 1


def test_folds_have_a_salt_and_weights_of_their_own(spark):
    data = training(spark)
    row = models.cross_validate(models.forest(trees=5, max_depth=4), data, folds=3).first()
    assert row["mean"] > 0.95 and row["folds"] == 3
    both = models.with_folds(models.stratified_split(data))
    assert both.groupBy("split", "fold").count().count() == 10
    with pytest.raises(ValueError, match="no rows"):
        models.with_class_weight(data.filter("ChurnStatus = 1"))


def test_wide_categories_train(spark):
    df = training(spark).join(spark.range(600).select(F.col("id").cast("string").alias("CustomerID"), F.concat(F.lit("town "), F.col("id") % 150).alias("town"), F.col("id").cast("double").alias("v")), "CustomerID").drop("features")
    data, _ = models.assemble(df, index=["town"])
    assert models.widest_category(data) >= 150
    assert models.fit_boosted(data, rounds=2).getNumTrees == 2
