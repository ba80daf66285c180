import pytest
from pyspark.sql import functions as F

from retentia.operators.joins import KeyViolation, assert_unique_key, join_one_to_one, with_globals


def frame(spark, rows, name="x"):
    return spark.createDataFrame(rows, f"CustomerID string, {name} int")


def test_one_to_one_left_and_inner(spark):
    a, b = frame(spark, [("a", 1), ("b", 2)]), frame(spark, [("a", 9), ("c", 8)], "y")
    assert {tuple(r) for r in join_one_to_one(a, b).collect()} == {("a", 1, 9), ("b", 2, None)}
    assert {tuple(r) for r in join_one_to_one(a, b, how="inner").collect()} == {("a", 1, 9)}
    with pytest.raises(ValueError):
        join_one_to_one(a, b, how="full")


@pytest.mark.parametrize("rows", [[("a", 1), ("a", 2)], [(None, 1)]])
def test_bad_keys_are_refused_on_either_side(spark, rows):
    good, bad = frame(spark, [("a", 1)]), frame(spark, rows, "y")
    for left, right in ((good, bad), (bad, good)):
        with pytest.raises(KeyViolation):
            join_one_to_one(left, right)
    with pytest.raises(KeyViolation, match="online"):
        assert_unique_key(bad, name="online")


def test_globals_reach_every_row_without_a_join(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    wide = with_globals(df, {"top": F.max("x"), "mean": F.avg("x")})
    assert {(r["top"], r["mean"]) for r in wide.collect()} == {(3, 2.0)}
    assert wide.columns == ["x", "top", "mean"]
    assert "Join" not in wide._jdf.queryExecution().executedPlan().toString()
