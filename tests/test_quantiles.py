import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.operators import sketches
from retentia.operators.quantiles import column_quantiles, exact_quantiles


def test_interpolation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    got = exact_quantiles(df, "x", {"q99": 0.99, "median": 0.5, "low": 0.0, "high": 1.0}).first()
    assert abs(got["q99"] - 9.79) < 1e-12
    assert (got["n"], got["median"], got["low"], got["high"]) == (4, 2.5, 1.0, 10.0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ggh"), st.integers(-50, 50)), min_size=1, max_size=80), st.floats(0, 1))
def test_groups_match_numpy(spark, rows, q):
    df = spark.createDataFrame([(g, v / 4) for g, v in rows], "g string, v double")
    got = {r["g"]: (r["n"], r["x"]) for r in exact_quantiles(df, "v", {"x": q}, ["g"]).collect()}
    for g in {g for g, _ in rows}:
        values = [v / 4 for h, v in rows if h == g]
        assert got[g][0] == len(values) and abs(got[g][1] - np.quantile(values, q)) < 1e-9


def test_skewed_values_over_many_slices(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 6000), np.full(3000, 7.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, "v", {f"q{i}": i / 20 for i in range(21)}).first()
    for i in range(21):
        assert abs(got[f"q{i}"] - np.quantile(values, i / 20)) < 1e-9 * max(1, got[f"q{i}"])


def test_columns_in_one_job_and_without_values(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 7.0, None), (3, None, None)], "a int, b double, c double")
    assert column_quantiles(df, {"a": 0.5, "b": 0.5, "c": 0.5}) == {"a": 2.0, "b": 6.0, "c": None}
    assert column_quantiles(df, {"a": 0.5}, exact=False) == {"a": 2}
    assert column_quantiles(df, {}) == {}


def test_sketches_are_merged_and_close(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(zip(rng.lognormal(3, 2, 60_000), rng.integers(0, 40, 60_000)))], "`load.no` int, `a.b` double, c double")
    probs = {"low": 0.01, "median": 0.5, "high": 0.99}
    loads = [sketches.value_sketches(df.filter(F.col("`load.no`") == i), ["a.b", "c"]) for i in range(3)]
    errors = sketches.rank_errors(df, sketches.merged_sketches(loads), probs).collect()
    assert len(errors) == 6 and all(r["n"] == 60_000 and r["error"] < 0.001 for r in errors)
    grouped = sketches.value_sketches(df, ["a.b"], ["load.no"])
    assert grouped.columns == ["load.no", "column", "n", "sketch"] and grouped.count() == 3
    whole = sketches.merged_sketches([grouped.drop("load.no"), loads[0].limit(0)])
    assert sketches.sketch_quantiles(whole, probs).first()["n"] == 60_000
    assert sketches.value_sketches(df.filter("false"), ["c"]).collect() == [] and sketches.rank_errors(df, loads[0].limit(0), probs).collect() == []
    missing = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "x double")
    assert sketches.sketch_quantiles(sketches.value_sketches(missing, ["x"]), {"m": 0.5}).collect()[0][1:] == (1, 2.0)
