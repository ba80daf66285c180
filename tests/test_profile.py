import numpy as np

from retentia.operators import profile


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    for values in (np.round(rng.normal(5, 3, 400), 2), np.arange(0, 101.0), np.array([3.0, 3.0, 3.0]), np.array([0.0, 1.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        got = sorted(profile.histogram(df, "x").collect(), key=lambda r: r["bin"])
        counts, edges = np.histogram(values, 50)
        assert [r["n"] for r in got] == counts.tolist()
        assert np.allclose([r["bin_start"] for r in got], edges[:-1]) and np.allclose([r["bin_end"] for r in got], edges[1:])


def test_weighted_and_empty_histograms(spark):
    df = spark.createDataFrame([(0, 3), (10, 2)], "x int, w int")
    got = {r["bin"]: r["n"] for r in profile.histogram(df, "x", bins=2, weight="w").collect()}
    assert got == {0: 3, 1: 2}
    assert {r["n"] for r in profile.histogram(df.limit(0), "x", bins=2).collect()} == {0}


def test_box_summary_and_its_guard(spark):
    rows = [(0, float(v), "1", None) for v in (1, 2, 3, 4, 100)] + [(1, float(v), "2", 5.0) for v in (5, 6, 7)] + [(None, 1.0, "1", 1.0)]
    df = spark.createDataFrame(rows, "g int, x double, t string, half double")
    got = {(r["feature"], r["g"]): r for r in profile.box_summary(df, "g", ["x", "t", "half", "absent"]).collect()}
    assert set(got) == {("x", 0), ("x", 1), ("t", 0), ("t", 1)}, "a column without values in one group is skipped"
    x = got["x", 0]
    assert (x["n"], x["q1"], x["median"], x["q3"]) == (5, 2.0, 3.0, 4.0)
    assert (x["whisker_low"], x["whisker_high"], x["n_outliers"]) == (1.0, 4.0, 1)


def test_crosstab_leaves_missing_out(spark):
    df = spark.createDataFrame([("w", 0), ("w", 1), ("w", 1), ("m", 1), (None, 1), ("m", None)], "c string, y int")
    for levels in (None, [0, 1]):
        got = {r["c"]: (r["share_0"], r["share_1"]) for r in profile.crosstab_share(df, "c", "y", levels).collect()}
        assert got == {"w": (1 / 3, 2 / 3), "m": (0.0, 1.0)}
