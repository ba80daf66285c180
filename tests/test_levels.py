"""Level dictionaries, out-of-fold means, exact splits and models on columns with very many levels."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retentia.operators import levels, metrics, models
from retentia.plans import attrition
from retentia.sources import stage

KIND = "CustomerID string, ChurnStatus int, `a.b` string, t string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = []
    for i in range(3000):
        hot = draw.random() < 0.4
        level = "St. Louis" if hot else None if draw.random() < 0.1 else f"l{draw.randrange(400)}"
        out.append((str(i), int(draw.random() < (0.8 if hot else 0.3)), level, draw.choice(["x", "y", None])))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return stage(spark.createDataFrame(rows, KIND))


@pytest.mark.parametrize("order", ["frequency", "name"])
def test_dictionary_ranks_levels(table, rows, order):
    got = {(r["column"], r["level"]): (r["n"], r["number"]) for r in levels.level_dictionary(table, ["a.b", "t"], order).collect()}
    for at, c in ((2, "a.b"), (3, "t")):
        n = Counter(r[at] for r in rows if r[at] is not None)
        ranked = sorted(n, key=lambda v: (-n[v], v) if order == "frequency" else v)
        assert {v: got[c, v] for v in n} == {v: (n[v], i) for i, v in enumerate(ranked)}
    assert levels.level_dictionary(table.filter("false"), ["t"]).collect() == []
    assert levels.level_dictionary(table, []).collect() == []


@pytest.mark.parametrize("hot", [1000, 5, 1])
def test_numbers_join_back(table, rows, monkeypatch, hot):
    monkeypatch.setattr(levels, "HOT", hot)
    dictionary = levels.level_dictionary(table, ["a.b", "t"])
    number = {(r["column"], r["level"]): r["number"] for r in dictionary.collect()}
    many = {c: len([1 for k in number if k[0] == c]) for c in ("a.b", "t")}
    unseen = table.withColumn("t", F.when(F.col("CustomerID") == "7", "new").otherwise(F.col("t")))
    got = {r["CustomerID"]: r for r in levels.with_level_numbers(unseen, dictionary, ["a.b", "t"]).collect()}
    assert len(got) == len(rows)
    for key, _, a, t in rows:
        assert got[key]["a.b_index"] == number.get(("a.b", a), many["a.b"])
        assert got[key]["t_index"] == (many["t"] if key == "7" else number.get(("t", t), many["t"]))


def test_target_means_see_no_label_of_their_own_fold(table, rows):
    folded = models.with_folds(models.stratified_split(table))
    placed = {r["CustomerID"]: (r["split"], r["fold"]) for r in folded.select("CustomerID", "split", "fold").collect()}
    got = {r["CustomerID"]: r for r in levels.target_means(folded, ["a.b", "t"], "ChurnStatus", train=F.col("split") == "train").collect()}
    for key, _, a, t in rows:
        split, fold = placed[key]
        others = [r for r in rows if placed[r[0]][0] == "train" and (split == "test" or placed[r[0]][1] != fold)]
        prior = sum(r[1] for r in others) / len(others)
        for at, c, v in ((2, "a.b", a), (3, "t", t)):
            own = [r[1] for r in others if v is not None and r[at] == v]
            assert got[key][f"{c}_mean"] == pytest.approx((sum(own) + 20 * prior) / (len(own) + 20))
    every = levels.target_means(models.with_folds(table), ["t"], "ChurnStatus")
    assert every.filter("t_mean IS NULL").isEmpty() and every.columns[-1] == "t_mean"


def test_split_and_folds_are_exact(spark):
    for n, share in ((1, 0.25), (2, 0.25), (1503, 0.25), (1503, 0.0), (1503, 1.0), (70_000, 0.1)):
        df = spark.range(n).select(F.col("id").cast("string").alias("CustomerID"), (F.col("id") % 3 == 0).cast("int").alias("ChurnStatus"))
        sides = {(r[0], r[1]): r[2] for r in models.stratified_split(df, frac=share).groupBy("ChurnStatus", "split").count().collect()}
        for c, size in ((1, (n + 2) // 3), (0, n - (n + 2) // 3)):
            assert sides.get((c, "test"), 0) == int(share * size + 0.5), (n, share, c)
        folds = {}
        for c, fold, m in models.with_folds(df, 4).groupBy("ChurnStatus", "fold").count().collect():
            folds.setdefault(c, []).append((fold, m))
        for c, own in folds.items():
            sizes = dict(own)
            assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(4)) <= 1


def test_rows_without_a_class_are_no_test_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 1), ("d", 0), ("e", 0)], "CustomerID string, ChurnStatus int")
    got = {r["CustomerID"]: r for r in models.with_folds(models.stratified_split(df, frac=0.5), 2).collect()}
    assert got["a"]["split"] == "train" and got["a"]["fold"] == 0
    assert Counter(r["split"] for r in got.values()) == {"train": 3, "test": 2}
    assert models.stratified_split(df.filter("false")).columns == ["CustomerID", "ChurnStatus", "split"]


@pytest.mark.parametrize("family", ["forest", "wide"])
def test_a_column_with_100_000_levels_trains(spark, family):
    """The label follows the level of a column in which most levels occur twice."""
    ids = spark.range(200_000)
    level = F.pmod(F.xxhash64("id"), F.lit(100_000))
    signal = F.pmod(F.col("id"), F.lit(8))
    frame = stage(ids.select(
        F.col("id").cast("string").alias("CustomerID"),
        F.when(signal < 4, 1).otherwise(0).alias("ChurnStatus"),
        F.concat(F.lit("L. "), F.when(F.col("id") % 2 == 0, signal.cast("string")).otherwise(level.cast("string"))).alias("city.name"),
        F.lit("x").alias("plan"), F.rand(1).alias("noise"),
    ))
    table = attrition.training_table(frame, family)
    assert {"city.name_mean", "city.name_number"} <= set(table.names) and len(table.names) <= 5
    fitted = attrition.fit(table, family, **({"trees": 3, "max_depth": 4} if family == "forest" else {"rounds": 2}))
    assert metrics.roc_auc(fitted.scores()).first()[0] > 0.7
