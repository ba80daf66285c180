import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from retentia.operators import explain, metrics, models
from retentia.operators.boosted_trees import BoostedTrees
from retentia.sources import stage

NAMES = ["signal", "noise", "flat"]


@pytest.fixture(scope="module")
def toy(spark):
    """The label follows the first feature, the others carry nothing."""
    rows = spark.range(800).select(
        F.col("id").cast("string").alias("CustomerID"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("signal"),
        (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 1000).alias("noise"),
    )
    label = (F.col("signal") > 0.6).cast("int")
    return stage(rows.select("CustomerID", label.alias("ChurnStatus"), array_to_vector(F.array("signal", "noise", F.lit(1.0))).alias("features")))


@pytest.fixture(scope="module")
def boosted(toy):
    return models.fit_boosted(toy, rounds=5)


def test_split_is_stable_and_stratified(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("CustomerID"), (F.col("id") % 5 == 0).cast("int").alias("ChurnStatus"))
    shares = {r["ChurnStatus"]: r["s"] for r in models.stratified_split(df).groupBy("ChurnStatus").agg(F.avg((F.col("split") == "test").cast("int")).alias("s")).collect()}
    assert shares == {0: pytest.approx(0.25, abs=0.01), 1: pytest.approx(0.25, abs=0.02)}
    sides = [{tuple(r) for r in models.stratified_split(df.repartition(n)).select("CustomerID", "split").collect()} for n in (1, 5)]
    assert sides[0] == sides[1]
    other = {tuple(r) for r in models.stratified_split(df, seed=1).select("CustomerID", "split").collect()}
    assert other != sides[0]
    assert models.with_folds(df).groupBy("fold").count().filter("count BETWEEN 3700 AND 4300").count() == 5


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "ChurnStatus int")
    assert [tuple(r) for r in models.class_weights(df).orderBy("ChurnStatus").collect()] == [(0, 3, 4 / 6, 1.0), (1, 1, 2.0, 3.0)]
    weights = {r["ChurnStatus"]: r["weight"] for r in models.with_class_weight(df, mode="ratio").collect()}
    assert weights == {0: 1.0, 1: 3.0}


def test_assemble_names_and_categories(spark):
    df = spark.createDataFrame([("a", 0, 1, "x", 2.0), ("b", 1, 2, None, 3.0)], "CustomerID string, ChurnStatus int, n int, t string, amount double")
    wide = spark.range(70).select(F.col("id").cast("string").alias("CustomerID"), F.lit(1).alias("ChurnStatus"), F.col("id").cast("string").alias("t"))
    assert models.widest_category(models.assemble(wide, index=["t"])[0]) == 71 and models.widest_category(models.assemble(wide.drop("t").withColumn("n", F.lit(1)))[0]) == 0
    data, names = models.assemble(df, index=["t"])
    assert names == ["n", "amount", "t"]
    assert {r["CustomerID"]: list(r["features"].toArray()) for r in data.collect()} == {"a": [1.0, 2.0, 0.0], "b": [2.0, 3.0, 1.0]}


@pytest.mark.parametrize("fit", [
    models.fit_logistic,
    lambda d: models.fit_forest(d, trees=5),
    lambda d: models.fit_boosted(d, rounds=4),
    lambda d: models.fit_boosted(d, "validated", rounds=4),
])
def test_separable_data_is_learned(toy, fit):
    data = models.stratified_split(toy)
    model = fit(data.filter("split = 'train'"))
    result = models.score(model, data.filter("split = 'test'"))
    assert metrics.roc_auc(result).first()[0] > 0.98
    assert result.filter("score < 0 OR score > 1").isEmpty()


def test_fits_are_repeatable(toy):
    first, second = (models.score(models.fit_forest(toy, trees=3), toy) for _ in range(2))
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in second.collect()}


def test_best_round_beats_the_last(spark, toy):
    """With random labels the held-out loss rises soon, so fewer than all rounds are kept."""
    noisy = stage(toy.withColumn("ChurnStatus", F.pmod(F.xxhash64("CustomerID", F.lit(99)), F.lit(2)).cast("int")))
    model = models.fit_boosted(noisy, "validated", rounds=12)
    assert 1 <= model.getNumTrees < 12


def test_rounds_are_judged_as_the_model_cut_there(toy):
    data = models.stratified_split(toy)
    noisy = stage(data.withColumn("ChurnStatus", F.when(F.pmod(F.xxhash64("CustomerID", F.lit(5)), F.lit(4)) == 0, 1 - F.col("ChurnStatus")).otherwise(F.col("ChurnStatus"))))
    model = models.fit_boosted(noisy.filter("split = 'train'"), rounds=6)
    test = noisy.filter("split = 'test'")
    areas = {r["round"]: r["roc_auc"] for r in models.staged_auc(model, test).collect()}
    assert sorted(areas) == [1, 2, 3, 4, 5, 6]
    for n in (1, 3, 6):
        cut = models.first_trees(model, n)
        assert cut.getNumTrees == n and cut.treeWeights == model.treeWeights[:n]
        assert areas[n] == pytest.approx(metrics.roc_auc(models.score(cut, test)).first()[0], abs=1e-12)
    assert {tuple(r) for r in models.score(models.first_trees(model, 6), test).collect()} == {tuple(r) for r in models.score(model, test).collect()}


def test_validated_profile_is_the_best_prefix(toy):
    """One fit with all rounds; the kept ones are those after which the held-out area is largest, the first of equals."""
    noisy = stage(toy.withColumn("ChurnStatus", F.when(F.pmod(F.xxhash64("CustomerID", F.lit(6)), F.lit(3)) == 0, 1 - F.col("ChurnStatus")).otherwise(F.col("ChurnStatus"))))
    model = models.fit_boosted(noisy, "validated", rounds=8)
    weighted = models.with_class_weight(models.spread(noisy, 50_000), mode="ratio")
    parts = stage(models.stratified_split(weighted, frac=0.2, seed=43))
    whole = models.boosted("validated", 8).fit(parts.filter("split = 'train'"))
    areas = {n: metrics.roc_auc(models.score(models.first_trees(whole, n), parts.filter("split = 'test'"))).first()[0] for n in range(1, 9)}
    assert model.getNumTrees == min(areas, key=lambda n: (-areas[n], n))


def test_out_of_fold_scores(toy):
    scores = stage(models.out_of_fold_scores(models.forest(trees=3), toy, folds=3))
    assert scores.count() == scores.select("CustomerID").distinct().count() == toy.count()
    folds = {r["CustomerID"]: r["fold"] for r in models.with_folds(toy, 3).collect()}
    assert {r["CustomerID"]: r["fold"] for r in scores.collect()} == folds
    areas = [r["roc_auc"] for r in metrics.roc_auc(scores, groups=["fold"]).collect()]
    row = models.cross_validate(models.forest(trees=3), toy, folds=3).first()
    assert row["mean"] == pytest.approx(sum(areas) / 3)


def test_tasks_of_a_training_table_are_bounded(toy):
    assert models.spread(toy, 100).rdd.getNumPartitions() == 8 and models.spread(toy, 100, most_tasks=3).rdd.getNumPartitions() == 3


def test_cross_validation(toy):
    row = models.cross_validate(models.forest(trees=3), toy, folds=3).first()
    assert row["metric"] == "roc_auc" and row["mean"] > 0.98 and row["std"] >= 0 and row["folds"] == 3


def test_rank_importance(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, importance double")
    assert [(r["feature"], r["rank"]) for r in explain.rank_importance(df).orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert explain.rank_importance(df, 2).count() == 2


def test_every_importance_finds_the_signal(toy, boosted):
    tables = {
        "gain": explain.impurity_importance(boosted, NAMES),
        "split": explain.split_importance(boosted, NAMES),
        "prediction": explain.shuffle_importance(boosted, toy, NAMES),
        "loss": explain.shuffle_importance(boosted, toy, NAMES, "loss"),
        "permutation": explain.permutation_importance(boosted, toy, NAMES, repeats=2),
    }
    for name, table in tables.items():
        got = {r["feature"]: r["importance"] for r in table.collect()}
        assert set(got) == set(NAMES), name
        assert got["signal"] > abs(got["noise"]) and got["flat"] == pytest.approx(0.0), name
    ranks = explain.compare_rankings(tables)
    assert {r["feature"]: r["rank_gain"] for r in ranks.collect()}["signal"] == 1
    assert ranks.columns == ["feature", *[f"rank_{m}" for m in tables]]


def test_split_counts_are_the_nodes_of_the_trees(boosted):
    counted = sum(r["importance"] for r in explain.split_importance(boosted, NAMES).collect())
    assert counted == sum((t.numNodes - 1) // 2 for t in boosted.trees)


def test_partners_use_every_row_once_per_repeat(toy):
    paired = explain.with_partner(toy, repeats=3, block=100)
    for r in range(3):
        part = paired.filter(F.col("repeat") == r)
        assert part.count() == 800
        used = {tuple(x["partner"].toArray()) for x in part.select("partner").collect()}
        assert used == {tuple(x["features"].toArray()) for x in toy.select("features").collect()}
    assert paired.filter("features = partner").count() < 30


def test_attributions_add_up_to_the_change_of_the_score(toy, boosted):
    some = stage(toy.limit(60))
    rows = explain.attributions(boosted, some, NAMES, samples=3, seed=5)
    total = {r["CustomerID"]: r["s"] for r in rows.groupBy("CustomerID").agg(F.sum("attribution").alias("s")).collect()}
    own = {r["CustomerID"]: r["score"] for r in models.score(boosted, some).collect()}
    partners = explain.with_partner(some.select("CustomerID", "features", "ChurnStatus"), 3, seed=5)
    theirs = models.score(boosted, partners.drop("features").withColumnRenamed("partner", "features"))
    mean = {r["CustomerID"]: r["m"] for r in theirs.groupBy("CustomerID").agg(F.avg("score").alias("m")).collect()}
    for key, value in total.items():
        assert value == pytest.approx(own[key] - mean[key], abs=1e-9)
    top = explain.rank_importance(explain.mean_abs_attribution(rows)).orderBy("rank").first()
    assert top["feature"] == "signal"


def test_attributions_are_sampled_until_they_are_certain(toy, boosted):
    some = stage(toy.limit(40))
    few = explain.attributions(boosted, some, NAMES, samples=4)
    rows, samples = explain.attributions_within(boosted, some, NAMES, error=0.02, most=32)
    assert samples in (4, 8, 16, 32)
    error = lambda df: df.agg(F.avg(F.col("std_error") ** 2)).first()[0]
    size = rows.agg(F.avg(F.col("attribution") ** 2)).first()[0]
    assert samples == 32 or error(rows) <= 0.02**2 * size
    assert error(rows) <= error(few) and rows.filter("feature = 'flat' AND (attribution <> 0 OR std_error <> 0)").isEmpty()
    assert explain.attributions(boosted, some, NAMES, samples=1).filter("std_error IS NOT NULL").isEmpty()


def test_linear_attributions_are_centred_and_exact(toy):
    model = models.fit_logistic(toy)
    rows = stage(explain.linear_attributions(model, toy, NAMES))
    means = {r["feature"]: r["m"] for r in rows.groupBy("feature").agg(F.avg("attribution").alias("m")).collect()}
    assert all(abs(m) < 1e-9 for m in means.values())
    log_odds = model.transform(toy).select("CustomerID", vector_to_array("rawPrediction")[1].alias("z"))
    sums = rows.groupBy("CustomerID").agg(F.sum("attribution").alias("s"))
    off = log_odds.join(sums, "CustomerID").filter(F.abs(F.col("z") - F.col("s") - F.lit(model.stages[-1].intercept)) > 1e-9)
    assert off.isEmpty()


def test_tasks_do_not_grow_with_a_training_table(toy, monkeypatch):
    """A tree learner shuffles the counts of its nodes once a task, so larger tables have larger tasks."""
    assert models.spread(toy, 10).rdd.getNumPartitions() == models.TASKS
    monkeypatch.setattr(models, "TASK_ROWS", 20)
    assert models.spread(toy, 10).rdd.getNumPartitions() == 40


@pytest.fixture(scope="module")
def mixed(spark):
    """Two numbers, a numbered category and a constant; the label depends on the first number and the category."""
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("CustomerID"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("n"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(7)).alias("m"),
        F.lit(1).alias("same"), F.concat(F.lit("t"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(6)).cast("string")).alias("t"),
    )
    label = ((F.col("n") > 20) != F.col("t").isin("t1", "t4")) & (F.pmod(F.xxhash64("CustomerID"), F.lit(9)) != 0)
    data, names = models.assemble(rows.withColumn("ChurnStatus", label.cast("int")), index=["t"])
    data = stage(data)
    return data, names, models.fit_boosted(data, rounds=4)


class NoTrees:
    pass


def test_batches_score_altered_rows_as_the_model_does(mixed, monkeypatch):
    data, names, model = mixed
    assert any(len(t.cut) for t in [BoostedTrees(model)] if t.goes_left.any()), "a category is split"
    own = {(r["_i"], r["repeat"], r["label"]): r["s"] for r in explain._boosted_shuffled_scores(model, data, len(names), 2, 42, "CustomerID", "ChurnStatus").groupBy("_i", "repeat", "label").agg(F.sum("score").alias("s")).collect()}
    other = {(r["_i"], r["repeat"], r["label"]): r["s"] for r in explain._shuffled_scores(model, data, len(names), 2, 42, "CustomerID", "ChurnStatus").groupBy("_i", "repeat", "label").agg(F.sum("score").alias("s")).collect()}
    assert own == {k: pytest.approx(v, abs=1e-9) for k, v in other.items() if k in own} and {k[0] for k in own} == set(BoostedTrees(model).trees_of)
    made = {
        "prediction": lambda: explain.shuffle_importance(model, data, names),
        "loss": lambda: explain.shuffle_importance(model, data, names, "loss"),
        "permutation": lambda: explain.permutation_importance(model, data, names, repeats=2),
        "attribution": lambda: explain.mean_abs_attribution(explain.attributions(model, data.limit(50), names, samples=2)),
    }
    fast = {m: {r["feature"]: r["importance"] for r in make().collect()} for m, make in made.items()}
    monkeypatch.setattr(explain, "GBTClassificationModel", NoTrees)
    for m, make in made.items():
        slow = {r["feature"]: r["importance"] for r in make().collect()}
        assert set(slow) == set(names) and fast[m] == {f: pytest.approx(v, abs=1e-9) for f, v in slow.items()}, m
