"""Splits, class weights, classifiers and cross-validation on Spark ML.

A training table holds the key, the label, a ``features`` vector and a
``weight``. Models read nothing else, so stage it once before fitting.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.functions.columns import _col
from retentia.operators.levels import level_counts, level_dictionary, with_level_numbers
from retentia.operators.metrics import roc_auc
from retentia.operators.prepare import NON_FEATURES, columns_of_type
from retentia.sources.sink import checkpoint_folder, stage
from retentia.sources.tables import KEY

LABEL = "ChurnStatus"
#: Bits of the hash that rows are drawn by, and those that are counted; the rest is compared inside one count only.
HASH_BITS, COUNTED_BITS = 60, 16
#: Bins of a feature in boosting, and so the numbered categories a column may have; one is for missing and unseen ones.
BINS = 64
#: Tasks of a training table, as long as they have no more rows than this. A tree learner sends the counts of all nodes it
#: grows from every task, so what it shuffles goes by the tasks, not by the rows.
TASKS, TASK_ROWS = 24, 250_000
#: Folds of the training rows for the level means of wide text columns.
MEAN_FOLDS = 5

# Settings of the two boosted profiles, beside the number of rounds.
BOOSTED_PROFILES = {
    "wide": {
        "stepSize": 0.03,
        "maxDepth": 6,
        "minInstancesPerNode": 20,
        "subsamplingRate": 0.9,
        "featureSubsetStrategy": "0.9",
    },
    "validated": {"stepSize": 0.05, "maxDepth": 6},
}


def _drawn(salt: str, key: str, label: str, seed: int) -> Column:
    """A number of ``HASH_BITS`` bits from an MD5 digest, which any engine can compute."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), _col(key).cast("string"), _col(label).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def class_cuts(df: DataFrame, wanted: Callable[[int], list[int]], salt: str, key: str = KEY, label: str = LABEL, seed: int = 42) -> dict:
    """For each class the (hash, key) of its k-th rows in the order of hash and key, for every k that ``wanted`` gives for the class's size.

    Rows are counted by class and leading bits of the hash (a fixed number of counts a class reaches the driver); only the
    counts that hold a wanted rank are put in order, a 65,536th of a class each. No class is sorted or meets in a task.
    A rank of 0 has no row and gives None.
    """
    placed = df.filter(_col(label).isNotNull()).select(_col(label).alias("_label"), _drawn(salt, key, label, seed).alias("_h"), _col(key).cast("string").alias("_k"))
    placed = placed.withColumn("_b", F.shiftright("_h", HASH_BITS - COUNTED_BITS))
    counts: dict = {}
    for value, bucket, n in placed.groupBy("_label", "_b").count().collect():
        counts.setdefault(value, {})[bucket] = n
    sought, cuts = [], {}
    for value, own in counts.items():
        buckets = sorted(own)
        ends = np.cumsum([own[b] for b in buckets])
        ranks = wanted(int(ends[-1]))
        cuts[value] = [None] * len(ranks)
        for i, k in enumerate(ranks):
            if k > 0:
                at = int(np.searchsorted(ends, k))
                sought.append((value, buckets[at], int(k - ends[at] + own[buckets[at]]), i))
    if sought:
        spark = df.sparkSession
        kind = placed.schema["_label"].dataType.simpleString()
        ranks = F.broadcast(spark.createDataFrame(sought, f"_label {kind}, _b bigint, _rank bigint, _i int"))  # classes times wanted ranks
        inside = placed.join(F.broadcast(ranks.select("_label", "_b").distinct()), ["_label", "_b"], "left_semi")
        nth = F.row_number().over(W.partitionBy("_label", "_b").orderBy("_h", "_k"))
        for r in inside.withColumn("_rank", nth.cast("bigint")).join(ranks, ["_label", "_b", "_rank"]).collect():
            cuts[r["_label"]][r["_i"]] = (r["_h"], r["_k"])
    return cuts


def _above(cut: tuple | None, salt: str, key: str, label: str, seed: int) -> Column:
    """Whether a row comes after a cut."""
    if cut is None:
        return F.lit(True)
    own = F.struct(_drawn(salt, key, label, seed).alias("h"), _col(key).cast("string").alias("k"))
    return own > F.struct(F.lit(cut[0]).cast("bigint").alias("h"), F.lit(cut[1]).alias("k"))


def stratified_split(df: DataFrame, key: str = KEY, label: str = LABEL, frac: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``split``: ``test`` for ``round(frac * n)`` of the n rows of each class, exactly, else ``train``.

    The test rows are those with the smallest hashes of key, class and seed, so the split depends neither on
    the partitioning nor on the order of the rows. Rows without a class, or rows that share a key at the cut, stay together.
    Two small jobs find the cuts; the rows are not shuffled.
    """
    cuts = class_cuts(df, lambda n: [math.floor(frac * n + 0.5)], "split", key, label, seed)
    side = F.lit("train")
    for value, (cut,) in cuts.items():
        side = F.when((_col(label) == F.lit(value)) & ~_above(cut, "split", key, label, seed), F.lit("test")).otherwise(side)
    return df.withColumn("split", side)


def with_folds(df: DataFrame, folds: int = 5, key: str = KEY, label: str = LABEL, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..folds-1; the rows of a class differ by one at most between folds. The hash has a salt of its own, so folds are independent of the split. Rows without a class are in fold 0."""
    cuts = class_cuts(df, lambda n: [j * n // folds for j in range(1, folds)], "fold", key, label, seed)
    fold = F.lit(0)
    for value, own in cuts.items():
        number = reduce(lambda a, b: a + b, [_above(cut, "fold", key, label, seed).cast("int") for cut in own], F.lit(0))
        fold = F.when(_col(label) == F.lit(value), number).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows and weights per class: ``balanced`` n / (2 n_c), ``ratio`` 1 and negatives / positives."""
    neg, pos = F.col("n_neg"), F.col("n_pos")
    counts = df.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))

    def line(value: int, n):
        ratio = F.lit(1.0) if value == 0 else F.try_divide(neg.cast("double"), pos)
        return F.struct(
            F.lit(value).alias(label),
            n.alias("n"),
            F.try_divide((neg + pos).cast("double"), 2 * n).alias("weight_balanced"),
            ratio.alias("weight_ratio"),
        )

    return counts.select(F.inline(F.array(line(0, neg), line(1, pos))))


def with_class_weight(df: DataFrame, label: str = LABEL, mode: str = "balanced", out: str = "weight") -> DataFrame:
    """Add the class weight of each row; two collected rows."""
    weights = {r[label]: r[f"weight_{mode}"] for r in class_weights(df, label).collect()}
    if any(w is None for w in weights.values()):
        raise ValueError(f"a class of {label} has no rows, so it has no weight")
    chosen = F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    return df.withColumn(out, chosen.cast("double"))


def assemble(df: DataFrame, label: str = LABEL, drop: Sequence[str] = NON_FEATURES, keep: Sequence[str] = (KEY,),
             index: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Key, label and a ``features`` vector of all other numeric columns, and their names in order.

    Text columns named in ``index`` enter as numbered categories, which trees split
    by subsets of levels; with ``BINS`` levels or more they need as many bins for every feature, so give such
    columns ``target_means`` instead where that matters. The first column of ``keep`` is the key.
    """
    names = [c for c in columns_of_type(df, include=["number"]) if c not in drop and c != label and c not in keep]
    indexed, levels = df, {}
    if index:
        dictionary = level_dictionary(df, index)
        levels = level_counts(dictionary, index)
        indexed = with_level_numbers(df, dictionary, index, key=keep[0])
    inputs = names + [f"{c}_index" for c in index]
    # Positions stand for the names, which may hold dots.
    plain = [_col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)]
    nominal = [_col(f"{c}_index").alias(f"_{len(names) + i}", metadata={"ml_attr": {"type": "nominal", "num_vals": levels[c][0] + 1}}) for i, c in enumerate(index)]
    held = indexed.select(*[_col(c) for c in (*keep, label)], *plain, *nominal)
    vectors = VectorAssembler(inputCols=[f"_{i}" for i in range(len(inputs))], outputCol="features").transform(held)
    return vectors.select(*[_col(c) for c in keep], _col(label).cast("int").alias(label), "features"), names + list(index)


def spread(df: DataFrame, rows_per_task: int, key: str = KEY, most_tasks: int = TASKS) -> DataFrame:
    """Partition a staged training table for many short passes over it.

    Tasks hold about ``rows_per_task`` rows, placed and ordered by key, however the table was scanned; a table for which
    that were more than ``most_tasks`` has larger tasks, of up to ``TASK_ROWS`` rows. Sampling inside a solver goes by task and row, so these
    settings belong to the model, and a fit on the same rows is the same on any number of cores.
    """
    n = df.count()
    wanted = max(1, min(math.ceil(n / rows_per_task), most_tasks), math.ceil(n / TASK_ROWS))
    return df.repartition(wanted, key).sortWithinPartitions(key)


@contextmanager
def held(train: DataFrame, rows_per_task: int, key: str = KEY) -> Iterator[DataFrame]:
    """``spread``, kept on the executors' disks during a fit, which reads the table several times; it is shuffled once."""
    placed = spread(train, rows_per_task, key).persist(StorageLevel.DISK_ONLY)
    try:
        yield placed
    finally:
        placed.unpersist()


def fit_logistic(train: DataFrame, label: str = LABEL, max_iter: int = 500, c: float = 1.0) -> PipelineModel:
    """L2-penalised logistic regression on standardised features, balanced classes.

    Spark's scaler divides by the sample deviation; the extra factor turns that into
    the population one. The penalty is spread over the weighted rows, which makes
    it the ``1 / c`` of the summed-loss form.
    """
    with held(train, 50_000) as placed:
        weighted = with_class_weight(placed, label)
        size = weighted.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
        width = len(weighted.select("features").first()["features"])
        widen = math.sqrt(size["n"] / max(size["n"] - 1, 1))
        return Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="_sample_scaled", withMean=True, withStd=True),
            ElementwiseProduct(inputCol="_sample_scaled", outputCol="scaled", scalingVec=Vectors.dense([widen] * width)),
            LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=max_iter,
                               regParam=1.0 / (c * size["w"]), elasticNetParam=0.0, standardization=False),
        ]).fit(weighted)


def forest(trees: int = 1000, min_leaf: int = 3, max_depth: int = 30, seed: int = 42, label: str = LABEL):
    """Random forest with ``sqrt`` feature sampling, as deep as Spark allows."""
    return RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=min_leaf,
        maxDepth=max_depth, featureSubsetStrategy="sqrt", cacheNodeIds=False, seed=seed,
    )


def fit_forest(train: DataFrame, label: str = LABEL, **settings) -> Model:
    with held(train, 2_000) as placed:
        return forest(label=label, **settings).fit(with_class_weight(placed, label))


def widest_category(train: DataFrame) -> int:
    """Values of the widest numbered category in the features; trees need a bin for each."""
    attrs = train.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    return max([a.get("num_vals", len(a.get("vals", []))) for a in attrs], default=0)


def boosted(profile: str = "wide", rounds: int = 1500, label: str = LABEL, seed: int = 42, bins: int = BINS) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds, maxBins=bins, checkpointInterval=10, seed=seed, **BOOSTED_PROFILES[profile])


def fit_boosted(train: DataFrame, profile: str = "wide", rounds: int = 1500, label: str = LABEL, validation: float = 0.2, seed: int = 42) -> Model:
    """Gradient-boosted trees in one of the ``BOOSTED_PROFILES``.

    Profile ``validated`` keeps the rounds up to the one with the best ROC-AUC on a share of the
    training rows held out for that, never on the test rows. It is fitted once with all rounds, judged at
    every round in one pass and cut. With one class only among the held-out rows all rounds stay.
    """
    checkpoint_folder(train.sparkSession)
    trees = boosted(profile, rounds, label, seed, max(BINS, widest_category(train)))
    with held(train, 50_000) as placed:
        weighted = with_class_weight(placed, label, "balanced" if profile == "wide" else "ratio")
        if profile != "validated":
            return trees.fit(weighted)
        parts = stage(stratified_split(weighted, label=label, frac=validation, seed=seed + 1))
    model = trees.fit(parts.filter("split = 'train'"))
    areas = staged_auc(model, parts.filter("split = 'test'"), label).filter("roc_auc IS NOT NULL")
    best = areas.orderBy(F.desc("roc_auc"), "round").first()
    return first_trees(model, best["round"]) if best else model


def leaf_values(model: GBTClassificationModel) -> tuple[np.ndarray, np.ndarray]:
    """What each leaf adds to the margin, tree by tree from left to right, and where each tree begins.

    Read from the model as it is saved; its size is that of the model, whatever the rows.
    """
    spark = SparkSession.active()
    path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    leaves = spark.read.parquet(f"{path}/data").filter("nodeData.leftChild < 0").select("treeID", "nodeData.id", "nodeData.prediction")
    rows = leaves.orderBy("treeID", "id").collect()
    tree = np.array([r["treeID"] for r in rows])
    weights = np.array(model.treeWeights)
    values = np.array([r["prediction"] for r in rows]) * weights[tree]
    return values, np.searchsorted(tree, np.arange(len(weights)))


def staged_margins(model: GBTClassificationModel, df: DataFrame) -> Column:
    """An array column for ``model.setLeafCol('_leaves').transform(df)``: the margin after each round."""
    values, starts = leaf_values(model)
    out = F.transform(vector_to_array("_leaves"), lambda leaf, i: F.get(F.lit(values), (F.get(F.lit(starts.astype(np.int32)), i) + leaf.cast("int"))))
    last = lambda sums: F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0.0))
    return F.aggregate(out, F.array().cast("array<double>"), lambda sums, x: F.array_append(sums, last(sums) + x))


def staged_auc(model: GBTClassificationModel, df: DataFrame, label: str = LABEL) -> DataFrame:
    """(round, roc_auc) after every round, from one scoring of the rows: the leaves a row falls in, summed round by round."""
    placed = model.copy().setLeafCol("_leaves").transform(df)
    sums = placed.select(_col(label).alias("label"), staged_margins(model, df).alias("_sums"))
    scored = sums.select("label", F.posexplode("_sums").alias("round", "score"))
    return roc_auc(scored.withColumn("round", F.col("round") + 1), groups=["round"])


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model after its first ``n`` rounds."""
    sc = SparkSession.active().sparkContext
    ml = sc._jvm.org.apache.spark.ml
    old = model._java_obj.trees()
    trees = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = old[i], float(model.treeWeights[i])
    # The settings (columns, thresholds) are those of the whole model.
    return model._copyValues(GBTClassificationModel(ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures)))


def score(model: Model, df: DataFrame, key: str = KEY, label: str = LABEL) -> DataFrame:
    """Key, label and the probability of class 1."""
    probability = vector_to_array("probability")[1]
    return model.transform(df).select(key, F.col(label).alias("label"), probability.alias("score"))


def out_of_fold_scores(estimator, df: DataFrame, folds: int = 5, key: str = KEY, label: str = LABEL, seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Key, label, ``fold`` and score of every row, from the model that was fitted on the other folds. Staged.

    Classes are weighted inside each fold's training rows only.
    """
    data = stage(with_folds(df, folds, key, label, seed))

    def one(fold: int) -> DataFrame:
        kept, held_out = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        with held(kept, 2_000, key) as placed:
            model = estimator.fit(with_class_weight(placed, label))
        return stage(score(model, held_out, key, label).withColumn("fold", F.lit(fold)))

    with ThreadPoolExecutor(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(folds)))


def cross_validate(estimator, df: DataFrame, folds: int = 5, label: str = LABEL, seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Mean and population standard deviation of ROC-AUC over stratified folds; one row. All folds share one score curve."""
    areas = roc_auc(out_of_fold_scores(estimator, df, folds, label=label, seed=seed, parallelism=parallelism), groups=["fold"])
    return areas.agg(F.avg("roc_auc").alias("mean"), F.stddev_pop("roc_auc").alias("std")).select(
        F.lit("roc_auc").alias("metric"), "mean", "std", F.lit(folds).alias("folds")
    )
