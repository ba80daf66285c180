"""Feature importance and per-row attribution for fitted models.

Models are probed by scoring altered copies of the rows, made inside the partitions and aggregated at once; what
is shuffled is one partner row per row, and the score counts. Boosted trees score the copies batch by batch (``boosted_trees``),
other models score copies made by ``explode``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.operators.boosted_trees import BoostedTrees, filled, matrix
from retentia.operators.metrics import roc_auc
from retentia.operators.models import LABEL
from retentia.sources.sink import checkpoint_folder, on_workers, stage
from retentia.sources.tables import KEY


def _table(spark: SparkSession, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def _named(index: str, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(index) + 1)


def rank_importance(df: DataFrame, top: int | None = None) -> DataFrame:
    """Add ``rank`` from 1, largest first, equal ones by name. One row per feature, so one task is enough."""
    order = W.orderBy(F.col("importance").desc(), "feature")
    ranked = df.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def impurity_importance(model: Model, names: Sequence[str]) -> DataFrame:
    """Total impurity decrease (gain) per feature, as a share."""
    return _table(SparkSession.active(), names, model.featureImportances.toArray())


def split_importance(model: Model, names: Sequence[str]) -> DataFrame:
    """Number of tree nodes that split on each feature, counted on the saved model's nodes."""
    spark = SparkSession.active()
    path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").filter("nodeData.leftChild >= 0")
    counts = nodes.groupBy(F.col("nodeData.split.featureIndex").alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    features = spark.createDataFrame(list(enumerate(names)), "_i int, feature string")
    return features.join(counts, "_i", "left").select("feature", F.coalesce("_n", F.lit(0)).cast("double").alias("importance"))


def with_partner(df: DataFrame, repeats: int, seed: int = 42, key: str = KEY, block: int = 10_000) -> DataFrame:
    """Give each row the features of another random row, ``repeats`` times over.

    Rows are hashed into blocks of about ``block`` rows, ordered at random inside, and
    each takes the features of the next (the last those of the first). Every vector
    is used once per repeat, as in a permutation, and no task sorts more than one block.
    """
    blocks = max(1, math.ceil(df.count() / block))
    copies = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    placed = copies.withColumns({
        "_block": F.pmod(F.xxhash64(F.col(key), F.col("repeat"), F.lit(seed)), F.lit(blocks)),
        "_order": F.xxhash64(F.col(key), F.col("repeat"), F.lit(seed + 1)),
    })
    order = W.partitionBy("repeat", "_block").orderBy("_order", key)
    partner = F.coalesce(F.lead("features").over(order), F.first("features").over(order))
    return placed.withColumn("partner", partner).drop("_block", "_order")


def _shuffled_scores(model: Model, df: DataFrame, width: int, repeats: int, seed: int, key: str, label: str) -> DataFrame:
    """Score of every row with one feature at a time taken from its partner."""
    scored = model.transform(df).select(key, label, "features", vector_to_array("probability")[1].alias("base_score"))
    paired = with_partner(scored, repeats, seed, key)
    arrays = paired.withColumns({"_own": vector_to_array("features"), "_other": vector_to_array("partner")})
    probes = arrays.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    mixed = F.transform("_own", lambda v, i: F.when(i == F.col("_i"), F.get(F.col("_other"), i)).otherwise(v))
    probed = probes.select(key, label, "repeat", "_i", "base_score", array_to_vector(mixed).alias("features"))
    return model.transform(probed).select(
        F.col(label).alias("label"), "repeat", "_i", "base_score", vector_to_array("probability")[1].alias("score")
    )


def _paired_arrays(df: DataFrame, repeats: int, seed: int, key: str, *columns: str) -> DataFrame:
    """The named columns, and the features of each row and of its partners as arrays."""
    on_workers(df.sparkSession)
    paired = with_partner(df.select(*dict.fromkeys([key, *[c for c in columns if c != "repeat"]]), "features"), repeats, seed, key)
    return paired.select(*columns, vector_to_array("features").alias("own"), vector_to_array("partner").alias("other"))


def _boosted_shuffled_scores(model: GBTClassificationModel, df: DataFrame, width: int, repeats: int, seed: int, key: str, label: str) -> DataFrame:
    """``_shuffled_scores`` under boosted trees, for the features that they split on."""
    trees = BoostedTrees(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filled(batches):
            own, other = (matrix(batch.column(i), width) for i in (2, 3))
            for f, rows, plain, chance in trees.swapped(own, other):
                score = plain.copy()
                score[rows] = chance
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(own), f, np.int32)), pa.array(score)], ["label", "repeat", "_i", "score"])

    kind = df.schema[label].dataType.simpleString()
    return _paired_arrays(df, repeats, seed, key, label, "repeat").mapInArrow(run, f"label {kind}, repeat int, _i int, score double")


def _boosted_effects(model: GBTClassificationModel, df: DataFrame, metric: str, names: Sequence[str], repeats: int, seed: int, key: str, label: str) -> DataFrame:
    """``shuffle_importance`` under boosted trees: every task gives the rows it has seen and the sum of the effects of each feature."""
    trees, width = BoostedTrees(model), len(names)

    def loss(chance: np.ndarray, hit: np.ndarray) -> np.ndarray:
        bounded = np.clip(chance, 1e-15, 1 - 1e-15)
        return -np.where(hit, np.log(bounded), np.log(1 - bounded))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, np.zeros(width)
        for batch in filled(batches):
            hit = batch.column(0).to_numpy(zero_copy_only=False)
            own, other = (matrix(batch.column(i), width) for i in (1, 2))
            n += len(own)
            for f, rows, plain, chance in trees.swapped(own, other):
                before = plain[rows]
                totals[f] += (np.abs(chance - before) if metric == "prediction" else loss(chance, hit[rows]) - loss(before, hit[rows])).sum()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(totals)], ["_i", "n", "total"])

    if metric not in ("prediction", "loss"):
        raise KeyError(metric)
    pairs = _paired_arrays(df, repeats, seed, key, label)
    marked = pairs.select(F.coalesce(F.col(label) == 1, F.lit(False)).alias("hit"), "own", "other")
    sums = marked.mapInArrow(run, "_i int, n long, total double").groupBy("_i").agg((F.sum("total") / F.sum("n")).alias("importance"))
    return sums.select(_named("_i", names).alias("feature"), "importance")


def permutation_importance(model: Model, df: DataFrame, names: Sequence[str], repeats: int = 10, seed: int = 42,
                           key: str = KEY, label: str = LABEL) -> DataFrame:
    """Mean and deviation over the repeats of the ROC-AUC lost when a feature is shuffled."""
    known = isinstance(model, GBTClassificationModel)
    shuffled = (_boosted_shuffled_scores if known else _shuffled_scores)(model, df, len(names), repeats, seed, key, label)
    counted = roc_auc(shuffled, groups=["_i", "repeat"])
    plain = model.transform(df).select(F.col(label).alias("label"), vector_to_array("probability")[1].alias("score"))
    base = roc_auc(plain).first()["roc_auc"]
    if known and not df.isEmpty():
        # No score depends on a feature that no tree splits on.
        spark = df.sparkSession
        rest = sorted(set(range(len(names))) - set(BoostedTrees(model).trees_of))
        counted = counted.unionByName(spark.createDataFrame([(i, r, base) for i in rest for r in range(repeats)], "_i int, repeat int, roc_auc double"))
    drop = F.lit(base) - F.col("roc_auc")
    return counted.groupBy("_i").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std")).select(
        _named("_i", names).alias("feature"), "importance", "std"
    )


def shuffle_importance(model: Model, df: DataFrame, names: Sequence[str], metric: str = "prediction", seed: int = 42,
                       repeats: int = 5, key: str = KEY, label: str = LABEL) -> DataFrame:
    """Effect of shuffling a feature: mean absolute change of the score, or growth of the log-loss."""
    if isinstance(model, GBTClassificationModel):
        return _boosted_effects(model, df, metric, names, repeats, seed, key, label)
    shuffled = _shuffled_scores(model, df, len(names), repeats, seed, key, label)

    def loss(p: Column) -> Column:
        bounded = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
        return -F.when(F.col("label") == 1, F.ln(bounded)).otherwise(F.ln(1 - bounded))

    effects = {
        "prediction": F.abs(F.col("score") - F.col("base_score")),
        "loss": loss(F.col("score")) - loss(F.col("base_score")),
    }
    return shuffled.groupBy("_i").agg(F.avg(effects[metric]).alias("importance")).select(
        _named("_i", names).alias("feature"), "importance"
    )


def attributions(model: Model, df: DataFrame, names: Sequence[str], samples: int = 4, seed: int = 42,
                 key: str = KEY) -> DataFrame:
    """Sampled Shapley value of each feature of each row, in units of probability, and its standard error.

    A row is reached from a random partner by switching features over one by one in
    random order, and once more in the opposite order; a feature is credited with the change of the score when it
    switches. The credits of a row add up to its score minus the mean score of
    its partners. ``std_error`` is that of the mean over the ``samples`` pairs of walks, NULL for one pair.
    """
    return _attribution_of_totals(_walk_totals(model, df, names, samples, seed, key), names, key)


def attributions_within(model: Model, df: DataFrame, names: Sequence[str], error: float = 0.1, samples: int = 4, most: int = 64,
                        seed: int = 42, key: str = KEY) -> tuple[DataFrame, int]:
    """``attributions`` with samples doubled until the standard errors are small, and the number of samples.

    The root mean square of the standard errors must be within ``error`` times that of the attributions. New walks are added to
    the sums of the earlier ones, which are staged; after ``most`` samples the answer is what there is.
    """
    samples = max(2, samples)
    totals = stage(_walk_totals(model, df, names, samples, seed, key))
    while True:
        rows = _attribution_of_totals(totals, names, key)
        seen = rows.agg(F.avg(F.col("std_error") ** 2).alias("e"), F.avg(F.col("attribution") ** 2).alias("a")).first()
        if samples * 2 > most or seen["e"] is None or seen["e"] <= error**2 * seen["a"]:
            return rows, samples
        more = _walk_totals(model, df, names, samples, seed + samples, key)
        totals = stage(totals.unionByName(more).groupBy(key, "i").agg(*[F.sum(c).alias(c) for c in ("n", "v", "v2")]))
        samples *= 2


def _attribution_of_totals(totals: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    mean = F.col("v") / F.col("n")
    spread = F.greatest(F.col("v2") - F.col("n") * mean * mean, F.lit(0.0))
    error = F.sqrt(F.try_divide(spread, F.col("n") * (F.col("n") - 1)))
    return totals.select(key, _named("i", names).alias("feature"), mean.alias("attribution"), error.alias("std_error"))


def _walk_totals(model: Model, df: DataFrame, names: Sequence[str], samples: int, seed: int, key: str) -> DataFrame:
    """(key, i, n, v, v2): pairs of walks, and the sum and the sum of squares of what they credit a feature with.

    The step at which a feature switches is looked up, so a probe costs one pass over its features.
    """
    width = len(names)
    if isinstance(model, GBTClassificationModel):
        return _boosted_walk_totals(model, df, width, samples, seed, key)
    paired = with_partner(df.select(key, "features"), samples, seed, key)
    index = F.sequence(F.lit(0), F.lit(width - 1))
    draws = F.transform(index, lambda i: F.struct(F.xxhash64(F.col(key), F.col("repeat"), i, F.lit(seed)).alias("h"), i.alias("i")))
    there = paired.withColumns({
        "_own": vector_to_array("features"),
        "_other": vector_to_array("partner"),
        "_there": F.transform(F.array_sort(draws), lambda d: d["i"]),
    })
    orders = F.array(F.col("_there"), F.reverse("_there"))
    walk = there.select(key, "repeat", "_own", "_other", F.explode(orders).alias("_order"))
    # The inverse of the order: at which step each feature switches.
    by_feature = F.array_sort(F.transform("_order", lambda i, step: F.struct(i.alias("i"), step.alias("step"))))
    steps = walk.withColumn("_when", F.transform(by_feature, lambda d: d["step"])).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    mixed = F.transform("_own", lambda v, i: F.when(F.get(F.col("_when"), i) < F.col("_step"), v).otherwise(F.get(F.col("_other"), i)))
    probes = steps.select(
        key, "repeat",
        array_to_vector(mixed).alias("features"),
        F.get(F.col("_order"), F.col("_step") - 1).alias("_in"),
        F.get(F.col("_order"), F.col("_step")).alias("_next"),
    )
    scored = model.transform(probes).withColumn("_p", vector_to_array("probability")[1])
    credits = F.array(
        F.struct(F.col("_in").alias("i"), F.col("_p").alias("v")), F.struct(F.col("_next").alias("i"), (-F.col("_p")).alias("v"))
    )
    credited = scored.select(key, "repeat", F.inline(credits)).filter("i IS NOT NULL")
    pairs = credited.groupBy(key, "repeat", "i").agg((F.sum("v") / 2).alias("v"))
    return pairs.groupBy(key, "i").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("v2"))


def _boosted_walk_totals(model: GBTClassificationModel, df: DataFrame, width: int, samples: int, seed: int, key: str) -> DataFrame:
    """``_walk_totals`` under boosted trees. The credits of a walk stay together in an array until they are placed by key."""
    trees = BoostedTrees(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filled(batches):
            own, other = (matrix(batch.column(i), width) for i in (2, 3))
            order = np.argsort(matrix(batch.column(4), width), axis=1, kind="stable")
            credit = (trees.walked(own, other, order) + trees.walked(own, other, order[:, ::-1])) / 2
            ends = pa.array(np.arange(0, credit.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(credit.ravel()))], ["key", "repeat", "credits"])

    draws = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.xxhash64(F.col(key), F.col("repeat"), i, F.lit(seed)))
    pairs = _paired_arrays(df, samples, seed, key, key, "repeat").withColumn("draws", draws)
    walked = pairs.mapInArrow(run, f"key {kind}, repeat int, credits array<double>").withColumnRenamed("key", key)
    credited = walked.repartition(key).select(key, "repeat", F.posexplode("credits").alias("i", "v"))
    by_walk = credited.groupBy(key, "repeat", "i").agg(F.sum("v").alias("v"))
    return by_walk.groupBy(key, "i").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("v2"))


def linear_attributions(model: PipelineModel, df: DataFrame, names: Sequence[str], key: str = KEY) -> DataFrame:
    """Exact attribution of a logistic pipeline: coefficient times distance from the mean, in log-odds."""
    coefficients = F.array(*[F.lit(float(c)) for c in model.stages[-1].coefficients])
    parts = F.zip_with(vector_to_array("scaled"), coefficients, lambda x, c: x * c)
    rows = model.transform(df).select(key, F.posexplode(parts).alias("_i", "attribution"))
    return rows.select(key, _named("_i", names).alias("feature"), "attribution")


def mean_abs_attribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))


def compare_rankings(rankings: Mapping[str, DataFrame]) -> DataFrame:
    """One row per feature with its rank under each method."""
    ranked = [rank_importance(df.select("feature", "importance")).withColumn("method", F.lit(m)) for m, df in rankings.items()]
    together = reduce(DataFrame.unionByName, ranked)
    wide = together.groupBy("feature").pivot("method", list(rankings)).agg(F.first("rank"))
    return wide.select("feature", *[F.col(f"`{m}`").alias(f"rank_{m}") for m in rankings])
