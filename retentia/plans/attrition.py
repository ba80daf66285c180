"""Training, scoring and explaining the four model families on a model frame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.operators import explain, metrics, models
from retentia.operators.levels import level_counts, level_dictionary, target_means, with_level_numbers
from retentia.operators.prepare import columns_of_type
from retentia.plans.customer import boosted_matrix, forest_matrix, linear_matrix
from retentia.sources.sink import stage
from retentia.sources.tables import KEY

FAMILIES = ("logistic", "forest", "wide", "validated")


@dataclass(frozen=True)
class TrainingTable:
    """A staged table of key, label, ``features`` vector and ``split``, and the feature names."""

    data: DataFrame
    names: list[str]

    @property
    def train(self) -> DataFrame:
        return self.data.filter("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.data.filter("split = 'test'")


@dataclass(frozen=True)
class Fitted:
    family: str
    model: Model
    table: TrainingTable

    def scores(self) -> DataFrame:
        """Key, label and score of the test rows."""
        return models.score(self.model, self.table.test)

    def importance(self) -> DataFrame:
        """Own importance of the family: mean absolute attribution, or impurity decrease."""
        if self.family == "logistic":
            rows = explain.linear_attributions(self.model, self.table.test, self.table.names)
            return explain.mean_abs_attribution(rows)
        return explain.impurity_importance(self.model, self.table.names)


def training_table(frame: DataFrame, family: str, test_share: float = 0.25, seed: int = 42) -> TrainingTable:
    """The matrix a family needs, assembled, split and staged; the split is the same for all families.

    Text columns with few levels are 0/1 columns for the forest and categories for boosting. One with more of them, however many,
    enters as two numbers: its level's rank by frequency, and the level's share of positive rows, taken from
    other folds of the training rows.
    """
    if family == "logistic":
        matrix, texts, most = linear_matrix(frame), [], 0
    elif family == "forest":
        matrix, most = forest_matrix(frame), 0
        texts = [c for c in columns_of_type(matrix, include=["string"]) if c != KEY]
    else:
        matrix, texts = boosted_matrix(frame)
        most = models.BINS - 1
    split = models.stratified_split(matrix, frac=test_share, seed=seed)
    narrow: list[str] = []
    if texts:
        dictionary = level_dictionary(matrix, texts)
        narrow = [c for c, (n, _) in level_counts(dictionary, texts).items() if n <= most]
        wide = [c for c in texts if c not in narrow]
        if wide:
            folded = models.with_folds(split, models.MEAN_FOLDS, seed=seed)
            means = target_means(folded, wide, models.LABEL, "fold", models.MEAN_FOLDS, F.col("split") == "train").drop("fold")
            split = with_level_numbers(means, dictionary, wide, "_number").drop(*wide)
    data, names = models.assemble(split, keep=(KEY, "split"), index=narrow)
    return TrainingTable(stage(data), names)


def fit(table: TrainingTable, family: str, **settings) -> Fitted:
    if family == "logistic":
        model = models.fit_logistic(table.train, **settings)
    elif family == "forest":
        model = models.fit_forest(table.train, **settings)
    else:
        model = models.fit_boosted(table.train, family, **settings)
    return Fitted(family, model, table)


def fit_families(frame: DataFrame, settings: Mapping[str, Mapping] | None = None) -> dict[str, Fitted]:
    """Fit all families; ``settings`` gives arguments per family. Both boosted ones share a table."""
    settings = settings or {}
    tables: dict[str, TrainingTable] = {}
    fitted = {}
    for family in FAMILIES:
        kind = "boosted" if family in models.BOOSTED_PROFILES else family
        if kind not in tables:
            tables[kind] = training_table(frame, family)
        fitted[family] = fit(tables[kind], family, **settings.get(family, {}))
    return fitted


def all_scores(fitted: Mapping[str, Fitted]) -> DataFrame:
    parts = [f.scores().withColumn("model", F.lit(name)) for name, f in fitted.items()]
    return stage(reduce(DataFrame.unionByName, parts))


def model_report(scores: DataFrame) -> DataFrame:
    """ROC-AUC, average precision and best-F1 threshold per model, for all models at once and from one staged curve."""
    groups = ["model"]
    curve = stage(metrics.score_curve(scores, groups=groups))
    return (
        metrics.auc_of_curve(curve, groups)
        .join(metrics.precision_of_curve(curve, groups), groups)
        .join(metrics.threshold_of_curve(curve, groups), groups)
    )


def rankings(fitted: Mapping[str, Fitted], settings: Mapping[str, Mapping] | None = None) -> dict[str, DataFrame]:
    """Feature importance under each method, ready for ``compare_rankings``: gain, split and permutation of the wide boosted
    model, prediction change, loss change and attributions of the validated one, impurity decrease of the forest.

    ``settings`` gives arguments per method. The shuffled and attributed ones probe the test rows.
    """
    settings = settings or {}
    wide, best, forest = (fitted[f] for f in ("wide", "validated", "forest"))
    found = {
        "gain": wide.importance(),
        "split": explain.split_importance(wide.model, wide.table.names),
        "permutation": explain.permutation_importance(wide.model, wide.table.test, wide.table.names, **settings.get("permutation", {})),
        "prediction": explain.shuffle_importance(best.model, best.table.test, best.table.names, "prediction", **settings.get("prediction", {})),
        "loss": explain.shuffle_importance(best.model, best.table.test, best.table.names, "loss", **settings.get("loss", {})),
        "attribution": explain.mean_abs_attribution(explain.attributions(best.model, best.table.test, best.table.names, **settings.get("attribution", {}))),
        "forest": forest.importance(),
    }
    return {method: stage(df.select("feature", "importance")) for method, df in found.items()}


def class_reports(scores: DataFrame) -> DataFrame:
    """Classification report of every model at its threshold: 0.5 for the logistic one, else the one with the best F1.

    The scored test rows are dealt in two halves by key; one chooses the thresholds, the reports are
    made on the other, which no choice has seen.
    """
    halves = models.with_folds(scores, 2, KEY, "label")
    best = metrics.best_f1_threshold(halves.filter("fold = 0"), groups=["model"])
    chosen = best.select("model", F.when(F.col("model") == "logistic", 0.5).otherwise(F.col("threshold")).alias("threshold"))
    held_out = halves.filter("fold = 1").join(chosen, "model")
    return metrics.classification_report(held_out, F.col("threshold"), groups=["model", "threshold"])


def scored_customers(fitted: Fitted) -> DataFrame:
    """Score of every customer of the table, for use outside the evaluation."""
    return models.score(fitted.model, fitted.table.data).select(KEY, "score")
