"""Exact ranking metrics on a scored table (label 0/1, score), as Spark aggregates.

Rows are first counted per distinct score; running counts over the scores then give every
curve. ``groups`` evaluates many score sets at once. Building the curve runs a job to place the counts; a
curve that is staged once serves all metrics (``..._of_curve``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.operators.ordered import running_totals


def score_curve(scored: DataFrame, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: its positives and negatives, and those it ranks above.

    ``tp`` and ``fp`` count rows scored at or above the threshold.
    """
    counts = scored.groupBy(*groups, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    points = running_totals(counts, "threshold", ["pos", "neg"], groups)
    return points.withColumns({"tp": F.col("pos_total") - F.col("pos_below"), "fp": F.col("neg_total") - F.col("neg_below")})


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; NULL with one class only."""
    return auc_of_curve(score_curve(scored, label, score, groups), groups)


def auc_of_curve(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    return curve.groupBy(*groups).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def average_precision(scored: DataFrame, label: str = "label", score: str = "score",
                      groups: Sequence[str] = ()) -> DataFrame:
    """Sum over thresholds of the recall gained times the precision reached."""
    return precision_of_curve(score_curve(scored, label, score, groups), groups)


def precision_of_curve(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    gained = F.sum(F.col("pos") * precision)
    return curve.groupBy(*groups).agg(
        F.try_divide(gained, F.max("pos_total").cast("double")).alias("average_precision")
    )


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score taken as threshold."""
    return points_of_curve(score_curve(scored, label, score, groups), groups)


def points_of_curve(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return curve.select(
        *groups,
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("pos_total")).alias("recall"),
    )


def best_f1_threshold(scored: DataFrame, label: str = "label", score: str = "score",
                      groups: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest F1, the lowest of equals."""
    return threshold_of_curve(score_curve(scored, label, score, groups), groups)


def threshold_of_curve(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / (p + r + 1e-9)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("order"), p.alias("precision"), r.alias("recall")))
    found = points_of_curve(curve, groups).groupBy(*groups).agg(best.alias("best"))
    return found.select(
        *groups, (-F.col("best.order")).alias("threshold"), F.col("best.precision"), F.col("best.recall"), F.col("best.f1")
    )


def classification_report(scored: DataFrame, threshold: float | Column = 0.5, label: str = "label",
                          score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Per-class precision, recall, F1 and support, with accuracy, macro and weighted means.

    The four cells of the confusion table are one aggregate, one row per group; the rest is
    arithmetic on that row. A ratio without cases is 0. ``threshold`` may be a column, such as a
    group's own.
    """
    hit, actual = F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(threshold)), F.col(label) == 1
    cells = scored.groupBy(*groups).agg(
        F.count_if(hit & actual).alias("tp"),
        F.count_if(hit & ~actual).alias("fp"),
        F.count_if(~hit & actual).alias("fn"),
        F.count_if(~hit & ~actual).alias("tn"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    negative = (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp), tn + fp)
    positive = (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    nothing = F.lit(None).cast("double")
    macro = tuple((a + b) / 2 for a, b in zip(negative[:3], positive[:3]))
    weighted = tuple(ratio(a * negative[3] + b * positive[3], n) for a, b in zip(negative[:3], positive[:3]))
    lines = {
        "0": negative,
        "1": positive,
        "accuracy": (nothing, nothing, ratio(tp + tn, n), n),
        "macro avg": (*macro, n),
        "weighted avg": (*weighted, n),
    }
    names = ("precision", "recall", "f1", "support")
    rows = F.array(*[
        F.struct(F.lit(line).alias("class"), *[v.alias(c) for c, v in zip(names, values)]) for line, values in lines.items()
    ])
    return cells.select(*groups, F.inline(rows))
