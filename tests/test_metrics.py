from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.operators import metrics

TOY = [(0, 0.1), (1, 0.4), (0, 0.35), (1, 0.8), (0, 0.5)]
scored_rows = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40)
SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def scored(spark, rows):
    return spark.createDataFrame([(y, float(s)) for y, s in rows], "label int, score double")


def auc_by_hand(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def curve_by_hand(rows):
    total = sum(y for y, _ in rows)
    out = {}
    for t in sorted({s for _, s in rows}):
        tp, n = sum(y for y, s in rows if s >= t), sum(1 for _, s in rows if s >= t)
        out[float(t)] = (tp / n, tp / total if total else None)
    return out


def test_toy_values(spark):
    df = scored(spark, TOY)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(5 / 6)
    assert metrics.average_precision(df).first()[0] == pytest.approx(5 / 6)
    best = metrics.best_f1_threshold(df).first()
    assert best["threshold"] == 0.4 and best["f1"] == pytest.approx(0.8)


@SLOW
@given(scored_rows)
def test_curves_match_brute_force(spark, rows):
    df = scored(spark, rows)
    want, total = curve_by_hand(rows), sum(y for y, _ in rows)
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in metrics.pr_curve(df).collect()}
    assert got.keys() == want.keys()
    for t in want:
        assert got[t] == pytest.approx(want[t])
    auc = metrics.roc_auc(df).first()[0]
    assert auc == pytest.approx(auc_by_hand(rows))
    raised = metrics.roc_auc(df.withColumn("score", F.exp("score") * 3)).first()[0]
    assert raised == pytest.approx(auc), "any rising map of the scores keeps the AUC"
    if total:
        order, last, steps = sorted(want, reverse=True), 0.0, 0.0
        for t in order:
            steps += (want[t][1] - last) * want[t][0]
            last = want[t][1]
        assert metrics.average_precision(df).first()[0] == pytest.approx(steps)
        f1 = {t: 2 * p * r / (p + r + 1e-9) for t, (p, r) in want.items()}
        top = max(f1.values())
        best = metrics.best_f1_threshold(df).first()
        assert best["f1"] == pytest.approx(top) and f1[best["threshold"]] == pytest.approx(top)
        assert not [t for t in f1 if t < best["threshold"] and f1[t] > top - 1e-12]


@SLOW
@given(scored_rows, scored_rows)
def test_groups_are_evaluated_apart(spark, a, b):
    df = scored(spark, a).withColumn("m", F.lit("a")).union(scored(spark, b).withColumn("m", F.lit("b")))
    got = {r["m"]: r["roc_auc"] for r in metrics.roc_auc(df, groups=["m"]).collect()}
    assert got == {"a": pytest.approx(auc_by_hand(a)), "b": pytest.approx(auc_by_hand(b))}


def test_one_class_has_no_auc(spark):
    df = scored(spark, [(1, 1), (1, 2)])
    assert metrics.roc_auc(df).first()[0] is None
    assert metrics.average_precision(df).first()[0] == 1.0


def test_classification_report(spark):
    got = {r["class"]: r for r in metrics.classification_report(scored(spark, TOY), 0.4).collect()}
    cells = defaultdict(int)
    for y, s in TOY:
        cells[y, s >= 0.4] += 1
    assert (cells[1, True], cells[0, True], cells[0, False]) == (2, 1, 2)
    one, zero = got["1"], got["0"]
    assert (one["precision"], one["recall"], one["f1"], one["support"]) == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8), 2)
    assert (zero["precision"], zero["recall"], zero["f1"], zero["support"]) == (1.0, pytest.approx(2 / 3), pytest.approx(0.8), 3)
    assert got["accuracy"]["f1"] == 0.8 and got["accuracy"]["precision"] is None
    assert got["macro avg"]["recall"] == pytest.approx(5 / 6) and got["weighted avg"]["recall"] == pytest.approx(0.8)
    nobody = {r["class"]: r for r in metrics.classification_report(scored(spark, TOY), 2.0).collect()}
    assert nobody["1"]["precision"] == 0.0 and nobody["1"]["f1"] == 0.0


def test_reports_of_groups_use_their_own_thresholds(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.4), ("b", 1, 0.3), ("b", 0, 0.1), ("b", 1, 0.1)]
    df = spark.createDataFrame(rows, "model string, label int, score double").withColumn("t", F.when(F.col("model") == "a", 0.5).otherwise(0.2))
    got = {(r["model"], r["class"]): r["recall"] for r in metrics.classification_report(df, F.col("t"), groups=["model"]).collect()}
    assert got["a", "1"] == 1.0 and got["b", "1"] == 0.5 and got["b", "0"] == 1.0 and len(got) == 10
