import pytest
from pyspark.sql import functions as F

from retentia.job import run
from retentia.operators.quality import IntegrityError, table_report
from retentia.sources import retention_tables
from tests.conftest import SMALL

FEW = {
    "logistic": {"max_iter": 20}, "forest": {"trees": 3}, "wide": {"rounds": 2}, "validated": {"rounds": 2},
    "permutation": {"repeats": 2}, "prediction": {"repeats": 1}, "loss": {"repeats": 1}, "attribution": {"samples": 2},
}


def test_the_whole_analysis_is_written(spark, tmp_path):
    out = str(tmp_path / "out")
    run(spark, retention_tables(spark, SMALL), out, expected=150, settings=FEW)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert read("features").count() == read("model_frame").count() == 150
    assert read("integrity").filter("ok").count() == 4
    report = {r["model"]: r for r in read("model_report").collect()}
    assert set(report) == {"logistic", "forest", "wide", "validated"}
    assert all(0 <= r["roc_auc"] <= 1 and 0 < r["average_precision"] <= 1 and 0 <= r["threshold"] <= 1 for r in report.values())
    sizes = {r["n"] for r in read("scores").groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 1, "all models are judged on the same customers"
    assert read("importance").filter("rank = 1").count() == 4
    assert read("class_reports").groupBy("model").count().count() == 4 and read("dedupe").count() == 2
    assert read("cross_validation").first()["folds"] == 5 and read("duplicates").count() == 4
    assert {r[0] for r in read("histograms").groupBy("measure").count().filter("count = 50").collect()} == {"amount", "log_amount", "gap_days"}
    assert read("boxes").select("feature").distinct().count() == 12 and read("channel_share").count() > 1 and read("gaps").count() > 1
    assert read("value_counts").filter("column_name = 'IncomeLevel'").agg(F.sum("n")).first()[0] == 150
    methods = {"gain", "split", "permutation", "prediction", "loss", "attribution", "forest"}
    assert {r[0] for r in read("rankings").select("method").distinct().collect()} == methods
    assert set(read("ranking_comparison").columns) == {"feature", *[f"rank_{m}" for m in methods]}
    assert read("weekly_tx").count() > 100 and read("weekly_svc").count() > 100


def test_a_failed_check_stops_the_job(spark, tmp_path):
    with pytest.raises(IntegrityError, match="expected_customers"):
        run(spark, retention_tables(spark, SMALL), str(tmp_path / "out"), expected=151)


def test_future_rows_default_to_now(tx):
    assert table_report({"tx": tx}).first()["n_future"] == 0
