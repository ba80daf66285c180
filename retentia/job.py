"""The whole analysis as one Spark job.

    spark-submit attrition_job.py --tables <folder> --out <folder> [--format parquet] [--snapshot 2024-03-31]

Reads the five customer tables, checks them, and writes below ``--out``: ``integrity``,
``missing_share``, ``table_report``, ``dedupe``, ``duplicates``, ``value_counts``, ``weekly_tx``, ``weekly_svc``,
``histograms``, ``gaps``, ``features``, ``boxes``, ``channel_share``, ``model_frame``, ``cross_validation``,
``scores``, ``model_report``, ``class_reports``, ``importance``, ``rankings`` and ``ranking_comparison``.
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions import clip
from retentia.functions.columns import _col
from retentia.operators.explain import compare_rankings, rank_importance
from retentia.operators.models import cross_validate, forest
from retentia.operators.ordered import event_gaps, gap_counts
from retentia.operators.prepare import columns_of_type
from retentia.operators.profile import box_summary, crosstab_share, histogram
from retentia.operators.quality import dedupe_report, duplicate_count, enforce, integrity_report, missing_share, table_report, value_counts
from retentia.operators.rollup import weekly_counts
from retentia.plans.attrition import all_scores, class_reports, fit_families, model_report, rankings
from retentia.plans.customer import CHANNEL, customer_features, join_customers, model_frame, snapshot_of
from retentia.sources import CUSTOMER_TABLES, KEY, load_tables, stage, write_features

# Columns with a box summary per label.
BOX_COLUMNS = (
    "txn_count", "amount_sum", "amount_mean", "tx_recency_days", "active_months", "product_cat_nunique",
    "cs_count", "complaint_count", "unresolved_count", "cs_recency_days", "LoginFrequency", "lastlogin_recency_days",
)


def run(spark: SparkSession, tables: dict[str, DataFrame], out: str, snapshot: datetime | None = None,
        expected: int | None = None, mode: str = "errorifexists", settings: dict | None = None) -> None:
    def save(df: DataFrame, name: str) -> None:
        write_features(df, f"{out.rstrip('/')}/{name}", mode)

    snapshot = snapshot or snapshot_of(tables)
    everyone = stage(join_customers(tables, snapshot, labelled=False))
    report = stage(integrity_report(everyone, tables["tx"], tables["svc"], expected))
    save(report, "integrity")
    enforce(report)
    save(missing_share(everyone), "missing_share")
    save(table_report(tables, snapshot), "table_report")
    copies = [dedupe_report(tables[t]).withColumn("table_name", F.lit(t)) for t in ("tx", "svc")]
    save(reduce(DataFrame.unionByName, copies), "dedupe")
    for name, time in (("tx", "TransactionDate"), ("svc", "InteractionDate")):
        save(weekly_counts(tables[name].dropDuplicates(), time), f"weekly_{name}")

    repeats = [(t, KEY, id) for t, id in (("tx", "TransactionID"), ("svc", "InteractionID"))]
    counted = [duplicate_count(tables[t], keys).select(F.lit(t).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "n_duplicates")
               for t, key, id in repeats for keys in ([id], [key, id])]
    save(reduce(DataFrame.unionByName, counted), "duplicates")
    texts = [(t, c) for t, kept in (("demo", None), ("svc", ("InteractionType", "ResolutionStatus")), ("online", ("ServiceUsage",)))
             for c in columns_of_type(tables[t], include=["string"]) if c != KEY and (kept is None or c in kept)]
    values = [value_counts(tables[t], c).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), _col(c).alias("value"), "n") for t, c in texts]
    if values:
        save(reduce(DataFrame.unionByName, values), "value_counts")
    tx = tables["tx"].dropDuplicates()
    gaps = stage(gap_counts(event_gaps(tx)))
    save(gaps, "gaps")
    spent = tx.withColumn("log_amount", F.log1p(clip("AmountSpent", lower=0)))
    bars = [("amount", histogram(tx, "AmountSpent")), ("log_amount", histogram(spent, "log_amount")), ("gap_days", histogram(gaps, "gap_days", weight="n_gaps"))]
    save(reduce(DataFrame.unionByName, [df.withColumn("measure", F.lit(name)) for name, df in bars]), "histograms")

    features = stage(customer_features(tables, snapshot, validate=False))
    save(features, "features")
    save(box_summary(features, "ChurnStatus", BOX_COLUMNS), "boxes")
    if CHANNEL in features.columns:
        save(crosstab_share(features, CHANNEL, "ChurnStatus", [0, 1]), "channel_share")
    frame = stage(model_frame(features, tables, snapshot))
    save(frame, "model_frame")

    settings = settings or {}
    fitted = fit_families(frame, settings)
    save(cross_validate(forest(**settings.get("forest", {})), fitted["forest"].table.data.drop("split")), "cross_validation")
    scores = all_scores(fitted)
    save(scores, "scores")
    save(model_report(scores), "model_report")
    save(class_reports(scores), "class_reports")
    ranked = [rank_importance(f.importance(), 20).withColumn("model", F.lit(name)) for name, f in fitted.items()]
    save(reduce(DataFrame.unionByName, ranked), "importance")
    methods = rankings(fitted, settings)
    save(reduce(DataFrame.unionByName, [rank_importance(df).withColumn("method", F.lit(m)) for m, df in methods.items()]), "rankings")
    save(compare_rankings(methods), "ranking_comparison")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--tables", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--snapshot", type=datetime.fromisoformat)
    parser.add_argument("--expected", type=int, help="number of customers the tables must hold")
    parser.add_argument("--mode", default="errorifexists")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("retentia").getOrCreate()
    spec = {name: replace(table, format=args.format) for name, table in CUSTOMER_TABLES.items()}
    run(spark, load_tables(spark, args.tables, spec), args.out, args.snapshot, args.expected, args.mode)
    spark.stop()


if __name__ == "__main__":
    main()
