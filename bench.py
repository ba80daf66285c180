"""Time the headline queries and print one JSON line.

Each query starts from the raw tables: staged inputs and models of an earlier one are
forgotten before it runs. BENCH_SF_DIR and BENCH_CPUS choose data and threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks.catalog import QUERIES, forget_shared  # noqa: E402

HEADLINE = (
    "tx_profile", "svc_profile", "event_gaps", "event_number", "trailing_windows", "integrity", "customer_features",
    "table_report", "dedupe", "missing_share", "weekly_interactions", "amount_histogram", "gap_histogram",
    "exact_quantiles", "box_summary", "crosstab_share", "winsorize", "model_frame", "forest_matrix", "roc_auc",
    "average_precision", "best_threshold", "classification_report", "score_logistic", "score_forest", "score_boosted",
    "score_validated", "importance_splits", "linear_attributions", "staged_rounds", "cv_forest", "permutation",
    "attributions", "ranking_comparison", "level_numbers", "target_means",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("retentia-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["value_counts"](spark, folder).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        forget_shared()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
