"""Every registered query: (spark, folder of the test tables) -> DataFrame.

All of them read the whole tables. Doubles are rounded to six places so
that the order of a sum does not decide a comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from retentia.functions import clip, flag, ieq, ine_or_null, is_missing, month_of, ntz, safe_ratio, week_of, whole_days
from retentia.job import BOX_COLUMNS
from retentia.operators import explain, levels, metrics, models, ordered, prepare, profile, quality, quantiles, rollup, sketches
from retentia.operators.joins import join_one_to_one, with_globals
from retentia.plans import attrition, customer
from retentia.sources import KEY, TableSpec, coerce_double, coerce_timestamp, load_tables, retention_tables, stage
from retentia.sources.sink import checkpoint_folder, write_features

# The day future events are counted from, the report's threshold.
AS_OF = datetime(2001, 1, 15)
THRESHOLD = 0.5
# Sizes of the models in the queries; those of the library and the job are larger (README has the times).
SIZES = {"forest": {"trees": 50, "max_depth": 12}, "wide": {"rounds": 30}, "validated": {"rounds": 30}}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), places) for c in doubles})


def query(run: Callable[[SparkSession, str], DataFrame]):
    @wraps(run)
    def rounded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(run(spark, sf_dir))

    QUERIES[run.__name__] = rounded_run
    return rounded_run


# Shared inputs. Staged tables and fitted models are kept per application, so that
# queries on the same tables do not build them again.


_BUILT: dict[tuple, object] = {}


def shared(build):
    @wraps(build)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _BUILT:
            _BUILT[key] = build(spark, sf_dir)
        return _BUILT[key]

    return get


def forget_shared() -> None:
    _BUILT.clear()


@shared
def tables(spark, sf_dir):
    return retention_tables(spark, sf_dir)


@shared
def snapshot(spark, sf_dir):
    return customer.snapshot_of(tables(spark, sf_dir))


@shared
def joined(spark, sf_dir):
    """Labelled customers before any fill."""
    return stage(customer.join_customers(tables(spark, sf_dir), snapshot(spark, sf_dir)))


@shared
def features(spark, sf_dir):
    return customer.customer_features(tables(spark, sf_dir), snapshot(spark, sf_dir))


@shared
def frame(spark, sf_dir):
    return stage(customer.model_frame(features(spark, sf_dir), tables(spark, sf_dir), snapshot(spark, sf_dir)))


@shared
def formula_scores(spark, sf_dir):
    """A scored table that plain SQL can compute too: long since the last purchase, few service contacts."""
    idle = F.col("tx_recency_days").cast("double")
    score = (idle + 1) / (idle + 10 * F.col("cs_count") + 1)
    return stage(features(spark, sf_dir).select(KEY, F.col("ChurnStatus").alias("label"), score.alias("score")))


@shared
def linear_table(spark, sf_dir):
    return attrition.training_table(frame(spark, sf_dir), "logistic")


@shared
def forest_table(spark, sf_dir):
    return attrition.training_table(frame(spark, sf_dir), "forest")


@shared
def boosted_table(spark, sf_dir):
    return attrition.training_table(frame(spark, sf_dir), "wide")


@shared
def logistic_model(spark, sf_dir):
    return attrition.fit(linear_table(spark, sf_dir), "logistic")


@shared
def forest_model(spark, sf_dir):
    return attrition.fit(forest_table(spark, sf_dir), "forest", **SIZES["forest"])


@shared
def wide_model(spark, sf_dir):
    return attrition.fit(boosted_table(spark, sf_dir), "wide", **SIZES["wide"])


@shared
def validated_model(spark, sf_dir):
    return attrition.fit(boosted_table(spark, sf_dir), "validated", **SIZES["validated"])


@shared
def model_scores(spark, sf_dir):
    return attrition.all_scores({f.family: f for f in (build(spark, sf_dir) for build in (logistic_model, forest_model, wide_model, validated_model))})


# Sources and sinks


@query
def typed_tables(spark, sf_dir):
    """Key to text, dates and amounts repaired while loading."""
    spec = {
        "orders": TableSpec("orders.parquet", key="o_custkey", timestamps=("o_orderdate",), doubles=("o_totalprice",)),
        "customer": TableSpec("customer.parquet", key="c_custkey", doubles=("c_acctbal", "c_name")),
    }
    loaded = load_tables(spark, sf_dir, spec)
    orders = loaded["orders"].select(
        F.lit("orders").alias("table_name"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("number"), F.col("o_orderdate").alias("event_time")
    )
    customers = loaded["customer"].select(
        F.lit("customer").alias("table_name"), F.col("c_custkey").alias("key"), F.col("c_name").alias("number"), F.lit(None).cast("timestamp_ntz").alias("event_time")
    )
    return orders.unionByName(customers)


@query
def coerced_text(spark, sf_dir):
    """Text that holds a number or a date in some rows only."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    mixed = orders.select(
        "o_orderkey",
        F.when(urgent, F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string")).alias("amount_text"),
        F.when(urgent, "unknown").otherwise(F.col("o_orderdate").cast("string")).alias("date_text"),
    )
    return coerce_timestamp(coerce_double(mixed, ["amount_text"]), ["date_text"])


@query
def written_features(spark, sf_dir):
    """Feature table written out, then read back."""
    path = f"{checkpoint_folder(spark)}/features-{datetime.now():%Y%m%d%H%M%S%f}"
    write_features(features(spark, sf_dir), path)
    return spark.read.parquet(path)


# Projections, filters, scalar functions


@query
def range_filter(spark, sf_dir):
    at = snapshot(spark, sf_dir)
    recent = rollup.since(tables(spark, sf_dir)["tx"], "TransactionDate", at.replace(year=at.year - 1))
    return recent.select(KEY, "TransactionID", "TransactionDate", F.col("AmountSpent").alias("amount"))


@query
def complete_rows(spark, sf_dir):
    """Rows that miss neither income nor channel, without the label and date columns."""
    return joined(spark, sf_dir).na.drop(subset=["IncomeLevel", "ServiceUsage"]).drop(
        "ChurnStatus", "first_txn_dt", "last_txn_dt", "last_cs_dt", "LastLoginDate", "not_there"
    ).select(KEY, "IncomeLevel", "ServiceUsage", "txn_count", "LoginFrequency")


@query
def status_flags(spark, sf_dir):
    """Case-insensitive tests with their rules for missing values."""
    svc = tables(spark, sf_dir)["svc"]
    return svc.groupBy("InteractionType", "ResolutionStatus").agg(
        F.count_if(ieq("InteractionType", "COMPLAINT")).alias("n_complaints"),
        F.count_if(ine_or_null("ResolutionStatus", "ReSolved")).alias("n_unresolved"),
        F.count(F.lit(1)).alias("n"),
    )


@query
def numeric_columns(spark, sf_dir):
    return prepare.select_by_type(joined(spark, sf_dir), include=["number"]).groupBy("ChurnStatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("LoginFrequency").alias("logins"), F.sum("cs_count").alias("contacts")
    )


@query
def collapsed_columns(spark, sf_dir):
    """Columns that share a trimmed name become their row-wise maximum."""
    base = joined(spark, sf_dir)
    twice = base.select(KEY, F.col("txn_count"), F.col("cs_count").alias(" events "), F.col("txn_count").alias("events"))
    return prepare.collapse_duplicate_columns(twice)


@query
def scalar_functions(spark, sf_dir):
    """Each scalar expression of the library on every transaction."""
    tx = tables(spark, sf_dir)["tx"]
    at = ntz(snapshot(spark, sf_dir))
    amount = F.col("AmountSpent")
    return tx.select(
        "TransactionID",
        F.lower("ProductCategory").alias("category"),
        whole_days(at, "TransactionDate").alias("age_days"),
        whole_days("TransactionDate", at).alias("age_days_back"),
        month_of("TransactionDate").alias("month"),
        week_of("TransactionDate").alias("week"),
        (F.col("TransactionDate") - F.make_dt_interval(F.lit(30))).alias("month_before"),
        F.log1p(clip(amount, lower=0)).alias("log_amount"),
        clip(amount, 1000.0, 100000.0).alias("clipped"),
        is_missing(F.nullif("ProductCategory", F.lit("P"))).alias("no_category"),
        safe_ratio(amount, F.when(F.col("ProductCategory") == "F", 0.0).otherwise(4.0)).alias("ratio"),
        flag(amount > 200000).alias("large"),
        F.bround(amount, 0).alias("whole_amount"),
        F.abs(150000 - amount).alias("distance"),
    )


# Joins


@query
def customer_base(spark, sf_dir):
    """Labelled customers with their online state, if any; keys checked on all sides."""
    t = tables(spark, sf_dir)
    base = join_one_to_one(t["demo"], t["churn"], how="inner", names=("demo", "churn"))
    return join_one_to_one(base, t["online"], how="left", names=("base", "online"))


@query
def global_scalars(spark, sf_dir):
    """Each customer against the table's extremes and means."""
    base = joined(spark, sf_dir).select(KEY, "amount_sum", "cs_count")
    wide = with_globals(base, {"top": F.max("amount_sum"), "contacts": F.avg("cs_count")})
    return wide.select(KEY, (F.col("amount_sum") / F.col("top")).alias("share_of_top"), (F.col("cs_count") - F.col("contacts")).alias("over_mean"))


# Roll-ups and windows


@query
def snapshot_time(spark, sf_dir):
    return rollup.snapshot_frame(customer.event_times(tables(spark, sf_dir)))


@query
def tx_profile(spark, sf_dir):
    return rollup.transaction_profile(tables(spark, sf_dir)["tx"], snapshot(spark, sf_dir))


@query
def svc_profile(spark, sf_dir):
    return rollup.service_profile(tables(spark, sf_dir)["svc"], snapshot(spark, sf_dir))


@query
def recency(spark, sf_dir):
    return joined(spark, sf_dir).select(KEY, *prepare.RECENCY_COLUMNS)


@query
def active_months(spark, sf_dir):
    return rollup.active_months(tables(spark, sf_dir)["svc"], ts="InteractionDate")


@query
def event_gaps(spark, sf_dir):
    return ordered.event_gaps(tables(spark, sf_dir)["svc"], ts="InteractionDate")


@query
def online_event_gaps(spark, sf_dir):
    """Gaps on times with a clock part."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias(KEY), "ts")
    return ordered.event_gaps(events, ts="ts")


@query
def event_number(spark, sf_dir):
    svc = tables(spark, sf_dir)["svc"].dropDuplicates()
    return ordered.event_number(svc, ts="InteractionDate", tie=["InteractionID", "InteractionType", "ResolutionStatus"])


@query
def tx_event_number(spark, sf_dir):
    return ordered.event_number(tables(spark, sf_dir)["tx"].dropDuplicates())


@query
def trailing_windows(spark, sf_dir):
    t, at = tables(spark, sf_dir), snapshot(spark, sf_dir)
    recent = rollup.trailing_transactions(t["tx"], at)
    return recent.join(rollup.trailing_interactions(t["svc"], at), KEY, "full")


@query
def weekly_transactions(spark, sf_dir):
    return rollup.weekly_counts(tables(spark, sf_dir)["tx"].dropDuplicates(), "TransactionDate")


@query
def weekly_interactions(spark, sf_dir):
    return rollup.weekly_counts(tables(spark, sf_dir)["svc"].dropDuplicates(), "InteractionDate")


@query
def customer_features(spark, sf_dir):
    return features(spark, sf_dir)


# Quality and profiles


@query
def integrity(spark, sf_dir):
    t = tables(spark, sf_dir)
    everyone = customer.join_customers(t, snapshot(spark, sf_dir), labelled=False)
    return quality.integrity_report(everyone, t["tx"], t["svc"])


@query
def dedupe(spark, sf_dir):
    t = tables(spark, sf_dir)
    return (
        quality.dedupe_report(t["tx"]).withColumn("table_name", F.lit("tx"))
        .unionByName(quality.dedupe_report(t["svc"]).withColumn("table_name", F.lit("svc")))
    )


@query
def duplicate_ids(spark, sf_dir):
    t = tables(spark, sf_dir)
    parts = [
        quality.duplicate_count(df, keys).withColumn("key_columns", F.lit(name))
        for name, df, keys in (
            ("TransactionID", t["tx"], "TransactionID"),
            ("InteractionID", t["svc"], "InteractionID"),
            ("CustomerID,TransactionID", t["tx"], [KEY, "TransactionID"]),
            ("CustomerID,InteractionID", t["svc"], [KEY, "InteractionID"]),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def missing_share(spark, sf_dir):
    return quality.missing_share(joined(spark, sf_dir))


@query
def missing_share_top(spark, sf_dir):
    return quality.missing_share(joined(spark, sf_dir), top=8)


@query
def table_report(spark, sf_dir):
    return quality.table_report(tables(spark, sf_dir), AS_OF)


@query
def coverage(spark, sf_dir):
    return quality.value_counts(prepare.coverage_flags(joined(spark, sf_dir)), ["had_tx", "had_service"])


@query
def value_counts(spark, sf_dir):
    return quality.value_counts(tables(spark, sf_dir)["svc"], ["InteractionType", "ResolutionStatus"])


@query
def income_counts(spark, sf_dir):
    return quality.value_counts(tables(spark, sf_dir)["demo"], "IncomeLevel")


@query
def fan_out(spark, sf_dir):
    return quality.fan_out(tables(spark, sf_dir)["svc"])


@query
def valid_counts(spark, sf_dir):
    return quality.valid_counts(joined(spark, sf_dir), "ChurnStatus", "amount_std")


@query
def global_stats(spark, sf_dir):
    stats = quality.global_stats(
        features(spark, sf_dir), {"ChurnStatus": ["mean"], "txn_count": ["sum"], "cs_count": ["sum", "max"]}
    )
    return stats.withColumn("ChurnStatus_mean", F.bround("ChurnStatus_mean", 3))


@query
def exact_quantiles(spark, sf_dir):
    """Quantiles of the line prices per return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    wanted = {"q01": 0.01, "median": 0.5, "q99": 0.99}
    return quantiles.exact_quantiles(lines, "l_extendedprice", wanted, ["l_returnflag"])


@query
def sketched_quantiles(spark, sf_dir):
    """Quantiles from sketches of the lines, built per return flag and merged: whether their ranks are off by less than one in a thousand."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cols, wanted = ["l_extendedprice", "l_quantity", "l_discount"], {"q01": 0.01, "median": 0.5, "q99": 0.99}
    flags = [lines.filter(F.col("l_returnflag") == f) for f in "ANR"]
    together = sketches.merged_sketches([sketches.value_sketches(part, cols) for part in flags])
    errors = sketches.rank_errors(lines, together, wanted)
    return errors.select("column", "probability", "n", (F.col("error") < 0.001).alias("close"))


@query
def amount_histogram(spark, sf_dir):
    return profile.histogram(tables(spark, sf_dir)["tx"].dropDuplicates(), "AmountSpent")


@query
def log_amount_histogram(spark, sf_dir):
    tx = tables(spark, sf_dir)["tx"].dropDuplicates()
    return profile.histogram(tx.withColumn("log_amount", F.round(F.log1p(clip("AmountSpent", lower=0)), 9)), "log_amount")


@query
def gap_histogram(spark, sf_dir):
    gaps = ordered.gap_counts(ordered.event_gaps(tables(spark, sf_dir)["tx"].dropDuplicates()))
    return profile.histogram(gaps, "gap_days", weight="n_gaps")


@query
def box_summary(spark, sf_dir):
    return profile.box_summary(features(spark, sf_dir), "ChurnStatus", BOX_COLUMNS)


@query
def crosstab_share(spark, sf_dir):
    return profile.crosstab_share(joined(spark, sf_dir), "ServiceUsage", "ChurnStatus", [0, 1])


@query
def top_customers(spark, sf_dir):
    ranked = features(spark, sf_dir).select(KEY, "amount_sum").na.drop()
    return ranked.orderBy(F.col("amount_sum").desc(), KEY).limit(15)


@query
def feature_preview(spark, sf_dir):
    return frame(spark, sf_dir).orderBy(KEY).limit(5)


# Feature preparation


@query
def fill_counts(spark, sf_dir):
    return prepare.fill_counts(joined(spark, sf_dir)).select(KEY, *prepare.COUNT_COLUMNS)


@query
def fill_recency(spark, sf_dir):
    return prepare.fill_recency(joined(spark, sf_dir)).select(KEY, *prepare.RECENCY_COLUMNS)


@query
def missing_flags(spark, sf_dir):
    flagged = prepare.missing_flags(features(spark, sf_dir))
    return flagged.select(KEY, *[c for c in flagged.columns if c.endswith("_was_missing")])


@query
def winsorize(spark, sf_dir):
    capped = prepare.log1p_features(prepare.winsorize_upper(joined(spark, sf_dir)))
    return capped.select(KEY, *prepare.AMOUNT_COLUMNS, "log1p_amount_sum", "log1p_amount_mean")


@query
def one_hot(spark, sf_dir):
    wide = prepare.one_hot(joined(spark, sf_dir).select(KEY, "ServiceUsage"), ["ServiceUsage"], "channel")
    return prepare.one_hot(wide.join(tables(spark, sf_dir)["demo"].select(KEY, "IncomeLevel"), KEY), ["IncomeLevel"])


@query
def fill_median(spark, sf_dir):
    filled = prepare.fill_std_zero(prepare.fill_median(joined(spark, sf_dir)))
    return filled.select(KEY, "tx_avg_gap_days", "amount_std")


@query
def activity_flags(spark, sf_dir):
    t, at = tables(spark, sf_dir), snapshot(spark, sf_dir)
    wide = features(spark, sf_dir).join(rollup.trailing_transactions(t["tx"], at), KEY, "left")
    wide = wide.join(rollup.trailing_interactions(t["svc"], at), KEY, "left")
    return prepare.spend_ratio(prepare.activity_flags(wide)).select(
        KEY, *prepare.WINDOW_COLUMNS, "no_tx_90d", "no_login_90d", "complained_90d", "avg_spend_per_tx"
    )


@query
def standardize(spark, sf_dir):
    counts = features(spark, sf_dir).select(KEY, *[F.col(c).cast("double").alias(c) for c in ("cs_count", "txn_count", "cs_recency_days")])
    return prepare.standardize(counts, ["cs_count", "txn_count", "cs_recency_days"])


@query
def model_frame(spark, sf_dir):
    return frame(spark, sf_dir)


@query
def forest_matrix(spark, sf_dir):
    return customer.forest_matrix(frame(spark, sf_dir))


@query
def indexed_categories(spark, sf_dir):
    matrix, texts = customer.boosted_matrix(frame(spark, sf_dir))
    indexed = levels.with_level_numbers(matrix, levels.level_dictionary(matrix, texts), texts)
    return indexed.select(KEY, *texts, *[f"{c}_index" for c in texts])


@query
def level_numbers(spark, sf_dir):
    """Numbers of the levels of text columns up to one level a row: customer names, part names, event properties."""
    parts = []
    for name, cols in (("customer", ["c_name", "c_mktsegment"]), ("part", ["p_name", "p_type"]), ("events", ["props", "event_type"])):
        dictionary = levels.level_dictionary(spark.read.parquet(f"{sf_dir}/{name}.parquet"), cols)
        parts.append(dictionary.withColumn("table_name", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def numbered_parts(spark, sf_dir):
    """Level numbers by name, joined back to the rows."""
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias(KEY), "p_name", "p_type")
    return levels.with_level_numbers(lines, levels.level_dictionary(lines, ["p_name", "p_type"], "name"), ["p_name", "p_type"])


@query
def target_means(spark, sf_dir):
    """Out-of-fold level means of text columns, on the training rows; those of all training rows on the test rows."""
    named = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias(KEY), "c_name")
    rows = features(spark, sf_dir).select(KEY, "ChurnStatus", "c_mktsegment", "IncomeLevel", "ServiceUsage").join(named, KEY)
    folded = models.with_folds(models.stratified_split(rows))
    means = levels.target_means(folded, ["c_mktsegment", "IncomeLevel", "ServiceUsage", "c_name"], "ChurnStatus", train=F.col("split") == "train")
    return means.select(KEY, "split", "fold", *[c for c in means.columns if c.endswith("_mean")])


@query
def assembled_vectors(spark, sf_dir):
    """The boosted matrix as vectors, and back to numbers: width, sum and numbers of the categories."""
    table = boosted_table(spark, sf_dir)
    v = vector_to_array("features")
    categories = {f"{c}_at": F.get(v, F.lit(table.names.index(c))) for c in ("c_mktsegment", "r_name", "IncomeLevel", "ServiceUsage")}
    return table.data.select(KEY, "ChurnStatus", F.size(v).alias("width"), F.get(v, F.lit(table.names.index("cs_count"))).alias("cs_count"),
                             F.get(v, F.lit(table.names.index("tx_90"))).alias("tx_90"), *[c.alias(name) for name, c in categories.items()])


@query
def features_without_events(spark, sf_dir):
    """Customer features when both event tables are empty: every count and window has its default."""
    t = tables(spark, sf_dir)
    bare = dict(t, tx=t["tx"].filter("false"), svc=t["svc"].filter("false"))
    at = snapshot(spark, sf_dir)
    made = customer.model_frame(customer.customer_features(bare, at), bare, at)
    return made.select(KEY, "txn_count", "cs_count", "active_months", "had_tx", "had_service", "tx_recency_days", "amount_sum", "amount_std",
                       "tx_30", "tx_90", "amt_90", "complaints_90d", "no_tx_90d", "complained_90d", "avg_spend_per_tx")


# Metrics


@query
def class_weights(spark, sf_dir):
    return models.class_weights(features(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(formula_scores(spark, sf_dir))


@query
def roc_auc_by_segment(spark, sf_dir):
    """Many score sets in one job: one per market segment."""
    scored = formula_scores(spark, sf_dir).join(tables(spark, sf_dir)["demo"].select(KEY, "c_mktsegment"), KEY)
    return metrics.roc_auc(scored, groups=["c_mktsegment"])


@query
def average_precision(spark, sf_dir):
    return metrics.average_precision(formula_scores(spark, sf_dir))


@query
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(formula_scores(spark, sf_dir))


@query
def best_threshold(spark, sf_dir):
    return metrics.best_f1_threshold(formula_scores(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return metrics.classification_report(formula_scores(spark, sf_dir), THRESHOLD)


# Models and explanations


@query
def split_shares(spark, sf_dir):
    return models.stratified_split(features(spark, sf_dir)).groupBy("split", "ChurnStatus").agg(F.count(F.lit(1)).alias("n"))


@query
def fold_shares(spark, sf_dir):
    return models.with_folds(features(spark, sf_dir)).groupBy("fold", "ChurnStatus").agg(F.count(F.lit(1)).alias("n"))


@query
def split_rows(spark, sf_dir):
    """Side and fold of every customer."""
    return models.with_folds(models.stratified_split(features(spark, sf_dir).select(KEY, "ChurnStatus")))


@query
def cv_forest(spark, sf_dir):
    return models.cross_validate(models.forest(**SIZES["forest"]), forest_table(spark, sf_dir).data.drop("split"))


@query
def staged_rounds(spark, sf_dir):
    """ROC-AUC of the wide boosted model after each of its rounds, on the test rows."""
    f = wide_model(spark, sf_dir)
    return models.staged_auc(f.model, f.table.test)


@query
def score_logistic(spark, sf_dir):
    return logistic_model(spark, sf_dir).scores()


@query
def score_forest(spark, sf_dir):
    return forest_model(spark, sf_dir).scores()


@query
def score_boosted(spark, sf_dir):
    return wide_model(spark, sf_dir).scores()


@query
def score_validated(spark, sf_dir):
    return validated_model(spark, sf_dir).scores()


@query
def model_report(spark, sf_dir):
    """Metrics of all four models on the test rows."""
    return attrition.model_report(model_scores(spark, sf_dir))


@query
def tuned_report(spark, sf_dir):
    """Classification report of all four models, each at its own threshold."""
    return attrition.class_reports(model_scores(spark, sf_dir))


@query
def importance_gain(spark, sf_dir):
    return explain.rank_importance(wide_model(spark, sf_dir).importance(), 20)


@query
def importance_splits(spark, sf_dir):
    fitted = wide_model(spark, sf_dir)
    return explain.rank_importance(explain.split_importance(fitted.model, fitted.table.names), 20)


@query
def importance_forest(spark, sf_dir):
    return explain.rank_importance(forest_model(spark, sf_dir).importance(), 20)


@query
def importance_prediction(spark, sf_dir):
    f = validated_model(spark, sf_dir)
    return explain.rank_importance(explain.shuffle_importance(f.model, f.table.train, f.table.names, "prediction"), 20)


@query
def importance_loss(spark, sf_dir):
    f = validated_model(spark, sf_dir)
    return explain.rank_importance(explain.shuffle_importance(f.model, f.table.train, f.table.names, "loss"), 20)


@query
def permutation(spark, sf_dir):
    f = wide_model(spark, sf_dir)
    return explain.rank_importance(explain.permutation_importance(f.model, f.table.test, f.table.names))


@query
def attributions(spark, sf_dir):
    f = validated_model(spark, sf_dir)
    rows = explain.attributions(f.model, f.table.test, f.table.names)
    return explain.rank_importance(explain.mean_abs_attribution(rows), 10)


@query
def linear_attributions(spark, sf_dir):
    return explain.rank_importance(logistic_model(spark, sf_dir).importance(), 10)


@query
def ranking_comparison(spark, sf_dir):
    """Ranks under all seven methods; those of the forest are on its own columns."""
    return explain.compare_rankings(attrition.rankings({
        "forest": forest_model(spark, sf_dir), "wide": wide_model(spark, sf_dir), "validated": validated_model(spark, sf_dir),
    }))


@query
def ranked_shares(spark, sf_dir):
    """The ranking operator on a table SQL can build: columns by their share of missing values."""
    shares = quality.missing_share(joined(spark, sf_dir)).select(
        F.col("column_name").alias("feature"), F.col("missing_share").alias("importance")
    )
    return explain.rank_importance(shares, 10)
