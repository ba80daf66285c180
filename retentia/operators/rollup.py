"""Event tables rolled up to one row per customer, and to one row per period."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.functions import ieq, ine_or_null, month_of, ntz, recency_days, week_of, whole_days
from retentia.functions.columns import _col
from retentia.operators.ordered import event_times, moving_average, timeline_profile
from retentia.sources.tables import KEY


def snapshot_frame(sources: Iterable[tuple[DataFrame, str]]) -> DataFrame:
    """Latest time over several (table, column) pairs, as a one-row table."""
    latest = [df.agg(F.max(ts).alias("snapshot")) for df, ts in sources]
    return reduce(DataFrame.unionByName, latest).agg(F.max("snapshot").alias("snapshot"))


def snapshot_date(sources: Iterable[tuple[DataFrame, str]]) -> datetime | None:
    """Latest time over several (table, column) pairs, collected; missing tables and times are skipped.

    A table is read after the latest time of those before it only, so the bound reaches its scan and a table that is itself
    a join joins what may be later, not all of its rows.
    """
    sources = list(sources)
    if any(df.schema[ts].dataType.typeName() != "timestamp_ntz" for df, ts in sources):
        return snapshot_frame(sources).first()["snapshot"]
    latest = None
    for df, ts in sources:
        later = df if latest is None else df.filter(_col(ts) > ntz(latest))
        latest = later.agg(F.max(_col(ts)).alias("snapshot")).first()["snapshot"] or latest
    return latest


def total(c: Column | str) -> Column:
    """Sum that is 0, not missing, when every value of the group is missing."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def transaction_profile(tx: DataFrame, snapshot: datetime | Column, key: str = KEY, id: str = "TransactionID",
                        ts: str = "TransactionDate", amount: str = "AmountSpent",
                        category: str = "ProductCategory") -> DataFrame:
    """Everything known about a customer's transactions, one row per customer with any.

    Events are read and shuffled once. Each event time and category of a customer is a state (rows, amounts, their sum and squared
    deviations) that is merged to hours and categories, and these to the customer: sums add up, squared deviations add up
    with the distances of the means, gaps and months come from the order of the hours. So a customer with
    very many rows is merged in parts. Deviations are taken from means, never as a difference of large squares.
    A category stays a grouping column until it is counted: all states are plain, no set is built for each of millions of hours.
    """
    amounts = {"_c": F.count(_col(amount)), "_s": F.sum(_col(amount)), "_m2": F.var_pop(_col(amount)) * F.count(_col(amount))}
    state = event_times(tx.filter(_col(key).isNotNull()), key, ts, {"_ids": F.count(_col(id)), **amounts}, by=[category])
    hour, whole = W.partitionBy(key, "_slice"), W.partitionBy(key)

    def mean(over) -> Column:
        return F.try_divide(F.sum("_s").over(over), F.sum("_c").over(over).cast("double"))

    def apart(part: Column, other: Column) -> Column:
        """Squared distance of two means, for every value of the part."""
        return F.coalesce(F.col("_c") * F.pow(part - other, F.lit(2)), F.lit(0.0))

    merged = {"_ids": F.sum("_ids"), "_c": F.sum("_c"), "_s": F.sum("_s"), "_m2": F.sum(F.coalesce("_m2", F.lit(0.0)) + F.col("_apart"))}
    # Only the first event time of an hour has none before it; the hour's last time and mean are known to all its states.
    known, opens = F.col(ts).isNotNull(), F.col("_previous").isNull()
    placed = state.withColumns({"_mean": mean(hour), "_end": F.max(ts).over(hour)})
    placed = placed.withColumn("_apart", apart(F.try_divide("_s", F.col("_c").cast("double")), F.col("_mean")))
    hours = placed.groupBy(key, "_slice", _col(category).alias("_kind")).agg(
        F.min(F.when(opens, _col(ts))).alias("_first"), F.max("_end").alias("_last"), F.sum(F.when(known, F.col("n_events"))).alias("_n"),
        F.sum(whole_days(ts, "_previous")).alias("_days"), F.max("_mean").alias("_mean"), *[c.alias(name) for name, c in merged.items()],
    )
    # Rows without a time are a part of their own, first in the order, with no last time to carry.
    earlier = whole.orderBy("_slice").rangeBetween(W.unboundedPreceding, -1)
    carried = hours.withColumns({"_carry": F.max("_last").over(earlier), "_apart": apart(F.col("_mean"), mean(whole))})
    opens_month = F.col("_first").isNotNull() & (F.col("_carry").isNull() | (month_of("_first") != month_of("_carry")))
    gaps = F.coalesce(F.sum(whole_days("_first", "_carry")), F.lit(0)) + F.coalesce(F.sum("_days"), F.lit(0))
    rolled = carried.groupBy(key).agg(
        F.min("_first").alias("first_txn_dt"), F.max("_last").alias("last_txn_dt"), F.sum("_n").alias("_n"), gaps.alias("_gaps"),
        F.count_if(opens_month).alias("_months"), F.count_distinct("_kind").alias("_kinds"), *[c.alias(name) for name, c in merged.items()],
    )
    dated = F.col("_n").isNotNull()
    return rolled.select(
        key, F.col("_ids").alias("txn_count"), F.coalesce("_s", F.lit(0.0)).alias("amount_sum"), F.try_divide("_s", "_c").alias("amount_mean"),
        F.sqrt(F.try_divide("_m2", F.when(F.col("_c") > 1, F.col("_c") - 1).cast("double"))).alias("amount_std"), "first_txn_dt", "last_txn_dt",
        F.col("_kinds").alias("product_cat_nunique"), recency_days("last_txn_dt", snapshot).alias("tx_recency_days"),
        F.when(dated, F.try_divide(F.col("_gaps").cast("double"), F.col("_n") - 1)).alias("tx_avg_gap_days"), F.when(dated, F.col("_months")).alias("active_months"),
    )


def active_months(tx: DataFrame, key: str = KEY, ts: str = "TransactionDate") -> DataFrame:
    return timeline_profile(tx, key, ts).select(key, "active_months")


def service_profile(svc: DataFrame, snapshot: datetime | Column, key: str = KEY, id: str = "InteractionID",
                    ts: str = "InteractionDate", kind: str = "InteractionType",
                    status: str = "ResolutionStatus") -> DataFrame:
    """Service contacts per customer; an unknown status counts as unresolved."""
    rolled = svc.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(id).alias("cs_count"),
        F.count_distinct(kind).alias("cs_types_nunique"),
        F.max(ts).alias("last_cs_dt"),
        F.count_if(ine_or_null(status, "resolved")).alias("unresolved_count"),
        F.count_if(ieq(kind, "complaint")).alias("complaint_count"),
    )
    return rolled.withColumn("cs_recency_days", recency_days("last_cs_dt", snapshot))


def online_profile(online: DataFrame, snapshot: datetime | Column, ts: str = "LastLoginDate") -> DataFrame:
    if ts not in online.columns:
        return online
    return online.withColumn("lastlogin_recency_days", recency_days(ts, snapshot))


def since(df: DataFrame, ts: str, cut: datetime) -> DataFrame:
    """Rows at or after ``cut``; the literal bound reaches the scan."""
    return df.filter(F.col(ts) >= ntz(cut))


def trailing_features(df: DataFrame, measures: Mapping[str, tuple[int, Column | None]], snapshot: datetime,
                      key: str = KEY, ts: str = "TransactionDate", distinct_rows: bool = True) -> DataFrame:
    """Per-customer measures over the days before ``snapshot``, all in one aggregate.

    ``measures`` maps a name to (days, column): the column is summed, None counts
    rows, a boolean column counts its true rows. Windows have an inclusive lower
    bound and no upper one. Rows outside the longest window are cut off in the scan, so
    removing exact copies (``distinct_rows``) touches recent rows only. Customers
    without a recent row are absent.
    """
    longest = max(days for days, _ in measures.values())
    recent = since(df.filter(F.col(key).isNotNull()), ts, snapshot - timedelta(days=longest))
    if distinct_rows:
        recent = recent.dropDuplicates()

    flags = {name: f"_flag_{name}" for name, (_, column) in measures.items() if column is not None}
    recent = recent.withColumns({flags[n]: c for n, (_, c) in measures.items() if c is not None})

    def measure(name: str, days: int) -> Column:
        inside = F.col(ts) >= ntz(snapshot - timedelta(days=days))
        if name not in flags:
            return F.count_if(inside)
        if recent.schema[flags[name]].dataType.typeName() == "boolean":
            return F.count_if(inside & F.col(flags[name]))
        return total(F.when(inside, F.col(flags[name])))

    return recent.groupBy(key).agg(*[measure(n, days).alias(n) for n, (days, _) in measures.items()])


def trailing_transactions(tx: DataFrame, snapshot: datetime, key: str = KEY, ts: str = "TransactionDate",
                          amount: str = "AmountSpent") -> DataFrame:
    spent = F.col(amount)
    measures = {"tx_30": (30, None), "tx_60": (60, None), "tx_90": (90, None), "amt_30": (30, spent), "amt_90": (90, spent)}
    return trailing_features(tx, measures, snapshot, key, ts)


def trailing_interactions(svc: DataFrame, snapshot: datetime, key: str = KEY, ts: str = "InteractionDate",
                          kind: str = "InteractionType", status: str = "ResolutionStatus") -> DataFrame:
    measures = {
        "complaints_90d": (90, ieq(kind, "complaint")),
        "unresolved_90d": (90, ine_or_null(status, "resolved")),
    }
    return trailing_features(svc, measures, snapshot, key, ts)


def weekly_counts(df: DataFrame, ts: str, average: int = 4) -> DataFrame:
    """Events per observed week (Monday start) with the mean over the last ``average`` weeks."""
    weekly = df.filter(F.col(ts).isNotNull()).groupBy(week_of(ts).alias("week")).agg(F.count(F.lit(1)).alias("n_events"))
    return moving_average(weekly, "week", "n_events", average, "moving_mean")
