"""Order-dependent operators that stay parallel when one group holds most rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. The operators
below cut the order into slices first, work inside each slice in parallel and
carry a small total from slice to slice:

* events of a key are sliced by time unit (``instants``, ``event_gaps``,
  ``timeline_profile``), so the carry has one row per key and time unit;
* values that are totalled and rows that are numbered are placed by range (``running_totals``,
  ``event_number``), so the carry has one row per group and partition.

The cuts decide only where work is done; results are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.functions import month_of, whole_days
from retentia.functions.columns import _col
from retentia.sources.sink import stage
from retentia.sources.tables import KEY


def _time_slice(ts: str, hours: int):
    """Number of the slice of ``hours`` hours that holds a time; grows with the time."""
    hour = F.unix_date(F.col(ts).cast("date")) * 24 + F.hour(ts)
    return F.floor(hour / hours)


def instants(df: DataFrame, key: str = KEY, ts: str = "TransactionDate", slice_hours: int = 1) -> DataFrame:
    """Distinct event times per key with their number of events and, inside a slice, the time before.

    Copies of one event time collapse map-side, before anything is shuffled.
    """
    return event_times(df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()), key, ts, {}, slice_hours)


def event_times(df: DataFrame, key: str, ts: str, measures: Mapping[str, Column], slice_hours: int = 1,
                by: Sequence[str] = ()) -> DataFrame:
    """``instants`` with more aggregates per event time; rows without a time are one with neither slice nor time.

    With ``by`` an event time has a row for each value of these columns, and the time before may be the same one.
    """
    counted = df.groupBy(key, _time_slice(ts, slice_hours).alias("_slice"), ts, *[_col(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n_events"), *[c.alias(name) for name, c in measures.items()]
    )
    previous = F.lag(ts).over(W.partitionBy(key, "_slice").orderBy(ts))
    return counted.withColumn("_previous", previous)


def _slice_summary(inst: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key and slice with the gap to the slice before it."""
    per_slice = inst.groupBy(key, "_slice").agg(
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        F.sum("n_events").alias("_n"),
        F.sum(whole_days(ts, "_previous")).alias("_days"),
    )
    order = W.partitionBy(key).orderBy("_slice")
    return per_slice.withColumn("_carry", F.lag("_last").over(order))


def event_gaps(df: DataFrame, key: str = KEY, ts: str = "TransactionDate", slice_hours: int = 1) -> DataFrame:
    """Whole days from each event time of a key to the one before.

    One row per key and distinct time. ``gap_days`` is NULL for the first; the
    ``n_events - 1`` further events at the same time have a gap of 0 each.
    """
    inst = instants(df, key, ts, slice_hours)
    carry = _slice_summary(inst, key, ts).select(key, "_slice", "_carry")
    previous = F.coalesce("_previous", "_carry")
    return inst.join(carry, [key, "_slice"]).select(key, ts, whole_days(ts, previous).alias("gap_days"), "n_events")


def gap_counts(gaps: DataFrame) -> DataFrame:
    """Distribution of the gaps of ``event_gaps``: gap length and number of gaps."""
    pairs = F.array(
        F.struct(F.col("gap_days").alias("gap_days"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit(0).cast("bigint").alias("gap_days"), (F.col("n_events") - 1).alias("n")),
    )
    return (
        gaps.select(F.explode(pairs).alias("g"))
        .select("g.gap_days", "g.n")
        .filter("gap_days IS NOT NULL AND n > 0")
        .groupBy("gap_days")
        .agg(F.sum("n").alias("n_gaps"))
    )


def timeline_profile(df: DataFrame, key: str = KEY, ts: str = "TransactionDate", slice_hours: int = 1) -> DataFrame:
    """Mean gap in days and number of active months per key.

    Both come from one pass over the time slices of a key: gaps inside slices are
    summed beforehand, and a month is counted when a slice opens a new one.
    """
    slices = _slice_summary(instants(df, key, ts, slice_hours), key, ts)
    across = F.sum(whole_days("_first", "_carry"))
    within = F.coalesce(F.sum("_days"), F.lit(0))
    opens_month = F.col("_carry").isNull() | (month_of("_first") != month_of("_carry"))
    return slices.groupBy(key).agg(
        F.try_divide((F.coalesce(across, F.lit(0)) + within).cast("double"), F.sum("_n") - 1).alias("tx_avg_gap_days"),
        F.count_if(opens_month).alias("active_months"),
    )


def event_number(df: DataFrame, key: str = KEY, ts: str = "TransactionDate",
                 tie: str | Sequence[str] = "TransactionID", out: str = "event_no") -> DataFrame:
    """Number the events of each key from 1 in time order, missing times last.

    ``tie`` names the columns that order events at the same time. Remove exact copies
    before: rows that tie in everything cannot be placed apart.

    Rows are placed by range over key, time and tie, so a key with many events spans
    several partitions. The placement is staged, for a repeated sampling of the bounds
    could place rows differently. Only the first key of a partition can continue from
    the one before it, which bounds the carry by the number of partitions.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    order = [_col(c).asc_nulls_last() for c in (ts, *ties)]
    placed = stage(df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        placed.filter(F.col(key).isNotNull())
        .groupBy(key, "_part")
        .count()
        .withColumn("_carry", F.sum("count").over(before))
        .filter("_carry IS NOT NULL")
        .select(key, "_part", "_carry")
    )
    local = F.row_number().over(W.partitionBy("_part", key).orderBy(*order))
    number = F.when(F.col(key).isNotNull(), F.col("_local") + F.coalesce("_carry", F.lit(0)))
    return (
        placed.withColumn("_local", local.cast("bigint"))
        .join(carry, [key, "_part"], "left")
        .select(*[_col(c) for c in df.columns], number.alias(out))
    )


def running_totals(df: DataFrame, value: str, weights: Iterable[str], groups: Iterable[str] = ()) -> DataFrame:
    """Totals of ``weights`` below each value, and over all values, within each group.

    ``df`` has one row per group and value. Adds ``<w>_below`` and ``<w>_total``. Rows are placed by range
    over group and value and stored, since sampling the bounds again could place them differently.
    Each partition of a group is totalled, the totals are summed from partition to partition (one row
    per group and partition), and rows add what lies below them in their own partition.
    """
    weights, groups = list(weights), list(groups)
    placed = stage(df.repartitionByRange(*[_col(g) for g in groups], _col(value)).withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(*groups, "_part").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    carry = parts.select(
        *groups,
        "_part",
        *[F.coalesce(F.sum(f"_{w}").over(before), F.lit(0)).alias(f"_{w}_base") for w in weights],
        *[F.sum(f"_{w}").over(W.partitionBy(*groups)).alias(f"{w}_total") for w in weights],
    )
    inside = W.partitionBy(*groups, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = {f"{w}_below": F.col(f"_{w}_base") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}
    joined = placed.join(carry, [*groups, "_part"])
    return joined.withColumns(below).drop("_part", *[f"_{w}_base" for w in weights])


def moving_average(df: DataFrame, order: str, col: str, n: int = 4, out: str | None = None) -> DataFrame:
    """Mean over the current and the ``n - 1`` rows before; NULL until ``n`` rows exist.

    For series with one row per period: the window has no partition key, and its
    single task sees as many rows as there are periods.
    """
    frame = W.orderBy(order).rowsBetween(1 - n, 0)
    full = F.count(F.lit(1)).over(frame) == n
    return df.withColumn(out or f"{col}_ma{n}", F.when(full, F.avg(col).over(frame)))
