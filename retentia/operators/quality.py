"""Data-quality checks. Each returns a small report table, one pass per table read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions import ntz
from retentia.functions.columns import _col
from retentia.sources.tables import KEY


class IntegrityError(AssertionError):
    """A conservation or uniqueness check failed."""


def missing_share(df: DataFrame, top: int | None = None) -> DataFrame:
    """Share of missing values per column, largest first."""
    shares = df.agg(*[F.avg(_col(c).isNull().cast("double")).alias(c) for c in df.columns])
    long = shares.unpivot([], [f"`{c}`" for c in df.columns], "column_name", "missing_share")
    ordered = long.orderBy(F.col("missing_share").desc(), "column_name")
    return ordered.limit(top) if top else ordered


def duplicate_count(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows beyond the first per key; missing keys are equal to one another."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    extra = F.coalesce(F.sum(F.col("count") - 1), F.lit(0))
    return df.groupBy(*[_col(k) for k in keys]).count().agg(extra.alias("n_duplicates"))


def dedupe_report(df: DataFrame) -> DataFrame:
    """Rows before and after removing exact copies, from one aggregate."""
    copies = df.groupBy(*[_col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    before = F.coalesce(F.sum("_copies"), F.lit(0))
    after = F.count(F.lit(1))
    return copies.agg(before.alias("rows_before"), after.alias("rows_after"), (before - after).alias("rows_removed"))


def fan_out(df: DataFrame, key: str = KEY) -> DataFrame:
    """Mean and largest number of rows per key (missing keys left out)."""
    rows = df.filter(_col(key).isNotNull()).groupBy(_col(key)).count()
    return rows.agg(F.avg("count").alias("mean_rows"), F.max("count").alias("max_rows"))


def value_counts(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Rows per combination of values, missing included, most frequent first."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    names = [_col(c) for c in cols]
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *names)


def valid_counts(df: DataFrame, group: str, col: str) -> DataFrame:
    """Non-missing values per group."""
    return df.filter(_col(group).isNotNull()).groupBy(_col(group)).agg(F.count(_col(col)).alias("n_valid"))


def global_stats(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row of named aggregates: ``{"x": ["mean", "sum", "max"]}`` gives x_mean, x_sum, x_max.

    Quantiles and medians have their own exact operator, ``exact_quantiles``.
    """
    known = {"mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "max": F.max, "min": F.min, "count": F.count}
    return df.agg(*[known[how](_col(c)).alias(f"{c}_{how}") for c, hows in spec.items() for how in hows])


def table_report(
    tables: Mapping[str, DataFrame],
    as_of: datetime | None = None,
    key: str = KEY,
    amounts: Mapping[str, str] | None = None,
    times: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per table: shape, distinct keys, non-positive amounts, events dated after ``as_of`` (default: now).

    ``amounts`` and ``times`` name the amount and the time column of the tables that have one.
    """
    amounts = {"tx": "AmountSpent"} if amounts is None else amounts
    times = {"tx": "TransactionDate", "svc": "InteractionDate"} if times is None else times
    none = F.lit(None).cast("bigint")
    now = F.localtimestamp() if as_of is None else ntz(as_of)

    def describe(name: str, df: DataFrame) -> DataFrame:
        nonpositive = F.count_if(_col(amounts[name]) <= 0) if name in amounts else none
        future = F.count_if(_col(times[name]) > now) if name in times else none
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(_col(key)).alias("n_keys"),
            nonpositive.alias("n_nonpositive"),
            future.alias("n_future"),
        ).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_keys",
                 "n_nonpositive", "n_future")

    return reduce(DataFrame.unionByName, [describe(n, df) for n, df in tables.items()])


def integrity_report(features: DataFrame, tx: DataFrame, svc: DataFrame, expected: int | None = None,
                     key: str = KEY) -> DataFrame:
    """One row per customer, and event counts conserved by the roll-ups."""
    seen = features.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(_col(key)).alias("n_keys"),
        F.coalesce(F.sum("txn_count"), F.lit(0)).cast("bigint").alias("n_tx"),
        F.coalesce(F.sum("cs_count"), F.lit(0)).cast("bigint").alias("n_svc"),
    )
    checks = [
        ("one_row_per_customer", F.col("n_keys"), F.col("n_rows")),
        ("transactions_conserved", F.col("tx_rows"), F.col("n_tx")),
        ("interactions_conserved", F.col("svc_rows"), F.col("n_svc")),
    ]
    if expected is not None:
        checks.append(("expected_customers", F.lit(expected).cast("bigint"), F.col("n_rows")))
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), want.alias("expected"), got.alias("actual")) for name, want, got in checks
    ])
    counts = seen.withColumns({"tx_rows": tx.agg(F.count(F.lit(1))).scalar(), "svc_rows": svc.agg(F.count(F.lit(1))).scalar()})
    return counts.select(F.inline(rows)).withColumn("ok", F.col("expected") == F.col("actual"))


def enforce(report: DataFrame) -> None:
    """Raise if a check of ``integrity_report`` failed; runs a job."""
    failed = report.filter(~F.col("ok")).collect()
    if failed:
        raise IntegrityError("; ".join(f"{r['check_name']}: expected {r['expected']}, got {r['actual']}" for r in failed))
