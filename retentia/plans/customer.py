"""The plans: raw tables -> customer features -> model frame -> one matrix per model family."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions import is_missing
from retentia.functions.columns import _col
from retentia.operators.joins import assert_unique_keys, join_one_to_one
from retentia.operators.prepare import (
    AMOUNT_COLUMNS,
    NON_FEATURES,
    WINDOW_COLUMNS,
    activity_flags,
    cap_at,
    collapse_duplicate_columns,
    columns_of_type,
    coverage_flags,
    fill_counts,
    fill_recency,
    fill_std_zero,
    fill_with,
    final_fill,
    narrow_levels,
    log1p_features,
    missing_flags,
    one_hot,
    spend_ratio,
)
from retentia.operators.quantiles import column_quantiles
from retentia.operators.rollup import (
    online_profile,
    service_profile,
    snapshot_date,
    trailing_interactions,
    trailing_transactions,
    transaction_profile,
)
from retentia.sources.sink import stage_by_key
from retentia.sources.tables import KEY

CHANNEL = "ServiceUsage"


# Time column of each table that has one.
EVENT_TIMES = {"tx": "TransactionDate", "svc": "InteractionDate", "online": "LastLoginDate"}


#: Snapshot of tables without a single event time.
NO_EVENTS = datetime(1970, 1, 1)


def event_times(tables: Mapping[str, DataFrame]) -> list[tuple[DataFrame, str]]:
    return [(tables[t], c) for t, c in EVENT_TIMES.items() if t in tables and c in tables[t].columns]


def snapshot_of(tables: Mapping[str, DataFrame]) -> datetime:
    """Latest time seen in the event tables; runs a job unless the caller has a cutoff of its own.

    Without any event there is nothing to measure from: ``NO_EVENTS``, and every feature has its default.
    """
    return snapshot_date(event_times(tables)) or NO_EVENTS


def join_customers(tables: Mapping[str, DataFrame], snapshot: datetime, labelled: bool = True,
                   validate: bool = True) -> DataFrame:
    """One row per customer with label, online state and both event roll-ups.

    ``labelled`` keeps customers with a label only; otherwise all of them, with a
    missing label. The given tables are checked for one row per customer; the
    roll-ups have one by construction. Every join is on the customer key.
    """
    how = "inner" if labelled else "left"
    if validate:
        assert_unique_keys({name: tables[name] for name in ("demo", "churn", "online")}, KEY)
    out = join_one_to_one(tables["demo"], tables["churn"], KEY, how, validate=False)
    out = join_one_to_one(out, online_profile(tables["online"], snapshot), KEY, "left", validate=False)
    for rolled in (transaction_profile(tables["tx"], snapshot), service_profile(tables["svc"], snapshot)):
        out = join_one_to_one(out, rolled, KEY, "left", validate=False)
    return out


def customer_features(tables: Mapping[str, DataFrame], snapshot: datetime, validate: bool = True) -> DataFrame:
    """Feature row of every labelled customer, with coverage flags, counts and recencies filled.

    The joined table is staged in buckets of the customer: the fills need its maxima, the roll-ups below
    it read all events, and what is joined later meets it without an exchange.
    """
    joined = stage_by_key(join_customers(tables, snapshot, True, validate), KEY)
    return fill_recency(fill_counts(coverage_flags(joined)))


def model_frame(features: DataFrame, tables: Mapping[str, DataFrame], snapshot: datetime) -> DataFrame:
    """Flags, caps, logs, channel dummies and recent-window features on top of ``customer_features``.

    The order of the steps is part of the result: flags are taken after the counts
    and recencies were filled, the spend ratio uses the capped sum, and the login flag the
    filled recency. Exact copies of events are removed for the windows only. A channel with more levels
    than ``one_hot`` takes stays a text column.
    """
    wanted = {c: 0.99 for c in AMOUNT_COLUMNS} | {"tx_avg_gap_days": 0.5}
    found = column_quantiles(features, {c: q for c, q in wanted.items() if c in features.columns})
    gap = {c: v for c, v in found.items() if c == "tx_avg_gap_days"}

    out = missing_flags(features)
    out = log1p_features(cap_at(out, {c: v for c, v in found.items() if c not in gap}))
    if CHANNEL in out.columns and (levels := narrow_levels(features, [CHANNEL])):
        out = one_hot(out.withColumn("_channel", F.col(CHANNEL)), ["_channel"], "channel", levels={"_channel": levels[CHANNEL]})
    out = out.withColumns({f"{c}_missing": is_missing(c) for c in ("tx_avg_gap_days", "amount_std")})
    out = fill_with(fill_std_zero(out), gap)
    for recent in (trailing_transactions(tables["tx"], snapshot), trailing_interactions(tables["svc"], snapshot)):
        out = join_one_to_one(out, recent, KEY, "left", validate=False)
    return spend_ratio(activity_flags(out))


def _channel_dummies(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.startswith("channel_")]


def _text_features(frame: DataFrame) -> list[str]:
    return [c for c in columns_of_type(frame, include=["string"]) if c not in NON_FEATURES]


def linear_matrix(frame: DataFrame) -> DataFrame:
    """Key, label and the numeric features known before the window features were added."""
    later = {*WINDOW_COLUMNS, "no_tx_90d", "no_login_90d", "complained_90d", "avg_spend_per_tx", *_channel_dummies(frame)}
    numeric = [c for c in columns_of_type(frame, include=["number"]) if c not in later and c not in NON_FEATURES]
    return final_fill(frame.select(KEY, "ChurnStatus", *[_col(c) for c in numeric]))


def forest_matrix(frame: DataFrame) -> DataFrame:
    """Key, label and all features, text ones as 0/1 columns; those with too many levels for that stay text."""
    dates = [c for c in NON_FEATURES if c not in (KEY, "ChurnStatus")]
    done = [CHANNEL] if _channel_dummies(frame) else []
    texts = [c for c in _text_features(frame) if c not in done]
    levels = narrow_levels(frame, texts)
    wide = one_hot(frame.drop(*dates, *done), list(levels), levels=levels)
    return final_fill(collapse_duplicate_columns(wide))


def boosted_matrix(frame: DataFrame) -> tuple[DataFrame, list[str]]:
    """Key, label and all features with text columns left whole, and the names of these."""
    dates = [c for c in NON_FEATURES if c not in (KEY, "ChurnStatus")]
    return final_fill(frame.drop(*dates, *_channel_dummies(frame))), _text_features(frame)
