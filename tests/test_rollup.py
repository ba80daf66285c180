import random
import statistics
from datetime import timedelta

import pytest

from retentia.functions import ntz
from retentia.operators import rollup
from tests.conftest import SVC_SCHEMA, TX_SCHEMA, at, by_key

SNAP = at("2024-03-31 12:00:00")


def test_snapshot_is_the_latest_known_time(spark, tx, svc):
    assert rollup.snapshot_date([(tx, "TransactionDate"), (svc, "InteractionDate")]) == at("2024-03-26")
    empty = spark.createDataFrame([], TX_SCHEMA)
    assert rollup.snapshot_date([(empty, "TransactionDate"), (svc, "InteractionDate")]) == at("2024-03-26")
    assert rollup.snapshot_date([(empty, "TransactionDate")]) is None


def test_a_table_is_searched_after_the_latest_time_before_it_only(spark, tx, svc, monkeypatch):
    bounds = []
    monkeypatch.setattr(rollup, "ntz", lambda when: bounds.append(when) or ntz(when))
    empty = spark.createDataFrame([], TX_SCHEMA)
    assert rollup.snapshot_date([(svc, "InteractionDate"), (empty, "TransactionDate"), (tx, "TransactionDate")]) == at("2024-03-26")
    assert bounds == [at("2024-03-26")] * 2, "what is not later is not read again"
    days = spark.createDataFrame([(at("2024-05-01").date(),)], "d date")
    assert rollup.snapshot_date([(tx, "TransactionDate"), (days, "d")]) == at("2024-05-01"), "other kinds of time"


def test_transaction_profile(tx):
    got = by_key(rollup.transaction_profile(tx, SNAP))
    assert set(got) == {"a", "b", "c", "d", "e"}, "a missing customer is no group"
    a, b, c, e = (got[k] for k in "abce")
    assert (a["txn_count"], a["amount_sum"], a["amount_mean"], a["product_cat_nunique"]) == (4, 100.0, 25.0, 2)
    assert a["amount_std"] == pytest.approx((500 / 3) ** 0.5)
    assert (a["first_txn_dt"], a["last_txn_dt"], a["tx_recency_days"]) == (at("2024-01-01"), at("2024-01-31"), 60)
    assert (b["amount_sum"], b["amount_mean"], b["amount_std"]) == (0.0, None, None), "no amount known sums to 0"
    assert (b["tx_avg_gap_days"], b["active_months"]) == (10.0, 1)
    assert (c["amount_std"], c["tx_avg_gap_days"]) == (None, None), "one transaction has neither spread nor gap"
    assert e["txn_count"] == 2, "exact copies count here"


def test_service_profile(svc):
    got = by_key(rollup.service_profile(svc, SNAP))
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["cs_count"], a["cs_types_nunique"], a["unresolved_count"], a["complaint_count"], a["cs_recency_days"]) == (2, 3, 2, 3, 5)
    assert (b["cs_count"], b["cs_types_nunique"], b["unresolved_count"], b["complaint_count"]) == (2, 1, 2, 0)


def test_windows_start_inclusive_and_ignore_exact_copies(spark, tx, svc):
    snap = at("2024-03-31")
    got = by_key(rollup.trailing_transactions(tx, snap))
    assert got["b"]["tx_30"] == 2 and got["b"]["amt_30"] == 0.0, "a row on the bound is inside"
    assert (got["e"]["tx_30"], got["e"]["amt_30"]) == (1, 4.0)
    assert (got["a"]["tx_30"], got["a"]["tx_60"], got["a"]["tx_90"]) == (0, 2, 3), "the row without a date is outside"
    late = spark.createDataFrame([("z", 1, at("2025-01-01"), 1.0, "A")], TX_SCHEMA)
    assert by_key(rollup.trailing_transactions(late, snap))["z"]["tx_30"] == 1, "there is no upper bound"
    recent = by_key(rollup.trailing_interactions(svc, snap))
    assert (recent["a"]["complaints_90d"], recent["a"]["unresolved_90d"]) == (2, 1)
    assert (recent["b"]["complaints_90d"], recent["b"]["unresolved_90d"]) == (0, 1)


def test_window_filter_reaches_the_scan(spark, tmp_path, tx):
    tx.write.parquet(str(tmp_path / "tx"))
    plan = rollup.trailing_transactions(spark.read.parquet(str(tmp_path / "tx")), SNAP)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(TransactionDate" in plan


def test_weeks_are_observed_weeks(spark):
    rows = [("a", 1, at(t), 1.0, "A") for t in ("2024-03-10", "2024-03-11", "2024-03-12", "2024-03-25", "2024-04-02")]
    rows.append(("a", 1, None, 1.0, "A"))
    got = {r["week"]: (r["n_events"], r["moving_mean"]) for r in rollup.weekly_counts(spark.createDataFrame(rows, TX_SCHEMA), "TransactionDate").collect()}
    assert got == {
        at("2024-03-04"): (1, None), at("2024-03-11"): (2, None), at("2024-03-25"): (1, None), at("2024-04-01"): (1, 1.25),
    }


def test_empty_event_tables(spark):
    tx, svc = spark.createDataFrame([], TX_SCHEMA), spark.createDataFrame([], SVC_SCHEMA)
    for df in (
        rollup.transaction_profile(tx, SNAP), rollup.service_profile(svc, SNAP), rollup.trailing_transactions(tx, SNAP),
        rollup.weekly_counts(tx, "TransactionDate"), rollup.active_months(tx),
    ):
        assert df.count() == 0


def test_profile_does_not_depend_on_partitions(tx):
    want = by_key(rollup.transaction_profile(tx, SNAP))
    for n in (1, 7):
        assert by_key(rollup.transaction_profile(tx.repartition(n), SNAP)) == want


def test_events_are_read_once_and_aggregated_before_the_shuffle(spark, tx):
    plan = rollup.transaction_profile(tx, SNAP)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(AmountSpent" in plan and plan.count("Scan ExistingRDD") == 1


def test_merged_states_equal_plain_aggregates(spark):
    """Many hours, clock times, missing times, amounts and categories; amounts far from 0, whose squares would cancel."""
    draw = random.Random(5)
    rows = []
    for i in range(4000):
        ts = None if draw.random() < 0.05 else at("2024-01-01") + timedelta(minutes=draw.randrange(60 * 24 * 120))
        rows.append((draw.choice("abc") if draw.random() < 0.9 else "d", i, ts, None if draw.random() < 0.1 else 1e9 + draw.gauss(0, 3), draw.choice(["x", "y", "z", None])))
    rows += [("e", 1, None, 5.0, "x"), ("e", 2, None, 7.0, None), ("f", 3, at("2024-02-01"), None, None)]
    got = by_key(rollup.transaction_profile(spark.createDataFrame(rows, TX_SCHEMA), SNAP))
    for key in "abcdef":
        own = [r for r in rows if r[0] == key]
        amounts = [r[3] for r in own if r[3] is not None]
        times = sorted(r[2] for r in own if r[2] is not None)
        r = got[key]
        assert r["txn_count"] == len(own) and r["product_cat_nunique"] == len({x[4] for x in own} - {None})
        assert r["amount_sum"] == pytest.approx(sum(amounts), rel=1e-12)
        assert r["amount_mean"] == (pytest.approx(statistics.fmean(amounts), rel=1e-12) if amounts else None)
        assert r["amount_std"] == (pytest.approx(statistics.stdev(amounts), rel=1e-7) if len(amounts) > 1 else None)
        assert (r["first_txn_dt"], r["last_txn_dt"]) == ((times[0], times[-1]) if times else (None, None))
        gaps = [(b - a) // timedelta(days=1) for a, b in zip(times, times[1:])]
        assert r["tx_avg_gap_days"] == (pytest.approx(sum(gaps) / len(gaps)) if gaps else None)
        assert r["active_months"] == (len({(t.year, t.month) for t in times}) or None)


def test_raw_transactions_are_counted_without_object_states(spark, tx):
    """The first aggregate has plain states only; categories are collected from an hour's states."""
    plan = rollup.transaction_profile(tx, SNAP)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Aggregate("):]
    assert "count(" in first and "collect_set" not in first
    rows = [("a", 1, at("2024-01-01"), 1.0, "A"), ("a", 2, at("2024-01-01"), 3.0, "B"), ("a", 3, at("2024-01-01"), None, "B"), ("a", 4, at("2024-01-03"), 8.0, None), ("a", 5, None, 4.0, "C")]
    got = by_key(rollup.transaction_profile(spark.createDataFrame(rows, TX_SCHEMA), SNAP))["a"]
    assert (got["txn_count"], got["product_cat_nunique"], got["amount_sum"], got["active_months"]) == (5, 3, 16.0, 1)
    assert got["tx_avg_gap_days"] == pytest.approx(2 / 3) and got["amount_std"] == pytest.approx(statistics.stdev([1, 3, 8, 4]))


def test_no_set_is_built_for_an_hour(spark, tx):
    """Sets as states of millions of hours would be sorted for every merge; categories are grouped instead."""
    profile = rollup.transaction_profile(tx, SNAP)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_" not in plan
    assert profile.schema["product_cat_nunique"].dataType.typeName() == "long"
    # Two categories at the time an hour opens with, one of them again later; gaps and months are those of the hours.
    rows = [("a", 1, at("2024-01-31 10:00"), 1.0, "A"), ("a", 2, at("2024-01-31 10:00"), 2.0, "B"), ("a", 3, at("2024-01-31 10:30"), 4.0, "A"),
            ("a", 4, at("2024-02-03 10:00"), 8.0, "B"), ("a", 5, at("2024-02-03 10:00"), 16.0, "A"), ("a", 6, at("2024-02-03 10:20"), 32.0, None), ("a", 7, None, 64.0, "C")]
    got = by_key(rollup.transaction_profile(spark.createDataFrame(rows, TX_SCHEMA), SNAP))["a"]
    assert (got["txn_count"], got["product_cat_nunique"], got["amount_sum"], got["active_months"]) == (7, 3, 127.0, 2)
    assert got["tx_avg_gap_days"] == pytest.approx(2 / 5) and got["amount_std"] == pytest.approx(statistics.stdev([1, 2, 4, 8, 16, 32, 64]))
    assert (got["first_txn_dt"], got["last_txn_dt"]) == (at("2024-01-31 10:00"), at("2024-02-03 10:20"))
