from collections import defaultdict
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.operators import ordered
from retentia.sources import stage
from tests.conftest import by_key

BASE = datetime(2024, 1, 1)
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

times = st.one_of(st.none(), st.integers(0, 200 * 24 * 60))
event_rows = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]), times), min_size=1, max_size=60)


def events(spark, rows):
    data = [(k, i, None if m is None else BASE + timedelta(minutes=m)) for i, (k, m) in enumerate(rows)]
    return data, spark.createDataFrame(data, "CustomerID string, TransactionID int, TransactionDate timestamp_ntz").repartition(5)


def gaps_by_hand(data):
    seen = defaultdict(list)
    for key, _, t in data:
        if key is not None and t is not None:
            seen[key].append(t)
    return {k: [(b - a) // timedelta(days=1) for a, b in zip(sorted(v), sorted(v)[1:])] for k, v in seen.items()}, seen


@SLOW
@given(event_rows)
def test_timeline_matches_brute_force(spark, rows):
    data, df = events(spark, rows)
    gaps, seen = gaps_by_hand(data)
    got = by_key(ordered.timeline_profile(df))
    assert set(got) == set(gaps)
    for key, want in gaps.items():
        mean = got[key]["tx_avg_gap_days"]
        assert (mean is None) if not want else abs(mean - sum(want) / len(want)) < 1e-9
        assert got[key]["active_months"] == len({(t.year, t.month) for t in seen[key]})


@SLOW
@given(event_rows, st.sampled_from([1, 24, 24 * 365]))
def test_gaps_do_not_depend_on_the_slices(spark, rows, hours):
    data, df = events(spark, rows)
    gaps, _ = gaps_by_hand(data)
    want = defaultdict(int)
    for gap in (g for v in gaps.values() for g in v):
        want[gap] += 1
    got = ordered.gap_counts(ordered.event_gaps(df, slice_hours=hours))
    assert {r["gap_days"]: r["n_gaps"] for r in got.collect()} == dict(want)


@SLOW
@given(event_rows)
def test_event_numbers_match_brute_force(spark, rows):
    data, df = events(spark, rows)
    want, count = {}, defaultdict(int)
    for key, i, t in sorted(data, key=lambda r: (r[2] is None, r[2] or BASE, r[1])):
        count[key] += 1
        want[i] = None if key is None else count[key]
    got = {r["TransactionID"]: r["event_no"] for r in ordered.event_number(df).collect()}
    assert got == want


def test_one_customer_spans_partitions(spark):
    """A customer with nearly all rows is placed on several partitions and still numbered without a gap."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).otherwise("hot").alias("CustomerID"),
        F.col("id").alias("TransactionID"),
        F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.col("id") * 40).cast("timestamp_ntz")).alias("TransactionDate"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = stage(ordered.event_number(df))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = numbered.filter("CustomerID = 'hot'").agg(F.count("*").alias("n"), F.max("event_no").alias("top"), F.count_distinct("event_no").alias("d")).first()
    assert hot["n"] == hot["top"] == hot["d"] == 19600
    assert numbered.filter("CustomerID <> 'hot' AND event_no <> 1").isEmpty()


def test_copies_of_one_event_time_collapse_before_the_shuffle(spark):
    """The first exchange carries one row per event time and task, not one per copy."""
    df = spark.range(1000).select(F.lit("hot").alias("CustomerID"), F.lit(BASE).cast("timestamp_ntz").alias("TransactionDate"))
    rows = ordered.event_gaps(df).collect()
    assert [(r["n_events"], r["gap_days"]) for r in rows] == [(1000, None)]
    assert [tuple(r) for r in ordered.gap_counts(ordered.event_gaps(df)).collect()] == [(0, 999)]


@SLOW
@given(st.lists(st.tuples(st.sampled_from("gh"), st.integers(-20, 20), st.integers(0, 5)), min_size=1, max_size=60))
def test_running_totals_match_brute_force(spark, rows):
    merged = defaultdict(int)
    for g, v, w in rows:
        merged[g, float(v)] += w
    df = spark.createDataFrame([(g, v, w) for (g, v), w in merged.items()], "g string, v double, w bigint")
    got = {(r["g"], r["v"]): (r["w_below"], r["w_total"]) for r in ordered.running_totals(df, "v", ["w"], ["g"]).collect()}
    want = {
        (g, v): (sum(w for (h, u), w in merged.items() if h == g and u < v), sum(w for (h, _), w in merged.items() if h == g))
        for g, v in merged
    }
    assert got == want


def test_running_totals_over_many_slices_and_without_groups(spark):
    df = spark.range(5000).select((F.col("id") * 0.5).alias("v"), (F.col("id") % 3).alias("w"))
    got = ordered.running_totals(df, "v", ["w"]).collect()
    below = 0
    for r in sorted(got, key=lambda r: r["v"]):
        assert r["w_below"] == below and r["w_total"] == 4999
        below += r["w"]


def test_one_group_with_most_values_spans_partitions(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 8).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).cast("bigint").alias("w"))
    got = ordered.running_totals(df, "v", ["w"], ["g"])
    seen, n = {}, {}
    for r in sorted(got.collect(), key=lambda r: r["v"]):
        assert r["w_below"] == seen.get(r["g"], 0)
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        n[r["g"]] = r["w_total"]
    assert seen == n


def test_moving_average_needs_full_frames(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "week int, n double")
    got = {r["week"]: r["n_ma4"] for r in ordered.moving_average(df, "week", "n", 4).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 2.5, 5: 3.5, 6: 4.5}


def test_clock_times_are_floored(spark, tx):
    got = by_key(ordered.timeline_profile(tx))
    assert got["d"]["tx_avg_gap_days"] == 1.0
    assert got["a"]["tx_avg_gap_days"] == 15.0 and got["a"]["active_months"] == 1
    assert got["c"]["tx_avg_gap_days"] is None and got["e"]["tx_avg_gap_days"] == 0.0
