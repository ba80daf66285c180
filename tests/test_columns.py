from pyspark.sql import functions as F

from retentia.functions import clip, flag, ieq, ine_or_null, month_of, nan_to_null, ntz, safe_ratio, week_of, whole_days
from tests.conftest import at


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_whole_days_are_floored_elapsed_days(spark):
    cases = {
        ("2024-01-03 01:00:00", "2024-01-01 23:00:00"): 1,
        ("2024-01-01 00:00:00", "2024-01-01 12:00:00"): -1,
        ("2024-01-02 00:00:00", "2024-01-01 00:00:00"): 1,
        ("2024-01-01 00:00:00", "2024-01-02 00:00:00"): -1,
        ("2024-01-01 00:00:00", "2024-01-01 00:00:00"): 0,
        ("2024-01-01 00:00:00.000001", "2024-01-01 00:00:00"): 0,
        ("2001-02-01 00:00:00", "1901-02-01 00:00:00"): 36525,
    }
    for (a, b), want in cases.items():
        assert one(spark, whole_days(ntz(a), ntz(b))) == want, (a, b)
    assert one(spark, whole_days(ntz("2024-01-01"), F.lit(None).cast("timestamp_ntz"))) is None


def test_days_and_buckets_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # the night of 10 March 2024 has 23 hours in New York
        assert one(spark, whole_days(ntz("2024-03-11"), ntz("2024-03-10"))) == 1
        assert one(spark, month_of(ntz("2024-03-31 23:30:00"))) == at("2024-03-01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_week_starts_on_monday(spark):
    assert one(spark, week_of(ntz("2024-03-10 23:59:59"))) == at("2024-03-04")
    assert one(spark, week_of(ntz("2024-03-11"))) == at("2024-03-11")


def test_case_insensitive_comparisons_with_missing_values(spark):
    none = F.lit(None).cast("string")
    assert one(spark, ieq(F.lit("COMPLAINT"), "complaint")) is True
    assert one(spark, ieq(none, "complaint")) is False
    assert one(spark, ine_or_null(F.lit("ReSolved"), "resolved")) is False
    assert one(spark, ine_or_null(none, "resolved")) is True


def test_clip_keeps_missing(spark):
    assert one(spark, clip(F.lit(None).cast("double"), upper=3.0)) is None
    assert one(spark, clip(F.lit(5.0), upper=3.0)) == 3.0
    assert one(spark, clip(F.lit(-5.0), lower=0.0)) == 0.0


def test_ratio_flag_and_nan(spark):
    assert one(spark, safe_ratio(F.lit(1.0), F.lit(0))) == 0.0
    assert one(spark, safe_ratio(F.lit(None).cast("double"), F.lit(2))) == 0.0
    assert one(spark, safe_ratio(F.lit(3.0), F.lit(2))) == 1.5
    assert one(spark, flag(F.lit(None).cast("int") > 1)) == 0
    assert one(spark, nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, F.bround(F.lit(0.0625), 3)) == 0.062
