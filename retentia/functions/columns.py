"""Column expressions with the missing-value rules the feature tables rely on.

Everything here is a built-in expression, so it stays inside whole-stage
codegen. Times are TIMESTAMP_NTZ throughout: subtracting two of them gives an
exact interval that does not depend on the session time zone.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    """A column by its whole name: dots and backticks in it are part of the name."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def ntz(value: datetime | date | str) -> Column:
    """A TIMESTAMP_NTZ literal; folded to a constant, so filters on it push down."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def nan_to_null(c: Column | str) -> Column:
    """Spark counts NaN as a value and lets it win max(); one missing marker is enough."""
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def is_missing(c: Column | str) -> Column:
    return _col(c).isNull().cast("int")


def not_missing(c: Column | str) -> Column:
    return _col(c).isNotNull().cast("int")


def flag(condition: Column) -> Column:
    """0/1 flag; an unknown comparison is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ieq(c: Column | str, value: str) -> Column:
    """Case-insensitive equality; a missing value is not equal."""
    return F.coalesce(F.lower(_col(c)) == value.lower(), F.lit(False))


def ine_or_null(c: Column | str, value: str) -> Column:
    """Case-insensitive inequality; a missing value counts as different."""
    return ~F.lower(_col(c)).eqNullSafe(F.lit(value.lower()))


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed 24-hour periods rounded down, so minus twelve hours is -1."""
    elapsed = _col(later) - _col(earlier)
    days = F.extract(F.lit("DAY"), elapsed)
    return (days - (elapsed < F.make_dt_interval(days)).cast("int")).cast("bigint")


def recency_days(last: Column | str, snapshot: datetime | Column) -> Column:
    at = snapshot if isinstance(snapshot, Column) else ntz(snapshot)
    return whole_days(at, last)


def month_of(ts: Column | str) -> Column:
    """Start of the month; by way of DATE, since date_trunc would bring in the session time zone."""
    return F.trunc(_col(ts).cast("date"), "MM").cast("timestamp_ntz")


def week_of(ts: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(_col(ts).cast("date"), "WEEK").cast("timestamp_ntz")


def clip(c: Column | str, lower=None, upper=None) -> Column:
    """Clip to bounds; a missing value stays missing (least/greatest would fill it)."""
    out = _col(c)
    if lower is not None:
        bound = lower if isinstance(lower, Column) else F.lit(lower)
        out = F.when(out < bound, bound).otherwise(out)
    if upper is not None:
        bound = upper if isinstance(upper, Column) else F.lit(upper)
        out = F.when(out > bound, bound).otherwise(out)
    return out


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0 or either side is missing."""
    return F.coalesce(F.try_divide(_col(a), _col(b)), F.lit(0.0))
