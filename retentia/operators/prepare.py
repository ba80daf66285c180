"""Feature preparation. Steps are separate so that a plan can fix their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions import flag, is_missing, safe_ratio
from retentia.functions.columns import _col
from retentia.operators.joins import with_globals
from retentia.operators.levels import level_counts, level_dictionary
from retentia.operators.quantiles import column_quantiles
from retentia.sources.tables import KEY

# Columns of the customer feature table by role.
COUNT_COLUMNS = (
    "txn_count", "product_cat_nunique", "cs_count", "cs_types_nunique", "complaint_count", "unresolved_count", "active_months",
)
RECENCY_COLUMNS = ("tx_recency_days", "cs_recency_days", "lastlogin_recency_days")
AMOUNT_COLUMNS = ("amount_sum", "amount_mean", "amount_std")
WINDOW_COLUMNS = ("tx_30", "tx_60", "tx_90", "amt_30", "amt_90", "complaints_90d", "unresolved_90d")
NON_FEATURES = (KEY, "ChurnStatus", "first_txn_dt", "last_txn_dt", "last_cs_dt", "LastLoginDate")

_KINDS = {"number": T.NumericType, "string": T.StringType, "bool": T.BooleanType, "time": T.DatetimeType}


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def columns_of_type(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Names of the columns of the kinds ``number``, ``string``, ``bool`` or ``time``. A flag of type BOOLEAN is no number."""
    wanted = tuple(_KINDS[k] for k in include) or (T.DataType,)
    unwanted = tuple(_KINDS[k] for k in exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, wanted) and not isinstance(f.dataType, unwanted)]


def select_by_type(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*[_col(c) for c in columns_of_type(df, include, exclude)])


def collapse_duplicate_columns(df: DataFrame, how: str = "max") -> DataFrame:
    """One column per trimmed name; columns of equal name become their row-wise maximum."""
    if how not in ("max", "first"):
        raise ValueError(f"how must be 'max' or 'first', not {how!r}")
    names = [c.strip() for c in df.columns]
    numbered = df.toDF(*[f"_c{i}" for i in range(len(names))])

    def merged(name: str):
        same = [F.col(f"_c{i}") for i, n in enumerate(names) if n == name]
        return (F.greatest(*same) if how == "max" and len(same) > 1 else same[0]).alias(name)

    return numbered.select(*[merged(n) for n in dict.fromkeys(names)])


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing numbers of the named columns become 0; columns of other types, and absent ones, stay as they are."""
    kinds = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return df.withColumns({c: F.coalesce(_col(c), F.lit(0).cast(kinds[c])) for c in cols if c in kinds})


def coverage_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "had_tx": F.col("txn_count").isNotNull().cast("int"),
        "had_service": F.col("cs_count").isNotNull().cast("int"),
    })


def fill_counts(df: DataFrame, cols: Sequence[str] = COUNT_COLUMNS) -> DataFrame:
    return fill_zero(df, cols)


def fill_recency(df: DataFrame, cols: Sequence[str] = RECENCY_COLUMNS) -> DataFrame:
    """Missing recency becomes one more than the largest in the table."""
    cols = _present(df, cols)
    tops = with_globals(df, {f"_max_{i}": F.max(_col(c)) for i, c in enumerate(cols)})
    filled = {c: F.coalesce(_col(c), F.col(f"_max_{i}") + 1) for i, c in enumerate(cols)}
    return tops.withColumns(filled).select(*[_col(c) for c in df.columns])


def missing_flags(df: DataFrame, cols: Sequence[str] | None = None, suffix: str = "_was_missing") -> DataFrame:
    """A 0/1 column per numeric column (or per named one) that tells whether it is missing."""
    cols = columns_of_type(df, include=["number"]) if cols is None else _present(df, cols)
    return df.withColumns({f"{c}{suffix}": is_missing(c) for c in cols})


def winsorize_upper(df: DataFrame, cols: Sequence[str] = AMOUNT_COLUMNS, q: float = 0.99, exact: bool = True) -> DataFrame:
    """Cap columns at their own quantile; missing values stay missing. Runs a job for the quantiles."""
    cols = _present(df, cols)
    return cap_at(df, column_quantiles(df, dict.fromkeys(cols, q), exact))


def cap_at(df: DataFrame, caps: dict) -> DataFrame:
    return df.withColumns({
        c: F.when(_col(c) > F.lit(cap), F.lit(cap)).otherwise(_col(c)) for c, cap in caps.items() if cap is not None
    })


def log1p_features(df: DataFrame, cols: Sequence[str] = ("amount_sum", "amount_mean")) -> DataFrame:
    return df.withColumns({f"log1p_{c}": F.log1p(_col(c)) for c in _present(df, cols)})


def levels_of(df: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict[str, list[str]]:
    """Sorted distinct values per column. Runs a job; refuses columns with too many levels."""
    places = {f"_{i}": c for i, c in enumerate(cols)}
    long = df.select(*[_col(c).cast("string").alias(p) for p, c in places.items()]).unpivot([], list(places), "column", "level")
    found = long.filter("level IS NOT NULL").distinct().take(max_levels * len(cols) + 1)
    levels = {c: sorted(r["level"] for r in found if r["column"] == p) for p, c in places.items()}
    wide = [c for c, values in levels.items() if len(values) > max_levels]
    if wide or len(found) > max_levels * len(cols):
        raise ValueError(f"more than {max_levels} levels in {wide or cols}; number them with level_dictionary instead")
    return levels


def narrow_levels(df: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict[str, list[str]]:
    """Sorted levels of the columns that have ``max_levels`` at most; wider ones are left out and none of their levels is collected."""
    if not cols:
        return {}
    dictionary = level_dictionary(df, cols, "name")
    narrow = [c for c, (n, _) in level_counts(dictionary, cols).items() if n <= max_levels]
    found: dict[str, list[str]] = {c: [] for c in narrow}
    for row in dictionary.filter(F.col("column").isin(narrow)).orderBy("column", "number").collect() if narrow else []:
        found[row["column"]].append(row["level"])
    return found


def one_hot(df: DataFrame, cols: Sequence[str], prefix: str | None = None, dummy_na: bool = True,
            max_levels: int = 1000, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Replace text columns by one 0/1 column per level, in sorted order, plus ``_nan``.

    The ``_nan`` column is there even when nothing is missing. Levels are looked up by
    a job unless given.
    """
    cols = list(cols)
    if not cols:
        return df
    levels = levels if levels is not None else levels_of(df, cols, max_levels)
    dummies = {}
    for c in cols:
        head = prefix or c
        text = _col(c).cast("string")
        dummies |= {f"{head}_{v}": flag(text == v) for v in levels[c]}
        if dummy_na:
            dummies[f"{head}_nan"] = is_missing(c)
    kept = [_col(c) for c in df.columns if c not in cols]
    return df.select(*kept, *[v.alias(n) for n, v in dummies.items()])


def fill_median(df: DataFrame, cols: Sequence[str] = ("tx_avg_gap_days",), exact: bool = True) -> DataFrame:
    cols = _present(df, cols)
    return fill_with(df, column_quantiles(df, dict.fromkeys(cols, 0.5), exact))


def fill_with(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(_col(c), F.lit(v)) for c, v in values.items() if v is not None})


def fill_std_zero(df: DataFrame, col: str = "amount_std") -> DataFrame:
    return fill_zero(df, [col])


def activity_flags(df: DataFrame, days: int = 90) -> DataFrame:
    """Missing window features become 0; three 0/1 flags on the longest window."""
    filled = fill_zero(df, WINDOW_COLUMNS)
    return filled.withColumns({
        f"no_tx_{days}d": flag(F.col(f"tx_{days}") == 0),
        f"no_login_{days}d": flag(F.col("lastlogin_recency_days") > days),
        f"complained_{days}d": flag(F.col(f"complaints_{days}d") > 0),
    })


def spend_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_spend_per_tx", safe_ratio("amount_sum", "txn_count"))


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean 0 and population standard deviation 1; a constant column becomes 0."""
    places = dict(enumerate(cols))
    stats = {f"_mean_{i}": F.avg(_col(c)) for i, c in places.items()} | {f"_std_{i}": F.stddev_pop(_col(c)) for i, c in places.items()}
    scale = {i: F.when(F.col(f"_std_{i}") == 0, 1.0).otherwise(F.col(f"_std_{i}")) for i in places}
    scaled = {c: (_col(c) - F.col(f"_mean_{i}")) / scale[i] for i, c in places.items()}
    return with_globals(df, stats).withColumns(scaled).select(*[_col(c) for c in df.columns])


def final_fill(df: DataFrame) -> DataFrame:
    """Last guard before a model: any missing number becomes 0."""
    return fill_zero(df, columns_of_type(df, include=["number"]))
