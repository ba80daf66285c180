"""Text columns with any number of levels: a dictionary kept as a table, level numbers, and out-of-fold level means.

Levels are counted and ranked in Spark and joined back to the rows, so no list of them passes through
the driver. The few levels that hold a large share of the rows reach them by broadcast; their number is
bounded by the share they hold. What is left is joined by level, where none of them is large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import _col
from retentia.operators.ordered import running_totals
from retentia.sources.sink import stage
from retentia.sources.tables import KEY

#: A level is hot if it holds more than one in so many rows; there are at most that many of a column.
HOT = 1000


def level_dictionary(df: DataFrame, cols: Sequence[str], order: str = "frequency") -> DataFrame:
    """(column, level, n, number) of every text column named; missing values are no level.

    Numbers go from 0 in each column: by falling frequency, equal ones by name, or with ``order='name'`` by name.
    Counts combine map-side, and the ranks are running totals over ranges, so no task holds a column's levels.
    The table is staged. Without columns, or rows, it is empty.
    """
    if order not in ("frequency", "name"):
        raise ValueError(f"order must be 'frequency' or 'name', not {order!r}")
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, level string, n bigint, number bigint")
    places = {f"_{i}": c for i, c in enumerate(cols)}
    long = df.select(*[_col(c).cast("string").alias(p) for p, c in places.items()]).unpivot([], list(places), "column", "level")
    counts = long.filter("level IS NOT NULL").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    by = F.struct("level") if order == "name" else F.struct((-F.col("n")).alias("m"), "level")
    ranked = running_totals(counts.withColumns({"_order": by, "_one": F.lit(1).cast("bigint")}), "_order", ["_one"], ["column"])
    return stage(ranked.select(_named(places, "column"), "level", "n", F.col("_one_below").cast("bigint").alias("number")))


def _named(places: Mapping[str, str], column: str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    return F.element_at(names, F.col(column)).alias(column)


def level_counts(dictionary: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, int]]:
    """(levels, rows with a level) of each column; one collected row per column."""
    rows = dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("rows")).collect()
    found = {r["column"]: (r["levels"], r["rows"]) for r in rows}
    return {c: found.get(c, (0, 0)) for c in cols}


def look_up(df: DataFrame, col: str, table: DataFrame, payload: Mapping[str, Column], rows: int, key: str = KEY) -> DataFrame:
    """Left join of a table with one row per level (``level``, its frequency ``n``, more) on a text column.

    ``payload`` names the columns to add, as expressions on the table. Hot levels are broadcast, at most ``HOT`` rows;
    rows that have one, or no level at all, are spread by key instead of meeting in one task.
    """
    value = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(payload.values())])
    hot = table.filter(F.col("n") * HOT > rows).select(F.col("level").alias("_hot_level"), value.alias("_hot"))
    cold = table.filter(F.col("n") * HOT <= rows).select(F.col("level").alias("_cold_level"), F.lit(0).cast("bigint").alias("_cold_salt"), value.alias("_cold"))
    level = _col(col).cast("string")
    near = df.withColumn("_level", level).join(F.broadcast(hot), F.col("_level") == F.col("_hot_level"), "left")
    sought = F.col("_hot").isNull() & F.col("_level").isNotNull()
    salted = near.withColumns({"_level": F.when(sought, F.col("_level")), "_salt": F.when(sought, F.lit(0).cast("bigint")).otherwise(F.xxhash64(_col(key)))})
    joined = salted.join(cold, (F.col("_level") == F.col("_cold_level")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = joined.withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.select(*[_col(c) for c in df.columns], *[F.col("_found")[f"_{i}"].alias(name) for i, name in enumerate(payload)])


def with_level_numbers(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], suffix: str = "_index", key: str = KEY) -> DataFrame:
    """Add ``<c><suffix>`` as a double: the level's number; missing and unknown levels share the number after the last."""
    for c, (levels, rows) in level_counts(dictionary, cols).items():
        out = f"{c}{suffix}"
        own = dictionary.filter(F.col("column") == c)
        df = look_up(df, c, own, {out: F.col("number").cast("double")}, rows, key)
        df = df.withColumn(out, F.coalesce(_col(out), F.lit(float(levels))))
    return df


def level_totals(df: DataFrame, cols: Sequence[str], label: str, fold: str, folds: int, within: Column) -> DataFrame:
    """(column, level, n, n_0.., p_0..): rows and positive rows of every level per fold, of the rows ``within``. Staged."""
    places = {f"_{i}": c for i, c in enumerate(cols)}
    given = df.filter(within).select(_col(label).alias("_label"), _col(fold).alias("_fold"), *[_col(c).cast("string").alias(p) for p, c in places.items()])
    long = given.unpivot(["_label", "_fold"], list(places), "column", "level").filter("level IS NOT NULL")
    of = [F.col("_fold") == k for k in range(folds)]
    sums = {f"n_{k}": F.count_if(of[k]) for k in range(folds)} | {f"p_{k}": F.count_if(of[k] & (F.col("_label") == 1)) for k in range(folds)}
    totals = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in sums.items()])
    return stage(totals.withColumn("column", _named(places, "column")))


def target_means(df: DataFrame, cols: Sequence[str], label: str, fold: str = "fold", folds: int = 5, train: Column | None = None,
                 smoothing: float = 20.0, suffix: str = "_mean", key: str = KEY) -> DataFrame:
    """Add ``<c><suffix>``: the share of positive rows of the row's level, from the training rows of the other folds only.

    A level's share is moved towards the share over all those rows, as if ``smoothing`` more rows had that one. Rows
    outside ``train`` (default: none are) get the share over all training rows, frozen. A missing or unseen level
    gets the overall share. So no row sees its own label, nor that of a row in its fold.
    """
    within = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    totals = level_totals(df, cols, label, fold, folds, within) if cols else None
    whole = df.filter(within).groupBy(_col(fold).alias("_fold")).agg(F.count(F.lit(1)).alias("n"), F.count_if(_col(label) == 1).alias("p")).collect() if cols else []
    n_all, p_all = sum(r["n"] for r in whole), sum(r["p"] for r in whole)

    def share(n: int, p: int) -> float:
        return p / n if n else 0.0

    prior = F.lit(share(n_all, p_all))
    for r in whole:  # one row per fold
        prior = F.when(within & (_col(fold) == r["_fold"]), F.lit(share(n_all - r["n"], p_all - r["p"]))).otherwise(prior)
    for c in cols:
        own = totals.filter(F.col("column") == c)
        rows = own.agg(F.sum("n")).first()[0] or 0
        hits = F.array(*[F.col(f"p_{k}") for k in range(folds)])
        counts = F.array(*[F.col(f"n_{k}") for k in range(folds)])
        df = look_up(df, c, own, {"_n": F.col("n"), "_counts": counts, "_hits": hits}, rows, key)
        at = F.when(within, _col(fold).cast("int"))
        add = lambda a, b: a + b
        n = F.col("_n") - F.coalesce(F.get("_counts", at), F.lit(0))
        p = F.aggregate("_hits", F.lit(0).cast("bigint"), add) - F.coalesce(F.get("_hits", at), F.lit(0))
        mean = (F.coalesce(p, F.lit(0)) + F.lit(smoothing) * prior) / (F.coalesce(n, F.lit(0)) + F.lit(smoothing))
        df = df.withColumn(f"{c}{suffix}", mean).drop("_n", "_counts", "_hits")
    return df
