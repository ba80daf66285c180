"""Distribution summaries: the numbers behind histograms, box plots and share bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import _col
from retentia.operators.quantiles import quantiles_of_counts
from retentia.sources.sink import stage


def histogram(df: DataFrame, col: str, bins: int = 50, weight: str | None = None) -> DataFrame:
    """Equal-width histogram between the least and the greatest value.

    Bins are closed on the left, the last on both sides; empty bins are listed. A
    constant column gets a range of width 1 around its value. ``weight`` counts a
    row several times.
    """
    present = df.filter(_col(col).isNotNull())
    x = _col(col).cast("double")
    present = present.select(x.alias("_x"), (_col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    low, high = F.min("_x"), F.max("_x")
    spread = F.when(low == high, 0.5).otherwise(0.0)
    bounds = present.agg(F.struct((low - spread).alias("lo"), (high + spread).alias("hi")).alias("_bounds"))

    def edge(i: Column) -> Column:
        return F.col("_bounds")["lo"] + i * ((F.col("_bounds")["hi"] - F.col("_bounds")["lo"]) / bins)

    bounded = present.withColumn("_bounds", bounds.scalar())
    scale = F.col("_bounds")["hi"] - F.col("_bounds")["lo"]
    guess = F.least(F.floor((F.col("_x") - F.col("_bounds")["lo"]) / scale * bins), F.lit(bins - 1))
    guessed = bounded.withColumn("_i", guess)
    i = F.col("_i")
    settled = F.when(F.col("_x") < edge(i), i - 1).when((F.col("_x") >= edge(i + 1)) & (i < bins - 1), i + 1).otherwise(i)
    counts = guessed.groupBy(settled.alias("bin")).agg(F.sum("_w").alias("_n"))

    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").withColumn("_bounds", bounds.scalar())
    return every.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("bin_start"),
        edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def box_summary(df: DataFrame, group: str, cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and outliers of each column per group.

    Whiskers are the extreme values within ``whisker`` interquartile ranges of the
    quartiles. A column is skipped when any group has no value for it.
    """
    cols = [c for c in cols if c in df.columns]
    # Positions stand for the names, which may hold dots.
    places, name, group = {f"_{i}": c for i, c in enumerate(cols)}, group, "_group"
    known = df.filter(_col(name).isNotNull())
    numeric = known.select(_col(name).alias(group), *[_col(c).try_cast("double").alias(p) for p, c in places.items()])
    long = numeric.unpivot([group], list(places), "feature", "value")
    counted = stage(long.groupBy("feature", group, "value").agg(F.count(F.lit(1)).alias("n")))
    known_values = counted.filter("value IS NOT NULL")

    n_valid = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    skipped = counted.groupBy("feature", group).agg(n_valid.alias("n_valid")).filter("n_valid IS NULL")

    quartiles = quantiles_of_counts(known_values, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["feature", group])
    reach = whisker * (F.col("q3") - F.col("q1"))
    fenced = known_values.withColumnRenamed("n", "_n").join(quartiles, ["feature", group])
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    summary = fenced.groupBy("feature", group).agg(
        *[F.first(c).alias(c) for c in ("n", "q1", "median", "q3")],
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"),
    )
    kept = summary.join(skipped.select("feature").distinct(), "feature", "left_anti")
    names = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    return kept.withColumn("feature", F.element_at(names, F.col("feature"))).withColumnRenamed(group, name)


def crosstab_share(df: DataFrame, row: str, col: str, levels: Sequence | None = None) -> DataFrame:
    """Share of each ``col`` level within each ``row`` value; rows missing either are left out.

    ``levels`` chooses the levels that get a column and avoids the job that looks them up; rows with
    other levels still count in the whole.
    """
    both = df.filter(_col(row).isNotNull() & _col(col).isNotNull()).select(_col(row).alias("_row"), _col(col).alias("_col"))
    counts = both.groupBy("_row", "_col").agg(F.count(F.lit(1)).alias("_n"))
    wide = counts.groupBy("_row").pivot("_col", list(levels) if levels is not None else None).agg(F.sum("_n"))
    names = [c for c in wide.columns if c != "_row"]
    everything = counts.groupBy("_row").agg(F.sum("_n").alias("_rows"))
    n = {c: F.coalesce(_col(c), F.lit(0)) for c in names}
    return wide.join(everything, "_row").select(F.col("_row").alias(row), *[(n[c] / F.col("_rows")).alias(f"share_{c}") for c in names])
