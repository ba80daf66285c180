"""Exact, linearly interpolated quantiles without a single-task sort.

The built-in exact ``percentile`` merges every distinct value in one task. Here
values are counted first, placed by range and totalled partition by partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import _col
from retentia.operators import ordered
from retentia.operators.sketches import sketch_quantiles, value_sketches


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], groups: Iterable[str] = ()) -> DataFrame:
    """One row per group: ``n`` non-missing values and one column per named probability.

    Quantile ``q`` sits at position ``q * (n - 1)`` of the ordered values and is
    interpolated linearly between its neighbours. Groups without values are absent.
    The counts per distinct value are placed by range and stored.
    """
    groups = list(groups)
    # Positions stand for the names, which may hold dots.
    places = {f"_g{i}": g for i, g in enumerate(groups)}
    plain = df.filter(_col(value).isNotNull()).select(*[_col(g).alias(p) for p, g in places.items()], _col(value).alias("_value"))
    counted = plain.groupBy(*places, "_value").agg(F.count(F.lit(1)).alias("n"))
    found = quantiles_of_counts(counted, "_value", probs, list(places))
    return found.select(*[F.col(p).alias(g) for p, g in places.items()], *[_col(c) for c in found.columns if c not in places])


def quantiles_of_counts(counted: DataFrame, value: str, probs: Mapping[str, float], groups: Iterable[str] = ()) -> DataFrame:
    """``exact_quantiles`` of a table with one row per group and value, and its frequency ``n``."""
    groups = list(groups)

    def rank(q: float):
        return F.lit(float(q)) * (F.col("n_total") - 1)

    rows = ordered.running_totals(counted, value, ["n"], groups)

    def at(position):
        return F.max(F.when((F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n")), F.col(value)))

    parts = []
    for name, q in probs.items():
        parts += [at(F.floor(rank(q))).alias(f"_lo_{name}"), at(F.ceil(rank(q))).alias(f"_hi_{name}")]
    picked = rows.groupBy(*groups).agg(F.max("n_total").alias("n"), *parts)
    if not groups:
        picked = picked.filter(F.col("n").isNotNull())

    def between(name: str, q: float):
        position = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return picked.select(*groups, "n", *[between(name, q) for name, q in probs.items()])


def column_quantiles(df: DataFrame, wanted: Mapping[str, float], exact: bool = True) -> dict:
    """Quantile of each named column as a plain value; one job, one collected row per column.

    ``exact=False`` uses mergeable sketches instead, for data where a rank error of less than one in a
    thousand is acceptable.
    """
    if not wanted:
        return {}
    if not exact:
        probs = {f"_{i}": q for i, q in enumerate(wanted.values())}
        rows = {r["column"]: r for r in sketch_quantiles(value_sketches(df, list(wanted)), probs).collect()}
        return {c: rows[c][f"_{i}"] if c in rows else None for i, c in enumerate(wanted)}
    levels = {f"q{i}": q for i, q in enumerate(sorted(set(wanted.values())))}
    names = {q: name for name, q in levels.items()}
    places = {f"_{i}": c for i, c in enumerate(wanted)}
    long = df.select(*[_col(c).cast("double").alias(p) for p, c in places.items()]).unpivot([], list(places), "column", "value")
    rows = exact_quantiles(long, "value", levels, ["column"]).collect()
    found = {places[row["column"]]: row for row in rows}
    return {c: found[c][names[q]] if c in found else None for c, q in wanted.items()}
