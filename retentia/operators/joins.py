"""Validated one-to-one joins and global scalars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.sources.tables import KEY


class KeyViolation(ValueError):
    """A table that must have one row per key has a missing or a repeated key."""


def assert_unique_keys(tables: Mapping[str, DataFrame], key: str = KEY) -> None:
    """Raise if ``key`` repeats or is missing in any of the tables.

    One job over all of them, which reads the key columns only.
    """
    faults = [
        df.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).limit(1)
        .select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), "count")
        for name, df in tables.items()
    ]
    bad = reduce(DataFrame.unionByName, faults).first()
    if bad is not None:
        raise KeyViolation(f"{bad['table_name']}: {key}={bad['key']!r} appears {bad['count']} times")


def assert_unique_key(df: DataFrame, key: str = KEY, name: str = "table") -> None:
    assert_unique_keys({name: df}, key)


def join_one_to_one(
    a: DataFrame, b: DataFrame, key: str = KEY, how: str = "left", validate: bool = True, names=("left", "right")
) -> DataFrame:
    """Equi-join of two tables with one row per key.

    ``validate=False`` skips the check for sides that are unique by construction,
    such as the result of a group-by on the key. No join hint is given: the sides
    grow with the customers, so the strategy is left to adaptive execution.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    if validate:
        assert_unique_keys(dict(zip(names, (a, b))), key)
    return a.join(b, key, how)


def with_globals(df: DataFrame, aggs: Mapping[str, Column], source: DataFrame | None = None) -> DataFrame:
    """Attach global aggregates of ``source`` (default ``df`` itself) to every row.

    One scalar subquery computes all of them in a single pass; its one-row result
    reaches the rows as a constant, without a join.
    """
    one = (source if source is not None else df).agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("_globals"))
    out = df.withColumn("_globals", one.scalar())
    return out.withColumns({n: F.col("_globals")[n] for n in aggs}).drop("_globals")
