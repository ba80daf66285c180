"""Run registered queries beside their SQL and compare names, row counts and values.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import QUERIES
from checks.oracle import ORACLE

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, str)):
        return value
    try:
        return repr(float(value) + 0.0)
    except (TypeError, ValueError):
        return str(value)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def close(got: Counter, want: Counter) -> bool:
    """Equal rows but for numbers that differ by one in the last of six places: a tie may be rounded to either side."""
    def split(row):
        numbers = [float(v) if isinstance(v, str) and is_number(v) else None for v in row]
        return tuple(str(v) if n is None else "" for v, n in zip(row, numbers)), [n for n in numbers if n is not None]

    a, b = (sorted((split(row) for row in side.elements())) for side in (got - want, want - got))
    return len(a) == len(b) and all(
        x == y and all(math.isclose(v, w, rel_tol=1e-9, abs_tol=1.5e-6) for v, w in zip(m, n, strict=True)) for (x, m), (y, n) in zip(a, b))


def is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def difference(spark: SparkSession, con, folder: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = QUERIES[name](spark, folder)
    got = bag(df.columns, df.collect())
    if name not in ORACLE:
        return None if got else "no rows"
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(set(columns) ^ set(df.columns))}"
    expected = bag(columns, want.fetchall())
    if got == expected or close(got, expected):
        return None
    return f"{got.total()} rows for {expected.total()}; only here {list((got - expected))[:2]}; only there {list((expected - got))[:2]}"


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("retentia-checks")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark, con, failed = session(), connect(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            found = difference(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - a broken query must not stop the others
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        kind = "sql " if name in ORACLE else "rows"
        print(f"{'ok  ' if found is None else 'FAIL'} {kind} {time.time() - start:6.1f}s {name} {found or ''}", flush=True)
    print(f"{failed} of {len(names or QUERIES)} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
