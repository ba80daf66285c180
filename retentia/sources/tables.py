"""Typed loading of the customer tables from Parquet, ORC, JSON, CSV or the catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions import nan_to_null

KEY = "CustomerID"


@dataclass(frozen=True)
class TableSpec:
    """Where a table lies and which of its columns must be repaired on reading.

    Columns that are not named here pass through unchanged, and named columns
    that a file lacks are skipped.
    """

    location: str
    key: str = KEY
    timestamps: tuple[str, ...] = ()
    doubles: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)


# Table and column names of the customer data contract.
CUSTOMER_TABLES: dict[str, TableSpec] = {
    "demo": TableSpec("Customer_Demographics"),
    "tx": TableSpec("Transaction_History", timestamps=("TransactionDate",), doubles=("AmountSpent",)),
    "svc": TableSpec("Customer_Service", timestamps=("InteractionDate",)),
    "online": TableSpec(
        "Online_Activity", timestamps=("LastLoginDate",), doubles=("LoginFrequency",), strings=("ServiceUsage",)
    ),
    "churn": TableSpec("Churn_Status"),
}


def coerce_timestamp(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Cast to TIMESTAMP_NTZ; text that does not parse becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in cols if c in df.columns})


def coerce_double(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Cast to DOUBLE; text that does not parse, and NaN, become NULL."""
    return df.withColumns({c: nan_to_null(F.col(c).try_cast("double")) for c in cols if c in df.columns})


def _nan_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]


def type_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Apply one spec: string key, repaired columns, a single missing marker.

    All of it is projection, so it runs in the scan stage and pruning still
    reaches the files.
    """
    out = coerce_double(coerce_timestamp(df, spec.timestamps), spec.doubles)
    texts = [c for c in (spec.key, *spec.strings) if c in df.columns]
    out = out.withColumns({c: F.col(c).cast("string") for c in texts})
    floats = [c for c in _nan_columns(df) if c not in spec.doubles and c not in texts and c not in spec.timestamps]
    return out.withColumns({c: nan_to_null(c).cast(df.schema[c].dataType) for c in floats})


def load_tables(spark: SparkSession, path: str, spec: Mapping[str, TableSpec] | None = None) -> dict[str, DataFrame]:
    """Read every table named in ``spec`` below ``path`` (or from the catalog).

    A location in the form ``table:name`` reads a catalog table. CSV is read as
    text with a header unless ``options`` says otherwise: the declared columns are
    cast afterwards, so no inference pass over the files is needed.
    """
    tables = {}
    for name, table in (spec or CUSTOMER_TABLES).items():
        if table.location.startswith("table:"):
            raw = spark.table(table.location.removeprefix("table:"))
        else:
            options = {"header": "true", **table.options} if table.format == "csv" else dict(table.options)
            raw = spark.read.format(table.format).options(**options).load(f"{path.rstrip('/')}/{table.location}")
        tables[name] = type_table(raw, table)
    return tables
