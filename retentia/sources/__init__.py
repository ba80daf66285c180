from retentia.sources.sink import stage, stage_by_key, write_features
from retentia.sources.star import CUTOFF, retention_tables
from retentia.sources.tables import (
    CUSTOMER_TABLES,
    KEY,
    TableSpec,
    coerce_double,
    coerce_timestamp,
    load_tables,
)

__all__ = [
    "CUSTOMER_TABLES",
    "CUTOFF",
    "KEY",
    "TableSpec",
    "coerce_double",
    "coerce_timestamp",
    "load_tables",
    "retention_tables",
    "stage",
    "stage_by_key",
    "write_features",
]
