import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("retentia-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


TX_SCHEMA = (
    "CustomerID string, TransactionID bigint, TransactionDate timestamp_ntz, AmountSpent double, ProductCategory string"
)
SVC_SCHEMA = (
    "CustomerID string, InteractionID string, InteractionDate timestamp_ntz, InteractionType string, ResolutionStatus string"
)


@pytest.fixture(scope="session")
def tx(spark):
    """Missing customer and date, all amounts missing, one transaction, an exact copy, a repeated time, clock times."""
    rows = [
        (None, 1, at("2024-01-01"), 5.0, "A"),
        ("a", 2, at("2024-01-01"), 10.0, "A"),
        ("a", 3, at("2024-01-31"), 20.0, "B"),
        ("a", 4, at("2024-01-31"), 30.0, None),
        ("a", 5, None, 40.0, "A"),
        ("b", 6, at("2024-03-01"), None, "A"),
        ("b", 7, at("2024-03-11"), None, "A"),
        ("c", 8, at("2024-02-01"), 7.0, "C"),
        ("d", 9, at("2024-03-01 23:00"), 1.0, "A"),
        ("d", 10, at("2024-03-03 01:00"), 2.0, "A"),
        ("e", 11, at("2024-03-20"), 4.0, "A"),
        ("e", 11, at("2024-03-20"), 4.0, "A"),
    ]
    return spark.createDataFrame(rows, TX_SCHEMA)


@pytest.fixture(scope="session")
def svc(spark):
    rows = [
        ("a", "i1", at("2024-03-25"), "COMPLAINT", "ReSolved"),
        ("a", "i1", at("2024-03-26"), "complaint", None),
        ("a", None, at("2023-01-01"), "Complaint", "Open"),
        ("b", None, at("2024-03-01"), None, "resolved"),
        ("b", "i3", at("2024-03-01"), "Inquiry", "Unresolved"),
        ("b", "i3", at("2024-03-01"), "Inquiry", "Unresolved"),
        (None, "i4", at("2024-03-01"), "Inquiry", "Unresolved"),
    ]
    return spark.createDataFrame(rows, SVC_SCHEMA)


def by_key(df, key="CustomerID"):
    return {row[key]: row.asDict() for row in df.collect()}


@pytest.fixture(scope="session")
def tables(spark, tx, svc):
    return {
        "demo": spark.createDataFrame([(k, g) for k, g in zip("abcdef", ("F", "M", None, "F", "M", "F"))], "CustomerID string, Gender string"),
        "churn": spark.createDataFrame([(k, i % 2) for i, k in enumerate("abcde")], "CustomerID string, ChurnStatus int"),
        "online": spark.createDataFrame(
            [("a", at("2024-03-31"), 3.0, "Website"), ("b", at("2024-03-01"), None, None), ("f", None, 1.0, "Mobile App")],
            "CustomerID string, LastLoginDate timestamp_ntz, LoginFrequency double, ServiceUsage string",
        ),
        "tx": tx.filter("CustomerID IS NOT NULL"),
        "svc": svc.filter("CustomerID IS NOT NULL"),
    }
