"""The five customer tables derived from an order-management star schema.

Everything is measured at one instant, ``CUTOFF``: features read rows before it,
the label rows from it on, so that no feature can see the label's period.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions import ntz
from retentia.sources.tables import KEY, TableSpec, type_table

CUTOFF = datetime(2001, 2, 2)

# Names given to the return flags, the two income bounds, and the
# shift in days that brings each user's last event before the cutoff.
INTERACTION_TYPES = {"R": "Complaint", "A": "Inquiry", "N": "Feedback"}
INCOME_BOUNDS = (3000.0, 7000.0)
LOGIN_SHIFT_DAYS, LOGIN_STAGGER_DAYS, LOGIN_STAGGER_GROUPS = 8398, 15, 12
#: Lines that one task sorts for the join with their orders, whatever the size of the table.
JOIN_ROWS = 500_000


def _key(name: str):
    return F.col(name).cast("string").alias(KEY)


def demographics(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    low, high = INCOME_BOUNDS
    balance = F.col("c_acctbal")
    income = (
        F.when(balance < 0, F.lit(None).cast("string"))
        .when(balance < low, "Low")
        .when(balance < high, "Medium")
        .otherwise("High")
    )
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        _key("c_custkey"), "c_mktsegment", "r_name", income.alias("IncomeLevel")
    )


def transactions(orders: DataFrame, cutoff: datetime = CUTOFF) -> DataFrame:
    return orders.filter(F.col("o_orderdate") < ntz(cutoff)).select(
        _key("o_custkey"),
        F.col("o_orderkey").alias("TransactionID"),
        F.col("o_orderdate").alias("TransactionDate"),
        F.col("o_totalprice").alias("AmountSpent"),
        F.col("o_orderstatus").alias("ProductCategory"),
    )


def interactions(lineitem: DataFrame, orders: DataFrame, cutoff: datetime = CUTOFF) -> DataFrame:
    kind = F.lit(None).cast("string")
    for code, name in INTERACTION_TYPES.items():
        kind = F.when(F.col("l_returnflag") == code, name).otherwise(kind)
    status = F.when(F.col("l_linestatus") == "F", "Resolved").when(F.col("l_quantity") <= 45, "Unresolved")
    # The number of parts goes by the rows (counted from the file footers), so that a task's sort does not grow with the table; never one part alone.
    parts = max(2, math.ceil(lineitem.count() / JOIN_ROWS))
    shipped = lineitem.filter(F.col("l_shipdate") < ntz(cutoff)).repartition(parts, "l_orderkey")
    return shipped.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _key("o_custkey"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("InteractionID"),
        F.col("l_shipdate").alias("InteractionDate"),
        kind.alias("InteractionType"),
        status.alias("ResolutionStatus"),
    )


def online_activity(events: DataFrame) -> DataFrame:
    stagger = F.lit(LOGIN_STAGGER_DAYS) * F.pmod(F.col("user_id"), F.lit(LOGIN_STAGGER_GROUPS))
    shift = F.make_dt_interval((F.lit(LOGIN_SHIFT_DAYS) + stagger).cast("int"))
    return (
        events.groupBy("user_id")
        .agg(
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).cast("double").alias("LoginFrequency"),
            F.max_by("event_type", F.struct("ts", "event_id")).alias("ServiceUsage"),
        )
        .select(_key("user_id"), (F.col("last_ts") - shift).alias("LastLoginDate"), "LoginFrequency", "ServiceUsage")
    )


def attrition_labels(customer: DataFrame, orders: DataFrame, cutoff: datetime = CUTOFF) -> DataFrame:
    """1 for a customer without an order from the cutoff on."""
    stayed = orders.filter(F.col("o_orderdate") >= ntz(cutoff)).select(_key("o_custkey")).distinct()
    return (
        customer.select(_key("c_custkey"))
        .join(stayed.withColumn("stayed", F.lit(True)), KEY, "left")
        .select(KEY, F.col("stayed").isNull().cast("int").alias("ChurnStatus"))
    )


def retention_tables(spark: SparkSession, sf_dir: str, cutoff: datetime = CUTOFF) -> dict[str, DataFrame]:
    names = ("customer", "nation", "region", "orders", "lineitem", "events")
    source = {name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name in names}
    raw = {
        "demo": demographics(source["customer"], source["nation"], source["region"]),
        "tx": transactions(source["orders"], cutoff),
        "svc": interactions(source["lineitem"], source["orders"], cutoff),
        "online": online_activity(source["events"]),
        "churn": attrition_labels(source["customer"], source["orders"], cutoff),
    }
    repairs = {
        "tx": TableSpec("", timestamps=("TransactionDate",), doubles=("AmountSpent",)),
        "svc": TableSpec("", timestamps=("InteractionDate",)),
        "online": TableSpec("", timestamps=("LastLoginDate",), doubles=("LoginFrequency",)),
    }
    return {name: type_table(df, repairs.get(name, TableSpec(""))) for name, df in raw.items()}
