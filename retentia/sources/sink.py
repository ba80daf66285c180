"""Writing feature tables, and the staging tables that cut long lineages."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def write_features(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partition_by: tuple[str, ...] = (),
    format: str = "parquet",
) -> None:
    """Persist a feature table; runs the plan."""
    df.write.mode(mode).partitionBy(*partition_by).format(format).save(path)


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    A cluster that has the package installed, or gets it with ``--py-files``, does not need this.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, root) if p)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for staged data, as the cluster names it.

    Where nothing is configured it lies below the session's warehouse; on a cluster that must be a place all
    executors reach, so a warehouse on a local disk is refused there.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not named and warehouse.startswith(("file:", "/")) and not (sc.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is a local one")
        sc.setCheckpointDir(named or f"{warehouse}/_staged")
        folder = sc.getCheckpointDir()
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Later steps then neither repeat the work before nor lose it with an executor.
    A Parquet table rather than a row checkpoint, so readers still prune columns
    and push filters into the scan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by_key(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``stage`` in buckets of ``key``, sorted by it, as a table of the session's catalog.

    Joins and aggregates on the key read it without an exchange or a sort, as long as the other side has as
    many partitions; the default is the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stage_{uuid.uuid4().hex}"
    placed = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    placed.format("parquet").option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
