"""Helpers shared by the operators that run Python over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.sources.sink import on_workers  # noqa: F401


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else one below the warehouse, which on a cluster must not be a local disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not folder and warehouse.startswith(("file:", "/")) and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is a local one")
    return folder or warehouse + "/_retentia"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces_of(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each; a longer text stands alone.

    After the last one Arrow gives back what it keeps for reuse: the worker may wait through stages that need the room.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    batch = None
    pa.default_memory_pool().release_unused()


def texts_of(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns, then the text (missing: empty). Other columns are not read."""
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
