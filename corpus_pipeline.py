"""A training corpus made from ``documents``: rejects go, shared lines go, copies go, secrets are masked, the rest is packed.

Each stage takes (spark, docs, folder of the tables) and works on all rows that the one before kept. All
but the last return the columns they were given, with ``n_chars`` brought up to date where a text
changed. Missing texts stay missing and are packed as empty; rows without a doc_id pass every filter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import importance, line_dedup, near_dedup, packing, secret_scan
from retentia.llm.batches import staged
from retentia.llm.queries import VOCABULARY


def with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The given columns with a new text where there was one, and its length."""
    changed = docs.withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))
    return changed.select(columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(line_dedup.drop_common_lines(docs), F.col("text"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(secret_scan.redact_secrets(docs), F.col("text"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("secret scan", secrets), ("packing", pack)]

# A fitted model, sketches and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
