"""Quality classifier by importance resampling.

Texts become bags of hashed n-grams: lower-case words, word shapes and pairs of neighbouring shapes (a
word said twice counts as a pair of its own). Two generative models are the shares of the hash
buckets in target texts and in all raw texts. The log of their ratio, summed over a text, is the log
of its importance; Gumbel noise makes the top-k of the sums a sample without replacement, weighted by
the importance (with ``sharpness`` other than 1, by that power of it).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from retentia.llm.batches import on_workers, pieces_of, staged
from retentia.llm.bpe import Memory, parts_of

BUCKETS = 10_007
#: Labelled target documents that the target model is fitted on, at most; chosen by the hash of the id.
TARGET_SAMPLE = 20_000
#: Texts with a log ratio from here on set the size of the sample; noise is divided by the sharpness.
LEAST_LOG_RATIO, SHARPNESS = -8.0, 1.0
#: n-grams with the shares of the raw text that are added to those of the target, and standard errors that a ratio is moved towards 0.
PRIOR, ERRORS = 1000.0, 2.0
#: Different keys next to the cut that are compared on the driver, at most; more are narrowed down further.
AT_CUT = 10_000
KEPT = 200_000
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs once; signs at the end stay as they are, up to three."""
    core = word.rstrip(MARKS)
    tail = word[len(core) :][:3]
    if core.isalpha():
        kind = "a" if core.islower() else "A" if core.isupper() else "Aa" if core.istitle() else "aA"
    else:
        kind = ""
        for c in core:
            x = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
            if not kind.endswith(x):
                kind += x
            if len(kind) == 6:
                break
    return kind + tail


def learn(words: Iterable[str]) -> dict[str, bytes]:
    """Hashes of each word and of its shape, packed."""
    return {w: np.array([zlib.crc32(w.lower().encode()), zlib.crc32(shape(w).encode())], "<u4").tobytes() for w in words}


@cache
def memory() -> Memory:
    return Memory(learn, KEPT)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(BUCKETS)


def ngrams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text."""
    found = []
    for part in parts_of(text):
        words = part.split()
        known = memory().of(set(words))
        h = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4").astype(np.uint64).reshape(-1, 2)
        same = h[1:, 0] == h[:-1, 0]
        pairs = np.where(same, np.uint64(1), (h[:-1, 1] << np.uint64(32)) | h[1:, 1])
        found += [mixed(h[:, 0], 1), mixed(h[:, 1], 2), mixed(pairs, 3)]
    return np.concatenate(found).astype(np.int64)


def target_ids(labels: DataFrame) -> DataFrame:
    """At most ``TARGET_SAMPLE`` ids of documents labelled good and not toxic."""
    good = labels.filter("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_SAMPLE)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target to raw share for each bucket, moved towards 0 by ``ERRORS`` standard errors, so that rare n-grams say nothing. Raw counts are over all documents; without a target all are 0."""
    on_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in pieces_of(batches, "text"):
            for is_target, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.bincount(ngrams(text or ""), minlength=BUCKETS)
                raw += counts
                if is_target:
                    target += counts
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    ids = F.broadcast(target_ids(labels).withColumn("is_target", F.lit(True)))  # TARGET_SAMPLE rows at most
    flagged = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("is_target", "text")
    summed = flagged.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in summed.collect():  # BUCKETS rows at most
        raw[bucket] += r
        target[bucket] += t
    if not target.sum():
        return np.zeros(BUCKETS)
    share = np.maximum(raw, 1) / np.maximum(raw, 1).sum()
    ratio = np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share)
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - ERRORS * np.sqrt(1 / (target + 1) + 1 / (raw + 1)))


def keyed(docs: DataFrame, ratio: np.ndarray, sharpness: float = SHARPNESS) -> DataFrame:
    """The documents with ``n_ngrams``, ``log_ratio`` and ``sample_key``: the log ratio plus Gumbel noise drawn from the hash of id and text."""
    on_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            grams = [ngrams(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            sums = pa.array([float(ratio[g].sum()) for g in grams], pa.float64())
            sizes = pa.array([len(g) for g in grams], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, sums], [*batch.schema.names, "n_ngrams", "log_ratio"])

    schema = StructType([*docs.schema.fields, StructField("n_ngrams", LongType()), StructField("log_ratio", DoubleType())])
    scored = docs.mapInArrow(run, schema)
    uniform = (F.pmod(F.xxhash64("doc_id", "text", F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("sample_key", F.col("log_ratio") - F.log(-F.log(uniform)) / sharpness)


def cut_of(keys: DataFrame, k: int) -> float | None:
    """The k-th largest ``sample_key``: bins around it are counted and narrowed until few keys are left to sort. None for no k."""
    low, high = keys.agg(F.min("sample_key"), F.max("sample_key")).first()
    if low is None or k <= 0:
        return None
    above = 0
    while True:
        inside = keys.filter((F.col("sample_key") >= low) & (F.col("sample_key") <= high))
        step = (high - low) / 1024
        bins = {int(b): n for b, n in inside.groupBy(F.floor((F.col("sample_key") - low) / (step or 1.0)).alias("b")).count().collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b] >= k:
                break
            above += bins[b]
        # Wide enough for the rounding of the bins; a range that cannot be narrowed holds a few dozen different numbers.
        reach = 8 * float(np.spacing(max(abs(low), abs(high))))
        narrow_low, narrow_high = max(low, low + b * step - reach), min(high, low + (b + 1) * step + reach)
        held = keys.filter((F.col("sample_key") >= narrow_low) & (F.col("sample_key") <= narrow_high))
        if bins[b] <= AT_CUT // 2 or narrow_high - narrow_low >= (high - low) * 0.99:
            distinct = held.groupBy("sample_key").count().orderBy(F.desc("sample_key")).limit(AT_CUT).collect()
            over = keys.filter(F.col("sample_key") > narrow_high).count()
            for key, n in distinct:
                over += n
                if over >= k:
                    return key
            return narrow_low
        above = keys.filter(F.col("sample_key") > narrow_high).count()
        low, high = narrow_low, narrow_high


def sample_cut(keys: DataFrame, least_log_ratio: float = LEAST_LOG_RATIO) -> float | None:
    """Key from which documents are in the sample, whose size is the number of texts with at least ``least_log_ratio``."""
    return cut_of(keys, keys.filter(F.col("log_ratio") >= least_log_ratio).count())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_ngrams, log_ratio, sample_key, selected.

    A missing or empty text has no n-grams and log ratio 0. Keys equal at the cut are all selected; rows
    that repeat have equal keys. Without good labels all log ratios are 0 and every document stays.
    """
    given = docs.select("doc_id", "text")
    keys = staged(keyed(given, fit(given, labels)).drop("text"))
    cut = sample_cut(keys)
    return keys.withColumn("selected", F.lit(False) if cut is None else F.col("sample_key") >= cut)


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents in the sample, columns as given. Scored twice rather than shuffled: first for the cut, then to filter."""
    given = docs.select("doc_id", "text")
    ratio = fit(given, labels)
    cut = sample_cut(staged(keyed(given, ratio).select("log_ratio", "sample_key")))
    names = docs.columns
    wide = docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(names)])
    chosen = keyed(wide, ratio).filter(F.lit(False) if cut is None else F.col("sample_key") >= cut)
    return chosen.drop("n_ngrams", "log_ratio", "sample_key").toDF(*names)
