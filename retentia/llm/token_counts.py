"""Token counts of whole texts by the public tokenizer libraries, without keeping tokens.

Batches are balanced by bytes. Texts are split where it is safe, at white space: no token of a
vocabulary that drops white space reaches across it. Parts seen before are not encoded again;
of the library's answer only the length is kept. Vocabularies that keep white space
(``.model``, and every ``.json`` that gives tokens for it) are given whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retentia.llm.batches import on_workers, pieces_of, texts_of
from retentia.llm.bpe import Memory, chunks_of, parts_of

#: Size of each half of a worker's memory of parts, and bytes given to the library at once.
KEPT, BATCH_BYTES = 400_000, 1 << 18


def balanced(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of texts with at most ``limit`` bytes each; a longer text stands alone."""
    held, size = [], 0
    for t in texts:
        own = len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += own
    if held:
        yield held


@cache
def library(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one worker per core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def drops_white_space(path: str) -> bool:
    """Whether white space gives no tokens, alone, around and between words, and no added token holds any."""
    tokenizer = library(path)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    added = any(chunks_of(t.content) != [t.content] for t in tokenizer.get_added_tokens_decoder().values())
    blanks = [b for b in (" ", "  ", "\n", "\r\n", "\t", " \n ") if ids(b) or ids(f"{b}ab{b}cd1{b}") != ids("ab") + ids("cd1")]
    return not added and not blanks


@cache
def word_lengths(path: str) -> Memory:
    """Token counts of texts without white space, from the ``tokenizers`` library."""
    tokenizer = library(path)

    def learn(chunks: Iterable[str]) -> dict[str, int]:
        known = {}
        for part in balanced(chunks):
            known.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return known

    return Memory(learn, KEPT)


@cache
def pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def counts(texts: list[str], path: str) -> list[int]:
    """Number of tokens of each text."""
    if path.endswith(".model"):
        return [len(ids) for part in balanced(texts) for ids in pieces(path).encode(part, num_threads=1)]
    if not drops_white_space(path):
        return [len(e) for part in balanced(texts) for e in library(path).encode_batch_fast(part, add_special_tokens=False)]
    totals = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= BATCH_BYTES]
    memory = word_lengths(path)
    cut = [chunks_of(texts[i]) for i in short]
    known = memory.of(set().union(*cut))
    for i, chunks in zip(short, cut):
        totals[i] = sum(map(known.__getitem__, chunks))
    for i in set(range(len(texts))).difference(short):
        for part in parts_of(texts[i], BATCH_BYTES):
            chunks = chunks_of(part)
            totals[i] += sum(map(memory.of(set(chunks)).__getitem__, chunks))
    return totals


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A missing or empty text has no bytes and no tokens. Repeated ids stay apart; an empty table gives no rows. No shuffle.
    """
    on_workers(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            n = pa.array(counts(batch.column(2).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], [id_column, "n_bytes", "n_tokens"])

    sized = texts_of(docs, id_column, text=text).select(id_column, F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
