"""Best-fit packing of token pieces, planned over a histogram of lengths.

Best fit needs only how many pieces there are of each length, at most ``size`` numbers. The plan says
which ranks of a length go to which sequences at which offset; pieces then take their slots by
joining on their rank within the length. Ranks are numbered inside hashed buckets and moved by the
counts of the buckets before, so that a length with most of the pieces is not one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.llm.batches import on_workers, pieces_of, staged, texts_of
from retentia.llm.bpe import encoded_parts, pack, unpack

SIZE = 2048
#: Buckets in which the ranks of a length are numbered.
BUCKETS = 512


def best_fit_plan(counts: Mapping[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slots for ``counts[length]`` pieces: (length, first rank, rank after the last, first sequence, offset).

    Longest first, each piece into the fullest sequence that still has room. Sequences with the same
    room are handled together, so the work depends on the number of lengths, not of pieces. Rank
    ``first + i`` of a row takes sequence ``first sequence + i``.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, first, n = size, sequences, -(-left // (size // length))
                sequences += n
            else:
                room = rooms[at]
                first, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            for k in range(each if full else 0):
                plan.append((length, rank, rank + full, first, size - room + k * length))
                rank += full
            left -= full * each
            put(room - each * length, first, full)
            first, n = first + full, n - full
            if n and left:
                some = min(left, each)
                for k in range(some):
                    plan.append((length, rank, rank + 1, first, size - room + k * length))
                    rank += 1
                left -= some
                put(room - some * length, first, 1)
                first, n = first + 1, n - 1
            put(room, first, n)
    return plan


def ranked(pieces: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank``, from 0 within each length; ``order`` decides within a bucket."""
    cut = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    counts = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    moved = counts.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*order)) - 1
    return cut.withColumn("_nth", nth).join(moved, ["length", "_bucket"]).withColumn("rank", F.col("_nth") + F.col("_before")).drop("_bucket", "_nth", "_before")


def pack_pieces(pieces: DataFrame, *order: str, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``size``.

    ``pieces`` is read three times, so give a stored table. Equal pieces may swap slots between
    runs; every run is a whole and gapless packing. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    if counts and not 1 <= min(counts) <= max(counts) <= size:
        raise ValueError(f"piece lengths must be from 1 to {size}")
    plan = spark.createDataFrame(best_fit_plan(counts, size), "length long, _from long, _to long, _first long, offset long")
    slot = ranked(pieces, *order).join(F.broadcast(plan), "length").filter((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
    return slot.withColumn("sequence_id", F.col("_first") + F.col("rank") - F.col("_from")).drop("rank", "_from", "_to", "_first")


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece, start, length, ids_crc32 and, if wanted, ``ids array<int>``.

    A document is its tokens and ``end_id``; only longer ones are cut, and just their last piece may be
    shorter. A missing or empty text has the end token alone.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            rows, owner = [], []
            for at, parts in enumerate(encoded_parts(batch.column(1).to_pylist(), path)):
                whole = b"".join(parts) + pack([end_id])
                for k, a in enumerate(range(0, len(whole), 4 * size)):
                    cut = whole[a : a + 4 * size]
                    owner.append(at)
                    rows.append((k, a // 4, len(cut) // 4, zlib.crc32(cut), *((unpack(cut),) if with_ids else ())))
            kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *columns], ["doc_id", *[n for n, _ in kinds]])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts_of(docs, "doc_id").mapInArrow(run, schema)


def packed_documents(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their place. Texts are encoded once; the pieces are stored in the shared folder."""
    pieces = staged(token_pieces(docs, path, end_id, size, with_ids))
    return pack_pieces(pieces, "doc_id", "piece", "ids_crc32", size=size)
