"""Runs of words that repeat with a period, found with the dictionary of basic factors.

For every power of two L, places whose next L words are equal share a name; the names of 2L are pairs of
names of L. The next occurrence of a factor, if it is at most 2L words on, proposes its distance as
a period. A proposal over L waits for the next level, where the factors overlap. There neighbouring places with
the same distance d form an arithmetic progression: the words from the first place to the last, and L + d
more, have period d, no neighbour extends them, and d is their smallest period, since a
smaller one would have been the next occurrence. A run of at least three periods holds such a place for the
first L >= d. Each period belongs to one level, which keeps every run once.

Only factors that occur twice go on to the next level, so text that does not repeat costs two or three of them;
a text of n words costs O(n log² n) at most.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.batches import on_workers, pieces_of

#: A run has at least so many words and periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def maximal_runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, length, period) by start and period of a sequence of numbers. ``longest``: no run is longer."""
    n = len(words)
    longest = n if longest is None else longest
    place, name = np.arange(n), np.unique(words, return_inverse=True)[1].astype(np.int64)
    found, size = [np.zeros((0, 3), np.int64)], 1
    while len(place) and size // 2 <= longest // LEAST_PERIODS:
        order = np.argsort(name, kind="stable")
        at, distance = place[order][:-1], np.diff(place[order])
        near = (np.diff(name[order]) == 0) & (distance <= size) & (2 * distance > size)
        at, distance = at[near], distance[near]
        order = np.argsort(at)
        at, distance = at[order], distance[order]
        if len(at):
            first = np.r_[True, (np.diff(at) != 1) | (np.diff(distance) != 0)]
            last = np.r_[first[1:], True]
            length = at[last] - at[first] + size + distance[last]
            found.append(np.stack([at[first], length, distance[last]], axis=1))
        name_at = np.full(n + size, -1, np.int64)
        name_at[place] = name
        right = name_at[place + size]
        place, key = place[right >= 0], name[right >= 0] * n + right[right >= 0]
        _, name, many = np.unique(key, return_inverse=True, return_counts=True)
        again = many[name] > 1
        place, name = place[again], name[again]
        size *= 2
    runs = np.concatenate(found)
    runs = runs[(runs[:, 1] >= LEAST_WORDS) & (runs[:, 1] >= LEAST_PERIODS * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def most_repeated(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the most periods; of equals the first, then the shorter period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def with_planted_tail(words: list, doc_id: int) -> list:
    """For one document in ten, chosen by the checksum of its id: words from a place on become a repetition of what stands there."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def described(texts: list[list[bytes]]) -> list[tuple]:
    """For each sequence of words: its runs, and the words that stay when every run keeps its first period only."""
    numbers: dict[bytes, int] = {}
    total = sum(map(len, texts))
    ids = np.empty(total + len(texts), np.int64)
    starts, at = [], 0
    for k, words in enumerate(texts):
        starts.append(at)
        ids[at : at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
        at += len(words)
        ids[at] = -1 - k  # a number of its own, so nothing repeats across two texts
        at += 1
    runs = maximal_runs(ids, max(map(len, texts), default=0))
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    lost = np.cumsum(change) > 0
    edges = np.searchsorted(runs[:, 0], [*starts, at])
    out = []
    for k, words in enumerate(texts):
        own = runs[edges[k] : edges[k + 1]]
        if not len(own):
            out.append(([], words))
            continue
        gone = lost[starts[k] : starts[k] + len(words)].tolist()
        out.append(([(s - starts[k], length, q) for s, length, q in own.tolist()], [w for w, x in zip(words, gone) if not x]))
    return out


def periodic_runs(docs: DataFrame, planted: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, ``runs array<struct<start, length, period>>`` and ``collapsed``, the words that stay joined by blanks.

    Words lie between ASCII blanks and are numbered from 0. A run has its smallest period, at least 24 words and three
    periods, and no neighbour extends it. A missing or empty text has no words, no runs and an empty ``collapsed``.
    Repeated ids each keep a row. ``planted`` makes a tail of one integer id in ten periodic first; rows without an id stay as they are.
    Texts are read whole, without a shuffle; other columns are not read.
    """
    on_workers(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            if planted:
                texts = [w if i is None else with_planted_tail(w, i) for w, i in zip(texts, batch.column(0).to_pylist())]
            rows = described(texts)
            columns = [
                batch.column(0),
                pa.array([len(w) for w in texts], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs, _ in rows], shape),
                pa.array([b" ".join(kept) for _, kept in rows], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_words", "runs", "collapsed"])

    given = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(run, f"`{id_column}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
