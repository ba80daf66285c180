"""Nearest neighbours by largest inner product, with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook; a pair of centroids is a cell.
Every row is indexed in its cell. A query visits cells by the sum of its halves' distances to the
centroids, taken from a heap, until the cells hold its share of the rows; all rows of the visited
cells are then ranked by their exact inner product; rows below the query's k-th best score among the
sample's rows in these cells cannot be in the answer and are not passed on. How large the share must be is measured
against exact search on the sample that the codebooks are trained on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.llm.batches import on_workers

#: Centroids per half, rows the codebooks are trained on (chosen by the hash of the id), rounds of training.
SIDE, SAMPLE, ROUNDS = 16, 20_000, 10
#: Recall wanted on the sample, and queries it is measured with.
RECALL, TRIALS = 0.96, 200
#: Rows of a list that are ranked together, and queries they are ranked for; larger ones are split.
ENTRY_BLOCK, QUERY_BLOCK = 1024, 32_768


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): rows with an id and a vector of the table's usual length whose components are finite and not all 0."""
    v = F.col("embedding").cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    )
    usual = whole.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return whole.filter(F.size("vector") == (usual[0]["n"] if usual else 0))


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spaced rows of the sorted sample; a centroid that loses its rows stays where it was."""
    order = np.lexsort(x.T) if x.shape[1] else np.arange(len(x))
    centroids = x[order[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]].copy()
    for _ in range(ROUNDS):
        own = nearest_centroids(x, centroids)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def visited(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells by summed distance until they hold ``wanted`` rows. ``first`` and ``second`` are the distances to the centroids, ``sizes`` the rows of each cell."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        if sizes[a[i], b[j]]:
            out.append((int(a[i]), int(b[j])))
            held += int(sizes[a[i], b[j]])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


class Index:
    """Codebooks of both halves; small, whatever the table."""

    def __init__(self, sample: np.ndarray, side: int = SIDE):
        self.half = max(1, sample.shape[1] // 2)
        self.first, self.second = codebook(sample[:, : self.half], side), codebook(sample[:, self.half :], side)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_centroids(x[:, : self.half], self.first), nearest_centroids(x[:, self.half :], self.second)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((self.first - q[: self.half]) ** 2).sum(1), ((self.second - q[self.half :]) ** 2).sum(1)

    def counted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sizes = np.zeros((len(self.first), len(self.second)), np.int64)
        np.add.at(sizes, (a, b), 1)
        return sizes

    def share_for(self, sample: np.ndarray, k: int, recall: float) -> float:
        """Smallest share of the rows, in twentieths, whose cells hold ``recall`` of the sample's true neighbours."""
        if len(sample) <= k + 1:
            return 1.0
        a, b = self.cells(sample)
        sizes = self.counted(a, b)
        trials = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
        shares, found = np.arange(1, 21) / 20, np.zeros(20)
        for q in trials:
            scores = sample @ sample[q]
            scores[q] = -np.inf
            best = np.argpartition(-scores, k)[:k]
            order = visited(*self.distances(sample[q]), sizes, len(sample))
            at = {cell: i for i, cell in enumerate(order)}
            held = np.cumsum([sizes[c] for c in order])
            before = np.r_[0, held[:-1]][[at[c] for c in zip(a[best].tolist(), b[best].tolist())]]
            found += (before[None, :] < shares[:, None] * len(sample)).mean(1)
        enough = np.flatnonzero(found / len(trials) >= recall)
        return float(shares[enough[0]]) if len(enough) else 1.0


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(entries: pa.Table, queries: pa.Table, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each query its k best entries in the cells it visits: (query_id, its vector's mark, ids, scores). Equal vectors get equal scores."""
    ids, cell, x = entries["vec_id"].to_numpy(), entries["second"].to_numpy(), matrix(entries["vector"])
    for start in range(0, len(queries), 512):
        part = queries.slice(start, 512)
        q = matrix(part["vector"])
        rough = q @ x.T
        for i, (query, mark, cells, floor) in enumerate(zip(*[part[c].to_pylist() for c in ("query_id", "mark", "cells", "floor")])):
            near = np.flatnonzero(np.isin(cell, cells) & (ids != query) & (rough[i] >= floor))
            if len(near) > k:
                scores = rough[i, near]
                least = np.partition(scores, len(near) - k)[len(near) - k]
                near = near[scores >= least - 1e-9 * max(1.0, abs(least))]
            exact = (x[near] * q[i]).sum(1)
            order = np.lexsort((ids[near], -exact))[:k]
            yield query, mark, ids[near][order], exact[order]


def search(vectors: DataFrame, is_query, k: int = 20, side: int = SIDE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows but itself; all of them if there are fewer.

    ``is_query`` is a condition on vec_id. Scores are inner products in double precision, ties go to the
    smaller vec_id. Vectors that are null, zero, of another length or hold null or non-finite
    components take no part. Rows that share a vec_id are rows of their own but never neighbours of that id: as queries
    each of their different vectors is asked once and has its own ranks. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    on_workers(spark)
    rows = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample_ids, sample = chosen["vec_id"].to_numpy(), matrix(chosen["vector"])
    if not len(sample):
        return spark.createDataFrame([], schema)
    index = Index(sample, side)
    share = index.share_for(sample, k, recall)
    sample_cells = index.cells(sample)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = index.cells(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["vec_id", "vector", "first", "second"])

    indexed = rows.mapInArrow(place, "vec_id long, vector array<double>, first int, second int")
    sizes = np.zeros((len(index.first), len(index.second)), np.int64)
    for a, b, n in indexed.groupBy("first", "second").count().collect():  # side * side rows at most
        sizes[a, b] = n
    wanted = max(int(np.ceil(share * sizes.sum())), k + 1)
    blocks = np.maximum(1, -(-sizes.sum(1) // ENTRY_BLOCK))
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "vector"]).withColumn("mark", F.xxhash64("vector"))
    groups = max(1, -(-asked.count() // QUERY_BLOCK))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lists, cells, parts, floors = [], [], [], [], []
            for i, q in enumerate(matrix(batch.column(1))):
                order = visited(*index.distances(q), sizes, wanted)
                seen = np.zeros(sizes.shape, bool)
                seen[tuple(np.array(order).T)] = True
                others = (sample @ q)[seen[sample_cells] & (sample_ids != batch.column(0)[i].as_py())]
                floor = np.partition(others, len(others) - k)[len(others) - k] if len(others) > k else -np.inf
                floor -= 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else 0
                mine: dict[int, list[int]] = {}
                for a, b in order:
                    mine.setdefault(a, []).append(b)
                for a, seconds in mine.items():
                    for part in range(blocks[a]):
                        at.append(i)
                        lists.append(a)
                        cells.append(seconds)
                        parts.append(part)
                        floors.append(float(floor))
            for s in range(0, len(at), 4096):
                cut = slice(s, s + 4096)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(at[cut])) for c in batch.columns], pa.array(lists[cut], pa.int32()), pa.array(cells[cut], pa.list_(pa.int32())), pa.array(parts[cut], pa.int32()), pa.array(floors[cut], pa.float64())],
                    ["query_id", "vector", "mark", "first", "cells", "part", "floor"])

    def rank(entries: pa.Table, queries: pa.Table) -> pa.Table:
        found = list(best_of(entries, queries, k)) if len(entries) and len(queries) else []
        query, mark = (np.repeat([f[i] for f in found], [len(f[2]) for f in found]) if found else [] for i in (0, 1))
        ids, scores = (np.concatenate([f[i] for f in found]) if found else [] for i in (2, 3))
        return pa.table({"query_id": pa.array(query, pa.int64()), "mark": pa.array(mark, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    n_blocks = F.get(F.array(*[F.lit(int(n)) for n in blocks]), F.col("first"))
    entries = indexed.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = asked.mapInArrow(route, "query_id long, vector array<double>, mark long, first int, cells array<int>, part int, floor double")
    queries = queries.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    keys = ["first", "part", "group"]
    found = entries.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(rank, "query_id long, mark long, vec_id long, score double")
    nth = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
