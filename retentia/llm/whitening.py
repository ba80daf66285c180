"""Whitening of embeddings: projections on the leading components, scaled to variance one.

Entries become integers on a grid, so sums and cross products over all rows are exact and the same however
the rows are split. Rows are centred on the rounded mean before multiplying; the rest of the mean is
taken out in integers. The leading eigenvalues are found by slicing the spectrum: the positive pivots of
an LDLᵀ factorisation of the covariance less a shift count the eigenvalues above it, which isolates each
one; Rayleigh quotient iteration inside its slice converges cubically, and two more counts certify that
the value found has the number it is given. What passes the driver is one row per pair of dimensions,
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.batches import on_workers, staged

# The grid of the entries.
STEPS, SHIFT = 1024, 100_000
#: Grid numbers are held within this range, in which doubles are exact.
FARTHEST = 1 << 52
#: The pivot rule that bounds the growth of the entries.
PIVOT = (1 + 17**0.5) / 8
EPS = float(np.finfo(np.float64).eps)


class Spectrum(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def positive_pivots(matrix: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix, from the pivots of LDLᵀ with blocks of one or two."""
    a, count = np.array(matrix, np.float64), 0
    while len(a):
        r = int(np.abs(a.diagonal()).argmax())
        column = np.abs(a[:, r])
        column[r] = 0
        q = int(column.argmax())
        pivot = [r]
        if column[q] > 0 and abs(a[r, r]) < PIVOT * column[q]:
            other = np.abs(a[:, q])
            other[q] = 0
            if abs(a[r, r]) * other.max() < PIVOT * column[q] ** 2:
                pivot = [q] if abs(a[q, q]) >= PIVOT * other.max() else [r, q]
        block = a[np.ix_(pivot, pivot)]
        count += 1 if len(pivot) == 2 else int(block[0, 0] > 0)  # a block of two has one eigenvalue of each sign
        if len(pivot) == 1 and block[0, 0] == 0:
            a = np.delete(np.delete(a, r, 0), r, 1)
            continue
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return count


def solved(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Columns of (matrix - shift)⁻¹ right, each of length one; a shift that is an eigenvalue is moved by a rounding error."""
    size = max(float(np.abs(matrix).max()), 1e-300)
    for step in (0.0, EPS, 8 * EPS):
        try:
            out = np.linalg.solve(matrix - (shift + step * size) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        most = np.abs(out).max(axis=0)
        if np.isfinite(most).all() and most.all():
            out = out / most
            return out / np.linalg.norm(out, axis=0)
    return right


def leading(matrix: np.ndarray, k: int) -> Spectrum:
    """The ``k`` largest eigenvalues above rounding error, falling, and their vectors as columns.

    Equal eigenvalues get an orthonormal basis of their space. The largest entry of a vector is positive.
    """
    d = len(matrix)
    trace = float(np.trace(matrix))
    bound = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    least = 8 * d * EPS * bound
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = positive_pivots(matrix - shift * np.eye(d))
        return counts[shift]

    wanted = min(k, above(least)) if bound > 0 else 0
    values, vectors = np.zeros(wanted), np.zeros((d, wanted))
    draw = np.random.default_rng(11)
    i = 0
    while i < wanted:
        low = max([s for s, c in counts.items() if c > i])
        high = min([s for s, c in counts.items() if c <= i], default=bound * (1 + 4 * EPS))
        while high - low > 16 * EPS * bound:
            many = above(low) - (counts[high] if high in counts else 0)
            if many == 1 and (found := refined(matrix, low, high, bound, draw)) is not None:
                value, vector, error = found
                reach = 4 * max(error, 4 * EPS * bound)
                if above(value - reach) == i + 1 and above(value + reach) == i:
                    values[i], vectors[:, i] = value, vector
                    i += 1
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > i else (low, middle)
        else:
            # What one rounding error holds together is one space.
            many = min(above(low), wanted) - i
            space = draw.standard_normal((d, many))
            for _ in range(4):
                space -= vectors[:, :i] @ (vectors[:, :i].T @ space)
                space = np.linalg.qr(solved(matrix, (low + high) / 2, space))[0]
            values[i : i + many], vectors[:, i : i + many] = (low + high) / 2, space
            i += many
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)]) if wanted else np.zeros(0)
    return Spectrum(values, vectors * signs, trace)


def refined(matrix: np.ndarray, low: float, high: float, bound: float, draw: np.random.Generator) -> tuple[float, np.ndarray, float] | None:
    """The eigenvalue of a slice that holds one, its vector and the residual, by Rayleigh quotient iteration; None if the iteration leaves the slice."""
    vector = solved(matrix, (low + high) / 2, draw.standard_normal((len(matrix), 1)))[:, 0]
    vector = solved(matrix, (low + high) / 2, vector[:, None])[:, 0]
    best = None
    for _ in range(12):
        value = float(vector @ matrix @ vector)
        error = float(np.linalg.norm(matrix @ vector - value * vector))
        if best is not None and error >= best[2]:
            break
        best = (value, vector, error)
        vector = solved(matrix, value, vector[:, None])[:, 0]
    return best if low < best[0] <= high and best[2] <= 64 * EPS * bound else None


def grid(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows of grid numbers as integers."""
    vectors = batch.column(batch.schema.get_field_index(column))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(STEPS * flat), -FARTHEST, FARTHEST).astype(np.int64).reshape(batch.num_rows, -1) + SHIFT


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right of integers without rounding, as Python integers."""
    bound = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64).astype(object)
    return left.astype(object) @ right.astype(object)


def numbers(values: Iterable[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def usable(embeddings: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """(id, vector) of the rows that take part, and the width: that of most rows, the larger of equals."""
    given = embeddings.select(F.col(f"`{id_column}`"), F.col(f"`{vector}`").alias("vector"))
    finite = given.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    widths = finite.groupBy(F.size("vector").alias("width")).count().filter("width > 0")
    top = widths.orderBy(F.desc("count"), F.desc("width")).first()
    return finite.filter(F.size("vector") == (top["width"] if top else -1)), top["width"] if top else 0


def sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension; a row per dimension and task meets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            n += batch.num_rows
            total += exact_products(np.ones((1, batch.num_rows), np.int64), grid(batch, "vector"))[0]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), numbers(total)], ["i", "n", "total"])

    made = rows.select("vector").mapInArrow(run, "i int, n long, total decimal(38,0)")
    found = made.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def covariance(rows: DataFrame, n: int, totals: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The covariance with divisor ``n``, each entry rounded once; the rounded means, and what the means lack to n times that."""
    width = len(totals)
    centre = np.array([(2 * t + n) // (2 * n) for t in totals], np.int64)
    left = np.array([t - n * int(c) for t, c in zip(totals, centre)], object)
    i, j = np.triu_indices(width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            z = grid(batch, "vector") - centre
            total += exact_products(z.T, z)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), numbers(total[i, j])], ["i", "j", "total"])

    made = rows.select("vector").mapInArrow(run, "i int, j int, total decimal(38,0)")
    out = np.zeros((width, width))
    for a, b, total in made.groupBy("i", "j").agg(F.sum("total")).collect():
        out[a, b] = out[b, a] = (n * int(total) - left[a] * left[b]) / (n * n)
    return out, centre, left


def projected(rows: DataFrame, id_column: str, n: int, centre: np.ndarray, left: np.ndarray, spectrum: Spectrum) -> DataFrame:
    """(id, deviation, whitened): the exact sum of (n x - S)², and one number per component."""
    kind = rows.schema[id_column].dataType.simpleString()
    rest = np.array([int(v) / n for v in left])
    scaled = spectrum.vectors / np.sqrt(spectrum.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = grid(batch, "vector") - centre
            reach = n * int(np.abs(z).max()) + n
            own = z if reach * reach * len(centre) < 1 << 62 else z.astype(object)
            y = own * n - (left.astype(np.int64) if own is z else left)
            squares = (y * y).sum(axis=1)
            fits = [Decimal(int(v)) if v < 10**38 else None for v in squares]
            whitened = (z - rest) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * scaled.shape[1], pa.int32()), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fits, pa.decimal128(38, 0)), lists], [id_column, "deviation", "whitened"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(embeddings: DataFrame, components: int = 8, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do vectors of
    another width than most have. Repeated rows count as often as they occur and each give their own rows; a null id stays.
    Components whose variance is zero but for rounding have no whitened value and are left out, so equal vectors,
    a single vector or an empty table give no row. Of equal variances any basis is right. Entries beyond 2**52 steps
    of the grid count as that far; ``deviation`` is decimal(38,0), null where it is longer.
    """
    spark = embeddings.sparkSession
    on_workers(spark)
    rows, width = usable(embeddings, id_column, vector)
    n, totals = sums(rows, width)
    spectrum = Spectrum(np.zeros(0), np.zeros((0, 0)), 0.0)
    if n:
        matrix, centre, left = covariance(rows, n, totals)
        spectrum = leading(matrix, components)
    k = len(spectrum.values)
    kind = embeddings.schema[id_column].dataType.simpleString()
    if not k:
        return spark.createDataFrame([], f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    scores = staged(projected(rows, id_column, n, centre, left, spectrum))
    of = lambda i: F.get("whitened", F.lit(i))
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    seen = scores.agg(*[F.covar_pop(of(i), of(j)).alias(f"c{i}_{j}") for i, j in cells]).first()
    error = max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in cells)
    explained = F.array(*[F.lit(float(v) / spectrum.trace) for v in spectrum.values])
    each = scores.select(F.col(f"`{id_column}`"), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        F.col(f"`{id_column}`"), (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
