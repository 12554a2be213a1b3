"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

The scatter A of d dimensions is summed over all rows in Spark; only d x d numbers reach the driver.
Pivoted Cholesky gives P'AP = LL'. Rotating pairs of columns of L until all are orthogonal gives a
matrix whose squared column norms are the eigenvalues of A and whose normalised columns, in the
order before pivoting, are its eigenvectors. A itself is never diagonalised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard
from .common import stage, staged
from .vectors import matrix

#: A component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Beyond it a whole number is not exact as a double; vectors with larger entries take no part.
_EXACT = 1 << 53


def pivoted_cholesky(a: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """F with F F' = a, of as many columns as the rank of `a`.

    The largest remaining diagonal entry is the pivot; rows stay in their order, which is that of
    the triangular factor with the row exchanges undone. It ends when no remaining entry exceeds
    `tolerance` of the largest.
    """
    rest = np.diag(a).astype(np.float64).copy()
    least = tolerance * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros_like(a, dtype=np.float64)
    left = np.ones(len(a), dtype=bool)
    for k in range(len(a)):
        pivot = int(np.argmax(np.where(left, rest, -np.inf)))
        if rest[pivot] <= least:
            return factor[:, :k]
        left[pivot] = False
        root = np.sqrt(rest[pivot])
        factor[pivot, k] = root
        factor[left, k] = (a[left, pivot] - factor[left, :k] @ factor[pivot, :k]) / root
        rest[left] -= factor[left, k] ** 2
    return factor


def _pairings(n: int):
    """Rounds of disjoint pairs in which every two of n columns meet once."""
    seats = list(range(n + n % 2))
    half = len(seats) // 2
    for _ in range(max(len(seats) - 1, 0)):
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if max(a, b) < n]
        yield np.array([p[0] for p in pairs], dtype=int), np.array([p[1] for p in pairs], dtype=int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def one_sided_jacobi(factor: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> np.ndarray:
    """`factor` with its columns rotated in pairs until they are orthogonal, longest column first."""
    columns = factor.T.copy()  # a column is a row here, so pairs lie next to each other
    rounds = list(_pairings(len(columns)))
    for _ in range(sweeps):
        worst = 0.0
        for p, q in rounds:
            x, y = columns[p], columns[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            scale = np.sqrt(xx * yy)
            off = np.abs(xy) / np.where(scale > 0, scale, 1.0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > tolerance
            if not turn.any():
                continue
            p, q, x, y = p[turn], q[turn], x[turn], y[turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cosine = 1 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            columns[p] = cosine[:, None] * x - sine[:, None] * y
            columns[q] = sine[:, None] * x + cosine[:, None] * y
        if worst <= tolerance * max(len(columns), 8):
            break
    norms = np.sqrt((columns**2).sum(1))
    return columns[np.argsort(-norms, kind="stable")].T


@dataclass(frozen=True)
class Whitening:
    """n rows with per-dimension sums; eigenvalues by size, components as rows, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float


def taking_part(vector: Column) -> Column:
    """Whether a vector is not null or empty and all its entries are finite numbers.

    An entry so large that its whole number is not exact as a double counts as not finite.
    """
    limit = F.lit(float((_EXACT - SHIFT) // SCALE - 1))
    # NaN is greater than any number here.
    entries = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < limit))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & entries, F.lit(False))


def _whole(column: pa.Array) -> np.ndarray:
    return (np.floor(SCALE * matrix(column)) + SHIFT).astype(np.int64)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S; Python's whole numbers where 64 bits could be too few."""
    if len(x) and n * max(int(np.abs(x).max()), 1) + max(map(abs, sums), default=0) >= 1 << 62:
        return n * x.astype(object) - np.array(sums, dtype=object)
    return n * x - np.array(sums, dtype=np.int64)


def _squared_length(deviations: np.ndarray) -> list[int | None]:
    """The exact sum of squares of every row, null where it does not fit a long."""
    if not len(deviations):
        return []
    largest = max(int(np.abs(deviations).max()), 1)
    if largest**2 * deviations.shape[1] < 1 << 63:
        return (deviations.astype(np.int64) ** 2).sum(1).tolist()
    exact = (deviations.astype(object) ** 2).sum(1)
    return [s if s < 1 << 63 else None for s in exact.tolist()]


def vector_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number and per-dimension sums of the vectors in column v that are of the most frequent length (ties: the longer)."""

    def compute(batches):
        held: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                x = _whole(column.filter(pa.array(sizes == dim)))
                own = held.setdefault(dim, [0, np.zeros(dim, dtype=object)])
                own[0] += len(x)
                own[1] += _column_sums(x)
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string())),
            ], ["dim", "n", "sums"])

    parts = rows.select("v").mapInArrow(compute, "dim int, n long, sums array<string>")
    each = parts.select("dim", "n", F.posexplode("sums").alias("at", "s"))
    totals = each.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    chosen = totals.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums"))
    first = chosen.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return (first[0].n, [int(s.s) for s in first[0].sums]) if first else (0, [])


def _column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums, by halves of 32 bits."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)


def _moments(rows: DataFrame, d: int, batch_rows) -> np.ndarray:
    """The sum over all rows of the products of the d numbers that `batch_rows` gives per row of a batch.

    Every task adds up its own d x d products; Spark adds the tasks' entries and the driver gets d rows.
    """

    def compute(batches):
        total = np.zeros((d, d))
        for batch in batches:
            y = batch_rows(batch)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.mapInArrow(compute, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    summed = parts.groupBy("i", "j").agg(F.sum("x").alias("x"))
    table = summed.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("row")).toArrow()
    out = np.zeros((d, d))
    for i, row in zip(table.column("i").to_pylist(), table.column("row").to_pylist()):
        out[i] = [e["x"] for e in row]
    return out


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of the vectors in column v; None without rows or variance. Reads the rows twice."""
    n, sums = vector_sums(rows)
    if not n:
        return None
    d = len(sums)
    scatter = _moments(
        rows.where(F.size("v") == d).select("v"), d,
        lambda batch: _deviations(_whole(batch.column(0)), n, sums).astype(np.float64) / n,
    )
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))
    squares = (rotated**2).sum(0)
    kept = min(components, len(squares))
    vectors = (rotated[:, :kept] / np.sqrt(squares[:kept])).T
    return Whitening(n, tuple(sums), squares[:kept] / n, vectors, float(np.trace(scatter)) / n) if kept else None


def whiten(embeddings: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out, and of vectors of
    different lengths only the most frequent length takes part (ties: the longer). All others are
    fitted on and returned, repeated and zero vectors and null vec_ids included. There are as many
    components as the covariance has rank, at most `components`; no rows for none. `deviation` is
    null where it does not fit a long. Only vec_id and the vector are read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v")).where(taking_part(F.col("v")))
    model = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums, k = model.n, model.sums, len(model.eigenvalues)
    projection = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def compute(batches):
        for batch in batches:
            deviations = _deviations(_whole(batch.column(1)), n, sums)
            whitened = (deviations.astype(np.float64) / n) @ projection
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(_squared_length(deviations), pa.int64()),
                pa.array(list(whitened), pa.list_(pa.float64())),
            ], ["vec_id", "deviation", "whitened"])

    projected = rows.where(F.size("v") == len(sums)).mapInArrow(compute, "vec_id long, deviation long, whitened array<double>")
    held, path = stage(projected, "whitened")
    error = identity_error(held, n, k)
    explained = F.lit([float(e) / model.trace for e in model.eigenvalues])
    out = staged(held.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(error).alias("identity_error"),
    ), "whitened_rows")
    discard(embeddings.sparkSession, path)
    return out


def identity_error(held: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of `whitened`, as written, minus the identity."""
    means = held.agg(*[(F.sum(F.col("whitened")[i]) / n).alias(f"m{i}") for i in range(k)]).first()
    middle = np.array([float(m) for m in means])
    covariance = _moments(held.select("whitened"), k, lambda batch: matrix(batch.column(0)) - middle) / n
    return float(np.abs(covariance - np.eye(k)).max())
