"""Embedding whitening, with principal components from QDWH spectral divide and conquer.

Vectors are put on an integer grid, x = floor(64 c) + 1000000 by default, so that equal
vectors are equal exactly; each distinct x vector counts once (the fit list). Spark
computes the fit list with one grouped shuffle, the sums S, then the covariance V of the
centred vectors: each partition multiplies its centred rows in blocks, the partial
matrices are added up row by row in a second exchange, and one d x d matrix reaches the
driver, whatever the number of rows (``max_dim`` bounds d).

Its eigenvectors come from polar decompositions: the unitary factor U of V - s I, found
by the QR-based dynamically weighted Halley iteration (QDWH), has eigenvalue +1 on the
invariant subspace of eigenvalues above the shift s and -1 below, so (I + U) / 2 is a
spectral projector. An orthonormal basis of its range and of the rest splits V into two
smaller symmetric blocks, which are split again until they are of order one. The mean
and the components (at most d x ``n_components`` doubles) are broadcast, and the rows
are whitened without a shuffle.

Defined cases. Rows whose vector is null, or holds a null or non-finite entry, are left
out. So are rows whose vector has another length than most (ties: the longer) or length
0. Repeated rows weigh once in the fit and are all returned. Components whose eigenvalue
is at most 1e-12 of the trace do not exist: fewer than ``n_components`` may be returned,
and none at all for one distinct vector or an empty table. Entries whose grid value
would pass 2^50 raise (sums would no longer be exact); a ``deviation`` that does not fit
a long is null. Input columns named like an added one give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.text import free_name, saved, without

SCALE, OFFSET = 64.0, 1_000_000
GRID_LIMIT = 2.0**50
BLOCK = 4096
LEAST_SHARE = 1e-12


# --- QDWH and divide and conquer, on one d x d matrix ---

def polar_unitary(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by QDWH."""
    n = len(a)
    norm = float(np.linalg.norm(a))  # an upper bound of the 2-norm
    if norm == 0.0:
        return np.eye(n)
    x, eye = a / norm, np.eye(n)
    # A lower bound of the smallest singular value; one that is too small costs an iteration, not accuracy.
    try:
        low = 1.0 / float(np.linalg.norm(np.linalg.inv(x)))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, np.finfo(float).eps / 8), 1.0)
    for _ in range(40):
        # Weights of the best rational approximation of the sign function on [low, 1].
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = float(np.linalg.norm(new - x))
        x = new
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if moved < 1e-10 and 1 - low < 1e-8:
            break
    return x


def range_basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a spectral projector and of its complement, by subspace iteration."""
    n = len(projector)
    # The columns of largest norm span the range well; a second product removes what rounding left outside.
    start = projector[:, np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")]
    chosen: list[np.ndarray] = []
    rest = start.copy()
    for _ in range(rank):  # pivoted Gram-Schmidt
        k = int(np.argmax(np.einsum("ij,ij->j", rest, rest)))
        v = rest[:, k] / np.linalg.norm(rest[:, k])
        chosen.append(v)
        rest -= np.outer(v, v @ rest)
    q, _ = np.linalg.qr(np.hstack([projector @ np.stack(chosen, axis=1), np.eye(n)]))
    return q[:, :rank], q[:, rank:n]


def shifts(a: np.ndarray) -> Iterator[float]:
    """Values to split the spectrum at: the median of the diagonal (halves most spectra), then its mean, which lies strictly
    between the extreme eigenvalues, then values beside the mean, should an eigenvalue sit on it."""
    diagonal = np.diag(a)
    yield float(np.median(diagonal))
    mean, spread = float(diagonal.mean()), float(np.linalg.norm(a - diagonal.mean() * np.eye(len(a))) / np.sqrt(len(a)))
    for k in range(16):
        yield mean + spread * (0.0, 0.11, -0.13, 0.29, -0.31)[k % 5] / (1 + k // 5)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    scale = float(np.linalg.norm(a))

    def split(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(block)
        off = float(np.linalg.norm(block - np.diag(np.diag(block))))
        if n == 1 or off <= np.finfo(float).eps * scale * 1e-3:
            return np.diag(block).copy(), np.eye(n)
        if n == 2:  # one rotation
            turn = 0.5 * np.arctan2(2 * block[0, 1], block[0, 0] - block[1, 1])
            c, s = np.cos(turn), np.sin(turn)
            v = np.array([[c, -s], [s, c]])
            return np.diag(v.T @ block @ v).copy(), v
        for shift in shifts(block):
            u = polar_unitary(block - shift * np.eye(n))
            projector = (np.eye(n) + u) / 2
            rank = int(round(float(np.trace(projector))))
            if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-9 * np.sqrt(n):
                continue
            upper, lower = range_basis(projector, rank)
            if np.linalg.norm(upper.T @ block @ lower) > 1e-12 * max(scale, np.linalg.norm(block)):
                continue
            parts = [split(_symmetric(v.T @ block @ v)) for v in (upper, lower)]
            return np.concatenate([e for e, _ in parts]), np.hstack([v @ w for v, (_, w) in zip((upper, lower), parts)])
        # No shift separates: all eigenvalues agree to rounding, and any basis will do.
        return np.diag(block).copy(), np.eye(n)
    values, vectors = split(_symmetric(np.asarray(a, float)))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


# --- The fit, over Spark ---

@dataclass(frozen=True)
class Whitening:
    """A fitted whitening; ``components`` has one unit eigenvector a column, ``identity_error`` is measured on the fit list."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.sums, self.n)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where a long cannot hold it."""
        if not len(x):
            return []
        gap = x - self.sums // self.n  # small numbers, and n * gap - S % n is the same difference
        if self.n * float(np.abs(gap).max(initial=0) + 1) < np.sqrt(2.0**62 / max(1, self.dim)):
            t = self.n * gap - self.sums % self.n
            return np.einsum("ij,ij->i", t, t).tolist()
        rest = [int(s) % self.n for s in self.sums]
        exact = [sum((self.n * int(g) - r) ** 2 for g, r in zip(row, rest)) for row in gap.tolist()]
        return [v if v < 2**63 else None for v in exact]


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - S / n: the whole part is subtracted exactly, so no digits are lost to the offset."""
    return (x - sums // n).astype(float) - (sums % n) / n


def usable(vector: Column) -> Column:
    """Neither null nor empty, and no null or non-finite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def on_grid(vector: Column) -> Column:
    def cell(c: Column) -> Column:
        v = F.lit(SCALE) * c.cast("double")
        return F.when(F.abs(v) >= GRID_LIMIT, F.raise_error(F.lit("an entry is too large for the integer grid")).cast("long")).otherwise(F.floor(v) + F.lit(OFFSET))
    return F.transform(vector, cell)


def prepared(vectors: DataFrame, column: str, grid: str) -> DataFrame:
    """The usable rows of the most frequent dimension, with their grid vector."""
    kept = vectors.where(usable(F.col(f"`{column}`")))
    # One row per distinct length: bounded by the longest vector, and only the winner comes back.
    common = kept.groupBy(F.size(F.col(f"`{column}`")).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return kept.withColumn(grid, F.lit(None).cast("array<bigint>")).limit(0)
    return kept.where(F.size(F.col(f"`{column}`")) == common["d"]).withColumn(grid, on_grid(F.col(f"`{column}`")))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of longs."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64, copy=False)


def summed(fit_list: DataFrame, partial, dtype: type) -> dict[int, np.ndarray]:
    """Adds up ``partial``'s arrays over all partitions, row by row: ``partial`` maps the blocks of a partition to one matrix,
    whose rows are exchanged by their number and added up where they meet; only the sums reach the driver."""
    def blocks(batches) -> Iterator[np.ndarray]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                yield matrix(b.column(0).slice(k, BLOCK))

    def parts(batches):
        rows = partial(blocks(batches))
        for k in range(0, 0 if rows is None else len(rows), BLOCK):
            part = rows[k:k + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part)), pa.int32()), pa.array([r.tobytes() for r in part], pa.binary())], ["i", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = np.frombuffer(v, dtype)
                total[i] = total[i] + row if i in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["i", "v"])
    rows = fit_list.mapInArrow(parts, "i int, v binary").repartition("i").mapInArrow(add, "i int, v binary").collect()
    return {r["i"]: np.frombuffer(bytes(r["v"]), dtype) for r in rows}


def fit(vectors: DataFrame, column: str, n_components: int = 16, max_dim: int = 4096) -> Whitening | None:
    """The whitening of ``prepared`` rows' distinct grid vectors in ``column``; None without rows."""
    fit_list = saved(vectors.select(F.col(f"`{column}`").alias("x")).distinct())

    def total(blocks):
        rows = None
        for x in blocks:
            if x.shape[1] > max_dim:
                raise ValueError(f"vectors of {x.shape[1]} dimensions, max_dim is {max_dim}")
            s = np.r_[len(x), x.sum(axis=0)][None, :]
            rows = s if rows is None else rows + s
        return rows
    counted = summed(fit_list, total, np.int64)
    if not counted:
        return None
    n, sums = int(counted[0][0]), counted[0][1:]

    def products(blocks):
        acc = None
        for x in blocks:
            y = centred(x, sums, n)
            acc = y.T @ y if acc is None else acc + y.T @ y
        return acc
    rows = summed(fit_list, products, np.float64)
    v = _symmetric(np.stack([rows[i] for i in range(len(sums))]) / n)
    values, vectors_ = eigen(v)
    trace = float(np.trace(v))
    k = int(np.count_nonzero(values[:n_components] > LEAST_SHARE * trace))
    model = Whitening(n, sums, values[:k], vectors_[:, :k], values[:k] / trace if trace > 0 else values[:0], 0.0)
    if not k:
        return model

    def whitened(blocks):
        acc = None
        for x in blocks:
            w = model.whiten(x)
            part = np.vstack([w.T @ w, w.sum(axis=0)])
            acc = part if acc is None else acc + part
        return acc
    rows = summed(fit_list, whitened, np.float64)
    mean = rows[k] / n
    covariance = np.stack([rows[i] for i in range(k)]) / n - np.outer(mean, mean)
    return Whitening(n, sums, model.eigenvalues, model.components, model.explained, float(np.abs(covariance - np.eye(k)).max()))


def transform(vectors: DataFrame, model: Whitening, column: str) -> DataFrame:
    """``vectors`` with ``whitened`` (one double a component) and ``deviation`` of the grid vectors in ``column``."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*vectors.schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType(), False))])
    at = vectors.columns.index(column)

    def run(batches):
        m = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                b = whole.slice(k, BLOCK)
                x = matrix(b.column(at))
                w = m.whiten(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.deviations(x), pa.int64()), lists], [f.name for f in schema.fields])
    return vectors.mapInArrow(run, schema)


def whiten(vectors: DataFrame, column: str = "embedding", n_components: int = 16) -> tuple[DataFrame, Whitening | None]:
    """Usable rows with ``deviation`` and ``whitened``, and the model (None where no row is usable)."""
    vectors = without(vectors, ["deviation", "whitened"])
    grid = free_name(vectors, "x")
    rows = prepared(vectors, column, grid)
    model = fit(rows, grid, n_components)
    if model is None:
        return rows.drop(grid).withColumn("deviation", F.lit(None).cast("long")).withColumn("whitened", F.lit(None).cast("array<double>")), None
    return transform(rows, model, grid).drop(grid), model
