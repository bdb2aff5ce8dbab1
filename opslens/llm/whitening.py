"""Embedding whitening: spectral divide and conquer of the covariance by QDWH polar decompositions.

Vectors become whole numbers, so that counts, sums and products add up exactly in whatever order Spark
adds them. The covariance (dimension by dimension) is all that the driver sees. There the polar factor
U of the covariance less a shift gives the projector (U + I) / 2 on the part of the space whose
eigenvalues exceed the shift; that part and the rest are split further until a block is diagonal.
The components are broadcast, and every vector is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import stored

STEPS, ORIGIN = 64, 1_000_000
COMPONENTS = 16
# Entries from here on have no place on the grid of whole numbers and count as not finite.
LARGEST = 2.0**56
# The driver holds a matrix of this many rows and columns at most.
MAX_DIMENSIONS = 4096
EPS = np.finfo(float).eps
# Whole sums travel in two parts, as they may exceed 38 digits.
HALF = 60
PART = "i int, j int, high decimal(38,0), low decimal(38,0)"


class Fit(NamedTuple):
    """n vectors with per-dimension ``sums``, their variance ``values`` along unit ``vectors`` (columns,
    by falling variance) and the ``trace`` of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def lattice(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector has finite entries only and the usual length."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    rows = vectors.where(F.col(vector_col).isNotNull() & finite)
    lengths = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first().m
    d = usual.d if usual else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions, at most {MAX_DIMENSIONS} are taken")
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * STEPS) + ORIGIN)
    return rows.where(F.size(vector_col) == d).select(F.col(id_col).alias("id"), x.alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(entries: Iterable[tuple[int, int, int]]) -> pa.RecordBatch:
    rows = [(i, j, v >> HALF, v & (1 << HALF) - 1) for i, j, v in entries]
    number = pa.decimal128(38, 0)
    arrays = [pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)]
    arrays += [pa.array([Decimal(r[k]) for r in rows], number) for k in (2, 3)]
    return pa.RecordBatch.from_arrays(arrays, ["i", "j", "high", "low"])


def _total(parts: DataFrame) -> dict[tuple[int, int], int]:
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r.i, r.j): (int(r.high) << HALF) + int(r.low) for r in found}


def products(y: np.ndarray) -> np.ndarray:
    """y'y, exact. Blocks are so small that doubles hold every sum; huge entries go as Python's."""
    most = int(np.abs(y).max(initial=0)) ** 2
    if most >= 2**52:
        big = y.astype(object)
        return big.T @ big
    total, step = np.zeros((y.shape[1],) * 2, object), max(2**52 // max(most, 1), 1)
    for first in range(0, len(y), step):
        block = y[first : first + step].astype(float)
        total += (block.T @ block).astype(np.int64)
    return total


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, per-dimension sums and the covariance (divisor n) of the rows ``x`` of ``fit``.

    Products are taken about the whole number next to the mean and corrected in whole numbers, which
    is the centred covariance to the last bit.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total = total + matrix(batch).astype(object).sum(axis=0)
        if n:
            yield _parts([(-1, 0, n), *((0, j, int(v)) for j, v in enumerate(total))])

    found = _total(fit.mapInArrow(sums, PART))
    n = found.get((-1, 0), 0)
    if not n:
        return 0, [], np.zeros((0, 0))
    s = [found[0, j] for j in range(len(found) - 1)]
    centre = [(2 * v + n) // (2 * n) for v in s]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + products(matrix(batch) - np.array(centre, np.int64)), True
        if seen:
            yield _parts((i, j, int(total[i, j])) for i in range(len(s)) for j in range(i, len(s)))

    rest = [v - n * c for v, c in zip(s, centre)]
    v = np.zeros((len(s),) * 2)
    for (i, j), g in _total(fit.mapInArrow(squares, PART)).items():
        v[i, j] = v[j, i] = (n * g - rest[i] * rest[j]) / (n * n)
    return n, s, v


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps: with
    QR factors while the weights are large, with Cholesky factors afterwards."""
    m = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS), 1.0)
    for _ in range(40):
        d = (4 * (1 - low * low) / low**4) ** (1 / 3)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * root), 0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > 100:
            stack, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(m)]))
            x = q / r * x + (p - q / r) / np.sqrt(r) * stack[:m] @ stack[m:].T
        else:
            z = np.linalg.cholesky(np.eye(m) + r * x.T @ x)
            x = q / r * x + (p - q / r) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        low = min(low * (p + q * low * low) / (1 + r * low * low), 1.0)
        if np.linalg.norm(x - before) <= 4 * m * EPS and 1 - low < 1e-8:
            break
    return (x + x.T) / 2


def divided(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of two invariant subspaces of a symmetric matrix that is not diagonal."""
    m, rng = len(a), np.random.default_rng(42)
    mean, spread = np.trace(a) / m, np.linalg.norm(a - np.trace(a) / m * np.eye(m)) / np.sqrt(m)
    best = None
    # The mean lies between the least and the largest eigenvalue; shifts beside it are for the case
    # that one of them is an eigenvalue.
    for shift in (np.median(np.diag(a)), mean, *(mean + spread * t for t in (0.1, -0.1, 0.37, -0.37, 0.7, -0.7))):
        moved = a - shift * np.eye(m)
        if not np.linalg.norm(moved):
            continue
        projector = (polar(moved) + np.eye(m)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < m:
            continue
        basis = np.linalg.qr(projector @ rng.standard_normal((m, k)))[0]
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        high, rest = basis[:, :k], basis[:, k:]
        apart = np.linalg.norm(rest.T @ a @ high)
        if best is None or apart < best[0]:
            best = (apart, high, rest)
        if apart <= 10 * m * EPS * np.linalg.norm(moved):
            break
    return best[1:] if best else (np.eye(m)[:, :1], np.eye(m)[:, 1:])


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    values, vectors = [], []
    stack = [(v, np.eye(len(v)))] if len(v) else []
    while stack:
        a, basis = stack.pop()
        off = np.linalg.norm(a - np.diag(np.diag(a)))
        if len(a) == 1 or off <= EPS * np.linalg.norm(a):
            values += np.diag(a).tolist()
            vectors += list(basis.T)
            continue
        for part in divided(a):
            inner = part.T @ a @ part
            stack.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort(-np.array(values), kind="stable")
    found = np.linalg.qr(np.array(vectors).reshape(len(v), -1).T[:, order])[0] if len(v) else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", found, v @ found)
    order = np.argsort(-values, kind="stable")
    return values[order], found[:, order]


def fitted(fit: DataFrame) -> Fit:
    n, sums, v = covariance(fit)
    values, vectors = spectrum(v)
    return Fit(n, sums, values, vectors, float(np.trace(v)))


def has_variance(model: Fit) -> np.ndarray:
    """Whether a component's variance is more than rounding."""
    return model.values > len(model.values) * EPS * max(model.values[0], 0.0) if len(model.values) else np.zeros(0, bool)


def projector(model: Fit, count: int):
    """A function from rows x to exact deviations n*x - S (rows) and whitened values; a component
    without variance gives NaN."""
    k = min(count, len(model.values))
    flat = ~has_variance(model)[:k]
    scaled = model.vectors[:, :k] / np.sqrt(np.where(flat, 1, model.values[:k]))
    centre = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    rest = [s - model.n * c for s, c in zip(model.sums, centre)]
    n = model.n

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x - np.array(centre, np.int64)
        if n * (int(np.abs(y).max(initial=0)) + 1) < 2**62:
            apart = y * n - np.array(rest, np.int64)
        else:
            apart = y.astype(object) * n - np.array(rest, object)
        white = (apart / n).astype(float) @ scaled
        white[:, flat] = np.nan
        return apart, white

    return project


def squared(apart: np.ndarray) -> list[int | None]:
    """Sums of squares of rows, exact; null beyond 63 bits."""
    most = int(np.abs(apart).max(initial=0))
    if most * most * max(apart.shape[1], 1) < 2**63:
        return (apart * apart).sum(axis=1).tolist()
    sums = (apart.astype(object) ** 2).sum(axis=1)
    return [int(s) if s < 2**63 else None for s in sums]


def identity_error(fit: DataFrame, model: Fit, count: int) -> float | None:
    """Largest entry of the covariance of the whitened ``fit`` less the identity, over the components
    with variance; None if there are none."""
    project, used = projector(model, count), np.flatnonzero(has_variance(model)[:count])
    if not len(used):
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, seen = 0.0, 0.0, False
        for batch in batches:
            if batch.num_rows:
                white = project(matrix(batch))[1][:, used]
                first, second, seen = first + white.sum(axis=0), second + white.T @ white, True
        if seen:
            table = np.vstack([first, second])
            i, j = np.indices(table.shape)
            arrays = [pa.array(z.ravel(), kind) for z, kind in ((i, pa.int32()), (j, pa.int32()), (table, pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "v"])

    found = fit.mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    table = np.zeros((len(used) + 1, len(used)))
    for r in found.collect():
        table[r.i, r.j] = r.v / model.n
    return float(np.abs(table[1:] - np.outer(table[0], table[0]) - np.eye(len(used))).max())


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS
) -> tuple[DataFrame, Fit, float | None]:
    """The remaining vectors (id, deviation, whitened array of ``count`` components), the model they were
    whitened with, and its identity error.

    Rows whose vector is null or holds null, not finite or huge (2**56) entries are left out, and so
    are vectors of another length than most (the longer on a tie). Each distinct vector on the grid
    counts once in the model, however often it comes; ids may be null or repeat. A component without
    variance has a null for each vector. Tables without vectors give no rows. deviation is null where
    it exceeds 63 bits. Other columns are not read.
    """
    rows = lattice(vectors, id_col, vector_col)
    fit = stored(rows.select("x").distinct(), "fit", True)
    model = fitted(fit)
    error = identity_error(fit, model, count) if model.n else None
    project = projector(model, count) if model.n and model.sums else None

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if project and batch.num_rows:
                apart, white = project(matrix(batch))
                flat = white.ravel()
                values = pa.array(flat, pa.float64(), mask=np.isnan(flat))
                ends = np.arange(0, len(flat) + 1, white.shape[1], dtype=np.int32)
                columns = [batch.column("id"), pa.array(squared(apart), pa.int64()), pa.ListArray.from_arrays(ends, values)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "deviation", "whitened"])

    kind = StructType(
        [rows.schema["id"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    )
    return rows.mapInArrow(rows_of, kind).withColumnRenamed("id", id_col), model, error


def whitening_report(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS
) -> DataFrame:
    """A row per remaining vector and component: id, component (from 1), n, deviation, whitened,
    explained (share of the variance, null if there is none), identity_error. See ``whitened``."""
    found, model, error = whitened(vectors, id_col, vector_col, count)
    shares = [float(e) / model.trace if model.trace > 0 else None for e in model.values[:count]]
    share: Column = F.array(*(F.lit(s).cast("double") for s in shares)) if shares else F.array(F.lit(None).cast("double"))
    return found.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_col,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
