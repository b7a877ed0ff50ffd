"""Embedding whitening: principal components by contour integration (FEAST).

Entries c become whole numbers x = floor(64 c) + 1000000. One pass sums x by dimension, a second
one sums products of x less a whole number beside the mean, so that the covariance follows from
exact sums that are centred before they are multiplied. What leaves a task is one row for each
dimension or pair of dimensions, whatever the number of vectors; the covariance (dimension squared
numbers) is all the driver holds.

Eigenvalues are cut into slices by bisection: the inertia of a shifted covariance (signs of the
pivots of its symmetric factorisation) counts those below the shift. Each slice is a task: solves
with complex shifts on a circle around the slice, summed by Gauss-Legendre quadrature, project a
random block onto the slice's eigenvectors, Rayleigh-Ritz takes values and vectors out of the block,
and this is repeated until the residuals vanish. A slice that gives another number of values than
the inertia counted is an error, so that none is missed. Rayleigh-Ritz over all slices makes the
vectors orthogonal across slices.

Defined cases: rows are dropped whose vector is null or empty, holds an entry that is null or not
finite or 2^40 or more in size (its squares would leave the exact range), or has another length
than most vectors (the longer one of equally many). Components without variance (up to rounding) are
left out, so equal vectors give no rows; an empty table gives none either. A null vec_id stays
null, repeated rows count each. ``deviation`` is null where it is 2^63 or more. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP, OFFSET = 64, 1_000_000
LARGEST = float(1 << 40)
WHOLE = pa.decimal128(38, 0)
#: Eigenvalues in a slice at most, unless they are too close to be told apart.
SLICE = 12
#: Places of the quadrature on the upper half of the circle.
NODES = 8


def _vectors(docs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the usable rows."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))
    return docs.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False)) & (F.size("v") > 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The whole numbers x of a batch of vectors."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(STEP * c).astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> DataFrame:
    """dim, j, n, s: number of vectors and exact sums of x, by length of the vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            column = batch.column("v")
            sizes = column.value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                x = _matrix(column.filter(pa.array(sizes == dim)), dim)
                n, s = total.get(dim, (0, [0] * dim))
                total[dim] = n + len(x), [a + b for a, b in zip(s, x.sum(axis=0).tolist())]
        for dim, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim), pa.array(range(dim)), pa.array([n] * dim), pa.array(map(Decimal, s), WHOLE)], ["dim", "j", "n", "s"])

    each = rows.select("v").mapInArrow(add, "dim long, j long, n long, s decimal(38,0)")
    return each.groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def products(y: np.ndarray) -> list[list[int]]:
    """Exact sums of products of the columns of whole numbers."""
    most = int(np.abs(y).max(initial=0))
    if len(y) * most * most < 1 << 53:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64).tolist()
    wide = y.astype(object)
    return (wide.T @ wide).tolist()


def _gram(rows: DataFrame, base: np.ndarray) -> DataFrame:
    """i, j, s: exact sums of (x_i - base_i)(x_j - base_j), i <= j."""
    dim = len(base)
    left, right = (a.tolist() for a in np.triu_indices(dim))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for batch in batches:
            if batch.num_rows:
                total += np.array(products(_matrix(batch.column("v"), dim) - base), object)
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array([Decimal(int(total[i, j])) for i, j in zip(left, right)], WHOLE)], ["i", "j", "s"])

    return rows.select("v").mapInArrow(add, "i long, j long, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s"))


def below(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric matrix under the shift, by its inertia.

    Symmetric elimination with pivots of one or two rows (Bunch and Kaufman's choice of pivot); a
    pivot of two rows has one negative value, as its determinant is negative.
    """
    a, count = v - shift * np.eye(len(v)), 0
    limit = (1 + 17**0.5) / 8
    while len(a):
        pick, size = 0, 1
        column = np.abs(a[1:, 0])
        most = column.max(initial=0.0)
        if most and abs(a[0, 0]) < limit * most:
            r = 1 + int(column.argmax())
            other = np.abs(np.delete(a[r], r)).max()
            if abs(a[0, 0]) * other < limit * most * most:
                pick, size = (r, 1) if abs(a[r, r]) >= limit * other else (r, 2)
        to = size - 1
        if pick != to:
            a[[pick, to]] = a[[to, pick]]
            a[:, [pick, to]] = a[:, [to, pick]]
        if size == 1:
            count += a[0, 0] < 0
            if a[0, 0]:
                a[1:, 1:] -= np.outer(a[1:, 0], a[0, 1:] / a[0, 0])
        else:
            count += 1
            a[2:, 2:] -= a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        a = a[size:, size:]
    return int(count)


def slices(v: np.ndarray, most: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top, until ``most`` eigenvalues above ``floor`` are covered."""
    top = float(np.abs(v).sum(axis=1).max()) * 1.01
    wide = top * 1e-9
    todo, out = [(floor, top, len(v) - below(v, floor))], []
    while todo and sum(x[2] for x in out) < most:
        a, b, n = todo.pop()
        if n == 0:
            continue
        cut = None
        if n > SLICE and b - a > 4 * wide:
            for part in (0.5, 0.42, 0.58, 0.35, 0.65, 0.27, 0.73):  # a place that no eigenvalue is close to
                at = a + part * (b - a)
                if below(v, at - wide) == below(v, at + wide):
                    cut = at
                    break
        if cut is None:
            out.append((a, b, n))
        else:
            above = n - (below(v, cut) - below(v, a))
            todo += [(a, cut, n - above), (cut, b, above)]
    return out


def contour(v: np.ndarray, a: float, b: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the symmetric matrix in [a, b), of which there are ``count``."""
    dim = len(v)
    scale = float(np.abs(v).max())
    size = min(dim, count + count // 2 + 6)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, size)))[0]
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (a + b) / 2, (b - a) / 2
    turns = np.exp(1j * np.pi / 2 * (1 - nodes))
    shifted = [np.linalg.inv((centre + radius * t) * np.eye(dim) - v) for t in turns]
    for _ in range(60):
        projected = sum(w / 2 * (radius * t * (s @ block)).real for w, t, s in zip(weights, turns, shifted))
        basis = np.linalg.qr(projected)[0]
        values, small = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ small
        inside = (values >= a) & (values < b)
        found = block[:, inside]
        if inside.sum() == count and np.abs(v @ found - found * values[inside]).max() <= 1e-13 * scale * dim**0.5:
            return values[inside], found
    raise ArithmeticError(f"{int(inside.sum())} eigenvalues found in [{a}, {b}), inertia counts {count}")


def eigenpairs(spark, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) with variance, and their vectors as columns."""
    dim = len(v)
    floor = dim * 1e-14 * float(np.trace(v))
    cut = slices(v, most, floor) if floor > 0 else []
    if not cut:
        return np.zeros(0), np.zeros((dim, 0))
    shared = spark.sparkContext.broadcast(v)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = contour(shared.value, a, b, n)[1]
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([vectors.T.ravel().tolist()], pa.list_(pa.float64()))], ["a", "vectors"])

    tasks = spark.createDataFrame(cut, "a double, b double, n long").repartition(len(cut))
    found = tasks.mapInArrow(solve, "a double, vectors array<double>").collect()
    basis = np.linalg.qr(np.concatenate([np.array(r.vectors).reshape(-1, dim) for r in found]).T)[0]
    values, small = np.linalg.eigh(basis.T @ v @ basis)
    return values[::-1][:most], (basis @ small)[:, ::-1][:, :most]


class Whitening:
    """What the fit list gives: n, base, rest (S - n base), components and shares of the variance."""

    def __init__(self, n: int, base: np.ndarray, rest: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.base, self.rest = n, base, rest
        self.mean = np.array([r / n for r in rest])
        self.scaled = vectors / np.sqrt(values)
        self.explained = (values / trace).tolist()

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base) - self.mean) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n x - S)^2; None beyond 63 bits."""
        z = x - self.base
        most = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest), default=0)
        if z.shape[1] * most * most < 1 << 63:
            return ((self.n * z - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * z.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [d if d < 1 << 63 else None for d in exact.tolist()]


def fit(vectors: DataFrame, components: int = 32, vec_col: str = "embedding") -> Whitening | None:
    """Fitted on all usable rows; None if there are none."""
    spark = vectors.sparkSession
    rows = _vectors(vectors, vec_col, vec_col).select("v")
    sums = _sums(rows)
    dims = sums.where("j = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if dims is None:
        return None
    dim, n = dims.dim, dims.n
    s = [int(r.s) for r in sums.where(F.col("dim") == dim).orderBy("j").collect()]
    base = [(2 * t + n) // (2 * n) for t in s]
    rest = [t - n * b for t, b in zip(s, base)]
    v = np.zeros((dim, dim))
    for r in _gram(rows.where(F.size("v") == dim), np.array(base, np.int64)).collect():
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.s) - rest[r.i] * rest[r.j]) / (n * n)
    values, found = eigenpairs(spark, v, components)
    return Whitening(n, np.array(base, np.int64), rest, values, found, float(np.trace(v)))


def _identity_error(rows: DataFrame, shared, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""
    left, right = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, sums = shared.value, np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = model.project(_matrix(batch.column("v"), len(model.base)))
                total, sums = total + w.T @ w, sums + w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([*left, *range(k)]), pa.array([*right, *[-1] * k]), pa.array([*total[left, right], *sums])], ["i", "j", "s"])

    n, cov, mean = shared.value.n, np.zeros((k, k)), np.zeros(k)
    for r in rows.select("v").mapInArrow(add, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        if r.j < 0:
            mean[r.i] = r.s / n
        else:
            cov[r.i, r.j] = r.s / n
    return float(np.abs(np.triu(cov - np.outer(mean, mean) - np.eye(k))).max())


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable
    vector and component."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, components, vec_col)
    k = len(model.explained) if model else 0
    if not k:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)
    rows = _vectors(vectors, id_col, vec_col).where(F.size("v") == len(model.base))
    error = _identity_error(rows, shared, k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column("v"), len(model.base))
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation, pa.array(model.project(x).ravel()),
                pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
