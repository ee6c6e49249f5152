"""Embedding whitening: principal axes of the distributed covariance, float32 eigenvectors refined in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, list_matrix, summed, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this many units count as this many, so that sums of entries stay exact.
LARGEST = 1 << 40


def refined_eigh(matrix: np.ndarray, most: int = 12, depth: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, in extended precision.

    Eigenvectors in float32 are corrected by the iterations of Ogita and Aishima, which are products of matrices in
    extended precision and converge quadratically. Eigenvalues that lie nearer than the iteration's own error bound form
    clusters: there only the space that a cluster spans converges, and the matrix restricted to it, less its mean and scaled,
    is solved the same way (in float64 after ``depth`` such steps).
    """
    a = np.asarray(matrix, np.longdouble)
    n = len(a)
    mean = np.trace(a) / max(1, n)
    unit = np.eye(n, dtype=np.longdouble)
    a = (a + a.T) / 2 - mean * unit
    size = np.abs(a).max(initial=0)
    if n < 2 or size <= np.finfo(np.longdouble).eps * abs(mean):
        return np.full(n, mean), unit
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32 if depth else np.float64))[1].astype(np.longdouble)
    norm, tiny = np.sqrt((a * a).sum()), np.finfo(np.longdouble).eps * n
    for _ in range(most):
        rest, s = unit - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(rest))
        off = s - np.diag(np.diag(s))
        bound = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((rest * rest).sum()))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= max(4 * bound, tiny)
        change = np.where(near, rest / 2, (s + values[None, :] * rest) / np.where(near, 1, gap))
        x = x + x @ change
        if np.abs(change).max() <= tiny:
            break
    for _ in range(2):
        x = x @ (3 * unit - x.T @ x) / 2
    order = np.argsort(-values, kind="stable")
    x, values, near = x[:, order], values[order], near[np.ix_(order, order)]
    cuts = np.flatnonzero(np.r_[True, ~np.diag(near, 1), True])
    for start, end in zip(cuts[:-1], cuts[1:], strict=True) if depth else ():
        if end - start > 1:
            own = x[:, start:end]
            values[start:end], turn = refined_eigh(own.T @ a @ own, most, depth - 1)
            x[:, start:end] = own @ turn
    order = np.argsort(-values, kind="stable")
    return values[order] * size + mean, x[:, order]


@dataclass
class Whitening:
    """The fit for vectors of one length: n, exact sums and the axes' matrix."""

    n: int
    sums: list[int]
    near: np.ndarray  # the integer nearest to the mean; with ``rest`` the mean to double precision of what is left
    rest: np.ndarray
    axes: np.ndarray | None = None  # columns: unit eigenvectors over the roots of their eigenvalues
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Whitening:
        near = [(2 * s + n) // (2 * n) for s in sums]
        return cls(n, sums, np.array(near, np.int64), np.array([(s - n * c) / n for s, c in zip(sums, near, strict=True)]))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest

    def solve(self, covariance: np.ndarray, components: int) -> None:
        values, vectors = refined_eigh(covariance)
        values, vectors = values[:components], vectors[:, :components]
        alive = values > np.finfo(np.float64).eps * len(covariance) * max(values.max(initial=0), 0)
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else 1
        self.axes = (vectors * sign * np.where(alive, 1 / np.sqrt(np.where(alive, values, 1)), 0)).astype(np.float64)
        trace = np.trace(covariance)
        self.explained = np.asarray(np.where(alive, values, 0) / trace if trace > 0 else 0 * values, np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where no 64-bit integer holds it."""
        sums = np.array(self.sums, object)
        if self.n * (int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)) < 1 << 62:
            y = self.n * x - np.array(self.sums, np.int64)
            if x.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
                return (y * y).sum(1).tolist()
        y = self.n * x.astype(object) - sums
        return [d if d < 1 << 63 else None for d in (y * y).sum(1)]


def usable(embedding: str = "embedding"):
    x = F.col(embedding)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def units(embedding: str = "embedding"):
    """Entries as integers: floor(64 c) + 1000000, of c as double."""
    most = LARGEST / SCALE
    return F.transform(embedding, lambda c: F.floor(SCALE * F.least(F.greatest(c.cast("double"), F.lit(-most)), F.lit(most))) + OFFSET)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of a list column by their length: the length, their places, and the matrix of their entries."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield int(size), own, list_matrix(column.take(pa.array(own)), int(size))


def _sums(fit: DataFrame) -> dict[int, Whitening]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, own, x in _by_length(batch.column("x")):
                yield pa.RecordBatch.from_pylist([{"size": size, "sums": [len(own), *x.sum(0).tolist()]}])

    # A row for each Arrow batch; sums of these may need more than 64 bits.
    found = summed(fit.mapInArrow(run, "size long, sums array<long>"), ["size"], "sums", "decimal(38,0)")
    return {size: Whitening.of(int(own[0]), [int(s) for s in own[1:]]) for (size,), own in found.items() if size}


def _products(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, np.ndarray]:
    """For each length the sum over ``fit`` of the outer products of centred (or, once solved, whitened) vectors; a task sends one matrix for each length."""
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_length(batch.column("x")):
                if size:
                    model = shared.value[size]
                    d = model.centred(x)
                    d = d if model.axes is None else d @ model.axes
                    found[size] = found.get(size, 0) + d.T @ d
        for size, own in found.items():
            yield pa.RecordBatch.from_pylist([{"size": size, "products": own.ravel().tolist()}], schema=pa.schema([("size", pa.int64()), ("products", pa.list_(pa.float64()))]))

    found = summed(fit.mapInArrow(run, "size long, products array<double>"), ["size"], "products", "double")
    return {size: np.array(own, np.float64).reshape(int(len(own) ** 0.5), -1) for (size,), own in found.items()}


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A fit for each length of vector, over all distinct integer vectors."""
    fit = written(vectors.where(usable()).select(units().alias("x")).distinct(), "fit")
    models = _sums(fit)
    for size, own in _products(fit, models).items():
        models[size].solve(own / models[size].n, components)
    for size, own in _products(fit, models).items():
        alive = models[size].axes.any(0)
        models[size].identity_error = float(np.abs(own / models[size].n - np.eye(len(own)))[np.ix_(alive, alive)].max(initial=0))
    forget(fit)
    return models


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable vector on its leading ``components`` axes.

    Returns vec_id, n (distinct vectors of the fit), deviation (exact; null where no long holds it), whitened and explained (arrays,
    by falling eigenvalue) and identity_error. Entries c are taken as floor(64 c) + 1000000, those beyond 2^40 / 64 as that. The
    fit has each distinct vector once; one distinct pass shuffles, the others send sums alone, whose size follows the length of the
    vectors and not their number.

    Vectors that are null or hold null, NaN or infinite entries have no row. Vectors of another length are whitened among
    themselves; empty ones have no components. A row gives a row, so repeated ids and null ids stay. Axes without variance (a
    single distinct vector, fewer vectors than entries, constant entries) have whitened 0 and explained 0 and do not count in
    identity_error. Other columns are ignored; no rows give no rows.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(fit_whitening(vectors, components))
    lists = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, own, x in _by_length(batch.column("x")):
                if not size:
                    continue
                model = shared.value[size]
                w = model.centred(x) @ model.axes
                flat = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                columns = [batch.column("vec_id").take(pa.array(own)), pa.array(np.full(len(own), model.n, np.int64)), pa.array(model.deviations(x), pa.int64()), flat(w), flat(np.tile(model.explained, (len(own), 1))), pa.array(np.full(len(own), model.identity_error))]
                yield pa.RecordBatch.from_arrays([columns[0], *columns[1:3], columns[3].cast(lists), columns[4].cast(lists), columns[5]], ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), units().alias("x"))
    return rows.mapInArrow(run, "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
