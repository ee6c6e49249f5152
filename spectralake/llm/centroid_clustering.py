"""Centroid clustering of integer vectors: Lloyd's rounds with the bounds and the ball search of Shallot, exact."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_matrix, summed, written

SCALE, DIMENSIONS, CENTROIDS, ROUNDS = 1024, 64, 8, 10
#: Components beyond this many units count as this many, so that squared distances fit in 64 bits.
LARGEST = 1 << 27
#: Vectors of a block, which is a row of the stored tables, and blocks of a bucket on average.
BLOCK, BUCKET_BLOCKS = 4096, 64
#: Bounds are moved outwards by this share, far above what rounding takes.
MARGIN = 1e-12


def squared(x: np.ndarray, centers: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to the centroids that ``which`` names, in integers."""
    d = x - centers[which]
    return np.einsum("nd,nd->n", d, d)


class Ball:
    """What a round knows of its centroids: distances between them, the others of each in order of distance, and how far each has moved."""

    def __init__(self, centers: np.ndarray, before: np.ndarray | None = None):
        k = len(centers)
        apart = np.sqrt(np.stack([squared(centers, centers, np.full(k, j)) for j in range(k)], 1).astype(np.float64))
        np.fill_diagonal(apart, -1)
        self.centers, self.order = centers, np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, 1) * (1 - MARGIN)
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(((centers - before) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)

    def loosened(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of vectors after the centroids have moved: of the others', the largest move counts."""
        top = np.argsort(-self.moved, kind="stable")[:2]
        others = np.where(own == top[0], self.moved[top[-1]] if len(top) > 1 else 0, self.moved[top[0]])
        return (upper + self.moved[own]) * (1 + MARGIN), (lower - others) * (1 - MARGIN)

    def search(self, x: np.ndarray, own: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Puts every vector to its nearest centroid (ties: the smaller number), in place; returns how many distances were computed.

        A vector whose upper bound lies below its lower bound, or below half the way from its centroid to the next one, stays.
        Else the bound is made exact and tried again; what is left compares its own and its remembered second centroid,
        begins at the nearer one and looks at the others in order of their distance from it. None beyond the distance to
        the start plus that to the second nearest found so far can be among the two nearest, so the ball shrinks as they are found.
        """
        k = len(self.centers)
        open_ = np.flatnonzero((upper >= lower) & (upper >= self.half[own]))
        first = squared(x[open_], self.centers, own[open_])
        upper[open_] = np.sqrt(first.astype(np.float64)) * (1 + MARGIN)
        work = len(open_)
        stays = (upper[open_] < lower[open_]) | (upper[open_] < self.half[own[open_]])
        open_, first = open_[~stays], first[~stays]
        if k == 1 or not len(open_):
            return work
        points, a, b = x[open_], own[open_], second[open_]
        other = squared(points, self.centers, b)
        work += len(open_)
        swap = (other < first) | ((other == first) & (b < a))
        best, next_ = np.where(swap, b, a), np.where(swap, a, b)
        d_best, d_next = np.where(swap, other, first), np.where(swap, first, other)
        start, tried, reach = best.copy(), next_.copy(), np.sqrt(d_best.astype(np.float64))
        alive = np.arange(len(open_))
        for rank in range(k - 1):
            alive = alive[self.apart[start[alive], rank] <= (reach[alive] + np.sqrt(d_next[alive].astype(np.float64))) * (1 + MARGIN)]
            if not len(alive):
                break
            j = self.order[start[alive], rank]
            new = j != tried[alive]
            at, j = alive[new], j[new]
            d = squared(points[at], self.centers, j)
            work += len(at)
            wins = (d < d_best[at]) | ((d == d_best[at]) & (j < best[at]))
            w = at[wins]
            next_[w], d_next[w], best[w], d_best[w] = best[w], d_best[w], j[wins], d[wins]
            places = ~wins & ((d < d_next[at]) | ((d == d_next[at]) & (j < next_[at])))
            w = at[places]
            next_[w], d_next[w] = j[places], d[places]
        own[open_], second[open_] = best, next_
        upper[open_], lower[open_] = np.sqrt(d_best.astype(np.float64)) * (1 + MARGIN), np.sqrt(d_next.astype(np.float64)) * (1 - MARGIN)
        return work


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and the components as integers of the vectors with ``dimensions`` finite components."""
    x, most = F.col("embedding"), LARGEST / scale
    good = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    unit = F.transform(x, lambda c: F.floor(scale * F.least(F.greatest(c.cast("double"), F.lit(-most)), F.lit(most))).cast("int"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), unit.alias("x"))


def blocks(rows: DataFrame, dimensions: int) -> DataFrame:
    """Rows of up to BLOCK vectors each: block, ids and the packed components (two bytes each where these hold them, else four)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = list_matrix(part.column("x"), dimensions)
                packed = x.astype(np.int16) if np.abs(x).max() < 1 << 15 else x.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([packed.tobytes()])], ["block", "ids", "packed"])
                number += 1

    return rows.mapInArrow(run, "block long, ids array<long>, packed binary")


def _unpacked(packed: bytes, n: int, dimensions: int) -> np.ndarray:
    return np.frombuffer(packed, np.int16 if len(packed) == 2 * n * dimensions else np.int32).reshape(n, dimensions).astype(np.int64)


def _sums(x: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """For each centroid the number and the sum of its vectors, in a row."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for j in np.unique(which):
        own = x[which == j]
        out[j] = [len(own), *own.sum(0)]
    return out.ravel()


def _searched(row: dict, ball: Ball, fresh: bool, dimensions: int) -> tuple[np.ndarray, ...]:
    """The vectors of a block, their centroids before (None if ``fresh``: nothing is known) and after a search, the second ones, the bounds, and the work."""
    n, k = len(row["ids"]), len(ball.centers)
    x = _unpacked(row["packed"], n, dimensions)
    if fresh:
        old, own, second, upper, lower = None, np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n)
    else:
        old, second = np.frombuffer(row["own"], np.int32), np.frombuffer(row["second"], np.int32).copy()
        own = old.copy()
        upper, lower = ball.loosened(own, np.frombuffer(row["upper"], np.float64), np.frombuffer(row["lower"], np.float64))
    work = ball.search(x, own, second, upper, lower)
    return x, old, own, second, upper, lower, work


STATE = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("own", "second", "upper", "lower")), ("moved", pa.list_(pa.int64())), ("work", pa.int64())])


def _round(table: DataFrame, centers: np.ndarray, before: np.ndarray | None, dimensions: int) -> DataFrame:
    """The state of each block after a search among ``centers``; ``moved``: what its vectors add to the numbers and sums of the centroids, and take from them.

    ``before``: the centroids of the round before; None in the first, when ``table`` has no state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, ball = len(centers), Ball(centers, before)
        for batch in batches:
            for row in batch.to_pylist():
                x, old, own, second, upper, lower, work = _searched(row, ball, before is None, dimensions)
                if old is None:
                    moved = _sums(x, own, k)
                else:
                    at = np.flatnonzero(own != old)
                    moved = _sums(x[at], own[at], k) - _sums(x[at], old[at], k)
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "own": own.tobytes(), "second": second.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "moved": moved.tolist(), "work": work}], schema=STATE)

    return table.mapInArrow(run, "block long, own binary, second binary, upper binary, lower binary, moved array<long>, work long")


def _assigned(table: DataFrame, centers: np.ndarray, before: np.ndarray | None, dimensions: int) -> DataFrame:
    """The last search: ids, cluster and exact squared distance of each block's vectors, and the sums of these by cluster (in decimal)."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("cluster", pa.list_(pa.int32())), ("distance", pa.list_(pa.int64())), ("totals", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(centers, before)
        for batch in batches:
            for row in batch.to_pylist():
                x, _, own, *_ = _searched(row, ball, before is None, dimensions)
                d = squared(x, centers, own)
                totals = [str(sum(d[own == j].tolist())) for j in range(len(centers))]
                yield pa.RecordBatch.from_pylist([{"ids": row["ids"], "cluster": own.tolist(), "distance": d.tolist(), "totals": totals}], schema=schema)

    return table.mapInArrow(run, "ids array<long>, cluster array<int>, distance array<long>, totals array<string>")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k rows with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, dimensions: int = DIMENSIONS) -> DataFrame:
    """Exact k-means of integer vectors: ``rounds`` rounds of assignment and update, and a last assignment.

    Returns vec_id, cluster, distance (squared, in integers), cluster_inertia, inertia and centroid_sha256. Vectors are packed into
    blocks, written once as a table bucketed by block; each round joins it with the bounds of the round before, bucketed
    alike, so that nothing is shuffled, and writes new bounds. A block sends what vectors that changed their centroid add to and take
    from its sums. The driver sees centroids and sums alone. Tables of the run are dropped at its end.

    Components x are taken as floor(1024 x), beyond 2^27 as that. Vectors that are null, have another number of components, or
    null, NaN or infinite ones have no row. A row counts as often as it is there; rows without a vec_id are clustered but
    start no centroid; without any vec_id there is no centroid and no row. With fewer vectors than k there are fewer centroids. Centroids
    at the same place leave all to the smallest number; those without vectors stay where they are. Sums of distances that no long
    holds are null. Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, dimensions)
    centers = first_centroids(rows, k, seed)
    if not len(centers):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k, name = len(centers), f"clustering_{uuid.uuid4().hex}"
    buckets = int(max(8, rows.count() / (BLOCK * BUCKET_BLOCKS)))
    stored = lambda df, table: df.write.bucketBy(buckets, "block").sortBy("block").format("parquet").saveAsTable(table)
    stored(blocks(rows, dimensions).repartition(buckets, "block"), f"{name}_blocks")
    given, before, sums = spark.table(f"{name}_blocks"), None, np.zeros((k, dimensions + 1), object)
    joined = given
    for turn in range(rounds):
        stored(_round(joined, centers, before, dimensions), f"{name}_{turn}")
        if turn:
            spark.sql(f"drop table {name}_{turn - 1}")
        state = spark.table(f"{name}_{turn}")
        moved = summed(state, [], "moved", "decimal(38,0)")[()]
        sums = sums + np.array([int(v) for v in moved], object).reshape(k, -1)
        before, centers = centers, np.array([[s // own[0] for s in own[1:]] if own[0] else old for own, old in zip(sums.tolist(), centers.tolist(), strict=True)], np.int64)
        joined = given.join(state.drop("moved", "work"), "block")
    last = written(_assigned(joined, centers, before, dimensions), "assigned")
    for table in [f"{name}_blocks", f"{name}_{rounds - 1}"][: 1 + (rounds > 0)]:
        spark.sql(f"drop table {table}")
    totals = [int(t) for t in summed(last, [], "totals", "decimal(38,0)")[()]]
    fits = lambda t: F.lit(t if t < 1 << 63 else None).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("r")["cluster"])
    digests = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centers.tolist()]
    flat = last.select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("r"))
    return flat.select(
        F.col("r")["ids"].alias("vec_id"), F.col("r")["cluster"].alias("cluster"), F.col("r")["distance"].alias("distance"), of(map(fits, totals)).alias("cluster_inertia"), fits(sum(totals)).alias("inertia"), of(digests).alias("centroid_sha256"),
    )
