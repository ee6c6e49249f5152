"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

THRESHOLD, RECALL = 0.9, 0.985
#: Vectors of a bucket that are compared in one piece, and rows that a task's group of buckets has on average.
CHUNK, CELL_ROWS = 1024, 20_000


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): bits keep buckets at about 128 unrelated vectors; tables then make the chance that a pair at the
    threshold meets in one of them at least ``recall``."""
    bits = min(30, max(6, math.ceil(math.log2(max(2, n))) - 7))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def usable(embedding: str = "embedding"):
    x = F.col(embedding)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & good & F.exists(x, lambda v: v != 0)


def sign_tables(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Adds ``signs``: for each table the signs of a vector's products with ``bits`` random directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, tables), np.int32)
            rows = [np.asarray(x, np.float64) for x in batch.column("embedding").to_pylist()]
            sizes = np.array([len(r) for r in rows])
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, tables * bits))
                own = np.flatnonzero(sizes == dim)
                x = np.stack([rows[i] for i in own])
                # A scale keeps products of huge components finite; signs do not depend on it.
                signs = (x / np.abs(x).max(1, keepdims=True)) @ planes[dim] >= 0
                out[own] = signs.reshape(len(own), tables, bits) @ (1 << np.arange(bits))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "signs"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("signs", ArrayType(IntegerType()))]))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes reaches over the links a-b."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(own: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside the buckets of one cell: for each vector how many others, and a smaller vector it is joined with.

    A pair counts only in the first table in which it meets, so that over all tables it counts once.
    """
    own = own.sort_values(["tab", "sign", "dim", "low", "high", "node"], kind="stable", ignore_index=True)
    keys = own[["tab", "sign", "dim", "low", "high"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(own) else []
    out = []
    for start, end in zip(starts, np.r_[starts[1:], len(own)].astype(int), strict=True):
        if end - start < 2:
            continue
        part = own.iloc[start:end]
        tab, _, _, low, high = keys[start]
        x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        chunk = part["chunk"].to_numpy()
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        hit = x[left] @ x[right].T >= threshold
        i, j = (v[w] for v, w in zip((left, right), np.nonzero(hit), strict=True))
        if low == high:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        signs = np.stack(part["signs"].to_numpy())[:, :tab]
        new = ~(signs[i] == signs[j]).any(1)
        i, j = i[new], j[new]
        node, times = part["node"].to_numpy(), part["times"].to_numpy()
        count = np.bincount(i, times[j], len(part)) + np.bincount(j, times[i], len(part))
        linked = np.flatnonzero(count)
        # Rows are in order of node, so the smallest index is the smallest node.
        out.append(pd.DataFrame({"node": node[linked], "links": count[linked].astype(np.int64), "root": node[_roots(len(part), i, j)[linked]]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """Links vectors of cosine >= ``threshold`` (in double precision) that share a bucket of some sign table.

    Returns vec_id, n_links (vectors linked directly, other than itself), component_id (smallest vec_id reachable,
    itself included) and kept (vec_id = component_id). Equal vectors are one node with a multiplicity, so copies
    are never paired. A bucket of more than CHUNK vectors is cut into pieces, and every pair of pieces is
    compared in a group of its own: nothing is left out, and no task holds a hot bucket. Links stay in
    the tasks: what leaves them is a count and one edge for each vector and bucket.

    Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing, as do vectors of other
    lengths with each other. Rows without a vec_id link with nothing and have no component; rows that repeat
    one are copies if equal, else one node. Other columns are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = usable() & F.col("vec_id").isNotNull()
    nodes = written(rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("times")), "nodes")
    n = nodes.count()
    bits, tables = plan_tables(n, threshold, recall)
    signed = written(sign_tables(nodes, bits, tables, seed), "signed")
    placed = signed.withColumn("dim", F.size("embedding")).select("node", "times", "embedding", "signs", "dim", F.posexplode("signs").alias("tab", "sign"))
    sizes = signed.select(F.size("embedding").alias("dim"), F.posexplode("signs").alias("tab", "sign")).groupBy("tab", "sign", "dim").count()
    hot = written(sizes.where(F.col("count") > CHUNK).withColumn("pieces", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count"), "hot")
    # Hot buckets are few; the list is broadcast while it is small, and joined by a shuffle beyond that.
    placed = placed.join(F.broadcast(hot) if hot.count() <= 50_000 else hot, ["tab", "sign", "dim"], "left")
    placed = placed.withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    cells = int(max(64, n * tables / CELL_ROWS))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("tab", "sign", "dim", "low", "high"), F.lit(cells)))
    found = placed.select("cell", "tab", "sign", "dim", "low", "high", "chunk", "node", "times", "embedding", "signs").groupBy("cell").applyInPandas(lambda own: _links(own, threshold), "node long, links long, root long")
    found = written(found, "found")
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    ends = nodes.join(counts, "node", "left").join(labels, "node", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = rows.where(good).join(ends, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good | good.isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
