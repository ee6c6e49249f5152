"""Long series in blocks of time with a margin on either side, and kernels over these: no series is one group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types of a kernel's results by their SQL names.
TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def halo_blocks(rows: DataFrame, keys: list[str], size: int, halo: int, columns: list[str], time: str = "idx") -> DataFrame:
    """``rows`` packed by ``keys`` and stretch of ``size`` times, with all rows up to ``halo`` outside it: keys, block, s (time and columns, in no order)."""
    first, last = F.floor((F.col(time) - halo) / size), F.floor((F.col(time) + halo) / size)
    spread = rows.select(*keys, F.struct(F.col(time).alias("_t"), *columns).alias("_r"), F.explode(F.sequence(first, last)).alias("block"))
    return spread.groupBy(*keys, "block").agg(F.collect_list("_r").alias("s"))


def arrays_of(s: pa.StructArray) -> dict[str, np.ndarray]:
    """The fields of a list of structs as arrays, in order of time; nulls of numbers are NaN."""
    found = {s.type.field(i).name: s.field(i).to_numpy(zero_copy_only=False) for i in range(s.type.num_fields)}
    order = np.argsort(found["_t"], kind="stable")
    return {k: v[order] for k, v in found.items()}


def map_blocks(blocks: DataFrame, keys: list[str], size: int, kernel: Callable[..., dict[str, np.ndarray] | None], out: str, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (keys and ``out``, as in a schema) that ``kernel(start, rows, *more)`` gives for each block: it gets the block's first time, the arrays
    of its rows and the values of the columns ``more``, and returns arrays of one length by name; NaN becomes null."""
    kinds = dict(blocks.dtypes)
    types = {name: TYPES[kind] for name, kind in (part.split() for part in out.split(","))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column("block")[i].as_py() * size
                found = kernel(start, arrays_of(batch.column("s")[i].values), *[batch.column(c)[i].as_py() for c in more])
                if found is None or not len(next(iter(found.values()))):
                    continue
                at = pa.array(np.full(len(next(iter(found.values()))), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *[pa.array(found[c], kind, from_pandas=True) for c, kind in types.items()]], [*keys, *types])

    return blocks.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], out]))



def pair_blocks(rows: DataFrame, by: list[str], columns: list[str], kernel: Callable[..., dict[str, np.ndarray]], out: str, time: str = "idx", size: int = 4096) -> DataFrame:
    """by, ch_i, ch_j and ``out`` for every two channels (ch_i < ch_j) and stretch of ``size`` times that both have rows in.

    All channels of a stretch meet in one matrix for each column (channels x times, NaN where there is no row), so that a sample is sent
    once and not once for each other channel. ``kernel(known, *matrices)`` returns matrices channels x channels by name, n (times that both
    have) among them. A task holds the channels of one stretch at a time.
    """
    kinds = dict(rows.dtypes)
    types = {name: TYPES[kind] for name, kind in (part.split() for part in out.split(","))}
    packed = rows.groupBy(*by, F.floor(F.col(time) / size).alias("_b")).agg(F.collect_list(F.struct(F.col(time).alias("_t"), "channel", *[F.col(c).cast("double").alias(c) for c in columns])).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.column("s")[i].values
                channels = s.field("channel").dictionary_encode()
                order = np.argsort(np.array(channels.dictionary.to_pylist(), object), kind="stable")
                names = channels.dictionary.take(pa.array(order))
                row = np.argsort(order)[channels.indices.to_numpy(zero_copy_only=False)]
                times, place = np.unique(s.field("_t").to_numpy(zero_copy_only=False), return_inverse=True)
                matrices = []
                for c in columns:
                    m = np.full((len(names), len(times)), np.nan)
                    m[row, place] = s.field(c).to_numpy(zero_copy_only=False)
                    matrices.append(m)
                known = ~np.isnan(sum(matrices[1:], matrices[0]))
                found = kernel(known, *[np.where(known, m, 0) for m in matrices])
                a, b = np.nonzero(np.triu(found["n"] > 0, 1))
                if len(a):
                    keys = [batch.column(k).take(pa.array(np.full(len(a), i))) for k in by]
                    yield pa.RecordBatch.from_arrays([*keys, names.take(pa.array(a)), names.take(pa.array(b)), *[pa.array(found[c][a, b]).cast(kind) for c, kind in types.items()]], [*by, "ch_i", "ch_j", *types])

    return packed.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "ch_i string", "ch_j string", out]))


def signs_of_pairs(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For complex series (channels x times) the sums over time of the sign of Im(z_i conj z_j), of whether it is above 0 (both to nine places), and of its size."""
    n = len(z)
    sign, above, size = np.zeros((3, n, n))
    for i in range(n - 1):
        d = (z[i].imag * z[i + 1 :].real - z[i].real * z[i + 1 :].imag)
        size[i, i + 1 :] = np.abs(d).sum(1)
        d = d.round(9)
        sign[i, i + 1 :], above[i, i + 1 :] = np.sign(d).sum(1), (d > 0).sum(1)
    return sign, above, size
