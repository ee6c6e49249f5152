"""Helpers shared by the text operators: scratch tables, tokens, hashes and connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Text is worked on in slices of about this many bytes inside a task, which bounds a worker's memory.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.spectralake.scratch", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-spectralake-")
    spark.conf.set("spark.spectralake.scratch", found)
    return found


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage; it goes with the session, or by :func:`forget`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spectralake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def shuffles_go(f):
    """Has Spark delete the shuffle files of each job that ``f`` (of a table) runs as soon as it ends; else they stay until the driver collects garbage."""

    @functools.wraps(f)
    def run(rows: DataFrame, *args, **kwargs):
        conf, own = rows.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(own, "false")
        conf.set(own, "true")
        try:
            return f(rows, *args, **kwargs)
        finally:
            conf.set(own, before)

    return run


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` made and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._written_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of whole rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths.astype(np.int64)) // limit
    starts = np.flatnonzero(np.r_[True, np.diff(run) > 0])
    for start, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: What parts words: ASCII white space, or every ASCII character that is no letter and no digit.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NO_WORD = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
#: A value for each byte; in FOLDED those of A-Z are those of a-z.
PLAIN = mix(np.arange(1, 257, dtype=np.uint64))
FOLDED = np.array([PLAIN[c + 32 if 0x41 <= c <= 0x5A else c] for c in range(256)], np.uint64)
_BASE, _KEPT = 0x9E3779B97F4A7C15, 1 << 20


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, np.uint64))


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` mod 2^64; those that slices take are kept."""
    return _powers(base, _KEPT)[:n] if n <= _KEPT else np.multiply.accumulate(np.full(n, base, np.uint64))


@dataclass
class Words:
    """The words of a run of texts, as places in their joined bytes; their hashes come from prefix sums of a polynomial."""

    prefix: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array | pa.ChunkedArray, parts: np.ndarray = WHITE, values: np.ndarray = PLAIN) -> Words:
        """``texts``: a string column (null counts as empty); ``parts``: which bytes part words; ``values``: a number for each byte."""
        data, offsets = joined_bytes(texts)
        starts, ends = runs_of(~parts[data], offsets)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _power(_BASE, len(data)), out=prefix[1:])
        return cls(prefix, starts, ends, np.diff(np.searchsorted(starts, offsets)))

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hashes of all words in a row, or of their first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        own = (self.prefix[ends] - self.prefix[self.starts]) * _power(pow(_BASE, -1, 1 << 64), len(self.prefix))[self.starts]
        return mix(own + (ends - self.starts).astype(np.uint64))


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that are ``inside`` begin and end; none goes on from one text (``offsets``) into the next."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[offsets < len(inside)]
    first[cuts] = inside[cuts]
    cuts = offsets[offsets > 0] - 1
    last[cuts] = inside[cuts]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def joined_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in a row, without a copy, and where each row's begin (one more: the end)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` values in a row, one for each start (also across texts: the caller masks those)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
    return mix(out)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes


def list_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The matrix of a list column whose rows all have ``width`` entries, none null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def summed(rows: DataFrame, keys: list[str], column: str, kind: str) -> dict[tuple, list]:
    """The sums, place by place and as ``kind``, of an array column, by key: as many numbers as the arrays of all keys have places."""
    places = rows.select(*keys, F.posexplode(column).alias("place", "value")).groupBy(*keys, "place").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    out: dict[tuple, list] = {}
    for r in places.orderBy(*keys, "place").collect():
        out.setdefault(tuple(r[k] for k in keys), []).append(r["value"])
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps; each is an aggregate, of which a node sends one row for each task, and an
    equi-join, whose side of edges AQE splits where a node has a large share of them. Stars never have more edges than before. Self-loops and nulls are
    ignored; no edges give no rows.
    """
    e = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        forget(e)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = written(
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct(),
            "small",
        )
        forget(large)
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    # Now every node but the roots has one edge, to its root.
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def md5_key(*parts) -> "F.Column":
    return F.md5(F.concat_ws(":", *[p.cast("string") if hasattr(p, "cast") else F.lit(str(p)) for p in parts]))


union_all = functools.partial(functools.reduce, DataFrame.unionByName)
