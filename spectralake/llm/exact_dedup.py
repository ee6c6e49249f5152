"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, forget, remove, shared_dir, written


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """The digests seen so far, each with the id of the row that stays.

    The table is bucketed and sorted by ``digest``: a batch is shuffled to the buckets once, while the
    index itself is read in place by every sort-merge join, however large it has become.
    ``buckets`` should grow with the final size of the index (about 128 MB a bucket).
    ``path`` puts the files in a folder of their own, from which another session opens the index anew.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 64, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Takes the table from the catalog and deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Dedups ``docs`` against the index and within itself, and appends what is new.

        Returns a row for each row of ``docs``: ``doc_id``, ``keep_id``, ``group_size`` (rows of this batch
        with the text), ``kept``, ``text_sha256``. A text that the index has keeps the id it has there, so
        all its rows in the batch are dropped; of a new text the smallest id stays.
        Null texts are empty texts. Null ids come last: one stays only where its whole group has none.
        Rows that repeat an id are one document: all of them report what that document does.
        Other columns of ``docs`` are ignored; no rows give no rows. A hot text costs one row per map task,
        since groups are counted before the shuffle, and its rows join back by a join that AQE can split.
        """
        return self._add(docs, id_col, text_col)[0]

    def _add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
        """As :meth:`add`, with the written tables that the result reads."""
        rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")
        fresh = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "fresh")
        new = fresh.hint("merge").join(self.rows(), "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"))
        new.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        # A text is kept by this batch only if the index got it from here.
        known = fresh.hint("merge").join(self.rows(), "digest").withColumn("ours", F.col("first_id").eqNullSafe(F.col("keep_id")))
        found = rows.join(known, "digest").select(
            "doc_id", "keep_id", "group_size",
            (F.col("ours") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
        return found, [rows, fresh]


def buckets_for(rows: int) -> int:
    """Buckets of about 128 MB for the digests and ids of so many rows (some 44 bytes each), 64 at least."""
    return max(64, rows * 44 // (128 << 20))


def exact_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``docs`` deduplicated as the first batch of an index of its own; see :meth:`DigestIndex.add`.

    Without ``buckets`` their number follows from the number of rows. The result is written, a narrow row for each row of ``docs``; the index
    and what else was written for it go at once.
    """
    index = DigestIndex(docs.sparkSession, buckets=buckets or buckets_for(docs.count()))
    found, made = index._add(docs)
    found = written(found, "deduplicated")
    forget(*made)
    index.drop()
    return found


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one.

    Null texts count as empty ones. A row without an id stays only where no row of its text has one. An id that stands
    with several texts is kept for those of which it is the smallest id. No rows give no rows.
    """
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), digest(F.col("text")).alias("digest"))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    return found.dropDuplicates(["id", "digest"]).select("row.*")
