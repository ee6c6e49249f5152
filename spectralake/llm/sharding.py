"""Minimax contiguous sharding: the smallest capacity at which a greedy cut fits, found by search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written


#: A group with more than a HOT-th of all rows is hot; there are fewer than HOT of these.
HOT = 1000


def _blocks(spark) -> int:
    return 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, digest, row_id) in group order, numbered over the whole table.

    Groups (equal digests) stand by their smallest doc_id; adds first_id, g (tells groups of one first_id
    apart), n (1 for the first row) and total (bytes up to and with the row). A group with more than a HOT-th of all
    rows learns its first_id by a broadcast, of which there can be HOT at most, so that no task gets a hot
    group's rows; the others do by a join. The rows are dealt by range into many blocks and summed inside a block; a row for each block gives the offsets. A hot group spreads
    over blocks, since ids break its ties.
    """
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "groups")
    limit = (first.agg(F.sum("rows")).first()[0] or 0) / HOT
    hot = F.broadcast(first.where(F.col("rows") > limit).select("digest", "first_id"))
    columns = ["digest", "first_id", "doc_id", "row_id", "size", "text_crc32"]
    known = rows.join(hot, "digest").select(columns)
    others = rows.join(hot, "digest", "left_anti").join(first.where(F.col("rows") <= limit), "digest").select(columns)
    keys = ["first_id", "g", "doc_id", "row_id"]
    ranged = written(
        known.union(others).select("first_id", F.xxhash64("digest").alias("g"), "doc_id", "row_id", "size", "text_crc32")
        .repartitionByRange(_blocks(rows.sparkSession), *keys).withColumn("block", F.spark_partition_id()),
        "ranged",
    )
    own = W.partitionBy("block").orderBy(*keys)
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("block").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    offsets = sums.select("block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    return written(
        ranged.withColumn("n", F.row_number().over(own)).withColumn("total", F.sum("size").over(own))
        .join(offsets, "block").select("first_id", "g", "doc_id", "size", "text_crc32", (F.col("n") + F.col("n0")).alias("n"), (F.col("total") + F.col("s0")).alias("total")),
        "ordered",
    )


def greedy_cuts(ends: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """Where greedy filling ends each shard, for every capacity at once: one aggregate per shard.

    ``ends`` has the running total at the end of each group. Only the rows between the smallest and the
    largest limit are read, which narrows as the search does.
    """
    cuts = [[0] for _ in capacities]
    for _ in range(shards):
        limits = [c[-1] + cap for c, cap in zip(cuts, capacities, strict=True)]
        low = min(c[-1] for c in cuts)
        found = ends.where(F.col("end").between(low, max(limits))).agg(*[F.max(F.when(F.col("end") <= t, F.col("end"))).alias(f"c{i}") for i, t in enumerate(limits)]).first()
        for c, x in zip(cuts, found, strict=True):
            c.append(max(c[-1], x or 0))
    return [c[1:] for c in cuts]


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int, ways: int = 32) -> tuple[int, list[int]]:
    """The least capacity with which ``shards`` contiguous shards hold everything, and its cuts.

    Feasibility is monotone in the capacity, so ``ways`` capacities at a time bisect the range from the
    larger of mean and largest group to mean plus largest group (always enough).
    """
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest
    while low < high:
        step = max(1, -(-(high - low) // (ways + 1)))
        tried = list(range(low, high, step))[:ways]
        fits = [c[-1] >= total for c in greedy_cuts(ends, tried, shards)]
        if any(fits):
            k = fits.index(True)
            low, high = (tried[k - 1] + 1 if k else low), tried[k]
        else:
            low = tried[-1] + 1
    return low, greedy_cuts(ends, [low], shards)[0]


def minimax_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Deals ``docs`` into ``shards`` contiguous shards whose largest is as small as can be.

    Equal texts form an atomic group; groups stand in the order of their smallest doc_id and are never
    split. Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot (gapless from
    0 in each shard), grown_shard (null: this law has none) and capacity (the bytes found by the search).
    A null text has no bytes, counts as empty and is of the empty texts' group. Null ids come first in a group, as its
    smallest only where it has no other. Repeated rows are rows of their own. Other columns are ignored;
    no rows give no rows; shards may be empty where there are fewer groups.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
        .withColumn("row_id", F.monotonically_increasing_id()),
        "rows",
    )
    numbered = ordered(rows)
    ends = written(numbered.groupBy("first_id", "g").agg(F.max("total").alias("end"), F.max("n").alias("n"), F.sum("size").alias("bytes")).repartitionByRange("end").sortWithinPartitions("end"), "ends")
    total, largest = ends.agg(F.max("end"), F.max("bytes")).first()
    capacity, cuts = (0, []) if total is None else smallest_capacity(ends, total, largest, shards)
    last = {r.end: r.n for r in ends.where(F.col("end").isin(cuts)).select("end", "n").collect()} if cuts else {}
    rows_at = [last.get(c, 0) for c in cuts[:-1]]
    shard = sum([F.when(F.col("n") > at, 1).otherwise(0) for at in rows_at], F.lit(0))
    start = F.greatest(F.lit(0), F.lit(0), *[F.when(F.col("n") > at, F.lit(at)).otherwise(0) for at in rows_at])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"),
        (F.col("n") - 1 - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
    )
