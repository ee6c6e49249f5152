"""Sums over sliding windows of time as differences of running sums: how much windows overlap costs nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, keys: list[str], time: str, values: list[str], block: int = 1 << 16) -> DataFrame:
    """Replaces each of ``values`` by its sum up to and with each time; a key's times are summed in blocks, and what the blocks before add up to is joined."""
    rows = rows.withColumn("_block", F.floor(F.col(time) / block))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select(*keys, "_block", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = W.partitionBy(*keys, "_block").orderBy(time)
    summed = rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(offsets, [*keys, "_block"])
    return summed.withColumns({v: F.col(v) + F.col(f"_o_{v}") for v in values}).drop("_block", *[f"_o_{v}" for v in values])


def sliding_sums(rows: DataFrame, keys: list[str], time: str, values: dict[str, Column], half: int | Column, at: str = "at") -> DataFrame:
    """keys, ``at``, n and for each of ``values`` its sum over the 2 ``half`` + 1 times around ``at``, where all are there.

    ``half`` may differ from row to row as a column of the keys. The sum over a window is the running sum at its last row less that before
    its first one, so each row is sent twice, whatever the windows' length. Both belong to one run of times without a gap:
    a window over a gap has but one of them and no row. Times are whole numbers, each once for a key.
    """
    names = list(values)
    own = rows.select(*keys, F.col(time).cast("long").alias("_t"), (F.lit(half) if isinstance(half, int) else half).cast("long").alias("_half"), F.lit(1).cast("long").alias("_n"), *[v.cast("double").alias(c) for c, v in values.items()])
    own = running_sums(own.withColumns({f"_own_{c}": F.col(c) for c in names}), keys, "_t", ["_n", *names])
    last = F.struct((F.col("_t") - F.col("_half")).alias("at"), *[F.col(c) for c in ("_n", *names)])
    first = F.struct((F.col("_t") + F.col("_half")).alias("at"), (1 - F.col("_n")).alias("_n"), *[(F.col(f"_own_{c}") - F.col(c)).alias(c) for c in names])
    ends = own.select(*keys, (F.col("_t") - F.col("_n")).alias("_run"), F.explode(F.array(last, first)).alias("_e"))
    found = ends.groupBy(*keys, "_run", F.col("_e.at").alias(at)).agg(F.sum("_e._n").alias("n"), F.count("*").alias("_both"), *[F.sum(f"_e.{c}").alias(c) for c in names])
    return found.where("_both = 2").drop("_run", "_both")


def numbered(rows: DataFrame, time: str, by: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    """``rows`` with their times numbered from 0 in order, whatever gaps they have, and ``_n``, how many there are."""
    times = rows.select(*by, time).distinct()
    order = W.partitionBy(*by)
    times = times.select(*by, time, (F.row_number().over(order.orderBy(time)) - 1).cast("long").alias("_k"), F.count("*").over(order).alias("_n"))
    return rows.join(times, [*by, time]).withColumn(time, F.col("_k")).drop("_k")


def moved_onsets(rows: DataFrame, onsets: DataFrame, reps: int, step: int, time: str = "idx") -> tuple[DataFrame, DataFrame]:
    """``rows`` with their times numbered in order for each session, and the onsets (session_id, event_id, onset) once for each rep from 0 on,
    at the number of the first time not before them, moved round by rep * step among the session's times."""
    times = rows.select("session_id", F.col(time).alias("_t")).distinct()
    both = times.select("session_id", "_t", F.lit(1).alias("_is"), F.lit(None).cast(dict(onsets.dtypes)["event_id"]).alias("event_id"))
    both = both.unionByName(onsets.select("session_id", F.col("onset").cast("long").alias("_t"), F.lit(0).alias("_is"), "event_id"))
    before = W.partitionBy("session_id").orderBy("_t", "_is").rowsBetween(W.unboundedPreceding, -1)
    placed = both.withColumns({"_k": F.coalesce(F.sum("_is").over(before), F.lit(0)), "_n": F.sum("_is").over(W.partitionBy("session_id"))}).where("_is = 0 and _n > 0")
    moved = placed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).select("session_id", "event_id", "rep", F.pmod(F.col("_k") + F.col("rep") * step, F.col("_n")).alias("onset"))
    return numbered(rows, time).drop("_n"), moved
