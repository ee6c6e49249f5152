"""Samples and state windows, time bases, lines, epochs and pairs of channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import pair_blocks


def _with_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """``rows`` with ``_w``, the windows of their session in one array, or all of them where windows name no session.

    A row stays a row. Windows of a session are few; whether their table is broadcast is left to its measured size.
    Windows without a session are a parameter of the query, and one row.
    """
    fields = [c for c in windows.columns if c != "session_id"]
    packed = F.array_sort(F.collect_list(F.struct("t0", "t1", *[c for c in fields if c not in ("t0", "t1")]))).alias("_w")
    if "session_id" in windows.columns:
        return rows.join(windows.groupBy("session_id").agg(packed), "session_id", "left")
    return rows.crossJoin(windows.agg(packed))


def _holding():
    return F.filter("_w", lambda w: (F.col("t") >= w["t0"]) & (F.col("t") < w["t1"]))


def in_windows(samples: DataFrame, windows: DataFrame, min_sec: float = 0.0) -> DataFrame:
    """Samples with each window (state, window_id, t0, t1) that holds them, t0 <= t < t1; shorter windows are left out."""
    names = [c for c in windows.columns if c != "session_id"]
    found = _with_windows(samples, windows.where(F.col("t1") - F.col("t0") >= min_sec))
    return found.withColumn("_h", F.explode(_holding())).select(*samples.columns, *[F.col(f"_h.{c}").alias(c) for c in names])


def outside_windows(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples in no window of their session: the baseline."""
    return _with_windows(samples, windows).where(F.size(F.coalesce(_holding(), F.array())) == 0).select(*samples.columns)


def label_state(rows: DataFrame, windows: DataFrame, order: list[str], other: str = "other") -> DataFrame:
    """Adds state: of the windows of the row's session that hold t, the state that comes first in ``order``; else ``other``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("state"))
    spans = windows.withColumn("_rank", rank).where("_rank > 0")
    first = F.array_min(F.transform(_holding(), lambda w: F.struct(w["_rank"].alias("rank"), w["state"].alias("state"))))["state"]
    return _with_windows(rows, spans).withColumn("state", F.coalesce(first, F.lit(other))).drop("_w")


def align(series: DataFrame, times: DataFrame, by: list[str]) -> DataFrame:
    """Values of ``series`` (by, t, v) at ``times`` (by, t), on the line between neighbours; null outside."""
    both = series.select(*by, "t", "v", F.lit(0).alias("_q")).unionByName(times.select(*by, "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("_q")))
    run = W.partitionBy(*by).orderBy("t", "_q")
    known = F.when(F.col("_q") == 0, F.struct("t", "v"))
    back = W.partitionBy(*by).orderBy(F.col("t").desc(), F.col("_q"))
    both = both.withColumn("_a", F.last(known, True).over(run)).withColumn("_b", F.last(known, True).over(back))
    line = F.when(F.col("_b.t") == F.col("_a.t"), F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("t") - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0)))
    return both.where("_q = 1").select(*by, "t", line.alias("v"))


def nearest_bin(spectra: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """The spectrum's value at the bin nearest to each line (f0); of two as near the lower one."""
    pairs = spectra.crossJoin(F.broadcast(lines))
    return pairs.groupBy(*by, "f0").agg(F.min_by(F.struct("f", "p"), F.struct(F.abs(F.col("f") - F.col("f0")), F.col("f"))).alias("_b")).select(*by, "f0", "_b.f", "_b.p")


def epochs(samples: DataFrame, onsets: DataFrame, before: int, after: int) -> DataFrame:
    """Samples from ``before`` samples ahead of each onset (event_id, onset) to ``after`` behind it; adds tau; edges are cut.

    Both sides meet by session and stretch of time, so a sample sees only the onsets near it.
    """
    stretch = before + after + 1
    spread = F.explode(F.sequence(F.floor((F.col("onset") - before) / stretch), F.floor((F.col("onset") + after) / stretch)))
    near = onsets.withColumn("_s", spread)
    found = samples.withColumn("_s", F.floor(F.col("idx") / stretch)).join(near, ["session_id", "_s"])
    return found.where(F.col("idx").between(F.col("onset") - before, F.col("onset") + after)).drop("_s").withColumn("tau", F.col("idx") - F.col("onset"))


def reflected_epochs(samples: DataFrame, onsets: DataFrame, before: int, after: int) -> DataFrame:
    """As :func:`epochs`, but whole at the edges: what lies outside the recording is its mirror image (session_id, channel, event_id, tau, x)."""
    ends = samples.groupBy("session_id").agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"))
    wanted = onsets.join(ends, "session_id").withColumn("tau", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    at = F.col("onset") + F.col("tau")
    mirror = F.when(at < F.col("_a"), 2 * F.col("_a") - at).when(at > F.col("_b"), 2 * F.col("_b") - at).otherwise(at)
    wanted = wanted.select("session_id", "event_id", "tau", mirror.alias("idx"))
    return samples.select("session_id", "channel", "idx", "x").join(wanted, ["session_id", "idx"]).select("session_id", "channel", "event_id", "tau", "x")


def channel_pairs(samples: DataFrame, value: str = "x", by: tuple[str, ...] = ("session_id", "idx")) -> DataFrame:
    """Each two channels' values at the same time: ch_i < ch_j, xi, xj."""
    i = samples.select(*by, F.col("channel").alias("ch_i"), F.col(value).alias("xi"))
    j = samples.select(*by, F.col("channel").alias("ch_j"), F.col(value).alias("xj"))
    return i.join(j, list(by)).where("ch_i < ch_j")


def gram(samples: DataFrame, by: tuple[str, ...] = ("session_id",), value: str = "x", size: int = 4096) -> DataFrame:
    """Covariance and correlation of each two channels of a session (or of what else ``by`` names) over the times that both have.

    Products are taken matrix by matrix in stretches of time, from the stretch's means; these parts then add up by the means' distances.
    """

    def kernel(known: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        m = known.astype(float)
        base = x.sum(1) / np.maximum(m.sum(1), 1)
        x = (x - base[:, None]) * m
        n = m @ m.T
        some = np.maximum(n, 1)
        own = x @ m.T  # sums of a row's values over the times that the column's channel has
        square = (x * x) @ m.T
        return {"n": n, "mi": base[:, None] + own / some, "mj": base[None, :] + own.T / some, "cij": x @ x.T - own * own.T / some, "cii": square - own**2 / some, "cjj": (square - own**2 / some).T}

    keys = [*by, "ch_i", "ch_j"]
    parts = pair_blocks(samples.where(F.col(value).isNotNull()), list(by), [value], kernel, "n long, mi double, mj double, cij double, cii double, cjj double", size=size)
    every = W.partitionBy(*keys)
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(every) / F.sum("n").over(every)
    parts = parts.withColumns({"_i": F.col("mi") - mean("mi"), "_j": F.col("mj") - mean("mj")})
    whole = lambda c, a, b: F.sum(F.col(c) + F.col("n") * F.col(a) * F.col(b))
    found = parts.groupBy(*keys).agg(F.sum("n").alias("n"), whole("cij", "_i", "_j").alias("_c"), whole("cii", "_i", "_i").alias("_a"), whole("cjj", "_j", "_j").alias("_b"))
    return found.select(*keys, (F.col("_c") / F.col("n")).alias("cov"), (F.col("_c") / F.nullif(F.sqrt(F.greatest(F.col("_a"), F.lit(0.0)) * F.greatest(F.col("_b"), F.lit(0.0))), F.lit(0.0))).alias("r"))
