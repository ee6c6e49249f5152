"""Per-sample work: filling, detrending, scaling, smoothing, framing, coarse-graining, mixing of channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import halo_blocks, map_blocks
from ..functions.order_statistics import rolling_median_and_deviation

KEYS = ["session_id", "channel"]


def _run(keys=KEYS):
    return W.partitionBy(*keys).orderBy("idx")


def numeric(samples: DataFrame) -> DataFrame:
    """x as a number; what is none, and what is missing, is 0."""
    return samples.withColumn("x", F.coalesce(F.col("x").try_cast("double"), F.lit(0.0)))


def fill_gaps(samples: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Nulls inside a channel become values on the line between their neighbours; at its ends the nearest value.

    Each block of a channel is worked on by itself; from the others it only gets the last value known before it and the first after it.
    """
    known = F.when(F.col("x").isNotNull(), F.struct("idx", "x"))
    rows = samples.withColumns({"_block": F.floor(F.col("idx") / block), "_k": known})
    edges = rows.groupBy(*KEYS, "_block").agg(F.max("_k").alias("_last"), F.min("_k").alias("_first"))
    order = W.partitionBy(*KEYS).orderBy("_block")
    edges = edges.select(*KEYS, "_block", F.last("_last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    run = W.partitionBy(*KEYS, "_block").orderBy("idx")
    rows = rows.withColumn("_a", F.last("_k", True).over(run)).withColumn("_b", F.first("_k", True).over(run.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.join(edges, [*KEYS, "_block"]).withColumns({"_a": F.coalesce("_a", "_before"), "_b": F.coalesce("_b", "_after")})
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col("idx") - F.col("_a.idx")) / (F.col("_b.idx") - F.col("_a.idx"))
    return rows.withColumn("x", F.coalesce("x", line, "_a.x", "_b.x")).select(*samples.columns)


def running_sum(rows: DataFrame, value: str, out: str, block: int = 1 << 16) -> DataFrame:
    """Adds ``out``, the sum of ``value`` up to and with each idx of a channel: sums inside blocks, plus what the blocks before add up to."""
    rows = rows.withColumn("_block", F.floor(F.col("idx") / block))
    before = W.partitionBy(*KEYS).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*KEYS, "_block").agg(F.sum(value).alias("_t")).select(*KEYS, "_block", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_o"))
    inside = F.sum(value).over(W.partitionBy(*KEYS, "_block").orderBy("idx"))
    return rows.withColumn("_i", inside).join(offsets, [*KEYS, "_block"]).withColumn(out, F.col("_i") + F.col("_o")).drop("_block", "_i", "_o")


def detrend(samples: DataFrame) -> DataFrame:
    """x without each channel's regression line on t."""
    line = samples.groupBy(*KEYS).agg(F.regr_slope("x", "t").alias("_s"), F.regr_intercept("x", "t").alias("_i"))
    return samples.join(line, KEYS).withColumn("x", F.col("x") - F.col("_s") * F.col("t") - F.col("_i")).drop("_s", "_i")


def z_score(samples: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(x - mean) / (population sd + 1e-12) within ``by``."""
    moments = samples.groupBy(*by).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return samples.join(moments, by).withColumn("z", (F.col("x") - F.col("_m")) / (F.col("_s") + 1e-12)).drop("_m", "_s")


def robust_z(samples: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(x - median) / (1.4826 MAD + 1e-12) within ``by``."""
    median = samples.groupBy(*by).agg(F.percentile("x", 0.5).alias("_m"))
    centred = samples.join(median, by).withColumn("_d", F.abs(F.col("x") - F.col("_m")))
    mad = centred.groupBy(*by).agg(F.percentile("_d", 0.5).alias("_mad"))
    return centred.join(mad, by).withColumn("z", (F.col("x") - F.col("_m")) / (1.4826 * F.col("_mad") + 1e-12)).drop("_m", "_d", "_mad")


def moving_average(samples: DataFrame, half: int) -> DataFrame:
    """Centred mean of up to 2 half + 1 samples (fewer at the ends)."""
    return samples.withColumn("x", F.avg("x").over(_run().rowsBetween(-half, half)))


def frames(samples: DataFrame, win: int, step: int) -> DataFrame:
    """Each sample once for every frame of ``win`` samples, begun every ``step`` samples from 0, that holds it; adds frame and j."""
    first, last = F.greatest(F.lit(0), F.ceil((F.col("idx") - win + 1) / step)), F.floor(F.col("idx") / step)
    return samples.withColumn("frame", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("j", F.col("idx") - F.col("frame") * step)


def coarse_grain(samples: DataFrame, scale: int) -> DataFrame:
    """Means of runs of ``scale`` samples; a shorter run at the end goes."""
    own = samples.groupBy(*KEYS, F.floor(F.col("idx") / scale).alias("idx")).agg(F.avg("x").alias("x"), F.count("*").alias("_n"))
    return own.where(F.col("_n") == scale).drop("_n")


def average_reference(samples: DataFrame) -> DataFrame:
    """x less the mean of all channels at the same time."""
    mean = samples.groupBy("session_id", "idx").agg(F.avg("x").alias("_m"))
    return samples.join(mean, ["session_id", "idx"]).withColumn("x", F.col("x") - F.col("_m")).drop("_m")


def region_mean(samples: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean series of the channels of each region (roi, channel)."""
    return samples.join(F.broadcast(regions), "channel").groupBy("session_id", "roi", "idx").agg(F.avg("x").alias("x"))


def project(samples: DataFrame, basis: DataFrame) -> DataFrame:
    """Series of each mode: the sum of channels times the weights (mode, channel, w)."""
    return samples.join(F.broadcast(basis), "channel").groupBy("session_id", "mode", "idx").agg(F.sum(F.col("w") * F.col("x")).alias("a"))


def mode_power(projected: DataFrame) -> DataFrame:
    return projected.groupBy("session_id", "mode").agg(F.avg(F.col("a") * F.col("a")).alias("power"))


def band_table_to_long(wide: DataFrame) -> DataFrame:
    """electrode, condition (default ALL), kind (abs / rel), band, value of a table with columns abs_* and rel_*."""
    wide = wide if "condition" in wide.columns else wide.withColumn("condition", F.lit("ALL"))
    long = wide.unpivot(["electrode", "condition"], [c for c in wide.columns if c[:4] in ("abs_", "rel_")], "name", "value")
    return long.select("electrode", "condition", F.substring("name", 1, 3).alias("kind"), F.expr("substring(name, 5)").alias("band"), "value")


def below_mean_bin(samples: DataFrame) -> DataFrame:
    """bin: 1 where x is below its channel's mean, else 0."""
    mean = samples.groupBy(*KEYS).agg(F.avg("x").alias("_m"))
    return samples.join(mean, KEYS).withColumn("bin", (F.col("x") < F.col("_m")).cast("int")).drop("_m")


def virtual_channel(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """One series for each session: the mean of its channels with weights (session_id, channel, w)."""
    own = samples.join(weights, ["session_id", "channel"]).groupBy("session_id", "idx")
    return own.agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("x"))


def reflected(samples: DataFrame, most: int, by: list[str] = KEYS) -> DataFrame:
    """Samples with a mirror image of up to ``most`` of them beyond either end of a series; ``mirrored`` tells which those are."""
    ends = samples.groupBy(*by).agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"))
    places = F.array(F.struct(F.col("idx"), F.lit(False).alias("m")), F.struct((2 * F.col("_a") - F.col("idx")).alias("idx"), (F.col("idx") > F.col("_a")).alias("m")), F.struct((2 * F.col("_b") - F.col("idx")).alias("idx"), (F.col("idx") < F.col("_b")).alias("m")))
    near = lambda p: (p["idx"] == F.col("idx")) & ~p["m"] | p["m"] & ((p["idx"] < F.col("_a")) & (p["idx"] >= F.col("_a") - most) | (p["idx"] > F.col("_b")) & (p["idx"] <= F.col("_b") + most))
    rows = samples.join(ends, by).withColumn("_p", F.explode(F.array_distinct(F.filter(places, near))))
    return rows.select(*[F.col("_p.idx").alias("idx") if c == "idx" else F.col(c) for c in samples.columns], F.col("_p.m").alias("mirrored"))


def rolling_robust_z(samples: DataFrame, half: int, by: list[str] = KEYS, mirror: bool = False, size: int = 1 << 16) -> DataFrame:
    """(x - median) / (1.4826 MAD + 1e-12) over the samples with idx up to ``half`` away from each: by, idx, x, z.

    A kernel takes a block of at least ``size`` samples with ``half`` more on either side; the cost of a sample grows with the logarithm
    of the block, not with the window. Nulls are in no window and have no z. Windows are cut at the ends of a series, or
    filled by its mirror image.
    """
    size = max(size, 4 * half)
    rows = reflected(samples, half, by) if mirror else samples.withColumn("mirrored", F.lit(False))

    def kernel(start: int, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        idx, x = rows["_t"], rows["x"].astype(np.float64)
        own, known = (idx >= start) & (idx < start + size) & ~rows["mirrored"].astype(bool), ~np.isnan(x)
        middle, deviation = rolling_median_and_deviation(idx[known], x[known], idx[own], half)
        return {"idx": idx[own], "x": x[own], "z": (x[own] - middle) / (1.4826 * deviation + 1e-12)}

    return map_blocks(halo_blocks(rows.withColumn("x", F.col("x").cast("double")), by, size, half, ["x", "mirrored"]), by, size, kernel, "idx long, x double, z double")


def hann_average(samples: DataFrame, half: int, by: list[str] = KEYS) -> DataFrame:
    """Sum of the up to 2 half + 1 samples around each with Hann weights that sum to 1; what is outside counts as 0."""
    import math

    raw = [0.5 - 0.5 * math.cos(2 * math.pi * (k + half + 1) / (2 * half + 2)) for k in range(-half, half + 1)]
    parts = [F.coalesce(F.lead("x", k).over(_run(by)), F.lit(0.0)) * (w / sum(raw)) for k, w in zip(range(-half, half + 1), raw, strict=True)]
    return samples.withColumn("x", sum(parts[1:], parts[0]))


def orthogonalised(regions: DataFrame) -> DataFrame:
    """Region series (session_id, roi, idx, x) turned symmetrically so that they share nothing: as near to the old ones as can be.

    Only the regions' inner products, a row for each two, reach the kernel; its weights join back to the samples.
    """
    import pandas as pd

    i, j = regions.select("session_id", "idx", F.col("roi").alias("a"), F.col("x").alias("xa")), regions.select("session_id", "idx", F.col("roi").alias("b"), F.col("x").alias("xb"))
    gram = i.join(j, ["session_id", "idx"]).groupBy("session_id", "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("g"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        m = own.pivot(index="a", columns="b", values="g")
        values, vectors = np.linalg.eigh(m.to_numpy())
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12 * values.max()))) @ vectors.T
        out = pd.DataFrame(root, index=m.index, columns=m.columns).stack().rename("w").reset_index()
        return out.assign(session_id=own["session_id"].iloc[0])[["session_id", "a", "b", "w"]]

    weights = gram.groupBy("session_id").applyInPandas(run, "session_id string, a string, b string, w double")
    return j.join(weights, ["session_id", "b"]).groupBy("session_id", F.col("a").alias("roi"), "idx").agg(F.sum(F.col("w") * F.col("xb")).alias("x"))
