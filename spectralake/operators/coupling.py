"""Phase and amplitude coupling from phases(session_id, channel, idx, phase, amp), frames or line reads."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import halo_blocks, map_blocks, pair_blocks, signs_of_pairs
from .windows import numbered, sliding_sums


def _edge_sums(phases: DataFrame, keys: list[str], size: int) -> DataFrame:
    """For each two channels and stretch of time the number of times, the sums of cosine and sine of their phases' difference, and of the sine's sign and being above 0."""

    def kernel(known: np.ndarray, phase: np.ndarray) -> dict[str, np.ndarray]:
        z, m = np.where(known, np.exp(1j * phase), 0), known.astype(float)
        mean = z @ z.conj().T
        sign, above, _ = signs_of_pairs(z)
        return {"n": m @ m.T, "c": mean.real, "s": mean.imag, "sign": sign, "above": above}

    return pair_blocks(phases, keys, ["phase"], kernel, "n long, c double, s double, sign double, above double", size=size)


def phase_edges(phases: DataFrame, window: list[str] | None = None, size: int = 4096) -> DataFrame:
    """plv, mean phase, pli and directed pli of each two channels (per session and what else ``window`` names).

    A difference whose sine is 0 to nine places leads in neither direction. Unit phasors of all channels are multiplied stretch by stretch of
    time, and only sums for each two channels and stretch leave the kernel.
    """
    keys = window or ["session_id"]
    mean = lambda c: F.sum(c) / F.sum("n")
    own = _edge_sums(phases, keys, size).groupBy(*keys, "ch_i", "ch_j")
    return own.agg(F.sqrt(mean("c") ** 2 + mean("s") ** 2).alias("plv"), F.atan2(mean("s"), mean("c")).alias("mean_phase"), F.abs(mean("sign")).alias("pli"), mean("above").alias("dpli"))


def sliding_edges(phases: DataFrame, half: int, size: int = 512) -> DataFrame:
    """plv of each two channels over the 2 half + 1 times around each (session_id, at, ch_i, ch_j, plv), where both have all of these.

    A kernel takes the products of all channels' unit phasors in a stretch of ``size`` times; a window's sum is the difference of two running sums.
    """

    def kernel(start: int, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        names, row = np.unique(rows["channel"].astype(str), return_inverse=True)
        first, win = start - half, 2 * half + 1
        z = np.zeros((size + 2 * half, len(names)), complex)
        z[rows["_t"] - first, row] = np.exp(1j * rows["phase"])
        i, j = np.triu_indices(len(names), 1)
        over = lambda v: np.diff(np.concatenate([np.zeros((1, v.shape[1]), v.dtype), np.cumsum(v, 0)])[[np.arange(size), np.arange(size) + win]], axis=0)[0]
        there = (z != 0).astype(int)
        at, pair = np.nonzero(over(there[:, i] * there[:, j]) == win)
        if not len(at):
            return None
        plv = np.abs(over(z[:, i] * z[:, j].conj()))[at, pair] / win
        return {"at": at + start, "ch_i": names[i[pair]], "ch_j": names[j[pair]], "plv": plv}

    blocks = halo_blocks(phases.where("phase is not null"), ["session_id"], size, half, ["channel", "phase"])
    return map_blocks(blocks, ["session_id"], size, kernel, "at long, ch_i string, ch_j string, plv double")


def directed_control(phases: DataFrame, state: str, base: str, length: int, reps: int, size: int = 4096) -> DataFrame:
    """Directed phase lag of each two channels in ``state`` less in ``base`` (phases with a column state), against stretches of the base.

    session_id, ch_i, ch_j, in_state, in_base, delta, reverse (the same from ch_j to ch_i), null95 and p: of ``reps`` stretches of
    ``length`` times drawn from the base (see ``control_windows``), the 95 % point of the size of their difference from the base, and
    how often it is as large as that of delta. A session's stretches are the same for all its channels.
    """
    from .inference import control_windows

    ends = ["ch_i", "ch_j"]
    share = lambda c: F.sum(c) / F.sum("n")
    lead = lambda rows, keys: _edge_sums(rows, keys, size).groupBy(*keys, *ends).agg(share("above").alias("lead"), share(F.col("above") - F.col("sign")).alias("back"))
    own = lead(phases.where(F.col("state").isin(state, base)), ["session_id", "state"])
    of = lambda c, s: F.max(F.when(F.col("state") == s, F.col(c)))
    own = own.groupBy("session_id", *ends).agg(of("lead", state).alias("in_state"), of("lead", base).alias("in_base"), (of("back", state) - of("back", base)).alias("reverse"))
    times = phases.where(F.col("state") == base).select("session_id", F.lit("all").alias("channel"), "idx", F.lit(0.0).alias("x")).distinct()
    drawn = control_windows(times, length, reps).select("session_id", "rep", F.explode(F.sequence("start", F.col("start") + length - 1)).alias("idx"))
    null = lead(phases.select("session_id", "channel", "idx", "phase").join(drawn, ["session_id", "idx"]), ["session_id", "rep"])
    both = own.join(null.select("session_id", "rep", *ends, F.col("lead").alias("_l")), ["session_id", *ends])
    far, near = F.round(F.abs(F.col("_l") - F.col("in_base")), 9), F.round(F.abs(F.col("in_state") - F.col("in_base")), 9)
    keys = ["session_id", *ends, "in_state", "in_base", "reverse"]
    found = both.groupBy(*keys).agg(F.percentile(far, 0.95).alias("null95"), ((F.count_if(far >= near) + 1) / (F.count("*") + 1)).alias("p"))
    return found.select("session_id", *ends, "in_state", "in_base", (F.col("in_state") - F.col("in_base")).alias("delta"), "reverse", "null95", "p")


def locking_n_m(phases: DataFrame, reference: str, orders: list[tuple[int, int]]) -> DataFrame:
    """n:m locking of every channel with the reference: length of the mean of exp(i(n own - m reference))."""
    spark = phases.sparkSession
    grid = F.broadcast(spark.createDataFrame(orders, "n int, m int"))
    r = phases.where(F.col("channel") == reference).select("session_id", "idx", F.col("phase").alias("_r"))
    d = F.col("n") * F.col("phase") - F.col("m") * F.col("_r")
    rows = phases.where(F.col("channel") != reference).join(r, ["session_id", "idx"]).crossJoin(grid)
    return rows.groupBy("session_id", "channel", "n", "m").agg(F.sqrt(F.avg(F.cos(d)) ** 2 + F.avg(F.sin(d)) ** 2).alias("plv"))


def cross_spectra(reads: DataFrame, size: int = 4096) -> DataFrame:
    """Imaginary coherency and weighted phase-lag index of each two channels at each line, over frames; as :func:`phase_edges` a product of matrices."""

    def kernel(known: np.ndarray, re: np.ndarray, im: np.ndarray) -> dict[str, np.ndarray]:
        z, m = re + 1j * im, known.astype(float)
        own = (re * re + im * im) @ m.T
        return {"n": m @ m.T, "y": (z @ z.conj().T).imag, "size": signs_of_pairs(z)[2], "pi": own, "pj": own.T}

    keys = ["session_id", "ch_i", "ch_j", "f0"]
    parts = pair_blocks(reads, ["session_id", "f0"], ["re", "im"], kernel, "n long, y double, size double, pi double, pj double", time="frame", size=size)
    return parts.groupBy(*keys).agg((F.sum("y") / F.sqrt(F.sum("pi") * F.sum("pj"))).alias("imag_coherency"), (F.abs(F.sum("y")) / F.nullif(F.sum("size"), F.lit(0.0))).alias("wpli"))


def synchrony(phases: DataFrame) -> DataFrame:
    """Length of the mean of all channels' unit phasors at each time."""
    return phases.groupBy("session_id", "idx").agg(F.sqrt(F.avg(F.cos("phase")) ** 2 + F.avg(F.sin("phase")) ** 2).alias("r"))


def metastability(r: DataFrame) -> DataFrame:
    return r.groupBy("session_id").agg(F.var_pop("r").alias("metastability"), F.avg("r").alias("mean_r"))


def modulation_index(rows: DataFrame, by: list[str], bins: int = 18) -> DataFrame:
    """How unevenly amp lies over phase: (ln bins - entropy of the bins' mean amplitudes) / ln bins; an empty bin has mean 0."""
    b = F.least(F.floor((F.col("phase") + math.pi) / (2 * math.pi) * bins), F.lit(bins - 1))
    means = rows.groupBy(*by, b.alias("_b")).agg(F.avg("amp").alias("_a"))
    share = means.withColumn("_p", F.col("_a") / F.sum("_a").over(W.partitionBy(*by)))
    return share.groupBy(*by).agg(((math.log(bins) + F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")).otherwise(0.0))) / math.log(bins)).alias("mi"))


def vector_length(rows: DataFrame, by: list[str]) -> DataFrame:
    """Length of the mean of amp exp(i phase) over the mean amp."""
    return rows.groupBy(*by).agg((F.sqrt(F.avg(F.col("amp") * F.cos("phase")) ** 2 + F.avg(F.col("amp") * F.sin("phase")) ** 2) / F.avg("amp")).alias("mvl"))


def lag_correlation(samples: DataFrame, reference: str, most: int) -> DataFrame:
    """Correlation of each channel with the reference ``lag`` samples before (lag > 0: the channel follows)."""
    r = samples.where(F.col("channel") == reference).select("session_id", F.col("idx").alias("_i"), F.col("x").alias("_r"))
    rows = samples.where(F.col("channel") != reference).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_i", F.col("idx") - F.col("lag"))
    return rows.join(r, ["session_id", "_i"]).groupBy("session_id", "channel", "lag").agg(F.corr("x", "_r").alias("r"))


def peak_lag(curve: DataFrame) -> DataFrame:
    """The lag of the strongest correlation; of equal ones the smallest."""
    return curve.groupBy("session_id", "channel").agg(F.min_by(F.struct("lag", "r"), F.struct(-F.abs("r"), F.col("lag"))).alias("b")).select("session_id", "channel", "b.lag", "b.r")


def winding(phases: DataFrame) -> DataFrame:
    """Turns a channel's phase makes from its first sample to its last, steps taken the short way round."""
    step = F.col("phase") - F.lag("phase").over(W.partitionBy("session_id", "channel").orderBy("idx"))
    short = step - 2 * math.pi * F.floor(step / (2 * math.pi) + 0.5)
    return phases.withColumn("_s", short).groupBy("session_id", "channel").agg((F.sum("_s") / (2 * math.pi)).alias("turns"))


def weighted_score(values: DataFrame, by: list[str]) -> DataFrame:
    """Mean of v over orders k with weights 1 / k."""
    return values.groupBy(*by).agg((F.sum(F.col("v") / F.col("k")) / F.sum(1 / F.col("k"))).alias("score"))


def _with_reference(phases: DataFrame, reference: str) -> DataFrame:
    r = phases.where(F.col("channel") == reference).select("session_id", "idx", F.col("phase").alias("_r"))
    return phases.where(F.col("channel") != reference).join(r, ["session_id", "idx"]).withColumn("_d", F.col("phase") - F.col("_r"))


def _sliding_length(rows: DataFrame, keys: list[str], time: str, half: int, angle: Column) -> DataFrame:
    """Length of the mean of exp(i angle) over the 2 half + 1 times around each (at), where all are there."""
    sums = sliding_sums(rows, keys, time, {"c": F.cos(angle), "s": F.sin(angle)}, half)
    return sums.select(*keys, "at", (F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("n")).alias("plv"))


def sliding_locking(phases: DataFrame, reference: str, half: int) -> DataFrame:
    """Phase locking with the reference over the 2 half + 1 times around each time (at), where all are there."""
    return _sliding_length(_with_reference(phases, reference), ["session_id", "channel"], "idx", half, F.col("_d"))


def locking_curves(phases: DataFrame, reference: str, half: int, reps: int, block: int, draws: int) -> tuple[DataFrame, DataFrame]:
    """Sliding locking with the reference against the same with the reference's times moved round by 1 to ``reps``.

    First table: session_id, channel, at, plv, null95 (95 % point over the shifts at that time). Second: session_id, channel, mean, p of
    the mean, coverage (share of times above null95, in %), and low and high, the 95 % interval of the mean by ``draws`` draws of
    circular blocks of ``block`` times. The curves of all shifts come from one set of running sums.
    """
    from .inference import circular_block_bootstrap

    keys = ["session_id", "channel"]
    each = shifted(phases.select(*keys, "idx", "phase"), F.col("channel") == reference, reps)
    r = each.where(F.col("channel") == reference).select("session_id", "rep", "idx", F.col("phase").alias("_r"))
    rows = each.where(F.col("channel") != reference).join(r, ["session_id", "rep", "idx"])
    curves = _sliding_length(rows, [*keys, "rep"], "idx", half, F.col("phase") - F.col("_r"))
    limits = curves.where("rep > 0").groupBy(*keys, "at").agg(F.percentile("plv", 0.95).alias("null95"))
    own = curves.where("rep = 0").drop("rep").join(limits, [*keys, "at"])
    means = significance(curves.groupBy(*keys, "rep").agg(F.avg("plv").alias("mean")), keys, "mean").select(*keys, "mean", "p")
    share = own.groupBy(*keys).agg((100 * F.avg((F.round(F.col("plv") - F.col("null95"), 9) > 0).cast("int"))).alias("coverage"))
    interval = circular_block_bootstrap(own.select(*keys, F.col("at").alias("idx"), F.col("plv").alias("x")), keys, block, draws)
    return own, means.join(share, keys).join(interval, keys)


def phase_lead(phases: DataFrame, reference: str) -> DataFrame:
    """Share of the times at which a channel's phase is ahead of the reference's by less than half a turn."""
    ahead = F.round(F.sin("_d"), 9) > 0
    return _with_reference(phases, reference).groupBy("session_id", "channel").agg(F.avg(ahead.cast("int")).alias("lead"))


def comodulogram(reads: DataFrame, bins: int = 18) -> DataFrame:
    """Modulation index of the amplitude of each line by the phase of each lower one, over frames."""
    at = ["session_id", "channel", "frame"]
    p = reads.select(*at, F.col("f0").alias("f_phase"), F.atan2("im", "re").alias("phase"))
    a = reads.select(*at, F.col("f0").alias("f_amp"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amp"))
    return modulation_index(p.join(a, at).where("f_phase < f_amp"), ["session_id", "channel", "f_phase", "f_amp"], bins)


def reference_lag(reads: DataFrame, reference: str) -> DataFrame:
    """Phase locking of each channel with the reference at each line, mean phase and the lag it stands for."""
    r = reads.where(F.col("channel") == reference).select("session_id", "frame", "f0", F.atan2("im", "re").alias("_r"))
    rows = reads.where(F.col("channel") != reference).join(r, ["session_id", "frame", "f0"]).withColumn("_d", F.atan2("im", "re") - F.col("_r"))
    c, s = F.avg(F.cos("_d")), F.avg(F.sin("_d"))
    own = rows.groupBy("session_id", "channel", "f0").agg(F.sqrt(c * c + s * s).alias("plv"), F.atan2(s, c).alias("phase"))
    return own.withColumn("lag", F.col("phase") / (2 * math.pi * F.col("f0")))


def shifted(rows: DataFrame, channels: Column, reps: int, time: str = "idx") -> DataFrame:
    """``rows`` once for each rep from 0 on; for rep > 0 the times of ``channels`` (a condition) are moved round by rep.

    Times are numbered in the order of all the session has, so that a gap in them parts no pairs.
    """
    each = numbered(rows, time).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    return each.withColumn(time, F.when(channels, F.pmod(F.col(time) + F.col("rep"), F.col("_n"))).otherwise(F.col(time))).drop("_n")


def significance(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Of values by rep (0: as observed): the observed one, its p against the others, their 95 % point and z; nine places count."""
    rows = values.withColumn("_v", F.round(value, 9))
    own = W.partitionBy(*by)
    rows = rows.withColumn("_o", F.max(F.when(F.col("rep") == 0, F.col("_v"))).over(own)).where("rep > 0")
    return rows.groupBy(*by).agg(
        F.first("_o").alias(value), ((F.count_if(F.col("_v") >= F.col("_o")) + 1) / (F.count("*") + 1)).alias("p"), F.percentile("_v", 0.95).alias("null95"),
        ((F.first("_o") - F.avg("_v")) / (F.stddev_pop("_v") + 1e-12)).alias("z"),
    )


def locking_with_null(phases: DataFrame, reference: str, orders: list[tuple[int, int]], reps: int) -> DataFrame:
    """n:m locking with the reference, against that with the reference's times moved round."""
    grid = F.broadcast(phases.sparkSession.createDataFrame(orders, "n int, m int"))
    each = shifted(phases, F.col("channel") == reference, reps)
    r = each.where(F.col("channel") == reference).select("session_id", "rep", "idx", F.col("phase").alias("_r"))
    d = F.col("n") * F.col("phase") - F.col("m") * F.col("_r")
    rows = each.where(F.col("channel") != reference).join(r, ["session_id", "rep", "idx"]).crossJoin(grid)
    keys = ["session_id", "channel", "n", "m"]
    return significance(rows.groupBy(*keys, "rep").agg(F.sqrt(F.avg(F.cos(d)) ** 2 + F.avg(F.sin(d)) ** 2).alias("plv")), keys, "plv")


def cross_order_locking(reads: DataFrame, reference: str, low: float, order: int, half: int) -> DataFrame:
    """Locking of each channel's phase at order * low with order times the reference's phase at low, over the frames around each (at)."""
    near = lambda f: F.abs(F.col("f0") - f) < 1e-9
    r = reads.where((F.col("channel") == reference) & near(low)).select("session_id", "frame", F.atan2("im", "re").alias("_r"))
    rows = reads.where((F.col("channel") != reference) & near(order * low)).join(r, ["session_id", "frame"])
    return _sliding_length(rows, ["session_id", "channel"], "frame", half, F.atan2("im", "re") - order * F.col("_r"))


def metastability_with_null(phases: DataFrame, reps: int) -> DataFrame:
    """Variance of the synchrony over time, against that with each channel's times moved round by rep times its rank (the first: not)."""
    rank = F.dense_rank().over(W.partitionBy("session_id").orderBy("channel")) - 1
    each = numbered(phases.withColumn("_k0", rank), "idx").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    each = each.withColumn("idx", F.pmod(F.col("idx") + F.col("rep") * F.col("_k0"), F.col("_n")))
    r = each.groupBy("session_id", "rep", "idx").agg(F.sqrt(F.avg(F.cos("phase")) ** 2 + F.avg(F.sin("phase")) ** 2).alias("r"))
    return significance(r.groupBy("session_id", "rep").agg(F.var_pop("r").alias("metastability")), ["session_id"], "metastability")


def phase_regression(rows: DataFrame, by: list[str]) -> DataFrame:
    """R² of amp on the sine and cosine of phase, from correlations."""
    c, s = F.cos("phase"), F.sin("phase")
    yc, ys, cs = F.corr("amp", c), F.corr("amp", s), F.corr(c, s)
    return rows.groupBy(*by).agg(((yc * yc + ys * ys - 2 * yc * ys * cs) / (1 - cs * cs)).alias("r2"))


def comodulogram_with_null(reads: DataFrame, reps: int, bins: int) -> DataFrame:
    """Comodulogram cells within and across channels (the phase's and the amplitude's), against amplitudes moved round in time."""
    p = reads.select("session_id", "frame", F.col("channel").alias("of_phase"), F.col("f0").alias("f_phase"), F.atan2("im", "re").alias("phase"))
    a = reads.select("session_id", "frame", F.col("channel").alias("of_amp"), F.col("f0").alias("f_amp"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amp"))
    a = shifted(a, F.lit(True), reps, "frame")
    keys = ["session_id", "of_phase", "of_amp", "f_phase", "f_amp"]
    return significance(modulation_index(p.join(a, ["session_id", "frame"]).where("f_phase < f_amp"), [*keys, "rep"], bins), keys, "mi")


def best_cell(cells: DataFrame, by: list[str], places: int = 9) -> DataFrame:
    """The cell with the largest modulation index for each of ``by``; of those equal to ``places`` places the one of the lowest lines, the phase's first."""
    return cells.groupBy(*by).agg(F.min_by(F.struct("f_phase", "f_amp", "mi", "z"), F.struct(-F.round("mi", places), "f_phase", "f_amp")).alias("b")).select(*by, "b.*")


def sliding_modulation(phases: DataFrame, half: int, bins: int) -> DataFrame:
    """Modulation index over the 2 half + 1 times around each time (at), where all are there: from running sums of each bin's amplitudes and times."""
    b = F.least(F.floor((F.col("phase") + math.pi) / (2 * math.pi) * bins), F.lit(bins - 1))
    values = {f"a{k}": F.when(b == k, F.col("amp")).otherwise(0.0) for k in range(bins)} | {f"n{k}": (b == k).cast("double") for k in range(bins)}
    sums = sliding_sums(phases, ["session_id", "channel"], "idx", values, half)
    means = F.array(*[F.when(F.round(f"n{k}") > 0, F.greatest(F.col(f"a{k}"), F.lit(0.0)) / F.round(f"n{k}")).otherwise(0.0) for k in range(bins)])
    share = sums.select("session_id", "channel", "at", means.alias("_m")).withColumn("_t", F.aggregate("_m", F.lit(0.0), lambda t, v: t + v))
    minus = F.aggregate("_m", F.lit(0.0), lambda t, v: t + F.when(v > 0, v / F.col("_t") * F.ln(v / F.col("_t"))).otherwise(0.0))
    return share.select("session_id", "channel", "at", ((math.log(bins) + minus) / math.log(bins)).alias("mi"))


def series_lag_scan(series: DataFrame, other: DataFrame, most: int) -> DataFrame:
    """Correlation of series (session_id, channel, at, v) with other (session_id, at, w) ``lag`` steps before, for each lag up to ``most``."""
    rows = series.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_a", F.col("at") - F.col("lag"))
    return rows.join(other.select("session_id", F.col("at").alias("_a"), "w"), ["session_id", "_a"]).groupBy("session_id", "channel", "lag").agg(F.corr("v", "w").alias("r"))


def coupling_around_onsets(phases: DataFrame, onsets: DataFrame, before: int, after: int) -> DataFrame:
    """Mean vector length of amp on phase over all onsets at each tau, less its mean before them."""
    from .joins import epochs

    rows = vector_length(epochs(phases, onsets, before, after), ["channel", "tau"])
    return rows.withColumn("change", F.col("mvl") - F.avg(F.when(F.col("tau") < 0, F.col("mvl"))).over(W.partitionBy("channel")))


def order_score(medians: DataFrame, constraints: DataFrame, tolerance: float) -> DataFrame:
    """Share of the constraints (first, second) that hold by a session's medians (session_id, name, t): first at most ``tolerance`` after second."""
    a = medians.select("session_id", F.col("name").alias("first"), F.col("t").alias("_a"))
    b = medians.select("session_id", F.col("name").alias("second"), F.col("t").alias("_b"))
    both = F.broadcast(constraints).join(a, "first").join(b, ["session_id", "second"])
    return both.groupBy("session_id").agg(F.count("*").alias("tested"), F.avg((F.col("_a") <= F.col("_b") + tolerance).cast("int")).alias("score"))


def circular_statistics(phases: DataFrame, reference: str, bins: int) -> DataFrame:
    """Of each channel: resultant length, circular correlation with the reference, and the entropy of their joint phase bins over ln bins²."""
    own = W.partitionBy("session_id", "channel")
    mean = F.atan2(F.avg(F.sin("phase")).over(own), F.avg(F.cos("phase")).over(own))
    rows = phases.withColumn("_e", F.sin(F.col("phase") - mean))
    r = rows.where(F.col("channel") == reference).select("session_id", "idx", F.col("phase").alias("_rp"), F.col("_e").alias("_re"))
    both = rows.where(F.col("channel") != reference).join(r, ["session_id", "idx"])
    keys = ["session_id", "channel"]
    rho = F.avg(F.col("_e") * F.col("_re")) / F.sqrt(F.avg(F.col("_e") ** 2) * F.avg(F.col("_re") ** 2))
    line = both.groupBy(*keys).agg(F.sqrt(F.avg(F.cos("phase")) ** 2 + F.avg(F.sin("phase")) ** 2).alias("resultant"), rho.alias("rho"))
    cell = lambda c: F.least(F.floor((F.col(c) + math.pi) / (2 * math.pi) * bins), F.lit(bins - 1))
    share = both.groupBy(*keys, cell("phase").alias("_i"), cell("_rp").alias("_j")).agg(F.count("*").alias("_c")).withColumn("_q", F.col("_c") / F.sum("_c").over(W.partitionBy(*keys)))
    return line.join(share.groupBy(*keys).agg((-F.sum(F.col("_q") * F.ln("_q")) / math.log(bins * bins)).alias("joint_entropy")), keys)


def lagged_moments(samples: DataFrame, order: int) -> DataFrame:
    """Sums of products of every two of the series x(channel, t - lag), lags 0 to ``order``, at the times where all are there: a row for
    each session and pair (ca, la, cb, lb), with the number of times n. The series are taken from their means."""
    base = samples.groupBy("session_id", "channel").agg(F.avg("x").alias("_m"))
    centred = samples.join(base, ["session_id", "channel"]).select("session_id", "channel", "idx", (F.col("x") - F.col("_m")).alias("x"))
    lags = centred.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(order)))).withColumn("idx", F.col("idx") + F.col("lag"))
    ends = samples.groupBy("session_id").agg((F.min("idx") + order).alias("_a"), F.max("idx").alias("_b"))
    lags = lags.join(ends, "session_id").where(F.col("idx").between(F.col("_a"), F.col("_b"))).select("session_id", "idx", "channel", "lag", "x")
    a = lags.select("session_id", "idx", F.col("channel").alias("ca"), F.col("lag").alias("la"), F.col("x").alias("xa"))
    b = lags.select("session_id", "idx", F.col("channel").alias("cb"), F.col("lag").alias("lb"), F.col("x").alias("xb"))
    return a.join(b, ["session_id", "idx"]).groupBy("session_id", "ca", "la", "cb", "lb").agg(F.sum(F.col("xa") * F.col("xb")).alias("s"), F.count("*").alias("n"))


def granger(samples: DataFrame, order: int) -> DataFrame:
    """For every ordered pair of channels: F and log-variance gain of the source's past in predicting the target, at the order from 1
    to ``order`` with the largest F. Only the lagged moments reach the kernel."""
    import numpy as np
    import pandas as pd

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names = sorted(own["ca"].unique())
        at = {(c, lag): i for i, (c, lag) in enumerate((c, lag) for c in names for lag in range(order + 1))}
        m = np.zeros((len(at), len(at)))
        m[[at[k] for k in zip(own["ca"], own["la"], strict=True)], [at[k] for k in zip(own["cb"], own["lb"], strict=True)]] = own["s"]
        n, out = int(own["n"].max()), []

        def rss(target: int, past: list[int]) -> float:
            return m[target, target] - m[target, past] @ np.linalg.lstsq(m[np.ix_(past, past)], m[past, target], rcond=None)[0]

        for source in names:
            for target in names:
                if source != target:
                    tried = []
                    for p in range(1, order + 1):
                        past = [at[target, k] for k in range(1, p + 1)]
                        less, full = rss(at[target, 0], past), rss(at[target, 0], past + [at[source, k] for k in range(1, p + 1)])
                        tried.append((((less - full) / p) / (full / (n - 2 * p)), np.log(less / full), p))
                    best = max(tried)
                    out.append((own["session_id"].iloc[0], source, target, best[2], best[0], best[1]))
        return pd.DataFrame(out, columns=["session_id", "source", "target", "order", "f", "log_gain"])

    return lagged_moments(samples, order).groupBy("session_id").applyInPandas(run, "session_id string, source string, target string, order int, f double, log_gain double")


def envelope_coupling(reads: DataFrame) -> DataFrame:
    """Slope and correlation of each line's amplitude on every line's amplitude one frame before, by channel."""
    amp = reads.select("session_id", "channel", "frame", "f0", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amp"))
    before = amp.select("session_id", "channel", (F.col("frame") + 1).alias("frame"), F.col("f0").alias("f_from"), F.col("amp").alias("_x"))
    return amp.join(before, ["session_id", "channel", "frame"]).groupBy("session_id", "channel", "f_from", F.col("f0").alias("f_to")).agg(F.regr_slope("amp", "_x").alias("slope"), F.corr("amp", "_x").alias("r"))


def phase_gradient(phases: DataFrame, places: DataFrame, f0: float) -> DataFrame:
    """At each time, the plane through the channels' phases over their places (channel, px, py): direction and speed of the wave it stands for.

    Phases are taken from their circular mean, the short way round.
    """
    at = W.partitionBy("session_id", "idx")
    mean = F.atan2(F.avg(F.sin("phase")).over(at), F.avg(F.cos("phase")).over(at))
    d = F.col("phase") - F.col("_m")
    rows = phases.join(F.broadcast(places), "channel").withColumn("_m", mean).withColumn("_p", F.atan2(F.sin(d), F.cos(d)))
    xx, yy, xy = F.var_pop("px"), F.var_pop("py"), F.covar_pop("px", "py")
    px, py = F.covar_pop("px", "_p"), F.covar_pop("py", "_p")
    det = xx * yy - xy * xy
    fit = rows.groupBy("session_id", "idx").agg(((px * yy - py * xy) / det).alias("_gx"), ((py * xx - px * xy) / det).alias("_gy"))
    return fit.select("session_id", "idx", F.atan2("_gy", "_gx").alias("direction"), (2 * math.pi * f0 / (F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2) + 1e-12)).alias("speed"))


def phase_to_amplitude(phases: DataFrame, reference: str, most: int) -> DataFrame:
    """By how much the reference's phase (sine and cosine), ``lag`` steps before, raises the R² of each channel's amplitude over what its own
    amplitude then says: from partial correlations."""
    r = phases.where(F.col("channel") == reference).select("session_id", "idx", F.sin("phase").alias("_s"), F.cos("phase").alias("_c"))
    before = phases.where(F.col("channel") != reference).select("session_id", "channel", "idx", F.col("amp").alias("_a")).join(r, ["session_id", "idx"])
    before = before.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("idx", F.col("idx") + F.col("lag"))
    rows = phases.select("session_id", "channel", "idx", F.col("amp").alias("_y")).join(before, ["session_id", "channel", "idx"])
    pairs = {f"{a}{b}": F.corr(f"_{a}", f"_{b}").alias(f"{a}{b}") for a, b in ("ya", "ys", "yc", "sa", "ca", "sc")}
    own = rows.groupBy("session_id", "channel", "lag").agg(*pairs.values())
    part = lambda x, y, xa, ya: (F.col(x + y) - F.col(xa) * F.col(ya)) / F.sqrt((1 - F.col(xa) ** 2) * (1 - F.col(ya) ** 2))
    s, c, sc = part("y", "s", "sa", "ya"), part("y", "c", "ca", "ya"), part("s", "c", "sa", "ca")
    gain = (1 - F.col("ya") ** 2) * (s * s + c * c - 2 * s * c * sc) / (1 - sc * sc)
    return own.select("session_id", "channel", "lag", gain.alias("gain"))


def phase_amplitude_direction(phases: DataFrame, reference: str, most: int, reps: int) -> DataFrame:
    """Whether the reference's phase foretells a channel's amplitude or the amplitude the phase: for each direction the lag (1 to ``most``) with the largest
    gain, that gain and its p against channels moved round by 1 to ``reps``.

    phase_to_amplitude: by how much sine and cosine of the phase ``lag`` before raise the R² of the amplitude over its own past; amplitude_to_phase:
    by how much the amplitude raises that of the phase's sine over the phase's past. All from correlations.
    """
    keys = ["session_id", "channel", "rep", "lag"]
    each = shifted(phases.select("session_id", "channel", "idx", "phase", "amp"), F.col("channel") != reference, reps)
    r = each.where(F.col("channel") == reference).select("session_id", "rep", "idx", F.sin("phase").alias("_s"), F.cos("phase").alias("_c"))
    now = each.where(F.col("channel") != reference).select("session_id", "channel", "rep", "idx", F.col("amp").alias("_a")).join(r, ["session_id", "rep", "idx"])
    before = now.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("idx", F.col("idx") + F.col("lag"))
    rows = now.select("session_id", "channel", "rep", "idx", F.col("_a").alias("_y"), F.col("_s").alias("_z")).join(before, ["session_id", "channel", "rep", "idx"])
    names = ["ya", "ys", "yc", "za", "zs", "zc", "as", "ac", "sc"]
    own = rows.groupBy(*keys).agg(*[F.corr(f"_{n[0]}", f"_{n[1]}").alias(n) for n in names])
    c = {n: F.col(n) for n in names}
    part = lambda xy, xz, yz: (xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz))
    # y on s and c, given a.
    s, k, x = part(c["ys"], c["ya"], c["as"]), part(c["yc"], c["ya"], c["ac"]), part(c["sc"], c["as"], c["ac"])
    forward = (1 - c["ya"] ** 2) * (s * s + k * k - 2 * s * k * x) / (1 - x * x)
    # z on a, given s and c.
    given = lambda p, q, r: part(p, q, r)
    za, zc, ac = given(c["za"], c["zs"], c["as"]), given(c["zc"], c["zs"], c["sc"]), given(c["ac"], c["as"], c["sc"])
    known = (c["zs"] ** 2 + c["zc"] ** 2 - 2 * c["zs"] * c["zc"] * c["sc"]) / (1 - c["sc"] ** 2)
    backward = (1 - known) * part(za, zc, ac) ** 2
    gains = own.select(*keys, F.explode(F.array(F.struct(F.lit("phase_to_amplitude").alias("direction"), forward.alias("gain")), F.struct(F.lit("amplitude_to_phase").alias("direction"), backward.alias("gain")))).alias("g")).select(*keys, "g.*")
    by = ["session_id", "channel", "direction"]
    peak = gains.groupBy(*by, "rep").agg(F.max("gain").alias("gain"), F.min_by("lag", F.struct(-F.round("gain", 9), F.col("lag"))).alias("lag"))
    return significance(peak, by, "gain").join(peak.where("rep = 0").select(*by, "lag"), by).select(*by, "lag", "gain", "p")


def envelope_matrix(reads: DataFrame, reference: str, reps: int, ridge: float = 1e-9) -> DataFrame:
    """The linear map of the lines' amplitudes of one frame to those of the next, from the reference to each channel and back: session_id, channel,
    direction, f_from, f_to, gain, threshold and significant.

    Gains come from one ridge regression for all lines together. The threshold is the 95 % point of a gain's size over ``reps`` in which each line
    of the source is moved round by rep times its rank. Only sums of products, a row for each two lines, reach the kernel.
    """
    import pandas as pd

    amp = numbered(reads, "frame").select("session_id", "channel", "frame", "_n", "f0", F.dense_rank().over(W.partitionBy("session_id").orderBy("f0")).alias("_k"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amp"))
    others = amp.where(F.col("channel") != reference).select("session_id", "channel").distinct()
    ref = amp.where(F.col("channel") == reference).drop("channel").join(others, "session_id")
    own = amp.where(F.col("channel") != reference)
    sides = [("from_reference", ref, own), ("to_reference", own, ref)]
    sums = None
    for way, source, target in sides:
        moved = source.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("frame", F.pmod(F.col("frame") + F.col("rep") * F.col("_k"), F.col("_n")))
        x = moved.where("frame < _n - 1").select("session_id", "channel", "rep", "frame", F.col("f0").alias("b"), F.col("amp").alias("xb"))
        left = x.select("session_id", "channel", "rep", "frame", F.lit("x").alias("side"), F.col("b").alias("a"), F.col("xb").alias("xa"))
        y = target.where("frame > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).select("session_id", "channel", "rep", (F.col("frame") - 1).alias("frame"), F.lit("y").alias("side"), F.col("f0").alias("a"), F.col("amp").alias("xa"))
        part = left.unionByName(y).join(x, ["session_id", "channel", "rep", "frame"]).groupBy("session_id", "channel", "rep", "side", "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("s")).withColumn("direction", F.lit(way))
        sums = part if sums is None else sums.unionByName(part)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        xx, yx = (part[part["side"] == side].pivot(index="a", columns="b", values="s") for side in "xy")
        g = np.linalg.solve(xx.to_numpy() + ridge * np.eye(len(xx)), yx[xx.index].to_numpy().T).T
        out = pd.DataFrame(g, index=yx.index, columns=xx.index).stack().rename("gain").rename_axis(["f_to", "f_from"]).reset_index()
        return out.assign(**{c: part[c].iloc[0] for c in ("session_id", "channel", "direction", "rep")})[["session_id", "channel", "direction", "rep", "f_from", "f_to", "gain"]]

    found = sums.groupBy("session_id", "channel", "direction", "rep").applyInPandas(run, "session_id string, channel string, direction string, rep int, f_from double, f_to double, gain double")
    keys = ["session_id", "channel", "direction", "f_from", "f_to"]
    both = found.groupBy(*keys).agg(F.max(F.when(F.col("rep") == 0, F.col("gain"))).alias("gain"), F.percentile(F.when(F.col("rep") > 0, F.abs("gain")), 0.95).alias("threshold"))
    return both.withColumn("significant", F.round(F.abs("gain") - F.col("threshold"), 9) > 0)


def epoch_coupling(phases: DataFrame, onsets: DataFrame, before: int, after: int, half: int, bins: int) -> DataFrame:
    """Modulation index of each epoch around the times of ``onsets``: session_id, event_id, tau, mi and change, mi less the epoch's mean before its onset.

    At each tau it is the index over the 2 half + 1 times around, averaged over channels.
    """
    from .joins import epochs

    curve = sliding_modulation(phases, half, bins).groupBy("session_id", F.col("at").alias("idx")).agg(F.avg("mi").alias("mi"))
    rows = epochs(curve, onsets, before, after)
    base = F.avg(F.when(F.col("tau") < 0, F.col("mi"))).over(W.partitionBy("session_id", "event_id"))
    return rows.select("session_id", "event_id", "tau", "mi", (F.col("mi") - base).alias("change"))


def directed_spectra(samples: DataFrame, order: int, lines: list[float], fs: float, ridge: float = 1e-8) -> DataFrame:
    """Vector autoregression of each session's channels (the order up to ``order`` with the least BIC), and from it at each line the
    directed transfer function (shares of a target's inflow) and partial directed coherence (shares of a source's outflow) of every
    ordered pair. Only the lagged moments reach the kernel."""
    import numpy as np
    import pandas as pd

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names = sorted(own["ca"].unique())
        k, n = len(names), int(own["n"].max())
        at = {(c, lag): lag * k + i for lag in range(order + 1) for i, c in enumerate(names)}
        m = np.zeros((len(at), len(at)))
        m[[at[x] for x in zip(own["ca"], own["la"], strict=True)], [at[x] for x in zip(own["cb"], own["lb"], strict=True)]] = own["s"]
        tried = []
        for p in range(1, order + 1):
            past = m[k : k * (p + 1), k : k * (p + 1)]
            a = np.linalg.solve(past + ridge * np.trace(past) / len(past) * np.eye(len(past)), m[k : k * (p + 1), :k]).T
            noise = (m[:k, :k] - a @ m[k : k * (p + 1), :k]) / n
            tried.append((n * np.linalg.slogdet(noise)[1] + k * k * p * np.log(n), p, a))
        _, p, a = min(tried, key=lambda t: t[:2])
        out = []
        for f in lines:
            b = np.eye(k) - sum(a[:, j * k : (j + 1) * k] * np.exp(-2j * np.pi * f * (j + 1) / fs) for j in range(p))
            h = np.abs(np.linalg.inv(b)) ** 2
            b = np.abs(b) ** 2
            dtf, pdc = h / h.sum(1, keepdims=True), b / b.sum(0, keepdims=True)
            out += [(own["session_id"].iloc[0], names[j], names[i], f, p, dtf[i, j], pdc[i, j]) for i in range(k) for j in range(k) if i != j]
        return pd.DataFrame(out, columns=["session_id", "source", "target", "f0", "order", "dtf", "pdc"])

    return lagged_moments(samples, order).groupBy("session_id").applyInPandas(run, "session_id string, source string, target string, f0 double, order int, dtf double, pdc double")


def net_flow(spectra: DataFrame) -> DataFrame:
    """For each channel and line what goes out of it less what comes in, by the directed transfer function."""
    out = spectra.select("session_id", "f0", F.col("source").alias("channel"), "dtf").union(spectra.select("session_id", "f0", F.col("target").alias("channel"), -F.col("dtf")))
    return out.groupBy("session_id", "f0", "channel").agg(F.sum("dtf").alias("net"))


def frame_synchrony(r: DataFrame, samples_rms: DataFrame, half: int, guard: int, floor: float = 1e-7) -> DataFrame:
    """Mean synchrony over the 2 half + 1 times around each, ``guard`` times off either end, null where the signal (session_id, idx, rms) is
    flatter than ``floor`` there."""
    around = W.partitionBy("session_id").orderBy("idx").rowsBetween(-half, half)
    every = W.partitionBy("session_id")
    rows = r.join(samples_rms, ["session_id", "idx"]).withColumns({"_r": F.avg("r").over(around), "_f": F.avg("rms").over(around), "_a": F.min("idx").over(every), "_b": F.max("idx").over(every)})
    return rows.where(F.col("idx").between(F.col("_a") + guard, F.col("_b") - guard)).select("session_id", "idx", F.when(F.col("_f") >= floor, F.col("_r")).alias("r"))


def sub_harmonic_locking(reads: DataFrame, reference: str, low: float, order: int, half: int) -> DataFrame:
    """Locking of order times each channel's phase at low with the reference's phase at order * low, over the frames around each (at)."""
    near = lambda f: F.abs(F.col("f0") - f) < 1e-9
    r = reads.where((F.col("channel") == reference) & near(order * low)).select("session_id", "frame", F.atan2("im", "re").alias("_r"))
    rows = reads.where((F.col("channel") != reference) & near(low)).join(r, ["session_id", "frame"])
    return _sliding_length(rows, ["session_id", "channel"], "frame", half, order * F.atan2("im", "re") - F.col("_r"))


def peak_lag_null(samples: DataFrame, reference: str, most: int, reps: int, step: int) -> DataFrame:
    """The strongest correlation with the reference at any lag up to ``most``, against that with the reference moved round by rep * step among the
    session's times, which are numbered in order."""
    placed = numbered(samples, "idx")
    r = placed.where(F.col("channel") == reference).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).select("session_id", "rep", F.pmod(F.col("idx") + F.col("rep") * step, F.col("_n")).alias("_i"), F.col("x").alias("_r"))
    rows = placed.where(F.col("channel") != reference).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_i", F.col("idx") - F.col("lag"))
    each = rows.join(r, ["session_id", "_i"]).groupBy("session_id", "channel", "rep", "lag").agg(F.abs(F.corr("x", "_r")).alias("r"))
    return significance(each.groupBy("session_id", "channel", "rep").agg(F.max("r").alias("r")), ["session_id", "channel"], "r")


def transfer_entropy(samples: DataFrame, reference: str, lags: list[int], block: int = 360, k: int = 4, reps: int = 0) -> DataFrame:
    """Transfer entropy between each channel and the reference, both ways, at each lag: entropies by k-th neighbours within blocks of
    ``block`` samples, averaged over the blocks of a recording (te); with ``reps`` also its p, 95 % point and z against as many shifts.

    For rep r the source is moved round within its block by r / (reps + 1) of the block, which leaves distances within the target and within
    the source as they are: these are taken once for all reps, and only their joint neighbours anew. The series are
    taken in units of their sd. A block with fewer than 8 k points is left out.
    """
    import pandas as pd

    from ..functions.kernels import digamma
    from .cleaning import z_score

    z = z_score(samples).select("session_id", "channel", "idx", F.col("z").alias("x"))
    r = z.where(F.col("channel") == reference).select("session_id", "idx", F.col("x").alias("r"))
    both = z.where(F.col("channel") != reference).join(r, ["session_id", "idx"]).withColumn("block", F.floor(F.col("idx") / block))

    def entropy(gap: np.ndarray, dimensions: int) -> float:
        radius = np.maximum(np.partition(gap, k, axis=1)[:, k], 1e-12)
        return digamma(len(gap)) - digamma(k) + dimensions * np.log(2 * radius).mean()

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        apart = lambda v: np.abs(v[:, None] - v[None, :])
        out = []
        for lag in lags:
            n = len(own) - lag
            if n < 8 * k:
                continue
            for way, x, y in (("from_reference", own["r"], own["x"]), ("to_reference", own["x"], own["r"])):
                x, y = x.to_numpy(), y.to_numpy()
                past, source = apart(y[:n]), apart(x[:n])
                joint = np.maximum(apart(y[lag:]), past)
                alone = entropy(joint, 2) - entropy(past, 1)
                for rep in range(reps + 1):
                    move = rep * n // (reps + 1)
                    moved = np.roll(source, (move, move), (0, 1))
                    te = alone - entropy(np.maximum(joint, moved), 3) + entropy(np.maximum(past, moved), 2)
                    out.append((own["session_id"].iloc[0], own["channel"].iloc[0], way, lag, rep, te))
        return pd.DataFrame(out, columns=["session_id", "channel", "direction", "lag", "rep", "te"])

    found = both.groupBy("session_id", "channel", "block").applyInPandas(run, "session_id string, channel string, direction string, lag int, rep int, te double")
    keys = ["session_id", "channel", "direction", "lag"]
    values = found.groupBy(*keys, "rep").agg(F.avg("te").alias("te"))
    return significance(values, keys, "te") if reps else values.drop("rep")


def conditional_granger(samples: DataFrame, order: int, win: int, step: int, frames_each: int = 32) -> DataFrame:
    """For every ordered pair of channels in each whole frame of ``win`` samples begun every ``step``: F and log-variance gain of the source's past of
    ``order`` samples in predicting the target from the past of all channels (f, log_gain), and from the pasts of the two alone (f_pair, log_gain_pair).

    session_id, frame, source, target and these four. Step divides win. A kernel gets stretches of ``frames_each`` frames; products of lagged
    channels are summed once for each step, and a frame's are the difference of two running sums. What a source adds follows from the inverse of
    the moments of all pasts: the full model is solved once for each target, none is fitted again without the source. A frame needs its
    samples and the ``order`` before it of all channels of its session, and more samples than the full model has coefficients.
    """
    if win % step:
        raise ValueError("step must divide win")
    size, halo = step * frames_each, win + order
    count = samples.groupBy("session_id").agg(F.countDistinct("channel").alias("_all"))

    def kernel(start: int, rows: dict[str, np.ndarray], channels: int) -> dict[str, np.ndarray] | None:
        names, row = np.unique(rows["channel"].astype(str), return_inverse=True)
        c, first = len(names), start - order
        x = np.full((c, order + size + win), np.nan)
        at = rows["_t"] - first
        inside = (at >= 0) & (at < x.shape[1])
        x[row[inside], at[inside]] = rows["x"][inside]
        if c < channels or c < 2:
            return None
        base = np.nanmean(x, 1, keepdims=True)
        # A row for each time: 1, the channels, and their values 1 to ``order`` before (by lag, then channel).
        lagged = np.concatenate([np.ones((1, size + win)), *[(x - base)[:, order - k : order - k + size + win] for k in range(order + 1)]])
        whole = ~np.isnan(lagged).any(0)
        lagged = np.where(whole, lagged, 0).reshape(len(lagged), -1, step).transpose(1, 0, 2)
        sums = np.cumsum(np.concatenate([np.zeros((1, len(lagged[0]), len(lagged[0]))), lagged @ lagged.transpose(0, 2, 1)]), 0)
        per, out = win // step, []
        for f in range(frames_each):
            m = sums[f + per] - sums[f]
            if m[0, 0] < win or win <= c * order + 1:
                continue
            m = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / win
            past = np.arange(c, c * (order + 1))
            inverse = np.linalg.pinv(m[np.ix_(past, past)], hermitian=True)
            weights = inverse @ m[past, :c]
            left = np.maximum(np.diag(m)[:c] - (m[past, :c] * weights).sum(0), 1e-300)
            for a in range(c):
                mine = np.arange(order) * c + a
                block = np.linalg.pinv(inverse[np.ix_(mine, mine)], hermitian=True)
                for b in range(c):
                    if a == b:
                        continue
                    added = max(weights[mine, b] @ block @ weights[mine, b], 0)
                    theirs = np.arange(order) * c + b
                    two = past[np.r_[theirs, mine]]
                    fit = lambda p: max(m[b, b] - m[b, p] @ np.linalg.lstsq(m[np.ix_(p, p)], m[p, b], rcond=None)[0], 1e-300)  # noqa: E731, B023
                    less, full = fit(past[theirs]), fit(two)
                    out.append((start // step + f, names[a], names[b], added / order / (left[b] / (win - c * order - 1)), np.log1p(added / left[b]), (less - full) / order / (full / (win - 2 * order - 1)), np.log(less / full)))
        return dict(zip(("frame", "source", "target", "f", "log_gain", "f_pair", "log_gain_pair"), map(np.array, zip(*out, strict=True)), strict=True)) if out else None

    blocks = halo_blocks(samples.withColumn("x", F.col("x").cast("double")), ["session_id"], size, halo, ["channel", "x"]).join(count, "session_id")
    return map_blocks(blocks, ["session_id"], size, kernel, "frame long, source string, target string, f double, log_gain double, f_pair double, log_gain_pair double", ["_all"])
