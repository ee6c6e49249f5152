"""Spectra and line reads. Few lines are read by summing windowed cosines and sines in SQL, so no sample leaves the JVM; all bins
of a frame come from an FFT over blocks of frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import analytic_band, fractal_power, high_passed, welch_power
from .cleaning import frames
from .joins import gram
from .windows import sliding_sums


def lock_in(framed: DataFrame, lines: DataFrame, win: int, fs: float) -> DataFrame:
    """re and im of each line (f0) in each whole frame: at the bin nearest to f0, periodic Hann window, frame mean removed.

    One aggregate: the mean is taken out of the sums afterwards, so samples are read once.
    """
    k = F.round(F.col("f0") * win / fs)
    hann = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("j") / win)
    turn = 2 * math.pi * k * F.col("j") / win
    rows = framed.crossJoin(F.broadcast(lines)).withColumns({"_c": hann * F.cos(turn), "_s": hann * F.sin(turn)})
    sums = rows.groupBy("session_id", "channel", "frame", "f0").agg(
        F.sum(F.col("x") * F.col("_c")).alias("xc"), F.sum(F.col("x") * F.col("_s")).alias("xs"), F.sum("_c").alias("c"), F.sum("_s").alias("s"), F.avg("x").alias("m"), F.count("*").alias("n")
    )
    return sums.where(F.col("n") == win).select("session_id", "channel", "frame", "f0", (F.col("xc") - F.col("m") * F.col("c")).alias("re"), (F.col("m") * F.col("s") - F.col("xs")).alias("im"))


def _framed_blocks(samples: DataFrame, win: int, step: int, frames_each: int = 64) -> DataFrame:
    """Samples packed into runs of ``frames_each`` frames, each with all samples its frames need: session_id, channel, block, s (idx, x)."""
    size = step * frames_each
    first = F.greatest(F.floor((F.col("idx") - win + step) / size), F.lit(0))
    spread = samples.withColumn("block", F.explode(F.sequence(F.least(first, F.floor(F.col("idx") / size)), F.floor(F.col("idx") / size))))
    return spread.groupBy("session_id", "channel", "block").agg(F.collect_list(F.struct("idx", "x")).alias("s"))


def _block_frames(s, block: int, win: int, step: int, frames_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and samples of the whole frames that begin in a block; frames with a missing sample are left out."""
    start = block * step * frames_each
    x = np.full(step * (frames_each - 1) + win, np.nan)
    at, value = np.array([v["idx"] for v in s]) - start, np.array([v["x"] for v in s], float)
    inside = (at >= 0) & (at < len(x))
    x[at[inside]] = value[inside]
    rows = np.lib.stride_tricks.sliding_window_view(x, win)[::step]
    whole = ~np.isnan(rows).any(1)
    return np.flatnonzero(whole) + block * frames_each, rows[whole]


def _transformed(rows: np.ndarray) -> np.ndarray:
    """FFT of frames without their mean, through a periodic Hann window."""
    win = rows.shape[1]
    return np.fft.rfft((rows - rows.mean(1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)), axis=1)


def frame_transform(samples: DataFrame, win: int, step: int, frames_each: int = 64) -> DataFrame:
    """re and im of every bin k of each whole frame: an FFT kernel over blocks of frames, so no recording is one group."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                number, rows = _block_frames(row.s, row.block, win, step, frames_each)
                z = _transformed(rows)
                out += [(row.session_id, row.channel, int(k), a.real, a.imag) for k, a in zip(number, z, strict=True)]
            yield pd.DataFrame(out, columns=["session_id", "channel", "frame", "re", "im"])

    packed = _framed_blocks(samples, win, step, frames_each).mapInPandas(run, "session_id string, channel string, frame long, re array<double>, im array<double>")
    return packed.select("session_id", "channel", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v")).select("session_id", "channel", "frame", "k", "v.re", "v.im")


def welch(samples: DataFrame, win: int, fs: float, frames_each: int = 64) -> DataFrame:
    """Power density by half-overlapping Hann frames with their mean removed, averaged over frames.

    A block of frames gives one row with its summed spectra; only these are summed over blocks.
    """
    sided = np.where((np.arange(win // 2 + 1) == 0) | (np.arange(win // 2 + 1) * 2 == win), 1.0, 2.0) / (fs * win * 0.375)  # fs times the sum of the squared window

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                _, rows = _block_frames(row.s, row.block, win, win // 2, frames_each)
                if len(rows):
                    out.append((row.session_id, row.channel, len(rows), (np.abs(_transformed(rows)) ** 2).sum(0) * sided))
            yield pd.DataFrame(out, columns=["session_id", "channel", "n", "p"])

    packed = _framed_blocks(samples, win, win // 2, frames_each).mapInPandas(run, "session_id string, channel string, n long, p array<double>")
    each = packed.select("session_id", "channel", "n", F.posexplode("p").alias("k", "p"))
    return each.groupBy("session_id", "channel", (F.col("k") * fs / win).alias("f")).agg((F.sum("p") / F.sum("n")).alias("p"))


def band_power(spectra: DataFrame, bands: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid area of each band (band, f_lo, f_hi), and its share of all bands."""
    steps = spectra.withColumn("_f", F.lead("f").over(W.partitionBy(*by).orderBy("f"))).withColumn("_p", F.lead("p").over(W.partitionBy(*by).orderBy("f")))
    area = steps.join(F.broadcast(bands), (F.col("f") >= F.col("f_lo")) & (F.col("_f") <= F.col("f_hi"))).groupBy(*by, "band").agg(F.sum((F.col("_f") - F.col("f")) * (F.col("p") + F.col("_p")) / 2).alias("power"))
    return area.withColumn("share", F.col("power") / F.sum("power").over(W.partitionBy(*by)))


def aperiodic_slope(spectra: DataFrame, by: list[str], lo: float, hi: float) -> DataFrame:
    """Slope of log p on log f between lo and hi."""
    return spectra.where((F.col("f") > 0) & (F.col("p") > 0) & F.col("f").between(lo, hi)).groupBy(*by).agg(F.regr_slope(F.ln("p"), F.ln("f")).alias("slope"))


def peak_and_centroid(spectra: DataFrame, by: list[str], lo: float, hi: float) -> DataFrame:
    own = spectra.where(F.col("f").between(lo, hi))
    return own.groupBy(*by).agg(F.min_by("f", F.struct(-F.col("p"), F.col("f"))).alias("peak_f"), (F.sum(F.col("f") * F.col("p")) / F.sum("p")).alias("centroid"))


def line_z(spectra: DataFrame, lines: DataFrame, by: list[str], half: float, side: float) -> DataFrame:
    """Mean power within ``half`` of each line against median and MAD of the bins beside it, up to ``side`` away."""
    near = spectra.join(F.broadcast(lines), F.abs(F.col("f") - F.col("f0")) <= side).withColumn("_in", F.abs(F.col("f") - F.col("f0")) <= half)
    flank = near.where("not _in")
    median = flank.groupBy(*by, "f0").agg(F.percentile("p", 0.5).alias("_m"))
    mad = flank.join(median, [*by, "f0"]).groupBy(*by, "f0").agg(F.first("_m").alias("_m"), F.percentile(F.abs(F.col("p") - F.col("_m")), 0.5).alias("_d"))
    own = near.where("_in").groupBy(*by, "f0").agg(F.avg("p").alias("p"))
    return own.join(mad, [*by, "f0"]).select(*by, "f0", ((F.col("p") - F.col("_m")) / (1.4826 * F.col("_d") + 1e-12)).alias("z"))


def line_snr(spectra: DataFrame, lines: DataFrame, by: list[str], half: float, side: float) -> DataFrame:
    """Mean power at each line over that of its flanks."""
    near = spectra.join(F.broadcast(lines), F.abs(F.col("f") - F.col("f0")) <= side)
    inside = F.abs(F.col("f") - F.col("f0")) <= half
    return near.groupBy(*by, "f0").agg((F.avg(F.when(inside, F.col("p"))) / F.avg(F.when(~inside, F.col("p")))).alias("snr"))


def refine_lines(spectra: DataFrame, lines: DataFrame, by: list[str], half: float) -> DataFrame:
    """The highest bin near each line, moved to the top of the parabola through the logs of it and its neighbours."""
    run = W.partitionBy(*by).orderBy("f")
    rows = spectra.withColumns({"_l": F.ln(F.lag("p").over(run)), "_r": F.ln(F.lead("p").over(run)), "_d": F.lead("f").over(run) - F.col("f")})
    top = rows.join(F.broadcast(lines), F.abs(F.col("f") - F.col("f0")) <= half).groupBy(*by, "f0").agg(F.min_by(F.struct("f", "p", "_l", "_r", "_d"), F.struct(-F.col("p"), F.col("f"))).alias("b"))
    c = F.ln("b.p")
    bend = F.col("b._l") - 2 * c + F.col("b._r")
    move = F.when(F.abs(bend) > 1e-9, 0.5 * (F.col("b._l") - F.col("b._r")) / bend)
    return top.select(*by, "f0", (F.col("b.f") + F.coalesce(move * F.col("b._d"), F.lit(0.0))).alias("f"))


def coherence(reads: DataFrame, reference: str, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Magnitude-squared coherence of every channel with the reference at each line, over frames."""
    r = reads.where(F.col("channel") == reference).select(*by, "frame", "f0", F.col("re").alias("rr"), F.col("im").alias("ri"))
    both = reads.where(F.col("channel") != reference).join(r, [*by, "frame", "f0"])
    re, im = F.avg(F.col("re") * F.col("rr") + F.col("im") * F.col("ri")), F.avg(F.col("im") * F.col("rr") - F.col("re") * F.col("ri"))
    return both.groupBy(*by, "channel", "f0").agg(((re * re + im * im) / (F.avg(F.col("re") ** 2 + F.col("im") ** 2) * F.avg(F.col("rr") ** 2 + F.col("ri") ** 2))).alias("msc"), F.count("*").alias("frames"))


def shifted_coherence(reads: DataFrame, reference: str, reps: int, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Coherence with the reference's frames moved round by rep * 7 + 1 frames: only reduced rows move."""
    count = reads.groupBy(*by).agg(F.countDistinct("frame").alias("_n"))
    r = reads.where(F.col("channel") == reference).join(count, list(by)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    r = r.withColumn("frame", F.pmod(F.col("frame") + F.col("rep") * 7 + 1, F.col("_n"))).drop("_n")
    others = reads.where(F.col("channel") != reference).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return coherence(others.unionByName(r), reference, (*by, "rep"))


def every_shifted_coherence(reads: DataFrame, reference: str, most: int, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Coherence with the reference's frames moved round by 1, 2, .. frames: every distinct shift but none, up to ``most``."""
    count = reads.groupBy(*by).agg(F.countDistinct("frame").alias("_n"))
    every = count.where("_n > 1").withColumn("rep", F.explode(F.sequence(F.lit(1), F.least(F.col("_n") - 1, F.lit(most)).cast("int"))))
    both = reads.join(every, list(by)).withColumn("frame", F.when(F.col("channel") == reference, F.pmod(F.col("frame") + F.col("rep"), F.col("_n"))).otherwise(F.col("frame")))
    return coherence(both.drop("_n"), reference, (*by, "rep"))


def band_phase(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """amp and phase of each band for blocks (session_id, channel, fs, start_idx, halo, x array): a kernel per block.

    The halo on either side of a block is cut from what is returned.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples():
            z = analytic_band(row.x, row.fs, row.f_lo, row.f_hi)
            keep = slice(row.halo_left, len(z) - row.halo_right)
            out.append((row.session_id, row.channel, row.band, row.start_idx, np.abs(z[keep]), np.angle(z[keep])))
        return pd.DataFrame(out, columns=["session_id", "channel", "band", "start_idx", "amp", "phase"])

    packed = blocks.crossJoin(F.broadcast(bands)).mapInPandas(lambda parts: map(run, parts), "session_id string, channel string, band string, start_idx long, amp array<double>, phase array<double>")
    return packed.select("session_id", "channel", "band", "start_idx", F.posexplode(F.arrays_zip("amp", "phase")).alias("k", "v")).select("session_id", "channel", "band", (F.col("start_idx") + F.col("k")).alias("idx"), "v.amp", "v.phase")


def high_pass(blocks: DataFrame, lo: float) -> DataFrame:
    """Series of blocks (see :func:`blocks_of`) without what is slower than ``lo``: session_id, channel, idx, x."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                y = high_passed(row.x, row.fs, lo)
                out.append((row.session_id, row.channel, row.start_idx, y[row.halo_left : len(y) - row.halo_right]))
            yield pd.DataFrame(out, columns=["session_id", "channel", "start_idx", "y"])

    found = blocks.mapInPandas(run, "session_id string, channel string, start_idx long, y array<double>")
    return found.select("session_id", "channel", "start_idx", F.posexplode("y").alias("k", "x")).select("session_id", "channel", (F.col("start_idx") + F.col("k")).alias("idx"), "x")


def band_decomposition(phases: DataFrame) -> DataFrame:
    """Of band signals (session_id, channel, band, idx, amp, phase): each sample's value x, power, share of all bands' power and
    whether x is below its mean."""
    rows = phases.withColumn("x", F.col("amp") * F.cos("phase")).withColumn("power", F.col("x") ** 2)
    at, own = W.partitionBy("session_id", "channel", "idx"), W.partitionBy("session_id", "channel", "band")
    rows = rows.withColumns({"share": F.col("power") / F.nullif(F.sum("power").over(at), F.lit(0.0)), "bin": (F.col("x") < F.avg("x").over(own)).cast("int")})
    return rows.select("session_id", "channel", "band", "idx", "x", "power", "share", "bin")


def blocks_of(samples: DataFrame, size: int, halo: int, fs: float) -> DataFrame:
    """Samples packed into blocks of ``size`` with ``halo`` samples of the neighbours: a recording is never one group."""
    first, last = F.floor((F.col("idx") - halo) / size), F.floor((F.col("idx") + halo) / size)
    spread = samples.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first), last)))
    own = spread.groupBy("session_id", "channel", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("_s"))
    start = F.col("block") * size
    own = own.select("session_id", "channel", F.lit(fs).alias("fs"), start.alias("start_idx"), F.size(F.filter("_s", lambda s: s["idx"] < start)).alias("halo_left"), F.size(F.filter("_s", lambda s: s["idx"] >= start + size)).alias("halo_right"), F.transform("_s", lambda s: s["x"]).alias("x"))
    return own.where(F.size("x") > F.col("halo_left") + F.col("halo_right"))


def relative_power_table(powers: DataFrame, bands: list[str]) -> DataFrame:
    """Mean share of each band, a row for each channel and a column for each band."""
    return powers.groupBy("channel").pivot("band", bands).agg(F.avg("share"))


def frame_spectra(samples: DataFrame, win: int, step: int, fs: float, lo: float, hi: float) -> DataFrame:
    """Power of each bin from lo to hi in each whole frame."""
    read = frame_transform(samples, win, step).withColumn("f", F.col("k") * fs / win).where(F.col("f").between(lo, hi))
    return read.select("session_id", "channel", "frame", "f", (F.col("re") ** 2 + F.col("im") ** 2).alias("p"))


def frame_slopes(framed: DataFrame, lo: float, hi: float, excluded: list[tuple[float, float]], least: int) -> DataFrame:
    """Aperiodic slope (log10 p on log10 f) of each frame between lo and hi, without the excluded bands, where ``least`` bins are left."""
    keep = F.col("f").between(lo, hi) & (F.col("f") > 0) & (F.col("p") > 0)
    for a, b in excluded:
        keep &= ~F.col("f").between(a, b)
    own = framed.where(keep).groupBy("session_id", "channel", "frame").agg(F.regr_slope(F.log10("p"), F.log10("f")).alias("slope"), F.count("*").alias("_n"))
    return own.where(F.col("_n") >= least).drop("_n")


def line_hits(z: DataFrame, by: list[str], level: float) -> DataFrame:
    """Lines whose z reaches ``level``, and the harmonicity index: the sum of the positive z."""
    return z.groupBy(*by).agg(F.count_if(F.round("z", 9) >= level).alias("hits"), F.sum(F.greatest("z", F.lit(0.0))).alias("harmonicity"))


def binomial_tail(n: Column, least: Column, p0: float) -> Column:
    """Chance of ``least`` or more successes in ``n`` draws of chance p0, for any n: each term follows from the one before by their ratio, as logarithms."""
    start = F.struct(F.lit(0.0).alias("total"), (n * math.log1p(-p0)).alias("term"))

    def step(got: Column, k: Column) -> Column:
        term = F.when(k == 0, got["term"]).otherwise(got["term"] + F.ln((n - k + 1) / F.greatest(k, F.lit(1))) + math.log(p0 / (1 - p0)))
        return F.struct((got["total"] + F.when(k >= least, F.exp(term)).otherwise(0.0)).alias("total"), term.alias("term"))

    return F.least(F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step)["total"], F.lit(1.0))


def epoch_consistency(z: DataFrame, by: list[str], level: float, p0: float) -> DataFrame:
    """Of z by epoch: number of epochs, the share with z of at least ``level``, and the one-sided binomial p of as many hits."""
    own = z.groupBy(*by).agg(F.count("*").alias("epochs"), F.count_if(F.round("z", 9) >= level).alias("_h"))
    return own.select(*by, "epochs", (F.col("_h") / F.col("epochs")).alias("consistency"), binomial_tail(F.col("epochs"), F.col("_h"), p0).alias("p"))


def smoothed_ridge(ridges: DataFrame, half: int) -> DataFrame:
    """Ridge frequencies by the running median of up to 2 half + 1 frames."""
    around = W.partitionBy("session_id", "channel").orderBy("frame").rowsBetween(-half, half)
    return ridges.withColumn("f", F.percentile("f", 0.5).over(around))


def ridge_agreement(ridges: DataFrame, reference: str, f0: float, level: float) -> DataFrame:
    """Of each channel's ridge: mean distance from f0, share of frames with power above ``level``, and correlation with the reference's ridge."""
    r = ridges.where(F.col("channel") == reference).select("session_id", "frame", F.col("f").alias("_r"))
    both = ridges.where(F.col("channel") != reference).join(r, ["session_id", "frame"])
    return both.groupBy("session_id", "channel").agg(F.avg(F.abs(F.col("f") - f0)).alias("alignment"), F.avg((F.col("p") > level).cast("int")).alias("coverage"), F.corr("f", "_r").alias("r"))


def ridge_coupling(ridges: DataFrame, reference: str, reps: int) -> DataFrame:
    """Correlation of each channel's ridge power with the reference's, and its p, 95 % point and z against the reference moved round by 1 to ``reps`` frames."""
    from .coupling import shifted, significance

    each = shifted(ridges.select("session_id", "channel", "frame", "p"), F.col("channel") == reference, reps, "frame")
    r = each.where(F.col("channel") == reference).select("session_id", "rep", "frame", F.col("p").alias("_r"))
    both = each.where(F.col("channel") != reference).join(r, ["session_id", "rep", "frame"])
    return significance(both.groupBy("session_id", "channel", "rep").agg(F.coalesce(F.corr("p", "_r"), F.lit(0.0)).alias("r")), ["session_id", "channel"], "r")


def largest_overtone(spectra: DataFrame, by: list[str], f0: float, half: float, most: int) -> DataFrame:
    """The overtone (2 to ``most``) with the largest mean power over that near f0, and that ratio."""
    near = lambda k: F.avg(F.when(F.abs(F.col("f") - k * f0) <= half, F.col("p")))
    ratios = F.array_max(F.array(*[F.struct(F.round(near(k) / F.nullif(near(1), F.lit(0.0)), 9).alias("ratio"), F.lit(k).alias("overtone")) for k in range(2, most + 1)]))
    return spectra.groupBy(*by).agg(ratios.alias("b")).select(*by, "b.overtone", "b.ratio")


def ridge(framed: DataFrame) -> DataFrame:
    """The strongest bin of each frame; of bins equal to six places the lowest."""
    top = framed.groupBy("session_id", "channel", "frame").agg(F.min_by(F.struct("f", "p"), F.struct(-F.round("p", 6), F.col("f"))).alias("b"))
    return top.select("session_id", "channel", "frame", "b.f", "b.p")


def band_features(framed: DataFrame, bands: DataFrame, names: list[str]) -> DataFrame:
    """Power of each band (f_lo <= f < f_hi) in each frame, a column for each band."""
    own = framed.join(F.broadcast(bands), (F.col("f") >= F.col("f_lo")) & (F.col("f") < F.col("f_hi")))
    return own.groupBy("session_id", "channel", "frame").pivot("band", names).agg(F.sum("p"))


def with_reference_products(reads: DataFrame, reference: str, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """For each other channel's read the parts of its product with the reference's (x, y) and both powers (p, q)."""
    r = reads.where(F.col("channel") == reference).select(*by, "frame", "f0", F.col("re").alias("rr"), F.col("im").alias("ri"))
    both = reads.where(F.col("channel") != reference).join(r, [*by, "frame", "f0"])
    return both.select(*by, "channel", "frame", "f0", (F.col("re") * F.col("rr") + F.col("im") * F.col("ri")).alias("x"), (F.col("im") * F.col("rr") - F.col("re") * F.col("ri")).alias("y"), (F.col("re") ** 2 + F.col("im") ** 2).alias("p"), (F.col("rr") ** 2 + F.col("ri") ** 2).alias("q"))


def sliding_coherence(reads: DataFrame, reference: str, half: int | Column, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Coherence with the reference over the 2 half + 1 frames around each frame (at), where all are there; half may follow from f0."""
    sums = sliding_sums(with_reference_products(reads, reference, by), [*by, "channel", "f0"], "frame", {c: F.col(c) for c in "xypq"}, half)
    return sums.select(*by, "at", "channel", "f0", ((F.col("x") ** 2 + F.col("y") ** 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0.0))).alias("msc"), F.col("n").alias("frames"))


def frames_for_cycles(cycles: float, win: int, step: int, fs: float, shortest: float, longest: float) -> Column:
    """Half the number of frames around one that together span ``cycles`` of f0, between ``shortest`` and ``longest`` seconds; at least 1."""
    seconds = F.least(F.greatest(cycles / F.col("f0"), F.lit(shortest)), F.lit(longest))
    return F.greatest(F.lit(1), F.ceil(F.round((seconds * fs - win) / (2 * step), 9)))


def component_weights(samples: DataFrame, f0: float, half: float, flank: float, fs: float, kind: str = "ssd", by: tuple[str, ...] = ("session_id",), size: int = 4096, halo: int = 1024) -> DataFrame:
    """Weights of the channels (by, channel, w; length 1, the largest positive) and ``ratio``, what the weighted sum makes largest.

    ``ssd``: power within ``half`` of f0 over that in the flanks of width ``flank`` on either side; ``pca``: power within ``half`` of f0 over that of
    all channels. Bands are cut from blocks of samples; only their covariances, a row for each two channels, reach the kernel. ``by`` may
    name more than the session, such as the state or event that samples belong to; bands are cut before samples are parted so, where
    ``samples`` has these columns.
    """
    bands = [("signal", f0 - half, f0 + half)] + ([("low", max(f0 - half - flank, 1e-3 * fs), f0 - half), ("high", f0 + half, f0 + half + flank)] if kind == "ssd" else [])
    cut = band_phase(blocks_of(samples, size, halo, fs), samples.sparkSession.createDataFrame(bands, "band string, f_lo double, f_hi double"))
    cut = cut.select("session_id", "channel", "idx", "band", (F.col("amp") * F.cos("phase")).alias("x"))
    more = [c for c in by if c != "session_id"]
    if more:
        cut = cut.join(samples.select("session_id", "channel", "idx", *more), ["session_id", "channel", "idx"])
    keys = [*by, "band"]
    own = cut.groupBy(*keys, "channel").agg(F.var_pop("x").alias("cov"), F.count("*").alias("n")).select(*keys, F.col("channel").alias("ch_i"), F.col("channel").alias("ch_j"), "cov", "n")
    pairs = gram(cut, tuple(keys)).select(*keys, "ch_i", "ch_j", "cov", F.lit(None).cast("long").alias("n"))
    kinds = dict(cut.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(part["ch_i"].unique())

        def matrix(band: str) -> tuple[np.ndarray, float]:
            rows = part[part["band"] == band]
            m = rows.pivot(index="ch_i", columns="ch_j", values="cov").reindex(index=names, columns=names).to_numpy(float)
            return np.nan_to_num(np.where(np.isnan(m), m.T, m)), float(rows["n"].max()) if len(rows) else 0.0

        signal = matrix("signal")[0]
        if kind == "ssd":
            (low, n_low), (high, n_high) = matrix("low"), matrix("high")
            noise = (low * n_low + high * n_high) / max(n_low + n_high, 1)
            values, axes = np.linalg.eigh(noise)
            keep = values > 1e-10 * max(values.max(), 1e-300)
            turn = axes[:, keep] / np.sqrt(values[keep])  # the flanks' covariance becomes the unit matrix
            gains, inner = np.linalg.eigh(turn.T @ signal @ turn)
            w, ratio = turn @ inner[:, -1], gains[-1]
        else:
            gains, axes = np.linalg.eigh(signal)
            w, ratio = axes[:, -1], gains[-1] / max(np.trace(signal), 1e-300)
        w = w / np.linalg.norm(w) * np.sign(w[np.abs(w).argmax()])
        return pd.DataFrame({**{c: part[c].iloc[0] for c in by}, "channel": names, "w": w, "ratio": ratio})[[*by, "channel", "w", "ratio"]]

    return own.unionByName(pairs).groupBy(*by).applyInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "channel string, w double, ratio double"]))


def weighted_sum(samples: DataFrame, weights: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One series for each of ``by``: the sum of its channels times their weights (by, channel, w)."""
    return samples.join(weights.select(*by, "channel", "w"), [*by, "channel"]).groupBy(*by, "idx").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def trace_summary(traces: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """Median and largest value of traces, and the share of their points above ``threshold``."""
    return traces.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), F.max(value).alias("largest"), F.avg((F.col(value) > threshold).cast("int")).alias("coverage"))


def overtone_index(spectra: DataFrame, by: list[str], f0: float, half: float, most: int) -> DataFrame:
    """Sum of the mean powers near the overtones 2 f0 to most f0, over that near f0."""
    near = lambda k: F.avg(F.when(F.abs(F.col("f") - k * f0) <= half, F.col("p")))
    over = sum((near(k) for k in range(3, most + 1)), near(2))
    return spectra.groupBy(*by).agg((over / F.nullif(near(1), F.lit(0.0))).alias("stack_index"))


def fractal_split(samples: DataFrame, win: int, fs: float, size: int = 4096) -> DataFrame:
    """Power of each bin by block of ``size`` samples, averaged over blocks, and how much of it is fractal and how much oscillates.

    Factors go from 1.1 to 1.9; blocks too short for two frames when shrunk go.
    """
    packed = samples.groupBy("session_id", "channel", F.floor(F.col("idx") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    factors = np.arange(1.1, 1.95, 0.05)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                x = np.array([v["x"] for v in row.s], float)
                if len(x) >= 2 * 1.5 * win:
                    out.append((row.session_id, row.channel, welch_power(x, win, fs), fractal_power(x, win, fs, factors)))
            yield pd.DataFrame(out, columns=["session_id", "channel", "p", "q"])

    found = packed.select("session_id", "channel", "s").mapInPandas(run, "session_id string, channel string, p array<double>, q array<double>")
    each = found.select("session_id", "channel", F.posexplode(F.arrays_zip("p", "q")).alias("k", "v")).where("k > 0")
    own = each.groupBy("session_id", "channel", (F.col("k") * fs / win).alias("f")).agg(F.avg("v.p").alias("p"), F.avg("v.q").alias("fractal"))
    return own.withColumn("oscillatory", F.col("p") - F.col("fractal"))
