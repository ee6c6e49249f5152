"""Wavelet, multitaper and higher-order reads of framed samples, and coherence maps over them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import halo_blocks, map_blocks
from ..functions.kernels import slepian
from .cleaning import detrend, hann_average, rolling_robust_z
from .coupling import significance
from .events import islands
from .spectral import sliding_coherence
from .windows import numbered


def _weighted_reads(framed: DataFrame, win: int, weight: Column, turn: Column, keys: list[str]) -> DataFrame:
    """re and im of the frames' samples, without their mean, times ``weight`` and exp(-i turn), for the whole frames."""
    rows = framed.withColumns({"_c": weight * F.cos(turn), "_s": weight * F.sin(turn), "_e": weight * weight})
    sums = rows.groupBy("session_id", "channel", "frame", *keys).agg(F.sum(F.col("x") * F.col("_c")).alias("xc"), F.sum(F.col("x") * F.col("_s")).alias("xs"), F.sum("_c").alias("c"), F.sum("_s").alias("s"), F.avg("x").alias("m"), F.sum("_e").alias("e"), F.count("*").alias("n"))
    own = sums.where(F.col("n") == win)
    return own.select("session_id", "channel", "frame", *keys, ((F.col("xc") - F.col("m") * F.col("c")) / F.sqrt("e")).alias("re"), ((F.col("m") * F.col("s") - F.col("xs")) / F.sqrt("e")).alias("im"))


def _wavelet_reads(rows: dict[str, np.ndarray], first: int, count: int, found: list[float], win: int, fs: float, w0: float) -> tuple[np.ndarray, np.ndarray]:
    """Morlet coefficients (lines x centres) at the ``count`` times from ``first`` on, and which of these have all ``win`` samples of their frame."""
    half = win // 2
    value = rows["x"].astype(np.float64)
    at = rows["_t"] - (first - half)
    known = ~np.isnan(value) & (at >= 0) & (at < count + 2 * half)
    x, there = np.zeros(count + 2 * half), np.zeros(count + 2 * half, np.int64)
    # Less their mean, which keeps sums small; the frames' own means are taken off below.
    x[at[known]], there[at[known]] = value[known] - (value[known].mean() if known.any() else 0), 1
    over = lambda v: np.diff(np.lib.stride_tricks.sliding_window_view(np.r_[0, np.cumsum(v)], win + 1)[:, [0, -1]], axis=1)[:, 0]
    whole, mean = over(there) == win, over(x) / win
    n = 1 << int(len(x) + win - 1).bit_length()
    spectrum, k, out = np.fft.fft(x, n), np.arange(-half, half + 1), np.empty((len(found), count), complex)
    for i, f0 in enumerate(found):
        envelope = np.exp(-k * k / (2 * (w0 / (2 * math.pi * f0) * fs) ** 2))
        wave = envelope * np.exp(-2j * math.pi * f0 * k / fs)
        read = np.fft.ifft(spectrum * np.fft.fft(wave[::-1], n))[win - 1 : win - 1 + count]
        out[i] = (read - mean * wave.sum()) / math.sqrt((envelope**2).sum())
    return out, whole


def _with_lines(blocks: DataFrame, lines: DataFrame, *columns: str) -> DataFrame:
    """Blocks with all lines, a parameter of the query, as arrays in order of their frequency."""
    packed = F.array_sort(F.collect_set(F.struct(F.col("f0"), *columns)))
    return blocks.crossJoin(F.broadcast(lines.agg(packed.alias("_l")))).select(*blocks.columns, *[F.col("_l")[c].alias(f"line_{c}") for c in ("f0", *columns)])


def morlet(samples: DataFrame, lines: DataFrame, win: int, step: int, fs: float, w0: float = 6.0, size: int = 1 << 14) -> DataFrame:
    """Morlet coefficients of each line (f0) at the centres of the whole frames of ``win`` (odd) samples begun every ``step``; the wavelet has
    sigma w0 / (2 pi f0) seconds and unit energy, and the frame's mean is taken off: session_id, channel, frame, f0, re, im.

    A kernel convolves blocks of at least ``size`` samples, with half a frame on either side, with the wavelets of all lines by FFT; frames
    that miss a sample have no row.
    """
    half, size, keys = win // 2, max(size, 4 * win), ["session_id", "channel"]

    def kernel(start: int, rows: dict[str, np.ndarray], found: list[float]) -> dict[str, np.ndarray]:
        z, whole = _wavelet_reads(rows, start, size, found, win, fs, w0)
        at = np.arange(start, start + size)
        at = at[whole & ((at - half) % step == 0)]
        z = z[:, at - start].ravel()
        return {"frame": np.tile((at - half) // step, len(found)), "f0": np.repeat(found, len(at)), "re": z.real, "im": z.imag}

    blocks = halo_blocks(samples.withColumn("x", F.col("x").cast("double")), keys, size, half, ["x"])
    return map_blocks(_with_lines(blocks, lines), keys, size, kernel, "frame long, f0 double, re double, im double", ["line_f0"])


def ridge_tracks(samples: DataFrame, grid: DataFrame, win: int, fs: float, median_half: int, w0: float = 6.0, size: int = 1 << 14) -> DataFrame:
    """The drifting frequency of each order of a grid (k, f0): session_id, channel, k, idx, f, x.

    At every sample whose frame is whole, the order's strongest wavelet (to nine places; of equal ones the lowest) gives a place on its
    grid; the lower median of these places over up to 2 ``median_half`` + 1 samples gives f, and x is the wavelet's amplitude there. A
    kernel reads the grids of all orders in a block at once, and only the ridges leave it.
    """
    keys, size = ["session_id", "channel"], max(size, 4 * win)

    def kernel(start: int, rows: dict[str, np.ndarray], found: list[float], orders: list[int]) -> dict[str, np.ndarray]:
        first, count = start - median_half, size + 2 * median_half
        z, whole = _wavelet_reads(rows, first, count, found, win, fs, w0)
        amplitude, own, out = np.abs(z), whole.copy(), []
        own[:median_half] = False
        own[count - median_half :] = False
        for k in sorted(set(orders)):
            mine = np.flatnonzero(np.array(orders) == k)
            place = np.where(whole, amplitude[mine].round(9).argmax(0).astype(float), np.nan)
            around = np.sort(np.lib.stride_tricks.sliding_window_view(np.pad(place, median_half, constant_values=np.nan), 2 * median_half + 1), axis=1)
            n = (~np.isnan(around)).sum(1)
            middle = np.take_along_axis(around, np.maximum((n - 1) // 2, 0)[:, None], 1)[own, 0].astype(int)
            at = np.flatnonzero(own)
            out.append((np.full(len(at), k), at + first, np.array(found)[mine][middle], amplitude[mine][middle, at]))
        return dict(zip(("k", "idx", "f", "x"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else None

    blocks = halo_blocks(samples.withColumn("x", F.col("x").cast("double")), keys, size, win // 2 + median_half, ["x"])
    return map_blocks(_with_lines(blocks, grid, "k"), keys, size, kernel, "k int, idx long, f double, x double", ["line_f0", "line_k"])


def drifting_spikes(samples: DataFrame, grid: DataFrame, win: int, fs: float, median_half: int, smooth_half: int, baseline_half: int, level: float, least: int) -> DataFrame:
    """Spikes of each order along its drifting ridge: stretches of ``least`` samples or more whose amplitude, smoothed by a Hann window, is
    ``level`` or more robust deviations above its rolling baseline.

    session_id, channel, k, start, end (behind), n, peak_z, peak_idx (the first of equal ones) and peak_f, the ridge's frequency there.
    """
    by = ["session_id", "channel", "k"]
    tracks = ridge_tracks(detrend(samples), grid, win, fs, median_half)
    smooth = hann_average(tracks, smooth_half, by).select(*by, "idx", "x")
    z = rolling_robust_z(smooth, baseline_half, by).select(*by, "idx", F.round("z", 9).alias("x"))
    found = islands(z, F.col("x") >= level, by, least)
    return found.join(tracks.select(*by, F.col("idx").alias("peak_idx"), F.col("f").alias("peak_f")), [*by, "peak_idx"]).select(*by, "start", "end", "n", F.col("peak").alias("peak_z"), "peak_idx", "peak_f")


def multitaper(framed: DataFrame, lines: DataFrame, win: int, fs: float, tapers: int, nw: float | None = None) -> DataFrame:
    """Reads of each line in each whole frame through each of ``tapers`` tapers, at the bin nearest to the line: sine tapers, or with ``nw`` the
    Slepian ones of that time-bandwidth product."""
    each = framed.crossJoin(F.broadcast(lines))
    if nw is None:
        each = each.withColumn("taper", F.explode(F.sequence(F.lit(1), F.lit(tapers))))
        weight = math.sqrt(2 / (win + 1)) * F.sin(math.pi * F.col("taper") * (F.col("j") + 1) / (win + 1))
    else:
        # A row for each sample of a frame, with all tapers' weights.
        table = framed.sparkSession.createDataFrame([(j, w) for j, w in enumerate(slepian(win, nw, tapers).T.tolist())], "j long, _w array<double>")
        each = each.join(F.broadcast(table), "j").select("*", F.posexplode("_w").alias("_k", "_v")).withColumn("taper", F.col("_k") + 1)
        weight = F.col("_v")
    return _weighted_reads(each, win, weight, 2 * math.pi * F.round(F.col("f0") * win / fs) * F.col("j") / win, ["f0", "taper"])


def multitaper_coherence(reads: DataFrame, reference: str) -> DataFrame:
    """Coherence with the reference over frames and tapers, its 95 % interval by leaving out a taper at a time, phase and lag."""
    r = reads.where(F.col("channel") == reference).select("session_id", "frame", "f0", "taper", F.col("re").alias("rr"), F.col("im").alias("ri"))
    both = reads.where(F.col("channel") != reference).join(r, ["session_id", "frame", "f0", "taper"])
    parts = {"x": F.col("re") * F.col("rr") + F.col("im") * F.col("ri"), "y": F.col("im") * F.col("rr") - F.col("re") * F.col("ri"), "p": F.col("re") ** 2 + F.col("im") ** 2, "q": F.col("rr") ** 2 + F.col("ri") ** 2}
    keys = ["session_id", "channel", "f0"]
    own = both.groupBy(*keys, "taper").agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    every = W.partitionBy(*keys)
    own = own.withColumns({f"t{k}": F.sum(k).over(every) for k in parts})
    left = {k: F.col(f"t{k}") - F.col(k) for k in parts}
    own = own.withColumns({"msc": (F.col("tx") ** 2 + F.col("ty") ** 2) / (F.col("tp") * F.col("tq")), "jk": (left["x"] ** 2 + left["y"] ** 2) / (left["p"] * left["q"])})
    found = own.groupBy(*keys).agg(F.first("msc").alias("msc"), F.sqrt((F.count("*") - 1) * F.var_pop("jk")).alias("_se"), F.first(F.atan2("ty", "tx")).alias("phase"))
    return found.select(*keys, "msc", (F.col("msc") - 1.96 * F.col("_se")).alias("low"), (F.col("msc") + 1.96 * F.col("_se")).alias("high"), "phase", (F.col("phase") / (2 * math.pi * F.col("f0"))).alias("lag"))


def max_null_map(reads: DataFrame, reference: str, half: int | Column, reps: int, step: int) -> DataFrame:
    """Sliding coherence at each frame and line against the 95 % point of the largest values it has when the reference's frames are
    moved round by rep * step: session_id, channel, f0, threshold, cells, significant (cells above it). For the null frames are numbered in order."""
    spread = numbered(reads, "frame").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    moved = spread.withColumn("frame", F.when(F.col("channel") == reference, F.pmod(F.col("frame") + F.col("rep") * step, F.col("_n"))).otherwise(F.col("frame"))).drop("_n")
    null = sliding_coherence(moved, reference, half, ("session_id", "rep"))
    top = null.groupBy("session_id", "channel", "f0", "rep").agg(F.max("msc").alias("_m")).groupBy("session_id", "channel", "f0").agg(F.percentile("_m", 0.95).alias("threshold"))
    own = sliding_coherence(reads, reference, half).join(top, ["session_id", "channel", "f0"])
    return own.groupBy("session_id", "channel", "f0").agg(F.first("threshold").alias("threshold"), F.count("*").alias("cells"), F.count_if(F.round(F.col("msc") - F.col("threshold"), 9) > 0).alias("significant"))


def bicoherence(low: DataFrame, high: DataFrame, triads: DataFrame, low_by: list[str], by: list[str]) -> DataFrame:
    """Bicoherence of the bins k1 and k2 of ``low`` with bin k1 + k2 of ``high`` (by, frame, k, re, im), over frames.

    ``triads`` has (k1, k2); ``low_by`` are the keys that low shares with high.
    """
    a = low.select(*low_by, "frame", F.col("k").alias("k1"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = low.select(*low_by, "frame", F.col("k").alias("k2"), F.col("re").alias("br"), F.col("im").alias("bi"))
    pairs = a.join(F.broadcast(triads), "k1").join(b, [*low_by, "frame", "k2"])
    product = pairs.select(*low_by, "frame", "k1", "k2", (F.col("k1") + F.col("k2")).alias("k"), (F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")).alias("pr"), (F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")).alias("pi"))
    rows = product.join(high, [*low_by, "frame", "k"]).withColumns({"tr": F.col("pr") * F.col("re") + F.col("pi") * F.col("im"), "ti": F.col("pi") * F.col("re") - F.col("pr") * F.col("im")})
    power = F.sqrt(F.avg(F.col("pr") ** 2 + F.col("pi") ** 2) * F.avg(F.col("re") ** 2 + F.col("im") ** 2))
    return rows.groupBy(*by, "k1", "k2").agg((F.sqrt(F.avg("tr") ** 2 + F.avg("ti") ** 2) / F.nullif(power, F.lit(0.0))).alias("b"))


def shape_or_resonance(auto: DataFrame, cross: DataFrame, null: DataFrame, by: list[str]) -> DataFrame:
    """Each triad by its own and its cross bicoherence against the 95 % point of the null (by, k1, k2, rep, b): shape_only if only the
    own one is above it, true_resonance if both are, else ambiguous."""
    keys = [*by, "k1", "k2"]
    limit = null.groupBy(*keys).agg(F.percentile("b", 0.95).alias("limit"))
    both = auto.select(*keys, F.col("b").alias("own")).join(cross.select(*keys, F.col("b").alias("across")), keys).join(limit, keys)
    own, across = F.round(F.col("own") - F.col("limit"), 9) > 0, F.round(F.col("across") - F.col("limit"), 9) > 0
    return both.withColumn("label", F.when(own & across, "true_resonance").when(own, "shape_only").otherwise("ambiguous"))


def bispectral_direction(bins: DataFrame, reference: str, ks: list[int], reps: int) -> DataFrame:
    """Which of a channel (E) and the reference (S) makes the other's overtone: for each bin k of ``ks`` the size of the mean over frames of
    S_k S_k conj(E_2k) (sse) and of E_k E_k conj(S_2k) (ees), their difference, and its p against means with random signs.

    Both products are taken once for each frame; a rep gives a frame one sign (by a digest of rep and frame) for both.
    """
    grid = F.broadcast(bins.sparkSession.createDataFrame([(k,) for k in ks], "k int"))
    near = lambda own, name, factor: own.join(grid.select((F.col("k") * factor).alias("_k"), F.col("k").alias("base")), F.col("k") == F.col("_k")).select("session_id", "frame", "base", *[c for c in ("channel",) if name == "e"], F.col("re").alias(f"{name}{factor}r"), F.col("im").alias(f"{name}{factor}i"))
    at = ["session_id", "frame", "base"]
    s, e = bins.where(F.col("channel") == reference), bins.where(F.col("channel") != reference)
    rows = near(e, "e", 1).join(near(e, "e", 2), [*at, "channel"]).join(near(s, "s", 1), at).join(near(s, "s", 2), at)

    def product(a: str, b: str) -> tuple[Column, Column]:
        re, im = F.col(f"{a}1r") ** 2 - F.col(f"{a}1i") ** 2, 2 * F.col(f"{a}1r") * F.col(f"{a}1i")
        return re * F.col(f"{b}2r") + im * F.col(f"{b}2i"), im * F.col(f"{b}2r") - re * F.col(f"{b}2i")

    (ar, ai), (br, bi) = product("s", "e"), product("e", "s")
    each = rows.select(*at, "channel", ar.alias("ar"), ai.alias("ai"), br.alias("br"), bi.alias("bi")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    sign = F.when((F.col("rep") == 0) | (F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "frame")), 1, 1), 16, 10).cast("int") < 8), 1.0).otherwise(-1.0)
    size = lambda r, i: F.sqrt(F.avg(sign * F.col(r)) ** 2 + F.avg(sign * F.col(i)) ** 2)
    keys = ["session_id", "channel", "base"]
    means = each.groupBy(*keys, "rep").agg(size("ar", "ai").alias("sse"), size("br", "bi").alias("ees"))
    observed = means.where("rep = 0").select(*keys, "sse", "ees")
    found = significance(means.withColumn("difference", F.col("sse") - F.col("ees")), keys, "difference")
    return observed.join(found, keys).select("session_id", "channel", F.col("base").alias("k"), "sse", "ees", "difference", "p")


def cyclic_correlation(bins: DataFrame, gap: int, df: float) -> DataFrame:
    """Spectral correlation of bins ``2 gap`` apart (k - gap, k + gap), over frames: its magnitude summed over the centres k, times
    ``df``, and the centre where it is largest."""
    up = bins.select("session_id", "channel", "frame", (F.col("k") - gap).alias("k"), F.col("re").alias("ur"), F.col("im").alias("ui"))
    down = bins.select("session_id", "channel", "frame", (F.col("k") + gap).alias("k"), F.col("re").alias("dr"), F.col("im").alias("di"))
    x, y = F.avg(F.col("ur") * F.col("dr") + F.col("ui") * F.col("di")), F.avg(F.col("ui") * F.col("dr") - F.col("ur") * F.col("di"))
    own = up.join(down, ["session_id", "channel", "frame", "k"]).groupBy("session_id", "channel", "k").agg(F.sqrt(x * x + y * y).alias("s"))
    return own.groupBy("session_id", "channel").agg((F.sum("s") * df).alias("integrated"), (F.min_by("k", F.struct(-F.round("s", 9), F.col("k"))) * df).alias("peak_f"))
