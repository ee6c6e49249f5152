"""Scaling, entropy and embedding of single series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import halo_blocks, map_blocks
from ..functions.kernels import gaussian_measures, laplacian_entropy
from .cleaning import running_sum
from .joins import gram

KEYS = ["session_id", "channel"]


def detrended_fluctuation(samples: DataFrame, scales: list[int]) -> DataFrame:
    """Exponent with which the residual of a line, in segments of the summed series, grows with the segments' length."""
    mean = samples.groupBy(*KEYS).agg(F.avg("x").alias("_m"), F.count("*").alias("_n"))
    walk = running_sum(samples.join(mean, KEYS).withColumn("_d", F.col("x") - F.col("_m")), "_d", "y")
    cut = walk.withColumn("s", F.explode(F.array(*map(F.lit, scales)))).withColumn("seg", F.floor(F.col("idx") / F.col("s"))).where((F.col("seg") + 1) * F.col("s") <= F.col("_n"))
    residual = F.regr_syy("y", "idx") - F.regr_sxy("y", "idx") ** 2 / F.regr_sxx("y", "idx")
    parts = cut.groupBy(*KEYS, "s", "seg").agg((residual / F.count("*")).alias("_v"))
    curve = parts.groupBy(*KEYS, "s").agg(F.sqrt(F.avg("_v")).alias("f"))
    return curve.groupBy(*KEYS).agg(F.regr_slope(F.ln("f"), F.ln("s")).alias("alpha"))


def permutation_entropy(samples: DataFrame, m: int = 3, delay: int = 1) -> DataFrame:
    """Entropy of the orders of m samples ``delay`` apart over ln(m!); of equal samples the earlier one is the smaller."""
    run = W.partitionBy(*KEYS).orderBy("idx")
    values = F.array(*[F.struct(F.lead("x", k * delay).over(run).alias("x"), F.lit(k).alias("k")) for k in range(m)])
    full = F.lead("x", (m - 1) * delay).over(run).isNotNull()
    pattern = F.concat_ws("", F.transform(F.array_sort(values), lambda v: v["k"].cast("string")))
    counts = samples.withColumns({"_p": pattern, "_ok": full}).where("_ok").groupBy(*KEYS, "_p").agg(F.count("*").alias("c"))
    share = counts.withColumn("_q", F.col("c") / F.sum("c").over(W.partitionBy(*KEYS)))
    import math

    return share.groupBy(*KEYS).agg((-F.sum(F.col("_q") * F.ln("_q")) / math.log(math.factorial(m))).alias("entropy"))


def autocorrelation(samples: DataFrame, most: int) -> DataFrame:
    """Correlation of each channel with itself ``lag`` samples before."""
    rows = samples.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_i", F.col("idx") - F.col("lag"))
    own = samples.select(*KEYS, F.col("idx").alias("_i"), F.col("x").alias("_y"))
    return rows.join(own, [*KEYS, "_i"]).groupBy(*KEYS, "lag").agg(F.corr("x", "_y").alias("r"))


def delay_of(curve: DataFrame) -> DataFrame:
    """The first lag at which the autocorrelation is at most 1/e (null if none is)."""
    import math

    return curve.groupBy(*KEYS).agg(F.min(F.when(F.col("r") <= 1 / math.e, F.col("lag"))).alias("tau"))


def embed(samples: DataFrame, m: int, delay: int) -> DataFrame:
    """Points (x, x delay later, ...) of m coordinates, where all are there."""
    run = W.partitionBy(*KEYS).orderBy("idx")
    rows = samples.withColumn("point", F.array(*[F.lead("x", k * delay).over(run) for k in range(m)]))
    return rows.where(F.element_at("point", -1).isNotNull()).select(*KEYS, "idx", "point")


def spectrum_breadth(powers: DataFrame, by: list[str]) -> DataFrame:
    """Of powers (by, mode, power): entropy of their shares, participation ratio, and share of the top tenth of modes."""
    w = W.partitionBy(*by)
    rows = powers.withColumns({"_q": F.col("power") / F.sum("power").over(w), "_rank": F.row_number().over(w.orderBy(F.col("power").desc(), F.col("mode"))), "_n": F.count("*").over(w)})
    return rows.groupBy(*by).agg((-F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.ln("_q")).otherwise(0.0))).alias("entropy"), (1 / F.sum(F.col("_q") ** 2)).alias("participation"), F.sum(F.when(F.col("_rank") <= F.ceil(F.col("_n") * 0.1), F.col("_q")).otherwise(0.0)).alias("top_share"))


def gaussian_information(samples: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Total and dual total correlation and O-information of the channels of each session (and what else ``by`` names), from their covariances.

    Only the covariances, a row for each two channels, reach the kernel.
    """
    keys = list(by)
    spread = samples.groupBy(*keys, "channel").agg(F.var_pop("x").alias("cov")).select(*keys, F.col("channel").alias("ch_i"), F.col("channel").alias("ch_j"), "cov")
    pairs = gram(samples, by).drop("r").unionByName(spread)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        upper = own.pivot(index="ch_i", columns="ch_j", values="cov").to_numpy()
        cov = np.where(np.isnan(upper), upper.T, upper)
        return pd.DataFrame([[*own[keys].iloc[0], *gaussian_measures(cov)]], columns=[*keys, "total", "dual", "o_information"])

    kinds = dict(samples.dtypes)
    return pairs.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", total double, dual double, o_information double")


def integration(phases: DataFrame, half: int, size: int = 512) -> DataFrame:
    """0.7 times the total correlation of the channels' amplitudes plus 0.3 times the entropy of their locking graph, over the 2 half + 1 times
    around each (session_id, at, score), where all of a session's channels are there.

    A kernel gets stretches of ``size`` times with a margin; the matrices of a window are differences of running sums of products.
    """
    count = phases.groupBy("session_id").agg(F.countDistinct("channel").alias("_all"))

    def kernel(start: int, rows: dict[str, np.ndarray], channels: int) -> dict[str, np.ndarray] | None:
        names, row = np.unique(rows["channel"].astype(str), return_inverse=True)
        first, length, win = start - half, size + 2 * half, 2 * half + 1
        amp, phase = np.full((2, len(names), length), np.nan)
        amp[row, rows["_t"] - first], phase[row, rows["_t"] - first] = rows["amp"], rows["phase"]
        whole = np.convolve((~np.isnan(amp + phase)).all(0).astype(int), np.ones(win, int), "valid") == win
        at = np.flatnonzero(whole)
        if len(names) < channels or not len(at):
            return None
        z = np.where(np.isnan(phase), 0, np.exp(1j * np.nan_to_num(phase))).T
        x = np.nan_to_num(amp - np.nanmean(amp, 1, keepdims=True)).T

        def over(products: np.ndarray) -> np.ndarray:
            sums = np.concatenate([np.zeros((1, *products.shape[1:]), products.dtype), np.cumsum(products, 0)])
            return (sums[at + win] - sums[at]) / win

        mean = over(x)
        cov = over(x[:, :, None] * x[:, None, :]) - mean[:, :, None] * mean[:, None, :]
        graph = np.abs(over(z[:, :, None] * z[:, None, :].conj()))
        graph[:, np.arange(len(names)), np.arange(len(names))] = 0
        score = [0.7 * gaussian_measures(c)[0] + 0.3 * laplacian_entropy(g) for c, g in zip(cov, graph, strict=True)]
        return {"at": at + start, "score": np.array(score)}

    blocks = halo_blocks(phases, ["session_id"], size, half, ["channel", "amp", "phase"]).join(count, "session_id")
    return map_blocks(blocks, ["session_id"], size, kernel, "at long, score double", ["_all"])


def against_envelope(scores: DataFrame, envelope: DataFrame, reps: int) -> DataFrame:
    """Correlation of a score (session_id, at, score) with an envelope (session_id, at, amp), against that with the envelope moved round."""
    from .coupling import shifted, significance

    order = W.partitionBy("session_id").orderBy("at")
    rows = scores.join(envelope, ["session_id", "at"]).withColumn("k", (F.row_number().over(order) - 1).cast("long"))
    moved = shifted(rows.select("session_id", "k", "amp"), F.lit(True), reps, "k")
    each = rows.select("session_id", "k", "score").join(moved, ["session_id", "k"]).groupBy("session_id", "rep").agg(F.corr("score", "amp").alias("r"))
    return significance(each, ["session_id"], "r")


def _tiles(points: DataFrame, size: int) -> DataFrame:
    """Points (session_id, channel, idx, point, ..) in tiles: every two blocks of a series, of ``size`` idx each, meet in one (i, j),
    so that no task gets or orders a whole series. ``own`` tells a point's block."""
    blocked = points.withColumn("own", F.floor(F.col("idx") / size))
    known = blocked.groupBy(*KEYS).agg(F.collect_set("own").alias("_o"))
    spread = blocked.join(known, KEYS).withColumn("_o", F.explode("_o"))
    return spread.withColumns({"i": F.least("own", "_o"), "j": F.greatest("own", "_o")}).drop("_o")


def _sides(own: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return own[own["own"] == own["i"].iloc[0]].sort_values("idx"), own[own["own"] == own["j"].iloc[0]].sort_values("idx")


def sample_entropy(samples: DataFrame, scales: list[int], m: int = 2, share: float = 0.2, size: int = 512) -> DataFrame:
    """-ln(A / B) of each series coarse-grained by each scale: B pairs of m samples in a row within ``share`` sd of each other in all
    of them, A pairs of m + 1; null where either is 0. Pairs are counted tile by tile."""
    from .cleaning import coarse_grain

    keyed = [coarse_grain(samples, k).withColumn("channel", F.concat_ws("|", "channel", F.lit(str(k)))) for k in scales]
    series = keyed[0]
    for more in keyed[1:]:
        series = series.unionByName(more)
    run = W.partitionBy(*KEYS).orderBy("idx")
    limit = series.groupBy(*KEYS).agg((share * F.stddev_pop("x")).alias("tol"))
    points = series.withColumn("point", F.array(*[F.lead("x", k).over(run) for k in range(m + 1)])).where(F.get("point", F.lit(m - 1)).isNotNull()).join(limit, KEYS)

    def count(own: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(own)
        x, y = (np.array([[np.nan if v is None else v for v in p] for p in side["point"]]) for side in (a, b))
        near = np.abs(x[:, None, :] - y[None, :, :]) <= own["tol"].iloc[0]
        if own["i"].iloc[0] == own["j"].iloc[0]:
            near &= np.triu(np.ones(near.shape[:2], bool), 1)[:, :, None]
        return pd.DataFrame([[*own[KEYS].iloc[0], int(near[:, :, :m].all(2).sum()), int(near.all(2).sum())]], columns=[*KEYS, "b", "a"])

    found = _tiles(points.select(*KEYS, "idx", "point", "tol"), size).groupBy(*KEYS, "i", "j").applyInPandas(count, "session_id string, channel string, b long, a long")
    total = found.groupBy(*KEYS).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = F.split("channel", r"\|")
    return total.select("session_id", part[0].alias("channel"), part[1].cast("int").alias("scale"), F.when((F.col("a") > 0) & (F.col("b") > 0), -F.ln(F.col("a") / F.col("b"))).alias("entropy"))


def entropy_area(curve: DataFrame) -> DataFrame:
    """Area under each entropy curve over its scales (trapezoids), and its value at the middle scale."""
    run = W.partitionBy(*KEYS).orderBy("scale")
    rows = curve.withColumns({"_s": F.lead("scale").over(run), "_e": F.lead("entropy").over(run), "_k": F.row_number().over(run), "_n": F.count("*").over(W.partitionBy(*KEYS))})
    return rows.groupBy(*KEYS).agg(F.sum((F.col("_s") - F.col("scale")) * (F.col("entropy") + F.col("_e")) / 2).alias("area"), F.max(F.when(F.col("_k") == F.floor((F.col("_n") + 1) / 2), F.col("entropy"))).alias("middle"))


def nearest(points: DataFrame, k: int, theiler: int = 0, size: int = 512) -> DataFrame:
    """The k nearest other points of each (Euclidean, more than ``theiler`` apart in idx; of equal ones the earlier): idx, near (d, idx)."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(own)
        out = []
        for left, right in ((a, b), (b, a)) if own["i"].iloc[0] != own["j"].iloc[0] else ((a, a),):
            x, y = np.stack(left["point"].to_numpy()), np.stack(right["point"].to_numpy())
            at, other = left["idx"].to_numpy(), right["idx"].to_numpy()
            d = np.sqrt(sum((x[:, None, c] - y[None, :, c]) ** 2 for c in range(x.shape[1]))).round(9)
            d[np.abs(at[:, None] - other[None, :]) <= theiler] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, order, 1)
            row, place = np.nonzero(np.isfinite(near))
            out.append(pd.DataFrame({"idx": at[row], "d": near[row, place], "other": other[order[row, place]]}))
        return pd.concat(out).assign(session_id=own["session_id"].iloc[0], channel=own["channel"].iloc[0])[[*KEYS, "idx", "d", "other"]]

    found = _tiles(points.select(*KEYS, "idx", "point"), size).groupBy(*KEYS, "i", "j").applyInPandas(run, "session_id string, channel string, idx long, d double, other long")
    return found.groupBy(*KEYS, "idx").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("near"))


def false_neighbours(samples: DataFrame, dims: list[int], delay: int, theiler: int = 10, ratio: float = 15.0) -> DataFrame:
    """For each dimension m the share of points whose nearest neighbour is false: the next coordinate parts them by more than
    ``ratio`` times their distance (neighbours at distance 0 are left out), and the least m with a share of 5 % or less, 3 at least."""
    out = None
    for m in dims:
        own = nearest(embed(samples, m, delay), 1, theiler).select(*KEYS, "idx", F.col("near")[0]["d"].alias("d"), F.col("near")[0]["other"].alias("other")).where("d > 0")
        later = samples.select(*KEYS, (F.col("idx") - m * delay).alias("idx"), F.col("x").alias("_x"))
        other = later.withColumnsRenamed({"idx": "other", "_x": "_y"})
        part = own.join(later, [*KEYS, "idx"]).join(other, [*KEYS, "other"]).groupBy(*KEYS).agg(F.avg((F.abs(F.col("_x") - F.col("_y")) / F.col("d") > ratio).cast("int")).alias("share")).withColumn("m", F.lit(m))
        out = part if out is None else out.unionByName(part)
    first = F.min(F.when(F.col("share") <= 0.05, F.col("m"))).over(W.partitionBy(*KEYS))
    return out.withColumn("chosen", F.greatest(F.lit(3), F.coalesce(first, F.lit(max(dims)))))


def divergence(samples: DataFrame, m: int, delay: int, theiler: int, most: int) -> DataFrame:
    """Largest exponent: slope over k of the mean log of how far nearest neighbours are apart k samples on, over their first distance."""
    points = embed(samples, m, delay)
    pairs = nearest(points, 1, theiler).select(*KEYS, "idx", F.col("near")[0]["d"].alias("d"), F.col("near")[0]["other"].alias("other")).where("d > 0")
    on = pairs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumns({"idx": F.col("idx") + F.col("k"), "other": F.col("other") + F.col("k")})
    a, b = points.select(*KEYS, "idx", F.col("point").alias("_p")), points.select(*KEYS, F.col("idx").alias("other"), F.col("point").alias("_q"))
    gap = F.sqrt(F.aggregate(F.zip_with("_p", "_q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v))
    rows = on.join(a, [*KEYS, "idx"]).join(b, [*KEYS, "other"]).withColumn("_g", gap).where("_g > 0")
    curve = rows.groupBy(*KEYS, "k").agg(F.avg(F.ln(F.col("_g") / F.col("d"))).alias("mean"))
    return curve.groupBy(*KEYS).agg(F.regr_slope("mean", "k").alias("exponent"))


def _spread(points: DataFrame) -> DataFrame:
    """The root of the sum of the coordinates' variances of each series, and how many points it has."""
    each = points.select(*KEYS, F.posexplode("point").alias("_k", "_x")).groupBy(*KEYS, "_k").agg(F.var_pop("_x").alias("_v"), F.count("*").alias("_n"))
    return each.groupBy(*KEYS).agg(F.sqrt(F.sum("_v")).alias("spread"), F.max("_n").alias("n"))


def _squared_distances(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of a tile: the idx of both sides, squared distances between them, and whether the sides are one block."""
    a, b = _sides(own)
    x, y = np.stack(a["point"].to_numpy()), np.stack(b["point"].to_numpy())
    return a["idx"].to_numpy(), b["idx"].to_numpy(), sum((x[:, None, c] - y[None, :, c]) ** 2 for c in range(x.shape[1])), bool(own["i"].iloc[0] == own["j"].iloc[0])


def _runs(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive ``at`` within a line (both in order of line, then at): line, first at and length."""
    new = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (at[1:] != at[:-1] + 1)]) if len(line) else np.empty(0, int)
    return line[new], at[new], np.diff(np.r_[new, len(line)])


def recurrence_runs(points: DataFrame, share: float, size: int = 512) -> DataFrame:
    """Lengths of the lines of a recurrence plot: session_id, channel, kind (diagonal or column), n (length) and c (how many).

    Two points recur when they are nearer than ``share`` of their series' spread. Diagonals are those of pairs i < j; columns take both
    halves of the plot without its main diagonal. A tile counts the runs that end inside it, and only those that reach its border
    leave it as rows, to be joined with what goes on beyond it: rows grow with tiles and their borders, not with pairs.
    """
    limit = _spread(points).select(*KEYS, (F.col("spread") * share).alias("eps"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        at, other, d, same = _squared_distances(own)
        near = d < own["eps"].iloc[0] ** 2
        rows, columns = int(own["i"].iloc[0]) * size, int(own["j"].iloc[0]) * size
        left, right = np.nonzero(np.triu(near, 1) if same else near)
        i, j = at[left], other[right]
        out = []

        def add(kind: str, line: np.ndarray, place: np.ndarray, open_) -> None:
            order = np.lexsort((place, line))
            line, start, n = _runs(line[order], place[order])
            reaches = open_(line, start, start + n - 1)
            length, count = np.unique(n[~reaches], return_counts=True)
            out.append(pd.DataFrame({"kind": kind, "line": None, "start": None, "n": length, "c": count}))
            out.append(pd.DataFrame({"kind": kind, "line": line[reaches], "start": start[reaches], "n": n[reaches], "c": 1}))

        # A diagonal is told by j - i and followed in i; it leaves the tile by its first or last row or column.
        add("diagonal", j - i, i, lambda d, a, z: (a == rows) | (a + d == columns) | (z == rows + size - 1) | (z + d == columns + size - 1))
        add("column", i, j, lambda _, a, z: (a == columns) | (z == columns + size - 1))
        add("column", j, i, lambda _, a, z: (a == rows) | (z == rows + size - 1))
        found = pd.concat(out, ignore_index=True).astype({"line": "Int64", "start": "Int64", "n": "int64", "c": "int64"})
        return found.assign(session_id=own["session_id"].iloc[0], channel=own["channel"].iloc[0])[[*KEYS, "kind", "line", "start", "n", "c"]]

    tiled = _tiles(points.select(*KEYS, "idx", "point").join(limit, KEYS), size)
    parts = tiled.groupBy(*KEYS, "i", "j").applyInPandas(run, "session_id string, channel string, kind string, line long, start long, n long, c long")
    order = W.partitionBy(*KEYS, "kind", "line").orderBy("start")
    new = F.coalesce(F.col("start") > F.lag(F.col("start") + F.col("n")).over(order), F.lit(True)).cast("int")
    open_ = parts.where("line is not null").withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    whole = open_.groupBy(*KEYS, "kind", "line", "_run").agg(F.sum("n").alias("n")).select(*KEYS, "kind", "n", F.lit(1).cast("long").alias("c"))
    return parts.where("line is null").select(*KEYS, "kind", "n", "c").unionByName(whole).groupBy(*KEYS, "kind", "n").agg(F.sum("c").alias("c"))


def recurrence_measures(points: DataFrame, share: float, least: int = 2, size: int = 512) -> DataFrame:
    """Of the pairs i < j of a series' points that recur (see :func:`recurrence_runs`): rate (of all pairs), share on diagonals of ``least`` or more
    (det), longest and mean diagonal and the entropy of their lengths, share on columns of ``least`` or more (lam) and their mean length (tt)."""
    lines = recurrence_runs(points, share, size)
    long = F.col("n") >= least
    own = lines.where("kind = 'diagonal'").withColumn("_q", F.when(long, F.col("c") / F.sum(F.when(long, F.col("c"))).over(W.partitionBy(*KEYS))))
    cells, on = F.sum(F.col("n") * F.col("c")), F.sum(F.when(long, F.col("n") * F.col("c")))
    mean = on / F.sum(F.when(long, F.col("c")))
    a = own.groupBy(*KEYS).agg(cells.alias("_all"), on.alias("_on"), F.max("n").alias("lmax"), mean.alias("lmean"), (-F.sum(F.col("_q") * F.ln("_q"))).alias("hdiag"))
    b = lines.where("kind = 'column'").groupBy(*KEYS).agg(cells.alias("_call"), on.alias("_con"), mean.alias("tt"))
    rows = _spread(points).join(a, KEYS).join(b, KEYS)
    return rows.select(*KEYS, (2 * F.col("_all") / (F.col("n") * (F.col("n") - 1))).alias("rate"), (F.coalesce("_on", F.lit(0)) / F.col("_all")).alias("det"), "lmax", "lmean", "hdiag", (F.coalesce("_con", F.lit(0)) / F.col("_call")).alias("lam"), "tt")


def correlation_sums(points: DataFrame, radii: list[float], size: int = 512) -> DataFrame:
    """For each of ``radii``, shares of a series' spread, how many pairs of its points are nearer (session_id, channel, r, c): a tile counts for all radii at once."""
    def run(own: pd.DataFrame) -> pd.DataFrame:
        _, _, d, same = _squared_distances(own)
        d = np.sort(d[np.triu_indices(len(d), 1)] if same else d.ravel())
        count = np.searchsorted(d, (np.array(radii) * own["spread"].iloc[0]) ** 2, side="left")
        return pd.DataFrame({"session_id": own["session_id"].iloc[0], "channel": own["channel"].iloc[0], "r": radii, "c": count})

    tiled = _tiles(points.select(*KEYS, "idx", "point").join(_spread(points).select(*KEYS, "spread"), KEYS), size)
    return tiled.groupBy(*KEYS, "i", "j").applyInPandas(run, "session_id string, channel string, r double, c long").groupBy(*KEYS, "r").agg(F.sum("c").alias("c"))


def correlation_dimension(points: DataFrame, radii: list[float], size: int = 512) -> DataFrame:
    """Slope of the log of the number of pairs nearer than r on ln r, for r the given shares of a series' spread."""
    return correlation_sums(points, radii, size).where("c > 0").groupBy(*KEYS).agg(F.regr_slope(F.ln("c"), F.ln("r")).alias("dimension"))


def two_nearest_dimension(points: DataFrame) -> DataFrame:
    """Intrinsic dimension: one over the mean log of the second nearest distance over the nearest (points with a double at distance 0 go)."""
    own = nearest(points, 2).where(F.size("near") == 2).select(*KEYS, F.col("near")[0]["d"].alias("a"), F.col("near")[1]["d"].alias("b")).where("a > 0")
    return own.groupBy(*KEYS).agg((1 / F.nullif(F.avg(F.ln(F.col("b") / F.col("a"))), F.lit(0.0))).alias("dimension"))


def histogram_entropy(samples: DataFrame, bins: int) -> DataFrame:
    """Entropy of the bins² cells between least and largest value that (x, next x) falls in."""
    run = W.partitionBy(*KEYS).orderBy("idx")
    ends = samples.groupBy(*KEYS).agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) * bins), F.lit(bins - 1))
    rows = samples.withColumn("_y", F.lead("x").over(run)).where("_y is not null").join(ends, KEYS)
    share = rows.groupBy(*KEYS, cell("x").alias("_i"), cell("_y").alias("_j")).agg(F.count("*").alias("_c")).withColumn("_q", F.col("_c") / F.sum("_c").over(W.partitionBy(*KEYS)))
    return share.groupBy(*KEYS).agg((-F.sum(F.col("_q") * F.ln("_q"))).alias("entropy"))


def lempel_ziv(samples: DataFrame, size: int) -> DataFrame:
    """Number of new phrases (of 1976's parsing) of x above its channel's mean, in each run of ``size`` samples, times log2(size) / size."""
    mean = samples.groupBy(*KEYS).agg(F.avg("x").alias("_m"))
    bits = samples.join(mean, KEYS).groupBy(*KEYS, F.floor(F.col("idx") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("x") > F.col("_m")).cast("int").alias("b")))).alias("s"))
    text = bits.select(*KEYS, "part", F.concat_ws("", F.transform("s", lambda v: v["b"].cast("string"))).alias("s"))

    def run(parts):
        for own in parts:
            yield own[[*KEYS, "part"]].assign(complexity=[phrases(s) * np.log2(max(2, len(s))) / len(s) for s in own["s"]])

    return text.mapInPandas(run, "session_id string, channel string, part long, complexity double")


def phrases(s: str) -> int:
    """Phrases of a string, each the shortest that has not begun before where it stands."""
    found, start = 0, 0
    while start < len(s):
        size = 1
        while start + size <= len(s) and s.find(s[start : start + size], 0, start + size - 1) >= 0:
            size += 1
        found += 1
        start += size
    return found


def relative_breadth(powers: DataFrame, by: list[str], state: str, base: str) -> DataFrame:
    """Spectral entropy over ln of the number of modes in ``state`` and in ``base``, and the difference (powers: by, state, mode, power)."""
    w = W.partitionBy(*by, "state")
    rows = powers.withColumns({"_q": F.col("power") / F.sum("power").over(w), "_n": F.count("*").over(w)})
    h = rows.groupBy(*by, "state").agg((-F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.ln("_q")).otherwise(0.0)) / F.ln(F.first("_n"))).alias("h"))
    own = lambda s: F.max(F.when(F.col("state") == s, F.col("h")))
    return h.groupBy(*by).agg(own(state).alias("in_state"), own(base).alias("in_base"), (own(state) - own(base)).alias("delta"))


def log_covariances(samples: DataFrame, win: int, step: int) -> DataFrame:
    """The logarithm of the covariance (sample; 1e-9 added to its diagonal) of all channels in each whole frame: session_id, frame, channels, v.

    v is the upper triangle, entries beside the diagonal times the root of 2, so that distances of v are those of the matrices. Frames in
    which a channel misses a sample have no row.
    """
    from .cleaning import frames

    packed = frames(samples, win, step).groupBy("session_id", "frame").agg(F.collect_list(F.struct("channel", "j", "x")).alias("s"))

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                s = batch.column("s")[i].values
                names, row = np.unique(np.array(s.field("channel").to_pylist(), object).astype(str), return_inverse=True)
                x = np.full((len(names), win), np.nan)
                x[row, s.field("j").to_numpy(zero_copy_only=False)] = s.field("x").to_numpy(zero_copy_only=False)
                if np.isnan(x).any():
                    continue
                values, axes = np.linalg.eigh(np.atleast_2d(np.cov(x)) + 1e-9 * np.eye(len(names)))
                log = (axes * np.log(np.maximum(values, 1e-12))) @ axes.T
                upper = np.triu_indices(len(names))
                out.append({"session_id": batch.column("session_id")[i].as_py(), "frame": batch.column("frame")[i].as_py(), "channels": names.tolist(), "v": (log * np.where(np.eye(len(names), dtype=bool), 1, np.sqrt(2)))[upper].tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("session_id", pa.string()), ("frame", pa.int64()), ("channels", pa.list_(pa.string())), ("v", pa.list_(pa.float64()))]))

    return packed.mapInArrow(run, "session_id string, frame long, channels array<string>, v array<double>")


def covariance_spread(samples: DataFrame, win: int, step: int, size: int = 512) -> DataFrame:
    """Log-Euclidean spread of a session's covariances: mean distance of the logarithms of every two frames' covariances, and the root
    of the mean squared distance (session_id, frames, spread, rms).

    The first is summed tile by tile, every two blocks of frames in one, so that pairs are no rows; the second needs no pairs, as the sum
    of all squared distances is n times the sum of squares less the square of the sum. Frames of other channels than most of their session's are left out.
    """
    logs = log_covariances(samples, win, step)
    most = logs.groupBy("session_id", "channels").agg(F.count("*").alias("_n")).groupBy("session_id").agg(F.min_by("channels", F.struct(-F.col("_n"), "channels")).alias("channels"))
    points = logs.join(most, ["session_id", "channels"]).select("session_id", F.lit("all").alias("channel"), F.col("frame").alias("idx"), F.col("v").alias("point"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        _, _, d, same = _squared_distances(own)
        d = np.sqrt(d)
        return pd.DataFrame({"session_id": [own["session_id"].iloc[0]], "total": [float((np.triu(d, 1) if same else d).sum())]})

    total = _tiles(points, size).groupBy(*KEYS, "i", "j").applyInPandas(run, "session_id string, total double").groupBy("session_id").agg(F.sum("total").alias("_d"))
    places = points.select("session_id", F.posexplode("point").alias("k", "x")).groupBy("session_id", "k").agg(F.count("*").alias("_n"), F.var_pop("x").alias("_v"))
    square = places.groupBy("session_id").agg(F.max("_n").alias("frames"), F.sum("_v").alias("_v"))
    n = F.col("frames")
    return square.where("frames > 1").join(total, "session_id").select("session_id", "frames", (F.col("_d") / (n * (n - 1) / 2)).alias("spread"), F.sqrt(2 * n / (n - 1) * F.col("_v")).alias("rms"))
