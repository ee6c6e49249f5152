"""Masks, intervals, events and what is locked to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def field_power(samples: DataFrame, kind: str = "var") -> DataFrame:
    """Variance (or sd) over the channels at each time."""
    of = F.var_pop if kind == "var" else F.stddev_pop
    return samples.groupBy("session_id", "idx").agg(of("x").alias("gfp"))


def islands(rows: DataFrame, mask: Column, by: list[str], min_len: int = 1, value: str = "x") -> DataFrame:
    """Runs of successive idx where ``mask`` holds, at least ``min_len`` long: start, end (exclusive), n, peak and its idx."""
    on = rows.where(mask)
    on = on.withColumn("_run", F.col("idx") - F.row_number().over(W.partitionBy(*by).orderBy("idx")))
    found = on.groupBy(*by, "_run").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.count("*").alias("n"), F.max(value).alias("peak"), F.min_by("idx", F.struct(-F.col(value), F.col("idx"))).alias("peak_idx"))
    return found.where(F.col("n") >= min_len).drop("_run")


def spike_events(samples: DataFrame, z: float, least: int, min_len: int, baseline: Column | None = None, of: str = "channel") -> DataFrame:
    """Runs in which at least ``least`` channels (or of what else ``of`` names, such as bands) are above mean + z sd (sample sd) of their baseline."""
    base = samples.where(baseline) if baseline is not None else samples
    limits = base.groupBy("session_id", of).agg((F.avg("x") + z * F.stddev_samp("x")).alias("_limit"))
    count = samples.join(limits, ["session_id", of]).groupBy("session_id", "idx").agg(F.count_if(F.col("x") > F.col("_limit")).alias("x"))
    return islands(count, F.col("x") >= least, ["session_id"], min_len)


def debounced_onsets(rows: DataFrame, mask: Column, by: list[str], gap: int) -> DataFrame:
    """Rising edges of ``mask`` of which each is at least ``gap`` after the last one taken (greedy, from the left).

    An edge at least ``gap`` after the edge before is always taken, and what comes after does not depend on what came
    before it: so edges part into crowds there, and only within a crowd are they folded one after another.
    """
    order = W.partitionBy(*by).orderBy("idx")
    edges = rows.withColumn("_on", mask).withColumn("_was", F.lag("_on", 1, False).over(order)).where("_on and not _was")
    apart = F.coalesce(F.col("idx") - F.lag("idx").over(order) >= gap, F.lit(True)).cast("int")
    crowds = edges.withColumn("_new", apart).withColumn("_crowd", F.sum("_new").over(order))
    taken = F.aggregate(
        F.array_sort(F.collect_list("idx")), F.array().cast("array<bigint>"),
        lambda got, i: F.when((F.size(got) == 0) | (i - F.element_at(got, -1) >= gap), F.array_append(got, i)).otherwise(got),
    )
    return crowds.groupBy(*by, "_crowd").agg(taken.alias("onset")).select(*by, F.explode("onset").alias("onset"))


def merge_intervals(spans: DataFrame, by: list[str], gap: float = 0) -> DataFrame:
    """Union of intervals (start, end); those at most ``gap`` apart become one."""
    before = W.partitionBy(*by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("end").over(before) + gap, F.lit(True)).cast("int")
    rows = spans.withColumn("_new", new)
    rows = rows.withColumn("_g", F.sum("_new").over(W.partitionBy(*by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("merged")).drop("_g")


def coincident_groups(events: DataFrame, tolerance: float) -> DataFrame:
    """Events (session_id, channel, t) grouped while each is at most ``tolerance`` after the one before."""
    order = W.partitionBy("session_id").orderBy("t", "channel")
    new = F.coalesce(F.col("t") - F.lag("t").over(order) > tolerance, F.lit(True)).cast("int")
    rows = events.withColumn("_new", new).withColumn("grp", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("session_id", "grp").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("channel"))).alias("channels"))


def activity(z_scores: DataFrame, threshold: float) -> DataFrame:
    """Sum of positive z and number of channels at or above ``threshold``, at each time."""
    return z_scores.groupBy("session_id", "idx").agg(F.sum(F.greatest("z", F.lit(0.0))).alias("activity"), F.count_if(F.col("z") >= threshold).alias("overlap"))


def tier_intervals(active: DataFrame, most: int, min_len: int = 1) -> DataFrame:
    """Runs in which at least k channels are active, for k = 1 to ``most``."""
    tiers = active.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("x", F.col("overlap"))
    return islands(tiers, F.col("overlap") >= F.col("k"), ["session_id", "k"], min_len)


def event_average(epoched: DataFrame, by: list[str]) -> DataFrame:
    """Mean, sem and count of x at each tau."""
    return epoched.groupBy(*by, "tau").agg(F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("sem"), F.count("x").alias("n"))


def latencies(z_scores: DataFrame, threshold: float, start: int) -> DataFrame:
    """First idx from ``start`` on at which each channel's z reaches ``threshold``, less ``start``."""
    return z_scores.where((F.col("idx") >= start) & (F.col("z") >= threshold)).groupBy("session_id", "channel").agg((F.min("idx") - start).alias("latency"))


def seed_channel(latency: DataFrame) -> DataFrame:
    """The channel that is first, and the spread of the latencies."""
    return latency.groupBy("session_id").agg(F.min_by("channel", F.struct("latency", "channel")).alias("seed"), (F.max("latency") - F.min("latency")).alias("spread"), F.percentile("latency", 0.5).alias("median_latency"))


def cycles(samples: DataFrame) -> DataFrame:
    """Cycles from trough to trough (local extrema): period, rise and decay, and the height of the peak over the first trough."""
    run = W.partitionBy("session_id", "channel").orderBy("idx")
    rows = samples.withColumn("_l", F.lag("x").over(run)).withColumn("_r", F.lead("x").over(run))
    kind = F.when((F.col("x") > F.col("_l")) & (F.col("x") >= F.col("_r")), "peak").when((F.col("x") < F.col("_l")) & (F.col("x") <= F.col("_r")), "trough")
    ends = rows.withColumn("kind", kind).where("kind is not null")
    ends = ends.select("session_id", "channel", "idx", "x", "kind", *[F.lead(c, k).over(run).alias(f"{c}{k}") for k in (1, 2) for c in ("idx", "x", "kind")])
    found = ends.where("kind = 'trough' and kind1 = 'peak' and kind2 = 'trough'")
    return found.select("session_id", "channel", "idx", (F.col("idx2") - F.col("idx")).alias("period"), (F.col("idx1") - F.col("idx")).alias("rise"), (F.col("idx2") - F.col("idx1")).alias("decay"), (F.col("x1") - F.col("x")).alias("height"))


def avalanches(samples: DataFrame, share: float) -> DataFrame:
    """Runs above the ``share`` percentile of each channel: size (area above it) and duration."""
    by = ["session_id", "channel"]
    limits = samples.groupBy(*by).agg(F.percentile("x", share).alias("_limit"))
    above = samples.join(limits, by).withColumn("x", F.col("x") - F.col("_limit")).where("x > 0")
    above = above.withColumn("_run", F.col("idx") - F.row_number().over(W.partitionBy(*by).orderBy("idx")))
    return above.groupBy(*by, "_run").agg(F.min("idx").alias("start"), F.count("*").alias("duration"), F.sum("x").alias("size")).drop("_run")


def tail_exponent(found: DataFrame, size: str, least: float) -> DataFrame:
    """Power-law exponent of sizes from ``least`` on: 1 + n / sum(ln(size / least))."""
    return found.where(F.col(size) >= least).groupBy("session_id").agg((1 + F.count("*") / F.nullif(F.sum(F.ln(F.col(size) / least)), F.lit(0.0))).alias("alpha"), F.count("*").alias("n"))


def rounded_windows(spans: DataFrame, first: int, last: int, least: int = 1) -> DataFrame:
    """Intervals clipped to the recording and widened to whole units; those of ``least`` or less go."""
    start, end = F.floor(F.greatest("start", F.lit(first))), F.ceil(F.least("end", F.lit(last)))
    return spans.withColumns({"start": start.cast("long"), "end": end.cast("long")}).where(F.col("end") - F.col("start") > least)


def prominent_peaks(curve: DataFrame, by: list[str], height: float, prominence: float, distance: int, reach: int) -> DataFrame:
    """Local maxima of x at least ``height`` high that stand out by ``prominence`` within ``reach`` samples: idx, x, prominence.

    A peak's base on a side is the lowest sample before a higher one or the end of the reach; prominence is over the higher
    base. Of peaks nearer than ``distance`` only one that no higher (of equal ones, earlier) peak has near it stays.
    """
    run = W.partitionBy(*by).orderBy("idx")
    side = lambda values: F.aggregate(  # noqa: E731  lowest sample before a higher one
        values, F.struct(F.col("x").alias("low"), F.lit(True).alias("open")),
        lambda got, v: F.when(got["open"] & (v <= F.col("x")), F.struct(F.least(got["low"], v).alias("low"), F.lit(True).alias("open"))).otherwise(F.struct(got["low"].alias("low"), F.lit(False).alias("open"))),
    )["low"]
    rows = curve.withColumns({"_l": F.lag("x").over(run), "_r": F.lead("x").over(run), "_before": F.collect_list("x").over(run.rowsBetween(-reach, -1)), "_after": F.collect_list("x").over(run.rowsBetween(1, reach))})
    tops = rows.where((F.col("x") > F.col("_l")) & (F.col("x") >= F.col("_r")) & (F.col("x") >= height))
    tops = tops.withColumn("prominence", F.col("x") - F.greatest(side(F.reverse("_before")), side(F.col("_after")))).where(F.col("prominence") >= prominence)
    near = W.partitionBy(*by).orderBy("idx").rangeBetween(-(distance - 1), distance - 1)
    best = F.max(F.struct("x", (-F.col("idx")).alias("i"))).over(near)
    return tops.withColumn("_best", best).where(F.col("_best.i") == -F.col("idx")).select(*by, "idx", "x", "prominence")


def cycle_shape(samples: DataFrame, k: int = 1) -> DataFrame:
    """Of each cycle (see :func:`cycles`): rise over decay, the peak's sharpness over the samples k away, and the share of the period before its peak."""
    run = W.partitionBy("session_id", "channel").orderBy("idx")
    sharp = samples.select("session_id", "channel", F.col("idx").alias("_p"), (F.col("x") - (F.lag("x", k).over(run) + F.lead("x", k).over(run)) / 2).alias("sharpness"))
    found = cycles(samples).withColumn("_p", F.col("idx") + F.col("rise")).join(sharp, ["session_id", "channel", "_p"], "left")
    return found.select("session_id", "channel", "idx", (F.col("rise") / F.col("decay")).alias("ratio"), "sharpness", (F.col("rise") / F.col("period")).alias("asymmetry"))


def pseudo_onset_band(curve: DataFrame, onsets: DataFrame, before: int, after: int, reps: int, step: int) -> DataFrame:
    """Event average of a series (session_id, idx, x) at each tau, with the 2.5 and 97.5 % points of the averages at onsets moved round by rep * step
    among each session's times, which are numbered in order."""
    from .joins import epochs
    from .windows import moved_onsets

    placed, moved = moved_onsets(curve, onsets, reps, step)
    means = epochs(placed, moved, before, after).groupBy("rep", "tau").agg(F.avg("x").alias("m"))
    null = F.when(F.col("rep") > 0, F.col("m"))
    return means.groupBy("tau").agg(F.max(F.when(F.col("rep") == 0, F.col("m"))).alias("mean"), F.percentile(null, 0.025).alias("low"), F.percentile(null, 0.975).alias("high"))


def perturbation(reads: DataFrame, onsets: DataFrame, before: int, after: int) -> DataFrame:
    """At each line and frame around the onsets: power in dB over the mean before them, trial by trial, and coherence between trials."""
    from .joins import epochs

    rows = epochs(reads.withColumnRenamed("frame", "idx"), onsets, before, after).withColumn("_p", F.col("re") ** 2 + F.col("im") ** 2)
    trial = ["session_id", "channel", "f0", "event_id"]
    base = F.avg(F.when(F.col("tau") < 0, F.col("_p"))).over(W.partitionBy(*trial))
    phase = F.atan2("im", "re")
    rows = rows.withColumns({"_db": 10 * F.log10((F.col("_p") + 1e-12) / (base + 1e-12)), "_c": F.cos(phase), "_s": F.sin(phase)})
    return rows.groupBy("channel", "f0", "tau").agg(F.avg("_db").alias("ersp"), F.sqrt(F.avg("_c") ** 2 + F.avg("_s") ** 2).alias("itc"), F.count("*").alias("n"))


def event_records(r: DataFrame, active: DataFrame, windows: DataFrame, level: float = 0.6) -> DataFrame:
    """One row for each session and window: duration, largest synchrony, where it rises most (t0), peak, its time and area of the activity.

    ``r`` has (session_id, t, r), ``active`` (session_id, t, activity). t0 is where r grows most among times with r of at least
    ``level``; if there are none, among all.
    """
    from .joins import in_windows

    step = F.col("r") - F.lag("r").over(W.partitionBy("session_id").orderBy("t"))
    keys = ["session_id", "state", "window_id"]
    high = F.col("r") >= level
    best = F.min_by("t", F.struct(F.when(high, 0).otherwise(1), -F.round(F.coalesce("_d", F.lit(0.0)), 9), "t"))
    sync = in_windows(r.withColumn("_d", step), windows).groupBy(*keys, "t0", "t1").agg(F.max("r").alias("max_r"), best.alias("onset"))
    power = in_windows(active, windows).groupBy(*keys).agg(F.max("activity").alias("peak"), F.min_by("t", F.struct(-F.round("activity", 9), F.col("t"))).alias("peak_t"), F.sum("activity").alias("area"))
    return sync.join(power, keys).select(*keys, (F.col("t1") - F.col("t0")).alias("duration"), "max_r", "onset", "peak", "peak_t", "area")


def event_type(z, stack, overtone, peaks, f0: float):
    """The label of an event by its line z, stack index, strongest overtone's frequency and number of peaks (columns)."""
    return (
        F.when((z >= 3) & (stack >= 0.2), "fundamental-led").when((z < 2) & ((stack >= 0.5) | (overtone >= 6 * f0 - 1)), "overtone-led")
        .when(peaks >= 2, "two-phase").otherwise("fundamental-led")
    )


def phase_at_onset(phases: DataFrame, onsets: DataFrame, bins: int) -> DataFrame:
    """Trials by the phase that a channel has at their onset: number and mean amplitude in each bin of the circle."""
    import math

    at = phases.join(onsets.select("session_id", "event_id", F.col("onset").alias("idx")), ["session_id", "idx"])
    b = F.least(F.floor((F.col("phase") + math.pi) / (2 * math.pi) * bins), F.lit(bins - 1))
    return at.groupBy("channel", b.cast("int").alias("bin")).agg(F.count("*").alias("trials"), F.avg("amp").alias("amp"))


def latency_summary(latency: DataFrame, roi_of, within: int) -> DataFrame:
    """For each session and region (``roi_of``: a column of channel): first latency, spread (median less first) and the share of channels within ``within``."""
    own = latency.withColumn("roi", roi_of)
    return own.groupBy("session_id", "roi").agg(F.min("latency").alias("first"), (F.percentile("latency", 0.5) - F.min("latency")).alias("spread"), F.avg((F.col("latency") <= within).cast("int")).alias("synchronised"))


def event_line_summaries(reads: DataFrame, reference: str, windows: DataFrame, slow: float, fast: float, step: float, before: float, around: float) -> DataFrame:
    """What the lines say of each session's windows (state, window_id, t0, t1), a frame being at ``step`` times its number.

    Of the mean of all channels but the reference: line_z, the largest amplitude at ``slow`` in the window in sd above its mean in the ``before``
    seconds ahead of it, line_area, the sum of these z times ``step`` within ``around`` of its start, msc, its coherence with the reference over the
    window's frames, and lead, how much later the slow line peaks than the fast one in the ``before`` seconds ahead. Of the reference's amplitude in
    sd of its session: ref_z_max and ref_peak_t in the window, ref_z_near within ``around`` of its start, ref_z_after in the ``around``
    seconds from its peak on. What has no frames is null.
    """
    from .joins import in_windows

    keys, at = ["session_id", "state", "window_id"], (F.col("frame") * step).cast("double")
    line = lambda f: F.abs(F.col("f0") - f) < 1e-9
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    mean = reads.where(F.col("channel") != reference).groupBy("session_id", "frame", "f0").agg(F.avg("re").alias("re"), F.avg("im").alias("im")).select("session_id", "f0", at.alias("t"), "re", "im", size.alias("amp"))
    ref = reads.where((F.col("channel") == reference) & line(slow)).select("session_id", at.alias("t"), F.col("re").alias("rr"), F.col("im").alias("ri"), size.alias("ref"))
    own = mean.where(line(slow)).join(ref, ["session_id", "t"])
    moments = own.groupBy("session_id").agg(F.avg("ref").alias("_m"), F.stddev_pop("ref").alias("_s"))
    own = own.join(moments, "session_id").withColumn("ref_z", (F.col("ref") - F.col("_m")) / (F.col("_s") + 1e-12))
    span = lambda t0, t1: windows.select("state", "window_id", t0.alias("t0"), t1.alias("t1"))
    ahead, near = span(F.col("t0") - before, F.col("t0")), span(F.col("t0") - around, F.col("t0") + around)
    base = in_windows(own, ahead).groupBy(*keys).agg(F.avg("amp").alias("_b"), F.stddev_pop("amp").alias("_d"))
    z = (F.col("amp") - F.col("_b")) / (F.col("_d") + 1e-12)
    x, y = F.sum(F.col("re") * F.col("rr") + F.col("im") * F.col("ri")), F.sum(F.col("im") * F.col("rr") - F.col("re") * F.col("ri"))
    inside = in_windows(own, windows).join(base, keys, "left").groupBy(*keys).agg(
        F.max(z).alias("line_z"), ((x * x + y * y) / F.nullif(F.sum(F.col("re") ** 2 + F.col("im") ** 2) * F.sum(F.col("rr") ** 2 + F.col("ri") ** 2), F.lit(0.0))).alias("msc"),
        F.max("ref_z").alias("ref_z_max"), F.min_by("t", F.struct(-F.round("ref_z", 9), F.col("t"))).alias("ref_peak_t"),
    )
    start = in_windows(own, near).join(base, keys, "left").groupBy(*keys).agg((F.sum(z) * step).alias("line_area"), F.avg("ref_z").alias("ref_z_near"))
    top = lambda f: F.min_by(F.when(line(f), F.col("t")), F.struct(F.when(line(f), 0).otherwise(1), -F.round("amp", 9), F.col("t")))
    lead = in_windows(mean.select("session_id", "t", "f0", "amp"), ahead).groupBy(*keys).agg((top(slow) - top(fast)).alias("lead"))
    after = inside.select(*keys, F.col("ref_peak_t").alias("t0"), (F.col("ref_peak_t") + around).alias("t1"))
    after = in_windows(own.select("session_id", "t", "ref_z"), after).groupBy(*keys).agg(F.avg("ref_z").alias("ref_z_after"))
    found = inside.join(start, keys, "left").join(lead, keys, "left").join(after, keys, "left")
    return found.select(*keys, "line_z", "line_area", "msc", "lead", "ref_z_max", "ref_peak_t", "ref_z_near", "ref_z_after")


def peak_widths(curve: DataFrame, peaks: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Peaks (by, idx, x, prominence) of a curve (by, idx, x) with left, right and width at half their prominence.

    An end is where the line between two samples crosses that height, going out from the peak; it is sought within ``reach`` samples, by
    stretches of the curve, and is the last sample there if the curve stays above.
    """
    stretch = lambda c: F.floor(c / reach)
    tops = peaks.select(*by, F.col("idx").alias("_p"), F.col("x").alias("_top"), "prominence", (F.col("x") - F.col("prominence") / 2).alias("_h"))
    spread = tops.withColumn("_b", F.explode(F.sequence(stretch(F.col("_p") - reach), stretch(F.col("_p") + reach))))
    near = curve.withColumn("_b", stretch(F.col("idx"))).join(spread, [*by, "_b"]).where(F.abs(F.col("idx") - F.col("_p")) <= reach)
    low = F.col("x") <= F.col("_h")
    keys = [*by, "_p", "_top", "prominence", "_h"]
    ends = near.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(low & (F.col("idx") < F.col("_p")), F.col("idx"))), F.min("idx")).alias("_i"), F.coalesce(F.min(F.when(low & (F.col("idx") > F.col("_p")), F.col("idx"))), F.max("idx")).alias("_j"), F.collect_list(F.struct("idx", "x")).alias("_c"),
    )
    value = lambda i: F.element_at(F.transform(F.filter("_c", lambda v: v["idx"] == i), lambda v: v["x"]), 1)
    rows = ends.withColumns({"_a": value(F.col("_i")), "_a1": value(F.col("_i") + 1), "_z": value(F.col("_j")), "_z1": value(F.col("_j") - 1)})
    left = F.col("_i") + F.when(F.col("_a") < F.col("_h"), (F.col("_h") - F.col("_a")) / (F.col("_a1") - F.col("_a"))).otherwise(0.0)
    right = F.col("_j") - F.when(F.col("_z") < F.col("_h"), (F.col("_h") - F.col("_z")) / (F.col("_z1") - F.col("_z"))).otherwise(0.0)
    return rows.select(*by, F.col("_p").alias("idx"), F.col("_top").alias("x"), "prominence", left.alias("left"), right.alias("right"), (right - left).alias("width"))


def shape_asymmetry(samples: DataFrame, k: int = 1) -> DataFrame:
    """For each channel how much sharper its peaks are than its troughs, and how much steeper it rises than it decays, as shares from -1 to 1.

    Sharpness is x less the mean of the samples ``k`` away on either side; steepness the largest (or least) central difference between an extremum
    and the next.
    """
    keys = ["session_id", "channel"]
    run = W.partitionBy(*keys).orderBy("idx")
    rows = samples.select(*keys, "idx", "x", F.lag("x").over(run).alias("_l"), F.lead("x").over(run).alias("_r"), F.lag("x", k).over(run).alias("_a"), F.lead("x", k).over(run).alias("_b"))
    rows = rows.withColumn("_k", F.when((F.col("x") > F.col("_l")) & (F.col("x") >= F.col("_r")), 1).when((F.col("x") < F.col("_l")) & (F.col("x") <= F.col("_r")), -1))
    sharp = F.col("x") - (F.col("_a") + F.col("_b")) / 2
    part = lambda up, down: (up - F.abs(down)) / (F.abs(up) + F.abs(down) + 1e-12)
    peaks = rows.groupBy(*keys).agg(F.avg(F.when(F.col("_k") == 1, sharp)).alias("_p"), F.avg(F.when(F.col("_k") == -1, sharp)).alias("_t"))
    slope = (F.col("_r") - F.col("_l")) / 2
    legs = rows.withColumn("_leg", F.count("_k").over(run)).where("_leg > 0 and _l is not null and _r is not null")
    legs = legs.groupBy(*keys, "_leg").agg(F.min_by("_k", "idx").alias("_from"), F.max(slope).alias("_up"), F.min(slope).alias("_down"))
    # The last leg ends in no extremum.
    last = W.partitionBy(*keys)
    legs = legs.withColumn("_n", F.max("_leg").over(last)).where("_leg < _n").groupBy(*keys).agg(F.avg(F.when(F.col("_from") == -1, F.col("_up"))).alias("_u"), F.avg(F.when(F.col("_from") == 1, F.col("_down"))).alias("_d"))
    return peaks.join(legs, keys).select(*keys, part(F.col("_p"), F.col("_t")).alias("sharpness"), part(F.col("_u"), F.col("_d")).alias("steepness"))


def trial_features(powers: DataFrame, phases: DataFrame, onsets: DataFrame, reference: str, before: int, after: int, bins: int) -> DataFrame:
    """For each trial (onset of a session) and channel: the bin of the circle that the reference's phase is in at its onset, and the mean of each band's
    power (session_id, channel, band, idx, p) from ``before`` ahead of it to ``after`` behind."""
    import math

    from .joins import epochs

    b = F.least(F.floor((F.col("phase") + math.pi) / (2 * math.pi) * bins), F.lit(bins - 1)).cast("int")
    at = phases.where(F.col("channel") == reference).join(onsets.select("session_id", "event_id", F.col("onset").alias("idx")), ["session_id", "idx"]).select("session_id", "event_id", b.alias("bin"))
    mean = epochs(powers, onsets, before, after).groupBy("session_id", "event_id", "channel", "band").agg(F.avg("p").alias("power"))
    return mean.join(at, ["session_id", "event_id"])


def coupling_by_onset_phase(phases: DataFrame, onsets: DataFrame, reference: str, before: int, after: int, bins: int, cells: int) -> DataFrame:
    """Modulation index (of ``cells`` phases) of each channel over the times around all onsets at which the reference's phase is in one bin, averaged over channels."""
    import math

    from .coupling import modulation_index
    from .joins import epochs

    b = F.least(F.floor((F.col("phase") + math.pi) / (2 * math.pi) * bins), F.lit(bins - 1)).cast("int")
    at = phases.where(F.col("channel") == reference).join(onsets.select("session_id", "event_id", F.col("onset").alias("idx")), ["session_id", "idx"]).select("session_id", "event_id", b.alias("bin"))
    rows = epochs(phases, onsets, before, after).join(at, ["session_id", "event_id"])
    return modulation_index(rows, ["bin", "channel"], cells).groupBy("bin").agg(F.avg("mi").alias("mi"), F.count("*").alias("channels"))
