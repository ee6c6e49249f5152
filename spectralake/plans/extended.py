"""More registered queries, with their SQL: drifting ridges, kernels over blocks, and what builds on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import slepian
from ..operators import cleaning as cl
from ..operators import complexity as cx
from ..operators import coupling as cp
from ..operators import events as ev
from ..operators import graphs as gr
from ..operators import inference as inf
from ..operators import joins as jn
from ..operators import spectral as sp
from ..operators import states as st
from ..operators import timefreq as tf
from . import catalog as base
from .catalog import BANDS, READS, REFERENCE, SAMPLES, SPECTRA, STEP, WIN, bands, edges, lines, phases, query, reads, windows
from .further import _BINS, _FRAMES, _MSC, _PEAKS, _SMOOTH, _Z, FRAME_ONSETS, _bins, _peaks, _significance, _smooth

#: A grid of wavelets around each order of one cycle a day (k, f0 in cycles per hour).
GRID = [(k, k / 24 + d) for k in (1, 2) for d in (-0.006, 0.0, 0.006)]


def _values(rows) -> str:
    """Rows as SQL values; doubles with all their digits."""
    return ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v) for v in row) + ")" for row in rows)


_MIRROR = """, e AS (SELECT session_id, channel, min(idx) AS a, max(idx) AS b FROM samples GROUP BY ALL),
 m AS (SELECT s.session_id, s.channel, s.idx AS own, s.x, w.x AS v FROM samples s JOIN e USING (session_id, channel), range(-30, 31) q(k), samples w
  WHERE w.session_id = s.session_id AND w.channel = s.channel AND w.idx = CASE WHEN s.idx + k < a THEN 2 * a - s.idx - k WHEN s.idx + k > b THEN 2 * b - s.idx - k ELSE s.idx + k END),
 n AS (SELECT session_id, channel, own, any_value(x) AS x, quantile_cont(v, 0.5) AS m, mad(v) AS d FROM m GROUP BY ALL)"""


@query(_MIRROR + " SELECT session_id, channel, own AS idx, r{(x - m) / (1.4826 * d + 1e-12)} AS z FROM n", places=5)
def p5_mirrored_robust_z(spark, s):
    """Rolling robust z with the windows of the first and last samples filled by the mirror image of the series."""
    return cl.rolling_robust_z(s, 30, mirror=True).select("session_id", "channel", "idx", "z")


_TRACKS = f"""{SAMPLES}, dt AS (SELECT session_id, channel, idx, x - regr_slope(x, t) OVER w * t - regr_intercept(x, t) OVER w AS x FROM samples WINDOW w AS (PARTITION BY session_id, channel)),
 gd(k, f0) AS (VALUES {_values(GRID)}),
 sm AS (SELECT session_id, channel, idx, avg(x) OVER w AS m, count(*) OVER w AS n FROM dt WINDOW w AS (PARTITION BY session_id, channel ORDER BY idx ROWS BETWEEN 48 PRECEDING AND 48 FOLLOWING)),
 kn AS (SELECT k, f0, j, exp(-(j ** 2) / (2 * (6 / (2 * pi() * f0)) ** 2)) AS g, cos(2 * pi() * f0 * j) AS c, sin(2 * pi() * f0 * j) AS s FROM gd, range(-48, 49) q(j)),
 am AS (SELECT session_id, channel, a.idx, k, f0, sqrt((sum(b.x * g * c) - any_value(m) * sum(g * c)) ** 2 + (any_value(m) * sum(g * s) - sum(b.x * g * s)) ** 2) / sqrt(sum(g * g)) AS amp
  FROM sm a JOIN kn ON true JOIN dt b USING (session_id, channel) WHERE a.n = 97 AND b.idx = a.idx + j GROUP BY session_id, channel, a.idx, k, f0),
 pl AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel, idx, k ORDER BY f0) AS place FROM am),
 mx AS (SELECT session_id, channel, idx, k, first(place ORDER BY round(amp, 9) DESC, f0) AS place FROM pl GROUP BY ALL),
 md AS (SELECT session_id, channel, idx, k, quantile_disc(place, 0.5) OVER (PARTITION BY session_id, channel, k ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS place FROM mx),
 tk AS (SELECT session_id, channel, idx, k, f0 AS f, amp FROM md JOIN pl USING (session_id, channel, idx, k, place))"""


@query(""" SELECT session_id, channel, k::INT AS k, idx, r{f} AS f, r{amp} AS x FROM tk""", _TRACKS)
def f16_ridge_tracks(spark, s):
    """The drifting frequency of each order on its grid of wavelets, and the amplitude along it."""
    return tf.ridge_tracks(cl.detrend(s), spark.createDataFrame(GRID, "k int, f0 double"), 97, 1.0, 2)


@query(""", hn AS (SELECT session_id, channel, k, idx, 0.25 * coalesce(lag(amp) OVER w, 0) + 0.5 * amp + 0.25 * coalesce(lead(amp) OVER w, 0) AS x FROM tk WINDOW w AS (PARTITION BY session_id, channel, k ORDER BY idx)),
 zz AS (SELECT *, round((x - quantile_cont(x, 0.5) OVER w) / (1.4826 * mad(x) OVER w + 1e-12), 9) AS z FROM hn WINDOW w AS (PARTITION BY session_id, channel, k ORDER BY idx ROWS BETWEEN 84 PRECEDING AND 84 FOLLOWING)),
 nn AS (SELECT *, idx - row_number() OVER (PARTITION BY session_id, channel, k ORDER BY idx) AS g FROM zz WHERE z >= 1.5),
 ev AS (SELECT session_id, channel, k, min(idx) AS start, max(idx) + 1 AS "end", count(*) AS n, max(z) AS peak_z, first(idx ORDER BY z DESC, idx) AS peak_idx FROM nn GROUP BY session_id, channel, k, g HAVING count(*) >= 4)
 SELECT session_id, channel, k::INT AS k, start, "end", n, r{peak_z} AS peak_z, peak_idx, r{f} AS peak_f FROM ev JOIN (SELECT session_id, channel, k, idx AS peak_idx, f FROM tk) USING (session_id, channel, k, peak_idx)""", _TRACKS, 5)
def e6_drifting_spikes(spark, s):
    """Spikes of each order along its drifting ridge against a rolling baseline of a week."""
    return tf.drifting_spikes(s, spark.createDataFrame(GRID, "k int, f0 double"), 97, 1.0, 2, 1, 84, 1.5, 4)


_ADAPTIVE = f""", wd AS (SELECT f0, greatest(1, ceil(round((least(greatest(8 / f0, 60.0), 200.0) - 48) / 48, 9)))::BIGINT AS h FROM lines)
 SELECT a.session_id, a.channel, k AS "at", r{{a.f0}} AS f0, r{{{_MSC}}} AS msc, count(*) AS frames FROM range(0, 29) q(k) JOIN rd a ON true JOIN wd ON wd.f0 = a.f0 AND a.frame BETWEEN k - h AND k + h JOIN rd b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0
 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY a.session_id, a.channel, k, a.f0, h HAVING count(*) = 2 * h + 1"""


@query(_ADAPTIVE, READS)
def f12_adaptive_windows(spark, s):
    """Sliding coherence whose window spans eight cycles of its line, between 60 and 200 hours."""
    return sp.sliding_coherence(reads(spark, s), REFERENCE, sp.frames_for_cycles(8.0, WIN, STEP, 1.0, 60.0, 200.0))


_DRAWS = "st AS (SELECT rep, ('0x' || substr(md5(rep || ':' || b), 1, 12))::BIGINT % 23 AS a, least({b}, 23 - {b} * b) AS n FROM range(1, {r} + 1) q(rep), range({k}) u(b)), dr AS (SELECT rep, (a + k) % 23 AS i FROM st JOIN range({b}) w(k) ON k < n)"


@query(f""", sl AS (SELECT a.session_id, a.channel, k AS "at", a.f0, {_MSC} AS msc FROM range(3, 26) q(k) JOIN rd a ON a.frame BETWEEN k - 3 AND k + 3 JOIN rd b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY a.session_id, a.channel, k, a.f0),
 {_DRAWS.format(b=5, r=200, k=5)}, mx AS (SELECT session_id, channel, f0, rep, max(msc) AS m FROM sl JOIN dr ON "at" - 3 = i GROUP BY ALL), th AS (SELECT session_id, channel, f0, quantile_cont(m, 0.95) AS t FROM mx GROUP BY ALL)
 SELECT session_id, channel, r{{f0}} AS f0, r{{t}} AS threshold FROM th""", READS)
def f12_block_null(spark, s):
    """Threshold of each coherence trace by circular blocks of itself: the 95 % point of the largest value of 200 traces built anew."""
    traces = sp.sliding_coherence(reads(spark, s), REFERENCE, 3)
    return inf.max_of_resampled(traces.select("session_id", "channel", "f0", F.col("at").alias("idx"), F.col("msc").alias("x")), ["session_id", "channel", "f0"], 5, 200)


_CURVES = """, sc AS (SELECT a.session_id, a.channel, rep, k AS "at", sqrt(avg(cos(a.phase - b.phase)) ** 2 + avg(sin(a.phase - b.phase)) ** 2) AS plv
  FROM range(3, 26) q(k) JOIN ph a ON a.idx BETWEEN k - 3 AND k + 3 JOIN range(0, 29) u(rep) ON true JOIN ph b ON a.session_id = b.session_id AND a.idx = (b.idx + rep) % 29 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL),
 lm AS (SELECT session_id, channel, "at", quantile_cont(plv, 0.95) AS null95 FROM sc WHERE rep > 0 GROUP BY ALL), oc AS (SELECT session_id, channel, "at", plv, null95 FROM sc JOIN lm USING (session_id, channel, "at") WHERE rep = 0)"""


@query(_CURVES + ' SELECT session_id, channel, "at", r{plv} AS plv, r{null95} AS null95 FROM oc', READS)
def c10_locking_null_curve(spark, s):
    """Sliding locking with the reference and the 95 % point at each time of what it is under all 28 shifts."""
    return cp.locking_curves(phases(spark, s), REFERENCE, 3, 28, 5, 200)[0]


@query(_CURVES + ", mn AS (SELECT session_id, channel, rep, avg(plv) AS mean FROM sc GROUP BY ALL), sg AS (" + _significance("mn", "session_id, channel", "mean") + "), " + _DRAWS.format(b=5, r=200, k=5) + """,
 bm AS (SELECT session_id, channel, rep, avg(plv) AS m FROM oc JOIN dr ON "at" - 3 = i GROUP BY ALL), iv AS (SELECT session_id, channel, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY ALL),
 cv AS (SELECT session_id, channel, 100 * avg((round(plv - null95, 9) > 0)::INT) AS coverage FROM oc GROUP BY ALL)
 SELECT session_id, channel, r{mean} AS mean, r{p} AS p, r{coverage} AS coverage, r{low} AS low, r{high} AS high FROM sg JOIN cv USING (session_id, channel) JOIN iv USING (session_id, channel)""", READS)
def c10_locking_summary(spark, s):
    """Mean locking, its p, the share of the time above the null curve, and the mean's interval by blocks."""
    return cp.locking_curves(phases(spark, s), REFERENCE, 3, 28, 5, 200)[1]


@query(_BINS + """, pd AS (SELECT e1.session_id, e1.channel, e1.frame, e1.k, (s1.re ** 2 - s1.im ** 2) * e2.re + 2 * s1.re * s1.im * e2.im AS ar, 2 * s1.re * s1.im * e2.re - (s1.re ** 2 - s1.im ** 2) * e2.im AS ai,
   (e1.re ** 2 - e1.im ** 2) * s2.re + 2 * e1.re * e1.im * s2.im AS br, 2 * e1.re * e1.im * s2.re - (e1.re ** 2 - e1.im ** 2) * s2.im AS bi
  FROM bn e1 JOIN bn e2 ON e1.session_id = e2.session_id AND e1.channel = e2.channel AND e1.frame = e2.frame AND e2.k = 2 * e1.k JOIN bn s1 ON s1.session_id = e1.session_id AND s1.frame = e1.frame AND s1.k = e1.k JOIN bn s2 ON s2.session_id = e1.session_id AND s2.frame = e1.frame AND s2.k = 2 * e1.k
  WHERE e1.k IN (2, 4, 6) AND e1.channel <> 'view' AND s1.channel = 'view' AND s2.channel = 'view'),
 sn AS (SELECT pd.*, rep, CASE WHEN rep = 0 OR ('0x' || substr(md5(rep || ':' || frame), 1, 1))::INT < 8 THEN 1 ELSE -1 END AS g FROM pd, range(0, 201) q(rep)),
 mb AS (SELECT session_id, channel, k, rep, sqrt(avg(g * ar) ** 2 + avg(g * ai) ** 2) AS sse, sqrt(avg(g * br) ** 2 + avg(g * bi) ** 2) AS ees FROM sn GROUP BY ALL),
 df AS (SELECT session_id, channel, k, rep, sse - ees AS difference FROM mb), sg AS (""" + _significance("df", "session_id, channel, k", "difference") + """)
 SELECT session_id, channel, k::INT AS k, r{sse} AS sse, r{ees} AS ees, r{difference} AS difference, r{p} AS p FROM mb JOIN sg USING (session_id, channel, k) WHERE rep = 0""", SPECTRA, 4)
def f19_bispectral_direction(spark, s):
    """Whether the reference makes a channel's overtone or the channel the reference's, with p by random signs of the frames' products."""
    return tf.bispectral_direction(_bins(s), REFERENCE, [2, 4, 6], 200)


_GRID = f""", mp AS (SELECT session_id, channel, frame, round(f0 * 48)::BIGINT AS "row", re * re + im * im AS p FROM rs WHERE round(f0 * 48) BETWEEN 1 AND 12),
 av AS (SELECT session_id, frame, "row", ln(avg(p) + 1) AS p FROM mp GROUP BY ALL), mm AS (SELECT "row", avg(p) AS m FROM av GROUP BY ALL),
 tr AS (SELECT session_id || '-' || e AS trial, "row", frame - o AS col, p - m AS x FROM av JOIN mm USING ("row") JOIN (VALUES (1, 5), (2, 12), (3, 21)) q(e, o) ON frame BETWEEN o - 4 AND o + 5),
 cu AS (SELECT rep, "row", col, avg(x * CASE WHEN rep = 0 OR ('0x' || substr(md5(rep || ':' || trial), 1, 1))::INT < 8 THEN 1 ELSE -1 END) AS m FROM tr, range(0, 101) q(rep) GROUP BY ALL),
 tt AS (SELECT "row", col, quantile_cont(m, 0.8) AS t FROM cu WHERE rep > 0 GROUP BY ALL), ab AS MATERIALIZED (SELECT rep, "row", col, m, "row" * 1000 + col + 500 AS id FROM cu JOIN tt USING ("row", col) WHERE round(m - t, 9) > 0),
 rc AS (SELECT rep, id, id AS low FROM ab UNION SELECT b.rep, b.id, rc.low FROM rc JOIN ab b ON b.rep = rc.rep AND b.id IN (rc.id + 1, rc.id - 1, rc.id + 1000, rc.id - 1000) WHERE rc.low < b.id),
 lb AS (SELECT rep, id, min(low) AS low FROM rc GROUP BY ALL), ms AS (SELECT rep, low, count(*) AS cells, min("row") AS low_row, max("row") AS high_row, min(col) AS low_col, max(col) AS high_col, sum(m) AS mass FROM lb JOIN ab USING (rep, id) GROUP BY ALL),
 nl AS (SELECT q.rep, coalesce(max(mass), 0) AS top FROM range(1, 101) q(rep) LEFT JOIN ms ON ms.rep = q.rep GROUP BY q.rep),
 cl AS (SELECT low // 1000 AS first_row, low % 1000 - 500 AS first_col, cells, low_row, high_row, low_col, high_col, mass, (count(*) FILTER (round(top - mass, 9) >= 0) + 1) / (count(*) + 1) AS p FROM ms, nl WHERE ms.rep = 0 GROUP BY ALL)
 SELECT first_row::BIGINT AS first_row, first_col::BIGINT AS first_col, cells, low_row, high_row, low_col, high_col, r{{mass}} AS mass, r{{p}} AS p, p <= 0.2 + 1e-9 AS significant FROM cl"""


@query(_GRID, f"RECURSIVE {SPECTRA}", 5)
def i6_grid_clusters(spark, s):
    """Clusters of the time-frequency map around three onsets, trials being sessions and onsets, against sign-flipped maps."""
    power = sp.frame_spectra(s, WIN, STEP, 1.0, 0.02, 0.255).groupBy("session_id", "frame", F.round(F.col("f") * WIN).cast("long").alias("row")).agg(F.ln(F.avg("p") + 1).alias("p"))
    mean = power.groupBy("row").agg(F.avg("p").alias("_m"))
    onsets = base._onsets(s, ((1, 5), (2, 12), (3, 21)))
    near = jn.epochs(power.withColumnRenamed("frame", "idx"), onsets, 4, 5).join(mean, "row")
    trials = near.select(F.concat_ws("-", "session_id", "event_id").alias("trial"), "row", F.col("tau").alias("col"), (F.col("p") - F.col("_m")).alias("x"))
    return inf.sign_flip_grid_clusters(trials, 100, 0.8)


@query()
def p17_component_weights(spark, s):
    """Weights of the channels that bring the daily line out against its flanks, and those of the first principal component of its band."""
    found = {kind: sp.component_weights(s, 1 / 24, 0.008, 0.02, 1.0, kind, size=240, halo=96) for kind in ("ssd", "pca")}
    return inf.stacked(found).select("session_id", "metric", "channel", "w", "ratio")


@query()
def p17_component_channel(spark, s):
    """The weighted sum of the channels by the weights that bring the daily line out."""
    return sp.weighted_sum(s, sp.component_weights(s, 1 / 24, 0.008, 0.02, 1.0, "ssd", size=240, halo=96))


@query()
def c25_conditional_granger(spark, s):
    """What each channel's past adds to the prediction of each other one over the pasts of all, frame by frame of ten days."""
    return cp.conditional_granger(s, 3, 240, 120)


@query()
def c27_transfer_entropy_null(spark, s):
    """Transfer entropy both ways with the reference, against 19 shifts of the source."""
    return cp.transfer_entropy(_smooth(s), REFERENCE, [6, 12], reps=19)


@query()
def x15_covariance_spread(spark, s):
    """How far apart the logarithms of the channels' covariances of two-day frames are."""
    return cx.covariance_spread(s, WIN, STEP)


_LINE_SUMMARIES = """, vm AS (SELECT session_id, frame * 24.0 AS t, f0, avg(re) AS re, avg(im) AS im, sqrt(avg(re) ** 2 + avg(im) ** 2) AS amp FROM rd WHERE channel <> 'view' GROUP BY ALL),
 rf AS (SELECT session_id, frame * 24.0 AS t, re AS rr, im AS ri, sqrt(re * re + im * im) AS ref FROM rd WHERE channel = 'view' AND f0 < 0.05),
 ow AS (SELECT *, (ref - avg(ref) OVER w) / (stddev_pop(ref) OVER w + 1e-12) AS rz FROM vm JOIN rf USING (session_id, t) WHERE f0 < 0.05 WINDOW w AS (PARTITION BY session_id)),
 bs AS (SELECT session_id, state, window_id, avg(amp) AS b, stddev_pop(amp) AS d FROM ow JOIN windows ON t >= t0 - 120 AND t < t0 GROUP BY ALL),
 iw AS (SELECT session_id, state, window_id, max((amp - b) / (d + 1e-12)) AS line_z, (sum(re * rr + im * ri) ** 2 + sum(im * rr - re * ri) ** 2) / (sum(re * re + im * im) * sum(rr * rr + ri * ri)) AS msc, max(rz) AS ref_z_max, first(t ORDER BY round(rz, 9) DESC, t) AS ref_peak_t FROM ow JOIN windows ON t >= t0 AND t < t1 LEFT JOIN bs USING (session_id, state, window_id) GROUP BY ALL),
 nr AS (SELECT session_id, state, window_id, sum((amp - b) / (d + 1e-12)) * 24 AS line_area, avg(rz) AS ref_z_near FROM ow JOIN windows ON t >= t0 - 48 AND t < t0 + 48 LEFT JOIN bs USING (session_id, state, window_id) GROUP BY ALL),
 ld AS (SELECT session_id, state, window_id, first(t ORDER BY round(amp, 9) DESC, t) FILTER (f0 < 0.05) - first(t ORDER BY round(amp, 9) DESC, t) FILTER (f0 > 0.05) AS lead FROM vm JOIN windows ON t >= t0 - 120 AND t < t0 GROUP BY ALL),
 af AS (SELECT iw.session_id, state, window_id, avg(rz) AS ref_z_after FROM iw JOIN ow ON ow.session_id = iw.session_id AND t >= ref_peak_t AND t < ref_peak_t + 48 GROUP BY ALL)
 SELECT session_id, state, window_id, r{line_z} AS line_z, r{line_area} AS line_area, r{msc} AS msc, r{lead} AS lead, r{ref_z_max} AS ref_z_max, r{ref_peak_t} AS ref_peak_t, r{ref_z_near} AS ref_z_near, r{ref_z_after} AS ref_z_after
 FROM iw JOIN nr USING (session_id, state, window_id) JOIN ld USING (session_id, state, window_id) JOIN af USING (session_id, state, window_id)"""


@query(_LINE_SUMMARIES, READS, 5)
def e10_line_summaries(spark, s):
    """The second half of each event's record: line z and area, coherence, lead, and what the reference's line does."""
    return ev.event_line_summaries(reads(spark, s), REFERENCE, windows(spark), 1 / 24, 1 / 12, 24.0, 120.0, 48.0)


_BAND_POWER = """, fb AS (SELECT session_id, channel, frame, sum(re * re + im * im) FILTER (f0 >= 0.02 AND f0 < 0.1) AS slow, sum(re * re + im * im) FILTER (f0 >= 0.1 AND f0 < 0.25) AS mid, sum(re * re + im * im) FILTER (f0 >= 0.25 AND f0 < 0.5) AS fast FROM rs GROUP BY ALL),
 bp AS (SELECT session_id, channel, frame AS idx, unnest(['slow', 'mid', 'fast']) AS band, unnest([slow, mid, fast]) AS p FROM fb)"""


def _band_power(spark, s):
    """Power of each band in each frame, a row for each: session_id, channel, band, idx, p."""
    wide = sp.band_features(sp.frame_spectra(s, WIN, STEP, 1.0, 0.0, 0.5), bands(spark), [b[0] for b in BANDS])
    return wide.unpivot(["session_id", "channel", "frame"], [b[0] for b in BANDS], "band", "p").withColumnRenamed("frame", "idx")


@query(_BAND_POWER + """, fp AS (SELECT session_id, band, idx, round(stddev_pop(p), 9) AS x FROM bp GROUP BY ALL), l AS (SELECT session_id, band, avg(x) + 0.5 * stddev_samp(x) AS l FROM fp WHERE idx < 10 GROUP BY ALL),
 q AS (SELECT session_id, idx, (count(*) FILTER (x > l))::BIGINT AS x FROM fp JOIN l USING (session_id, band) GROUP BY ALL) """ + (base._RUNS % "x >= 2").replace("r{max(x)}", "max(x)"), SPECTRA)
def e2_band_spike_events(spark, s):
    """Stretches in which the field power of two bands or more is above its baseline; peak is the most bands at once."""
    field = _band_power(spark, s).groupBy("session_id", "band", "idx").agg(F.round(F.stddev_pop("p"), 9).alias("x"))
    return ev.spike_events(field, 0.5, 2, 1, F.col("idx") < 10, "band")


_STATES = ", pl AS (SELECT *, CASE WHEN idx IN (10, 11, 20, 21) THEN 'event' WHEN idx IN (12, 13) THEN 'rebound' ELSE 'baseline' END AS state FROM ph)"


def _labelled(spark, s):
    return jn.label_state(phases(spark, s).withColumn("t", F.col("idx") * STEP), windows(spark), ["event", "rebound"], "baseline")


@query(_STATES + """, pp AS (SELECT a.session_id, a.channel AS ch_i, b.channel AS ch_j, a.idx, a.state, round(sin(a.phase - b.phase), 9) AS g FROM pl a JOIN pl b ON a.session_id = b.session_id AND a.idx = b.idx AND a.channel < b.channel),
 o AS (SELECT session_id, ch_i, ch_j, avg((g > 0)::INT) FILTER (state = 'event') AS e, avg((g > 0)::INT) FILTER (state = 'baseline') AS b, avg((g < 0)::INT) FILTER (state = 'event') - avg((g < 0)::INT) FILTER (state = 'baseline') AS rv FROM pp GROUP BY ALL),
 pc AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n FROM (SELECT DISTINCT session_id, a AS start FROM pl, range(0, 26) q(a) WHERE list_sum(list_transform(range(a, a + 4), lambda i: CASE WHEN i IN (10, 11, 12, 13, 20, 21) THEN 1 ELSE 0 END)) = 0)),
 dw AS (SELECT session_id, rep, start FROM pc, range(1, 101) q(rep) WHERE k = ('0x' || substr(md5(session_id || ':' || rep), 1, 12))::BIGINT % n),
 nl AS (SELECT pp.session_id, ch_i, ch_j, rep, avg((g > 0)::INT) AS l FROM pp JOIN dw ON pp.session_id = dw.session_id AND idx >= start AND idx < start + 4 GROUP BY ALL)
 SELECT session_id, ch_i, ch_j, r{any_value(e)} AS in_state, r{any_value(b)} AS in_base, r{any_value(e - b)} AS delta, r{any_value(rv)} AS reverse, r{quantile_cont(round(abs(l - b), 9), 0.95)} AS null95, r{(count(*) FILTER (round(abs(l - b), 9) >= round(abs(e - b), 9)) + 1) / (count(*) + 1)} AS p FROM o JOIN nl USING (session_id, ch_i, ch_j) GROUP BY ALL""", READS)
def c8_directed_control(spark, s):
    """Directed lag in the events less in the baseline, with the reverse direction and stretches of the baseline as controls."""
    return cp.directed_control(_labelled(spark, s), "event", "baseline", 4, 100)


@query(f""", sl AS (SELECT a.session_id, a.channel, k AS "at", a.f0, {_MSC} AS msc FROM range(3, 26) q(k) JOIN rd a ON a.frame BETWEEN k - 3 AND k + 3 JOIN rd b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY a.session_id, a.channel, k, a.f0)
 SELECT session_id, channel, "at", r{{sum(msc / round(f0 * 24)) / sum(1 / round(f0 * 24))}} AS score FROM sl GROUP BY ALL""", READS)
def c11_frame_score(spark, s):
    """Sliding coherence averaged over the orders with weights 1 / k, frame by frame."""
    found = sp.sliding_coherence(reads(spark, s), REFERENCE, 3)
    return cp.weighted_score(found.select("session_id", "channel", "at", F.col("msc").alias("v"), F.round(F.col("f0") * 24).alias("k")), ["session_id", "channel", "at"])


@query(f""", sb AS (SELECT session_id, channel, k, least(floor((phase + pi()) / (2 * pi()) * 4), 3) AS b, avg(amp) AS a FROM ph JOIN range(2, 27) q(k) ON idx BETWEEN k - 2 AND k + 2 GROUP BY ALL),
 sq AS (SELECT *, a / sum(a) OVER (PARTITION BY session_id, channel, k) AS p FROM sb), si AS (SELECT session_id, channel, k, (ln(4) + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) / ln(4) AS mi FROM sq GROUP BY ALL),
 sm AS (SELECT session_id, k, avg(mi) AS mi FROM si GROUP BY ALL), ec AS (SELECT session_id, event_id, k - onset AS tau, mi FROM sm, {_FRAMES} WHERE k BETWEEN onset - 2 AND onset + 3)
 SELECT session_id, event_id, tau, r{{mi}} AS mi, r{{mi - avg(mi) FILTER (tau < 0) OVER (PARTITION BY session_id, event_id)}} AS change FROM ec""", READS, 5)
def c18_epoch_coupling(spark, s):
    """Modulation index of each epoch at each time around its onset, less that before it."""
    return cp.epoch_coupling(phases(spark, s), base._onsets(s, FRAME_ONSETS), 2, 3, 2, 4)


_DIRECTION = """, ea AS (SELECT a.session_id, a.channel, rep, l::INT AS lag, y.amp AS y, sin(ry.phase) AS z, a.amp AS a, sin(r.phase) AS s, cos(r.phase) AS c FROM range(0, 29) u(rep) JOIN range(1, 4) q(l) ON true
  JOIN ph r ON r.channel = 'view' JOIN ph a ON a.session_id = r.session_id AND a.channel <> 'view' AND (a.idx + rep) % 29 = r.idx JOIN ph ry ON ry.session_id = r.session_id AND ry.channel = 'view' AND ry.idx = r.idx + l JOIN ph y ON y.session_id = a.session_id AND y.channel = a.channel AND (y.idx + rep) % 29 = r.idx + l),
 co AS (SELECT session_id, channel, rep, lag, corr(y, a) AS ya, corr(y, s) AS ys, corr(y, c) AS yc, corr(z, a) AS za, corr(z, s) AS zs, corr(z, c) AS zc, corr(a, s) AS sa, corr(a, c) AS ca, corr(s, c) AS sc FROM ea GROUP BY ALL),
 p1 AS (SELECT *, (ys - ya * sa) / sqrt((1 - ya * ya) * (1 - sa * sa)) AS s1, (yc - ya * ca) / sqrt((1 - ya * ya) * (1 - ca * ca)) AS k1, (sc - sa * ca) / sqrt((1 - sa * sa) * (1 - ca * ca)) AS x1,
  (za - zs * sa) / sqrt((1 - zs * zs) * (1 - sa * sa)) AS za1, (zc - zs * sc) / sqrt((1 - zs * zs) * (1 - sc * sc)) AS zc1, (ca - sa * sc) / sqrt((1 - sa * sa) * (1 - sc * sc)) AS ac1 FROM co),
 gn AS (SELECT session_id, channel, 'phase_to_amplitude' AS direction, rep, lag, (1 - ya * ya) * (s1 * s1 + k1 * k1 - 2 * s1 * k1 * x1) / (1 - x1 * x1) AS gain FROM p1 UNION ALL
  SELECT session_id, channel, 'amplitude_to_phase', rep, lag, (1 - (zs * zs + zc * zc - 2 * zs * zc * sc) / (1 - sc * sc)) * (za1 - zc1 * ac1) ** 2 / ((1 - zc1 * zc1) * (1 - ac1 * ac1)) FROM p1),
 pk AS (SELECT session_id, channel, direction, rep, max(gain) AS gain, first(lag ORDER BY round(gain, 9) DESC, lag) AS lag FROM gn GROUP BY ALL), sg AS ("""


@query(_DIRECTION + _significance("pk", "session_id, channel, direction", "gain") + ") SELECT session_id, channel, direction, lag, r{gain} AS gain, r{p} AS p FROM sg JOIN (SELECT session_id, channel, direction, lag FROM pk WHERE rep = 0) USING (session_id, channel, direction)", READS, 5)
def c23_direction(spark, s):
    """Phase to amplitude and amplitude to phase with the reference: best lag, gain and its p under all shifts."""
    return cp.phase_amplitude_direction(phases(spark, s), REFERENCE, 3, 28)


_ENVELOPES = """, am AS (SELECT session_id, channel, frame, CASE WHEN f0 < 0.05 THEN 1 ELSE 2 END AS k, sqrt(re * re + im * im) AS a FROM rd), oc AS (SELECT DISTINCT session_id, channel FROM am WHERE channel <> 'view'),
 sr AS (SELECT oc.session_id, oc.channel, 'from_reference' AS direction, frame, k, a FROM oc JOIN am ON am.session_id = oc.session_id AND am.channel = 'view' UNION ALL SELECT session_id, channel, 'to_reference', frame, k, a FROM am WHERE channel <> 'view'),
 ta AS (SELECT oc.session_id, oc.channel, 'to_reference' AS direction, frame, k, a FROM oc JOIN am ON am.session_id = oc.session_id AND am.channel = 'view' UNION ALL SELECT session_id, channel, 'from_reference', frame, k, a FROM am WHERE channel <> 'view'),
 mx AS (SELECT session_id, channel, direction, rep, (frame + rep * k) % 29 AS frame, k, a FROM sr, range(0, 29) q(rep)),
 xw AS (SELECT session_id, channel, direction, rep, frame, max(a) FILTER (k = 1) AS x1, max(a) FILTER (k = 2) AS x2 FROM mx WHERE frame < 28 GROUP BY ALL), yw AS (SELECT session_id, channel, direction, frame - 1 AS frame, max(a) FILTER (k = 1) AS y1, max(a) FILTER (k = 2) AS y2 FROM ta WHERE frame > 0 GROUP BY ALL),
 su AS (SELECT session_id, channel, direction, rep, sum(x1 * x1) + 1e-9 AS p, sum(x2 * x2) + 1e-9 AS q, sum(x1 * x2) AS r, sum(y1 * x1) AS a1, sum(y1 * x2) AS a2, sum(y2 * x1) AS b1, sum(y2 * x2) AS b2 FROM xw JOIN yw USING (session_id, channel, direction, frame) GROUP BY ALL),
 gg AS (SELECT session_id, channel, direction, rep, unnest([1 / 24.0, 1 / 12.0, 1 / 24.0, 1 / 12.0]) AS f_from, unnest([1 / 24.0, 1 / 24.0, 1 / 12.0, 1 / 12.0]) AS f_to, unnest([(a1 * q - a2 * r) / (p * q - r * r), (a2 * p - a1 * r) / (p * q - r * r), (b1 * q - b2 * r) / (p * q - r * r), (b2 * p - b1 * r) / (p * q - r * r)]) AS g FROM su),
 gr AS (SELECT session_id, channel, direction, f_from, f_to, max(g) FILTER (rep = 0) AS gain, quantile_cont(abs(g), 0.95) FILTER (rep > 0) AS threshold FROM gg GROUP BY ALL)"""


@query(_ENVELOPES + " SELECT session_id, channel, direction, r{f_from} AS f_from, r{f_to} AS f_to, r{gain} AS gain, r{threshold} AS threshold, round(abs(gain) - threshold, 9) > 0 AS significant FROM gr", READS, 5)
def c28_envelope_matrix(spark, s):
    """How the amplitudes of all lines of one frame make those of the next, from the reference to each channel and back."""
    return cp.envelope_matrix(reads(spark, s), REFERENCE, 28)


_CUT = """ nu AS (SELECT {keys}, ch, row_number() OVER (PARTITION BY {keys} ORDER BY ch) - 1 AS k FROM (SELECT {keys}, ch_i AS ch FROM ge UNION SELECT {keys}, ch_j FROM ge)),
 ct AS (SELECT {keys}, m, sum(CASE WHEN ((m >> a.k) & 1) <> ((m >> b.k) & 1) THEN w ELSE 0 END) AS cut FROM ge JOIN nu a USING ({keys}) JOIN nu b USING ({keys}), range(1, 16) q(m) WHERE a.ch = ch_i AND b.ch = ch_j GROUP BY ALL), mc AS (SELECT {keys}, min(cut) AS min_cut FROM ct GROUP BY ALL)"""


@query(", ge AS (SELECT * FROM edges)," + _CUT.format(keys="session_id") + " SELECT session_id, r{min_cut} AS min_cut FROM mc", READS)
def g7_min_cut(spark, s):
    """The least weight of edges that part each session's locking graph in two."""
    return gr.matrix_measures(edges(spark, s), ["session_id"]).select("session_id", "min_cut")


@query(""", pz AS (SELECT session_id, channel, f0, frame, atan2(im, re) AS phase, CASE WHEN frame IN (10, 11, 20, 21) THEN 'event' WHEN frame IN (12, 13) THEN 'rebound' ELSE 'baseline' END AS state FROM rd),
 ge AS (SELECT a.session_id, a.f0, a.state, a.channel AS ch_i, b.channel AS ch_j, sqrt(avg(cos(a.phase - b.phase)) ** 2 + avg(sin(a.phase - b.phase)) ** 2) AS w FROM pz a JOIN pz b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 AND a.channel < b.channel GROUP BY ALL),""" + _CUT.format(keys="session_id, f0, state")
       + """, va AS (SELECT session_id, f0, state, 'min_cut' AS metric, min_cut AS v FROM mc UNION ALL SELECT session_id, f0, state, 'plv', avg(w) FROM ge GROUP BY ALL),
 de AS (SELECT session_id, f0, metric, max(v) FILTER (state = 'event') - max(v) FILTER (state = 'baseline') AS d FROM va GROUP BY ALL)
 SELECT r{f0} AS f0, metric, count(d) AS sessions, r{avg(d)} AS mean, r{stddev_samp(d) / sqrt(count(d))} AS sem FROM de GROUP BY f0, metric""", READS)
def g11_band_contrast(spark, s):
    """Minimum cut and mean locking in the events less in the baseline, line by line: mean and standard error over the sessions."""
    own = reads(spark, s).select("session_id", "channel", "f0", F.col("frame").alias("idx"), F.atan2("im", "re").alias("phase"), (F.col("frame") * STEP).alias("t"))
    graph = cp.phase_edges(jn.label_state(own, windows(spark), ["event", "rebound"], "baseline"), ["session_id", "f0", "state"])
    keys = ["session_id", "f0", "state"]
    graph = graph.select(*keys, "ch_i", "ch_j", F.col("plv").alias("w"))
    cut = gr.matrix_measures(graph, keys).select(*keys, F.lit("min_cut").alias("metric"), F.col("min_cut").alias("value"))
    values = cut.unionByName(graph.groupBy(*keys).agg(F.avg("w").alias("value")).withColumn("metric", F.lit("plv")))
    return inf.summary(inf.state_contrast(values, ["session_id", "f0", "metric"]), ["f0", "metric"], "delta").select("f0", "metric", F.col("n").alias("sessions"), "mean", "sem")


@query(_Z + _PEAKS + """, hp AS (SELECT session_id, idx AS p, x AS top, prominence, x - prominence / 2 AS h FROM pk),
 nr AS (SELECT hp.*, max(c.idx) FILTER (c.idx < p AND c.x <= h) AS i, min(c.idx) FILTER (c.idx > p AND c.x <= h) AS j, min(c.idx) AS lo, max(c.idx) AS hi FROM hp JOIN cv c ON c.session_id = hp.session_id AND c.idx BETWEEN p - 24 AND p + 24 GROUP BY ALL),
 en AS (SELECT n.*, a.idx AS ia, a.x AS xa, a1.x AS xa1, z.idx AS iz, z.x AS xz, z1.x AS xz1 FROM nr n JOIN cv a ON a.session_id = n.session_id AND a.idx = coalesce(i, lo) JOIN cv a1 ON a1.session_id = n.session_id AND a1.idx = a.idx + 1 JOIN cv z ON z.session_id = n.session_id AND z.idx = coalesce(j, hi) JOIN cv z1 ON z1.session_id = n.session_id AND z1.idx = z.idx - 1),
 wd AS (SELECT session_id, p AS idx, top AS x, prominence, ia + CASE WHEN xa < h THEN (h - xa) / (xa1 - xa) ELSE 0 END AS l, iz - CASE WHEN xz < h THEN (h - xz) / (xz1 - xz) ELSE 0 END AS r FROM en)
 SELECT session_id, idx, r{x} AS x, r{prominence} AS prominence, r{l} AS "left", r{r} AS "right", r{r - l} AS width FROM wd""", places=5)
def e9_peak_widths(spark, s):
    """Where each prominent peak of the activity begins and ends at half its prominence."""
    curve = ev.activity(cl.z_score(s), 1.0).select("session_id", "idx", F.round("activity", 9).alias("x"))
    return ev.peak_widths(curve, _peaks(s), ["session_id"], 24)


@query(""", nb AS (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM samples WINDOW w AS (PARTITION BY session_id, channel ORDER BY idx)), kd AS (SELECT *, CASE WHEN x > l AND x >= r THEN 1 WHEN x < l AND x <= r THEN -1 END AS k FROM nb),
 sh AS (SELECT session_id, channel, avg(x - (l + r) / 2) FILTER (k = 1) AS p, avg(x - (l + r) / 2) FILTER (k = -1) AS t FROM kd GROUP BY ALL), lg AS (SELECT *, count(k) OVER (PARTITION BY session_id, channel ORDER BY idx) AS leg FROM kd),
 ls AS (SELECT session_id, channel, leg, arg_min(k, idx) AS f, max((r - l) / 2) AS up, min((r - l) / 2) AS down, max(leg) OVER (PARTITION BY session_id, channel) AS n FROM lg WHERE leg > 0 AND l IS NOT NULL AND r IS NOT NULL GROUP BY session_id, channel, leg),
 st AS (SELECT session_id, channel, avg(up) FILTER (f = -1) AS u, avg(down) FILTER (f = 1) AS d FROM ls WHERE leg < n GROUP BY ALL)
 SELECT session_id, channel, r{(p - abs(t)) / (abs(p) + abs(t) + 1e-12)} AS sharpness, r{(u - abs(d)) / (abs(u) + abs(d) + 1e-12)} AS steepness FROM sh JOIN st USING (session_id, channel)""")
def e17_shape_asymmetry(spark, s):
    """How much sharper peaks are than troughs and rises steeper than decays."""
    return ev.shape_asymmetry(s)


@query(_BAND_POWER + f""", ob AS (SELECT session_id, event_id, least(floor((atan2(im, re) + pi()) / (2 * pi()) * 4), 3)::INT AS bin FROM rs, {_FRAMES} WHERE channel = 'view' AND frame = onset AND round(f0 * 48) = 2)
 SELECT session_id, event_id, channel, band, bin, r{{avg(p)}} AS power FROM bp JOIN ob USING (session_id), {_FRAMES.replace("o(event_id, onset)", "o(eid, onset)")} WHERE eid = event_id AND idx BETWEEN onset - 1 AND onset + 2 GROUP BY ALL""", SPECTRA, 4)
def e19_trial_features(spark, s):
    """Band powers of each trial and the bin of the reference's phase at its onset."""
    return ev.trial_features(_band_power(spark, s), phases(spark, s), base._onsets(s, FRAME_ONSETS), REFERENCE, 1, 2, 4)


@query(f""", ob AS (SELECT session_id, event_id, onset, least(floor((phase + pi()) / (2 * pi()) * 2), 1)::INT AS bin FROM ph, {_FRAMES} WHERE channel = 'view' AND idx = onset),
 eb AS (SELECT bin, channel, least(floor((phase + pi()) / (2 * pi()) * 4), 3) AS b, avg(amp) AS a FROM ph JOIN ob USING (session_id) WHERE idx BETWEEN onset - 2 AND onset + 3 GROUP BY ALL), eq AS (SELECT *, a / sum(a) OVER (PARTITION BY bin, channel) AS p FROM eb),
 ei AS (SELECT bin, channel, (ln(4) + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) / ln(4) AS mi FROM eq GROUP BY ALL) SELECT bin, r{{avg(mi)}} AS mi, count(*) AS channels FROM ei GROUP BY bin""", READS)
def e19_coupling_by_phase(spark, s):
    """Modulation index of the trials whose reference phase at the onset lies in one half of the circle."""
    return ev.coupling_by_onset_phase(phases(spark, s), base._onsets(s, FRAME_ONSETS), REFERENCE, 2, 3, 2, 4)


@query(base._LABELS + """, ch AS (SELECT session_id, idx, label, lag(label) OVER (PARTITION BY session_id ORDER BY idx) AS was FROM lb), av AS (SELECT session_id, idx, (label <> was)::INT AS y, round(var_pop(x), 9) AS amp FROM ch JOIN samples USING (session_id, idx) WHERE was IS NOT NULL GROUP BY session_id, idx, label, was),
 rk AS (SELECT session_id, idx - 1 AS k, y, rank() OVER (PARTITION BY session_id ORDER BY amp) + (count(*) OVER (PARTITION BY session_id, amp) - 1) / 2 AS r FROM av),
 au AS (SELECT a.session_id, rep, (sum(b.r) - count(*) * (count(*) + 1) / 2) / nullif(count(*) * (719 - count(*)), 0) AS auc FROM rk a JOIN range(0, 20) q(rep) ON true JOIN rk b ON b.session_id = a.session_id AND b.k = (a.k + rep * 37) % 719 WHERE a.y = 1 GROUP BY a.session_id, rep), sg AS (""" + _significance("au", "session_id", "auc") + ") SELECT session_id, r{auc} AS auc, r{p} AS p, r{null95} AS null95, r{z} AS z FROM sg", places=5)
def m10_change_auc_null(spark, s):
    """How well the field power tells label changes, against the field power moved round."""
    return st.change_auc_with_null(base._labels(s), ev.field_power(s).withColumnRenamed("gfp", "amp"), 19, 37)


@query(""", ri AS (SELECT session_id, channel, frame, max(re * re + im * im) AS p FROM rs WHERE f0 BETWEEN 0.02 AND 0.25 GROUP BY ALL),
 rc AS (SELECT a.session_id, a.channel, rep, coalesce(corr(a.p, b.p), 0) AS r FROM ri a JOIN range(0, 29) q(rep) ON true JOIN ri b ON a.session_id = b.session_id AND a.frame = (b.frame + rep) % 29 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL), sg AS (""" + _significance("rc", "session_id, channel", "r") + ") SELECT session_id, channel, r{r} AS r, r{p} AS p, r{null95} AS null95, r{z} AS z FROM sg", SPECTRA, 5)
def f16_ridge_coupling(spark, s):
    """Correlation of the ridges' power with the reference's, and its p under all shifts."""
    return sp.ridge_coupling(sp.ridge(sp.frame_spectra(s, WIN, STEP, 1.0, 0.02, 0.25)), REFERENCE, 28)


@query()
def x9_choice_of_dimension(spark, s):
    """Shares of false neighbours in two to four dimensions and the dimension chosen."""
    return cx.false_neighbours(_smooth(s), [2, 3, 4], 12)


def _eliminated(name: str, table: str, keys: str, steps: int) -> str:
    """CTEs that take one variable after another out of the matrices (keys, i, j, v) of ``table``: name_k has what is left after k of ``steps``, and
    name_pivots (keys, k, v) the diagonal entry that each step divides by."""
    at = " AND ".join(f"{{0}}.{k.strip()} = {{1}}.{k.strip()}" for k in keys.split(","))
    parts, last = [], table
    for k in range(1, steps + 1):
        own = ", ".join(f"m.{c.strip()}" for c in keys.split(","))
        parts.append(f"""{name}_{k} AS MATERIALIZED (SELECT {own}, m.i, m.j, m.v - a.v * b.v / p.v AS v FROM {last} m JOIN {last} a ON {at.format("a", "m")} AND a.i = m.i AND a.j = {k}
  JOIN {last} b ON {at.format("b", "m")} AND b.i = {k} AND b.j = m.j JOIN {last} p ON {at.format("p", "m")} AND p.i = {k} AND p.j = {k} WHERE m.i > {k} AND m.j > {k})""")
        last = f"{name}_{k}"
    pivots = " UNION ALL ".join(f"SELECT {keys}, {k} AS k, v FROM {table if k == 1 else f'{name}_{k - 1}'} WHERE i = {k} AND j = {k}" for k in range(1, steps + 1))
    return ", ".join([*parts, f"{name}_pivots AS ({pivots})"])


_LAGGED = """, nm AS (SELECT channel, row_number() OVER (ORDER BY channel) AS c FROM (SELECT DISTINCT channel FROM samples)),
 lg AS MATERIALIZED (SELECT a.session_id, a.idx, c, l, b.x FROM samples a JOIN nm USING (channel) JOIN range(0, 4) q(l) ON true JOIN samples b ON b.session_id = a.session_id AND b.channel = a.channel AND b.idx = a.idx - l)"""


def _placed(name: str, keys: str, source: str, where: str) -> str:
    """CTEs with the moments of the variables that ``where`` keeps (of ``source``: keys, c1, l1, c2, l2, v), lags first, numbered as _eliminated wants them."""
    return f"""{name}_v AS (SELECT {keys}, c, l, row_number() OVER (PARTITION BY {keys} ORDER BY l = 0, l, c) AS k FROM (SELECT DISTINCT {keys}, c1 AS c, l1 AS l FROM {source}) WHERE {where}),
 {name} AS MATERIALIZED (SELECT {", ".join(f"s.{k.strip()}" for k in keys.split(","))}, a.k AS i, b.k AS j, s.v FROM {source} s JOIN {name}_v a ON {" AND ".join(f"a.{k.strip()} = s.{k.strip()}" for k in keys.split(","))} AND a.c = c1 AND a.l = l1 JOIN {name}_v b ON {" AND ".join(f"b.{k.strip()} = s.{k.strip()}" for k in keys.split(","))} AND b.c = c2 AND b.l = l2)"""


_CONDITIONAL = _LAGGED + f""", fm AS (SELECT lg.*, f FROM lg JOIN range(1, 5) w(f) ON idx >= 120 * f AND idx < 120 * f + 240),
 mo AS MATERIALIZED (SELECT a.session_id, a.f, a.c AS c1, a.l AS l1, b.c AS c2, b.l AS l2, sum(a.x * b.x) - sum(a.x) * sum(b.x) / 240 AS v FROM fm a JOIN fm b USING (session_id, f, idx) GROUP BY a.session_id, a.f, a.c, a.l, b.c, b.l),
 {_placed("fu", "session_id, f", "mo", "true")}, {_eliminated("fu", "fu", "session_id, f", 15)}, ro AS (SELECT mo.*, s FROM mo, range(1, 6) w(s)), {_placed("re", "session_id, f, s", "ro", "l = 0 OR c <> s")}, {_eliminated("re", "re", "session_id, f, s", 12)},
 po AS (SELECT mo.*, s, t FROM mo, range(1, 6) w(s), range(1, 6) u(t) WHERE s <> t), {_placed("pa", "session_id, f, s, t", "po", "l = 0 AND c = t OR l > 0 AND c IN (s, t)")}, {_eliminated("pa", "pa", "session_id, f, s, t", 6)},
 oo AS (SELECT mo.*, t FROM mo, range(1, 6) u(t)), {_placed("ow", "session_id, f, t", "oo", "c = t")}, {_eliminated("ow", "ow", "session_id, f, t", 3)},
 rs AS (SELECT p.session_id, p.f, p.s, p.t, a.v AS fu, b.v AS re, p.v AS pa, o.v AS ow FROM pa_6 p JOIN fu_15 a ON a.session_id = p.session_id AND a.f = p.f AND a.i = 15 + p.t AND a.j = a.i JOIN re_12 b ON b.session_id = p.session_id AND b.f = p.f AND b.s = p.s AND b.i = 12 + p.t AND b.j = b.i JOIN ow_3 o ON o.session_id = p.session_id AND o.f = p.f AND o.t = p.t)
 SELECT session_id, f AS frame, a.channel AS source, b.channel AS target, r{{(re - fu) / 3 / (fu / 224)}} AS f, r{{ln(re / fu)}} AS log_gain, r{{(ow - pa) / 3 / (pa / 233)}} AS f_pair, r{{ln(ow / pa)}} AS log_gain_pair FROM rs JOIN nm a ON a.c = s JOIN nm b ON b.c = t"""
base.ORACLE_SQL["c25_conditional_granger"] = f"WITH {SAMPLES} {base._rounded(_CONDITIONAL, 6)}"


def _pairwise_sql() -> str:
    """Pairwise Granger at orders 1 to 3 from moments over the whole series, taken from the series' means."""
    parts = [_LAGGED.replace("b.x FROM", "b.x - b.m AS x FROM").replace("JOIN samples b ON", "JOIN (SELECT *, avg(x) OVER (PARTITION BY session_id, channel) AS m FROM samples) b ON"),
             ", mo AS MATERIALIZED (SELECT a.session_id, a.c AS c1, a.l AS l1, b.c AS c2, b.l AS l2, sum(a.x * b.x) AS v FROM lg a JOIN lg b USING (session_id, idx) WHERE idx >= 3 GROUP BY a.session_id, a.c, a.l, b.c, b.l), po AS (SELECT mo.*, s, t FROM mo, range(1, 6) w(s), range(1, 6) u(t) WHERE s <> t), oo AS (SELECT mo.*, t FROM mo, range(1, 6) u(t))"]
    found = []
    for p in (1, 2, 3):
        parts += [f", {_placed(f'pa{p}', 'session_id, s, t', 'po', f'l = 0 AND c = t OR l BETWEEN 1 AND {p} AND c IN (s, t)')}, {_eliminated(f'pa{p}', f'pa{p}', 'session_id, s, t', 2 * p)}, {_placed(f'ow{p}', 'session_id, t', 'oo', f'c = t AND l <= {p}')}, {_eliminated(f'ow{p}', f'ow{p}', 'session_id, t', p)}"]
        found.append(f"SELECT a.session_id, a.s, a.t, {p} AS p, (o.v - a.v) / {p} / (a.v / (717 - {2 * p})) AS f, ln(o.v / a.v) AS g FROM pa{p}_{2 * p} a JOIN ow{p}_{p} o ON o.session_id = a.session_id AND o.t = a.t")
    return "".join(parts) + f", tr AS ({' UNION ALL '.join(found)}), be AS (SELECT session_id, s, t, arg_max(p, f) AS p, max(f) AS f, arg_max(g, f) AS g FROM tr GROUP BY ALL) SELECT session_id, a.channel AS source, b.channel AS target, p::INT AS \"order\", r{{f}} AS f, r{{g}} AS log_gain FROM be JOIN nm a ON a.c = s JOIN nm b ON b.c = t".replace("{{", "{").replace("}}", "}")


base.ORACLE_SQL["c25_granger"] = f"WITH {SAMPLES} {base._rounded(_pairwise_sql(), 6)}"


_INFORMATION = f""", nm AS (SELECT channel, row_number() OVER (ORDER BY channel) AS c FROM (SELECT DISTINCT channel FROM samples)), sx AS (SELECT session_id, idx, c, x - avg(x) OVER (PARTITION BY session_id, c) AS x FROM samples JOIN nm USING (channel)),
 c0 AS (SELECT a.session_id, a.c AS c1, b.c AS c2, avg(a.x * b.x) AS v FROM sx a JOIN sx b USING (session_id, idx) GROUP BY a.session_id, a.c, b.c), tc AS (SELECT session_id, 1e-9 * sum(v) / count(*) AS e FROM c0 WHERE c1 = c2 GROUP BY session_id),
 mo AS MATERIALIZED (SELECT session_id, c1, 0 AS l1, c2, 0 AS l2, v + CASE WHEN c1 = c2 THEN e ELSE 0 END AS v FROM c0 JOIN tc USING (session_id)), ro AS (SELECT mo.*, s FROM mo, range(1, 6) w(s)),
 {_placed("fu", "session_id", "mo", "true")}, {_eliminated("fu", "fu", "session_id", 5)}, {_placed("re", "session_id, s", "ro", "c <> s")}, {_eliminated("re", "re", "session_id, s", 4)},
 fd AS (SELECT session_id, sum(ln(v)) AS d FROM fu_pivots GROUP BY ALL), rd AS (SELECT session_id, sum(ln(v)) AS d FROM re_pivots GROUP BY session_id), dg AS (SELECT session_id, sum(ln(v)) AS d FROM mo WHERE c1 = c2 GROUP BY session_id),
 ii AS (SELECT session_id, 0.5 * (dg.d - fd.d) AS total, 0.5 * (fd.d + rd.d - 5 * fd.d) AS dual FROM fd JOIN rd USING (session_id) JOIN dg USING (session_id)) SELECT session_id, r{{total}} AS total, r{{dual}} AS dual, r{{total - dual}} AS o_information FROM ii"""
base.ORACLE_SQL["x5_gaussian_information"] = f"WITH {SAMPLES} {base._rounded(_INFORMATION, 6)}"


#: The digamma terms of the four entropies cancel: what is left are mean logs of the distances to the fourth neighbours.
_TRANSFER = _SMOOTH + """, zs AS (SELECT session_id, channel, idx, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12) AS x FROM sm WINDOW w AS (PARTITION BY session_id, channel)),
 bo AS (SELECT a.session_id, a.channel, a.idx, a.x, b.x AS r FROM zs a JOIN zs b USING (session_id, idx) WHERE b.channel = 'view' AND a.channel <> 'view'),
 sd AS (SELECT session_id, channel, idx, d, CASE WHEN d = 'from_reference' THEN r ELSE x END AS s, CASE WHEN d = 'from_reference' THEN x ELSE r END AS y FROM bo, (VALUES ('from_reference'), ('to_reference')) w(d)),
 pt4 AS MATERIALIZED (SELECT a.session_id, a.channel, a.d, a.idx // 360 AS b, l, a.idx, f.y AS f, a.y AS p, a.s FROM sd a JOIN (VALUES (6), (12)) q(l) ON true JOIN sd f ON f.session_id = a.session_id AND f.channel = a.channel AND f.d = a.d AND f.idx = a.idx + l AND f.idx // 360 = a.idx // 360),
 nb AS (SELECT a.session_id, a.channel, a.d, a.b, a.l, a.idx, min(greatest(abs(a.f - c.f), abs(a.p - c.p)), 5)[5] AS fp, min(abs(a.p - c.p), 5)[5] AS p, min(greatest(abs(a.f - c.f), abs(a.p - c.p), abs(a.s - c.s)), 5)[5] AS fps, min(greatest(abs(a.p - c.p), abs(a.s - c.s)), 5)[5] AS ps FROM pt4 a JOIN pt4 c USING (session_id, channel, d, b, l) GROUP BY ALL),
 te AS (SELECT session_id, channel, d, l, b, 2 * avg(ln(2 * greatest(fp, 1e-12))) - avg(ln(2 * greatest(p, 1e-12))) - 3 * avg(ln(2 * greatest(fps, 1e-12))) + 2 * avg(ln(2 * greatest(ps, 1e-12))) AS te FROM nb GROUP BY ALL)
 SELECT session_id, channel, d AS direction, l::INT AS lag, r{avg(te)} AS te FROM te GROUP BY session_id, channel, d, l"""
base.ORACLE_SQL["c27_transfer_entropy"] = f"WITH {SAMPLES} {base._rounded(_TRANSFER, 6)}"


def _dimension_sql(dims: list[int]) -> str:
    parts, found = [_SMOOTH], []
    for m in dims:
        gap = " + ".join(f"(p.a{k} - q.a{k}) ** 2" for k in range(m))
        parts.append(f""", q{m} AS MATERIALIZED (SELECT * FROM (SELECT session_id, channel, idx, {", ".join(f"lead(x, {12 * k}) OVER w AS a{k}" for k in range(m))} FROM sm WINDOW w AS (PARTITION BY session_id, channel ORDER BY idx)) WHERE a{m - 1} IS NOT NULL),
 d{m} AS (SELECT session_id, channel, i, min(d) AS d, arg_min(o, (d, o)) AS o FROM (SELECT p.session_id, p.channel, p.idx AS i, q.idx AS o, round(sqrt({gap}), 9) AS d FROM q{m} p JOIN q{m} q USING (session_id, channel) WHERE abs(p.idx - q.idx) > 10) GROUP BY ALL),
 s{m} AS (SELECT n.session_id, n.channel, avg((abs(a.x - b.x) / n.d > 15)::INT) AS share, {m} AS m FROM d{m} n JOIN sm a ON a.session_id = n.session_id AND a.channel = n.channel AND a.idx = n.i + {12 * m} JOIN sm b ON b.session_id = n.session_id AND b.channel = n.channel AND b.idx = n.o + {12 * m} WHERE n.d > 0 GROUP BY ALL)""")
        found.append(f"SELECT * FROM s{m}")
    return "".join(parts) + f", sa AS ({' UNION ALL '.join(found)}) SELECT session_id, channel, m, r{{share}} AS share, greatest(3, coalesce(min(m) FILTER (share <= 0.05) OVER (PARTITION BY session_id, channel), {max(dims)})) AS chosen FROM sa"


base.ORACLE_SQL["x9_choice_of_dimension"] = f"WITH {SAMPLES} {base._rounded(_dimension_sql([2, 3, 4]), 6)}"


def _first_component_sql(squarings: int = 10) -> str:
    """The first component of a covariance as the limit of its powers, each squared and divided by its trace: the projection on that component."""
    keys = "session_id, f0"
    unit = lambda name, source: f"{name} AS MATERIALIZED (SELECT session_id, f0, i, j, v / sum(CASE WHEN i = j THEN v ELSE 0 END) OVER (PARTITION BY {keys}) AS v FROM ({source}))"
    parts = [f"g0 AS MATERIALIZED (SELECT a.session_id, a.f0, a.channel AS i, b.channel AS j, avg(a.re * b.re + a.im * b.im) AS v FROM rd a JOIN rd b ON a.session_id = b.session_id AND a.f0 = b.f0 AND a.frame = b.frame GROUP BY ALL)", unit("b0", "SELECT * FROM g0")]
    parts += [unit(f"b{k + 1}", f"SELECT a.session_id, a.f0, a.i, b.j, sum(a.v * b.v) AS v FROM b{k} a JOIN b{k} b ON a.session_id = b.session_id AND a.f0 = b.f0 AND a.j = b.i GROUP BY ALL") for k in range(squarings)]
    return f", {', '.join(parts)} SELECT session_id, r{{f0}} AS f0, r{{sum(b.v * g.v) / sum(g.v) FILTER (i = j)}} AS share, r{{sqrt(sum(b.v) / count(*) FILTER (i = j))}} AS in_phase FROM g0 g JOIN b{squarings} b USING (session_id, f0, i, j) GROUP BY session_id, f0"


base.ORACLE_SQL["m14_spatial_mode"] = f"WITH {READS} {base._rounded(_first_component_sql(), 6)}"


_TAPERS = slepian(WIN, 2.5, 4)
_SLEPIAN = f""", tw AS (SELECT unnest({[list(map(float, t)) for t in _TAPERS]}::DOUBLE[][]) AS w, unnest(range(1, {len(_TAPERS) + 1})) AS taper),
 mt AS (SELECT session_id, channel, frame, f0, taper, (sum(x * w * c) - avg(x) * sum(w * c)) / sqrt(sum(w * w)) AS re, (avg(x) * sum(w * s) - sum(x * w * s)) / sqrt(sum(w * w)) AS im FROM
  (SELECT fr.*, f0, taper, w[j + 1] AS w, cos(2 * pi() * round(f0 * 48) * j / 48) AS c, sin(2 * pi() * round(f0 * 48) * j / 48) AS s FROM fr, lines, tw) GROUP BY ALL HAVING count(*) = 48),
 su AS (SELECT a.session_id, a.channel, a.f0, a.taper, sum(a.re * b.re + a.im * b.im) AS x, sum(a.im * b.re - a.re * b.im) AS y, sum(a.re ** 2 + a.im ** 2) AS p, sum(b.re ** 2 + b.im ** 2) AS q FROM mt a JOIN mt b USING (session_id, frame, f0, taper) WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL),
 jk AS (SELECT *, sum(x) OVER w AS tx, sum(y) OVER w AS ty, sum(p) OVER w AS tp, sum(q) OVER w AS tq FROM su WINDOW w AS (PARTITION BY session_id, channel, f0)),
 f AS (SELECT session_id, channel, f0, any_value((tx * tx + ty * ty) / (tp * tq)) AS msc, sqrt(3 * var_pop(((tx - x) ** 2 + (ty - y) ** 2) / ((tp - p) * (tq - q)))) AS se, any_value(atan2(ty, tx)) AS phase FROM jk GROUP BY ALL)
 SELECT session_id, channel, r{{f0}} AS f0, r{{msc}} AS msc, r{{msc - 1.96 * se}} AS low, r{{msc + 1.96 * se}} AS high, r{{phase}} AS phase, r{{phase / (2 * pi() * f0)}} AS lag FROM f"""


@query(_SLEPIAN, places=5)
def f14_slepian_coherence(spark, s):
    """Coherence with the reference over frames and four Slepian tapers, with its interval by leaving out a taper at a time."""
    return tf.multitaper_coherence(tf.multitaper(cl.frames(s, WIN, STEP), lines(spark), WIN, 1.0, 4, 2.5), REFERENCE)
