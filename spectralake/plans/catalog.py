"""Registered queries over the driver's tables read as recordings, and the SQL that says the same.

The recordings are hourly counts of ``events`` (a session for each 2,500 events, an event type a channel, 720 hours or more);
phases and amplitudes are line reads of two-day frames, a frame being a step of time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as cl
from ..operators import complexity as cx
from ..operators import coupling as cp
from ..operators import events as ev
from ..operators import graphs as gr
from ..operators import inference as inf
from ..operators import joins as jn
from ..operators import spectral as sp
from ..operators import states as st
from ..sources import recordings as src

FLAGSHIP = "f11_coherence"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
WIN, STEP, REFERENCE = 48, 24, "view"
# State windows in hours, lines in cycles per hour, bands, regions and a mode basis for the event types.
STATES = [("event", 0, 240.0, 288.0), ("event", 1, 480.0, 528.0), ("rebound", 2, 288.0, 336.0)]
LINES = [(1 / 24,), (1 / 12,)]
BANDS = [("slow", 0.02, 0.1), ("mid", 0.1, 0.25), ("fast", 0.25, 0.5)]
REGIONS = [("front", "view"), ("front", "click"), ("back", "purchase"), ("back", "signup"), ("back", "error")]
BASIS = [(0, "view", 0.5), (0, "click", 0.5), (1, "view", 0.7), (1, "purchase", -0.7), (2, "error", 1.0)]

SAMPLES = """ns AS (SELECT greatest(4, count(*) // 2500) AS k FROM events), c AS (SELECT coalesce((user_id % (SELECT k FROM ns))::VARCHAR, 'none') AS session_id, event_type AS channel, floor((floor(epoch(ts)) - 1704067200) / 3600)::BIGINT AS idx, count(*)::DOUBLE AS x FROM events WHERE ts IS NOT NULL GROUP BY ALL),
 grid_hours AS (SELECT unnest(range(least(0, min(idx)), greatest(719, max(idx)) + 1)) AS idx FROM c), grid_sessions AS (SELECT unnest(range(k))::VARCHAR AS session_id FROM ns UNION SELECT session_id FROM c WHERE session_id = 'none'),
 samples AS (SELECT g.session_id, g.channel, g.idx, g.idx::DOUBLE AS t, coalesce(c.x, 0) AS x FROM (SELECT session_id, channel, idx FROM grid_sessions, (SELECT DISTINCT event_type AS channel FROM events), grid_hours) g LEFT JOIN c USING (session_id, channel, idx)),
 windows(state, window_id, t0, t1) AS (VALUES ('event', 0, 240.0, 288.0), ('event', 1, 480.0, 528.0), ('rebound', 2, 288.0, 336.0)),
 lines AS (SELECT unnest([1.0::DOUBLE / 24, 1.0::DOUBLE / 12]) AS f0), bands(band, f_lo, f_hi) AS (VALUES ('slow', 0.02, 0.1), ('mid', 0.1, 0.25), ('fast', 0.25, 0.5)),
 regions(roi, channel) AS (VALUES ('front', 'view'), ('front', 'click'), ('back', 'purchase'), ('back', 'signup'), ('back', 'error')),
 basis(mode, channel, w) AS (VALUES (0, 'view', 0.5), (0, 'click', 0.5), (1, 'view', 0.7), (1, 'purchase', -0.7), (2, 'error', 1.0)),
 fr AS (SELECT s.*, frame, s.idx - frame * 24 AS j FROM samples s JOIN range(30) f(frame) ON s.idx >= frame * 24 AND s.idx < frame * 24 + 48)"""


def _reads(lines: str) -> str:
    return f"""SELECT session_id, channel, frame, f0, sum(x * c) - avg(x) * sum(c) AS re, avg(x) * sum(s) - sum(x * s) AS im FROM
 (SELECT fr.*, f0, (0.5 - 0.5 * cos(2 * pi() * j / 48)) * cos(2 * pi() * round(f0 * 48) * j / 48) AS c, (0.5 - 0.5 * cos(2 * pi() * j / 48)) * sin(2 * pi() * round(f0 * 48) * j / 48) AS s FROM fr, {lines})
 GROUP BY ALL HAVING count(*) = 48"""


READS = f"""{SAMPLES}, rd AS ({_reads('lines')}),
 ph AS (SELECT session_id, channel, frame AS idx, atan2(im, re) AS phase, sqrt(re * re + im * im) AS amp FROM rd WHERE f0 < 0.05),
 pr AS (SELECT a.session_id, a.channel AS ch_i, b.channel AS ch_j, a.idx, a.phase AS p1, b.phase AS p2 FROM ph a JOIN ph b ON a.session_id = b.session_id AND a.idx = b.idx AND a.channel < b.channel),
 edges AS (SELECT session_id, ch_i, ch_j, sqrt(avg(cos(p1 - p2)) ** 2 + avg(sin(p1 - p2)) ** 2) AS w FROM pr GROUP BY ALL)"""
SPECTRA = f"""{SAMPLES}, rs AS ({_reads('(SELECT k / 48.0 AS f0 FROM range(25) q(k))')}),
 spectra AS (SELECT session_id, channel, f0 AS f, avg((re * re + im * im) / (48 * 0.375) * CASE WHEN f0 IN (0, 0.5) THEN 1 ELSE 2 END) AS p FROM rs GROUP BY ALL)"""


def query(sql: str | None = None, base: str = SAMPLES, places: int = 6, source=src.hourly_events):
    """Registers a query of (spark, samples) with its SQL; doubles are rounded here, and in the SQL as r{...}."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, source(spark, sf_dir))
            # Adding 0 makes a negative zero a plain one.
            return out.select(*[(F.round(F.col(c), places) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {base} {_rounded(sql, places)}"
        return f

    return add


def _rounded(sql: str, places: int) -> str:
    """r{...} stands for the rounded value of an expression."""
    return re.sub(r"r\{(.*?)\}", rf"(round((\1)::DOUBLE, {places}) + 0.0::DOUBLE)", sql)


def windows(spark):
    return spark.createDataFrame(STATES, "state string, window_id int, t0 double, t1 double")


def lines(spark):
    return spark.createDataFrame(LINES, "f0 double")


def bands(spark):
    return spark.createDataFrame(BANDS, "band string, f_lo double, f_hi double")


def reads(spark, s):
    return sp.lock_in(cl.frames(s, WIN, STEP), lines(spark), WIN, 1.0)


def phases(spark, s):
    return reads(spark, s).where("f0 < 0.05").select("session_id", "channel", F.col("frame").alias("idx"), F.atan2("im", "re").alias("phase"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amp"))


def spectra(s):
    return sp.welch(s, WIN, 1.0)


def edges(spark, s):
    return cp.phase_edges(phases(spark, s)).select("session_id", "ch_i", "ch_j", F.col("plv").alias("w"))


@query("SELECT session_id, channel, idx, t, x FROM samples")
def s3_samples(spark, s):
    return s


@query("SELECT DISTINCT session_id, 1.0::DOUBLE AS fs FROM samples")
def s5_sampling_rate(spark, s):
    return src.sampling_rate(s)


@query("""SELECT session_id, channel, idx, r{CASE WHEN idx % 5 <> 0 THEN x WHEN idx = 0 THEN nx WHEN idx % 5 = 0 AND nx IS NULL THEN px ELSE (px + nx) / 2 END} AS x FROM
 (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM samples WINDOW w AS (PARTITION BY session_id, channel ORDER BY idx))""")
def p2_fill_gaps(spark, s):
    return cl.fill_gaps(s.withColumn("x", F.when(F.col("idx") % 5 != 0, F.col("x")))).select("session_id", "channel", "idx", "x")


@query("""SELECT session_id, channel, idx, r{x - regr_slope(x, t) OVER w * t - regr_intercept(x, t) OVER w} AS x FROM samples WINDOW w AS (PARTITION BY session_id, channel)""")
def p3_detrend(spark, s):
    return cl.detrend(s).select("session_id", "channel", "idx", "x")


@query("""SELECT session_id, channel, idx, r{(x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12)} AS z FROM samples WINDOW w AS (PARTITION BY session_id, channel)""")
def p4_z_score(spark, s):
    return cl.z_score(s).select("session_id", "channel", "idx", "z")


@query(""", m AS (SELECT session_id, channel, quantile_cont(x, 0.5) AS m FROM samples GROUP BY ALL), d AS (SELECT session_id, channel, any_value(m) AS m, quantile_cont(abs(x - m), 0.5) AS d FROM samples JOIN m USING (session_id, channel) GROUP BY ALL)
 SELECT session_id, channel, idx, r{(x - m) / (1.4826 * d + 1e-12)} AS z FROM samples JOIN d USING (session_id, channel)""")
def p5_robust_z(spark, s):
    return cl.robust_z(s).select("session_id", "channel", "idx", "z")


@query("SELECT session_id, channel, idx, (x < avg(x) OVER (PARTITION BY session_id, channel))::INT AS bin FROM samples")
def p7_below_mean_bin(spark, s):
    return cl.below_mean_bin(s).select("session_id", "channel", "idx", "bin")


@query("SELECT session_id, channel, idx, r{avg(x) OVER (PARTITION BY session_id, channel ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)} AS x FROM samples")
def p8_moving_average(spark, s):
    return cl.moving_average(s, 3).select("session_id", "channel", "idx", "x")


@query("SELECT session_id, channel, frame, count(*) AS n, r{avg(x)} AS mean FROM fr GROUP BY ALL")
def p10_frames(spark, s):
    return cl.frames(s, WIN, STEP).groupBy("session_id", "channel", "frame").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


@query("SELECT session_id, channel, idx // 7 AS idx, r{avg(x)} AS x FROM samples GROUP BY ALL HAVING count(*) = 7")
def p11_coarse_grain(spark, s):
    return cl.coarse_grain(s, 7)


@query("SELECT session_id, channel, idx, r{x - avg(x) OVER (PARTITION BY session_id, idx)} AS x FROM samples")
def p12_average_reference(spark, s):
    return cl.average_reference(s).select("session_id", "channel", "idx", "x")


@query("SELECT session_id, roi, idx, r{avg(x)} AS x FROM samples JOIN regions USING (channel) GROUP BY ALL")
def p13_region_mean(spark, s):
    return cl.region_mean(s, spark.createDataFrame(REGIONS, "roi string, channel string"))


@query("""SELECT session_id, mode, r{avg(a * a)} AS power FROM (SELECT session_id, mode, idx, sum(w * x) AS a FROM samples JOIN basis USING (channel) GROUP BY ALL) GROUP BY ALL""")
def p15_mode_power(spark, s):
    return cl.mode_power(cl.project(s, spark.createDataFrame(BASIS, "mode int, channel string, w double")))


@query("SELECT session_id, channel, state, window_id, count(*) AS n, r{avg(x)} AS mean FROM samples JOIN windows ON t >= t0 AND t < t1 GROUP BY ALL")
def j1_in_windows(spark, s):
    return jn.in_windows(s, windows(spark), 1.0).groupBy("session_id", "channel", "state", "window_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


@query("SELECT session_id, channel, count(*) AS n, r{avg(x)} AS mean FROM samples WHERE NOT EXISTS (SELECT 1 FROM windows WHERE t >= t0 AND t < t1) GROUP BY ALL")
def j2_baseline(spark, s):
    return jn.outside_windows(s, windows(spark)).groupBy("session_id", "channel").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


@query("""SELECT session_id, idx, CASE WHEN idx >= 240 AND idx < 288 OR idx >= 480 AND idx < 528 THEN 'event' WHEN idx >= 288 AND idx < 336 THEN 'rebound' ELSE 'other' END AS state FROM samples WHERE channel = 'view'""")
def j3_label_state(spark, s):
    return jn.label_state(s.where("channel = 'view'").select("session_id", "idx", "t"), windows(spark), ["event", "rebound"]).select("session_id", "idx", "state")


@query("""SELECT a.session_id, a.channel, a.idx + 0.25::DOUBLE AS t, r{a.x + (b.x - a.x) * 0.25} AS v FROM samples a JOIN samples b ON a.session_id = b.session_id AND a.channel = b.channel AND b.idx = a.idx + 1""")
def j4_align(spark, s):
    times = s.where("idx < 719").select("session_id", "channel", (F.col("t") + 0.25).alias("t"))
    return jn.align(s.select("session_id", "channel", "t", F.col("x").alias("v")), times, ["session_id", "channel"])


@query("SELECT session_id, channel, r{f0} AS f0, r{round(f0 * 48) / 48} AS f, r{p} AS p FROM spectra JOIN lines ON abs(f - round(f0 * 48) / 48) < 1e-9", SPECTRA)
def j5_nearest_bin(spark, s):
    return jn.nearest_bin(spectra(s), lines(spark), ["session_id", "channel"])


@query("""SELECT session_id, channel, event_id, tau, r{x} AS x FROM (SELECT s.session_id, s.channel, o.event_id, s.idx - o.onset AS tau, x FROM samples s JOIN (VALUES (1, 100), (2, 300), (3, 715)) o(event_id, onset) ON s.idx BETWEEN o.onset - 6 AND o.onset + 12)""")
def j6_epochs(spark, s):
    return jn.epochs(s, _onsets(s), 6, 12).select("session_id", "channel", "event_id", "tau", "x")


def _onsets(s, onsets=((1, 100), (2, 300), (3, 715))):
    """The same onsets (event_id, onset) in every session."""
    return s.select("session_id").distinct().crossJoin(s.sparkSession.createDataFrame(onsets, "event_id int, onset long"))


# Covariances of counts over 720 hours are multiples of 1 / 518,400: to eight places none of them is a tie.
@query("SELECT a.session_id, a.channel AS ch_i, b.channel AS ch_j, r{covar_pop(a.x, b.x)} AS cov, r{corr(a.x, b.x)} AS r FROM samples a JOIN samples b ON a.session_id = b.session_id AND a.idx = b.idx AND a.channel < b.channel GROUP BY ALL", places=8)
def j7_channel_gram(spark, s):
    return jn.gram(s)


@query("SELECT session_id, channel, r{f} AS f, r{p} AS p FROM spectra", SPECTRA)
def f1_welch(spark, s):
    return spectra(s)


@query("""SELECT session_id, channel, band, r{power} AS power, r{power / sum(power) OVER (PARTITION BY session_id, channel)} AS share FROM
 (SELECT session_id, channel, band, sum((f1 - f) * (p + p1) / 2) AS power FROM (SELECT *, lead(f) OVER w AS f1, lead(p) OVER w AS p1 FROM spectra WINDOW w AS (PARTITION BY session_id, channel ORDER BY f)) JOIN bands ON f >= f_lo AND f1 <= f_hi GROUP BY ALL)""", SPECTRA)
def f2_band_power(spark, s):
    return sp.band_power(spectra(s), bands(spark), ["session_id", "channel"])


@query("SELECT session_id, channel, r{arg_max(f, p)} AS peak_f, r{sum(f * p) / sum(p)} AS centroid FROM spectra WHERE f BETWEEN 0.02 AND 0.5 GROUP BY ALL", SPECTRA)
def f4_peak_and_centroid(spark, s):
    return sp.peak_and_centroid(spectra(s), ["session_id", "channel"], 0.02, 0.5)


@query("SELECT session_id, channel, r{regr_slope(ln(p), ln(f))} AS slope FROM spectra WHERE f BETWEEN 0.02 AND 0.45 GROUP BY ALL", SPECTRA)
def f5_aperiodic_slope(spark, s):
    return sp.aperiodic_slope(spectra(s), ["session_id", "channel"], 0.02, 0.45)


@query(""", near AS (SELECT *, abs(f - f0) <= 0.011 AS inside FROM spectra JOIN lines ON abs(f - f0) <= 0.15), m AS (SELECT session_id, channel, f0, quantile_cont(p, 0.5) AS m FROM near WHERE NOT inside GROUP BY ALL),
 d AS (SELECT session_id, channel, f0, any_value(m) AS m, quantile_cont(abs(p - m), 0.5) AS d FROM near JOIN m USING (session_id, channel, f0) WHERE NOT inside GROUP BY ALL)
 SELECT session_id, channel, r{f0} AS f0, r{(avg(p) - any_value(m)) / (1.4826 * any_value(d) + 1e-12)} AS z FROM near JOIN d USING (session_id, channel, f0) WHERE inside GROUP BY session_id, channel, f0""", SPECTRA, 5)
def f6_line_z(spark, s):
    return sp.line_z(spectra(s), lines(spark), ["session_id", "channel"], 0.011, 0.15)


@query("SELECT session_id, channel, r{f0} AS f0, r{avg(p) FILTER (abs(f - f0) <= 0.011) / avg(p) FILTER (abs(f - f0) > 0.011)} AS snr FROM spectra JOIN lines ON abs(f - f0) <= 0.15 GROUP BY session_id, channel, f0", SPECTRA)
def f8_line_snr(spark, s):
    return sp.line_snr(spectra(s), lines(spark), ["session_id", "channel"], 0.011, 0.15)


@query(""", n AS (SELECT *, ln(lag(p) OVER w) AS l, ln(lead(p) OVER w) AS g FROM spectra WINDOW w AS (PARTITION BY session_id, channel ORDER BY f)),
 b AS (SELECT session_id, channel, f0, arg_max(f, p) AS f, max(p) AS p, arg_max(l, p) AS l, arg_max(g, p) AS g FROM n JOIN lines ON abs(f - f0) <= 0.03 GROUP BY ALL)
 SELECT session_id, channel, r{f0} AS f0, r{f + CASE WHEN abs(l - 2 * ln(p) + g) > 1e-9 THEN 0.5 * (l - g) / (l - 2 * ln(p) + g) / 48 ELSE 0 END} AS f FROM b""", SPECTRA)
def f9_refine_lines(spark, s):
    return sp.refine_lines(spectra(s), lines(spark), ["session_id", "channel"], 0.03)


@query("SELECT session_id, channel, frame, r{f0} AS f0, r{re} AS re, r{im} AS im FROM rd", READS)
def f10_lock_in(spark, s):
    return reads(spark, s)


@query("""SELECT a.session_id, a.channel, r{a.f0} AS f0, r{(avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / (avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2))} AS msc, count(*) AS frames
 FROM rd a JOIN rd b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY a.session_id, a.channel, a.f0""", READS)
def f11_coherence(spark, s):
    return sp.coherence(reads(spark, s), REFERENCE)


@query(""", b AS (SELECT rep, session_id, (frame + rep * 7 + 1) % 29 AS frame, f0, re, im FROM rd, range(1, 20) q(rep) WHERE channel = 'view'),
 z AS (SELECT a.session_id, a.channel, a.f0, rep, (avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / (avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2)) AS v
   FROM rd a JOIN b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 WHERE a.channel <> 'view' GROUP BY ALL)
 SELECT session_id, channel, r{f0} AS f0, r{quantile_cont(v, 0.95)} AS null95, count(*) AS reps FROM z GROUP BY session_id, channel, f0""", READS)
def f11_coherence_null(spark, s):
    return sp.shifted_coherence(reads(spark, s), REFERENCE, 19).groupBy("session_id", "channel", "f0").agg(F.percentile("msc", 0.95).alias("null95"), F.count("*").alias("reps"))


@query("""SELECT session_id, ch_i, ch_j, r{sqrt(avg(cos(p1 - p2)) ** 2 + avg(sin(p1 - p2)) ** 2)} AS plv, r{atan2(avg(sin(p1 - p2)), avg(cos(p1 - p2)))} AS mean_phase, r{abs(avg(sign(round(sin(p1 - p2), 9))))} AS pli, r{avg((round(sin(p1 - p2), 9) > 0)::INT)} AS dpli FROM pr GROUP BY ALL""", READS)
def c2_phase_edges(spark, s):
    return cp.phase_edges(phases(spark, s))


@query(""", e AS (SELECT a.session_id, a.channel AS ch_i, b.channel AS ch_j, a.f0, a.im * b.re - a.re * b.im AS y, a.re ** 2 + a.im ** 2 AS pa, b.re ** 2 + b.im ** 2 AS pb FROM rd a JOIN rd b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 AND a.channel < b.channel)
 SELECT session_id, ch_i, ch_j, r{f0} AS f0, r{avg(y) / sqrt(avg(pa) * avg(pb))} AS imag_coherency, r{abs(avg(y)) / avg(abs(y))} AS wpli FROM e GROUP BY session_id, ch_i, ch_j, f0""", READS)
def c6_cross_spectra(spark, s):
    return cp.cross_spectra(reads(spark, s))


@query("""SELECT a.session_id, a.channel, n::INT AS n, m::INT AS m, r{sqrt(avg(cos(n * a.phase - m * b.phase)) ** 2 + avg(sin(n * a.phase - m * b.phase)) ** 2)} AS plv FROM ph a JOIN ph b ON a.session_id = b.session_id AND a.idx = b.idx, (VALUES (1, 1), (1, 2), (2, 1)) g(n, m)
 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY a.session_id, a.channel, n, m""", READS)
def c9_locking_n_m(spark, s):
    return cp.locking_n_m(phases(spark, s), REFERENCE, [(1, 1), (1, 2), (2, 1)])


@query("SELECT session_id, idx, r{sqrt(avg(cos(phase)) ** 2 + avg(sin(phase)) ** 2)} AS r FROM ph GROUP BY ALL", READS)
def c12_synchrony(spark, s):
    return cp.synchrony(phases(spark, s))


@query(", q AS (SELECT session_id, idx, sqrt(avg(cos(phase)) ** 2 + avg(sin(phase)) ** 2) AS r FROM ph GROUP BY ALL) SELECT session_id, r{var_pop(r)} AS metastability, r{avg(r)} AS mean_r FROM q GROUP BY ALL", READS)
def c13_metastability(spark, s):
    return cp.metastability(cp.synchrony(phases(spark, s)))


@query(""", b AS (SELECT session_id, channel, least(floor((phase + pi()) / (2 * pi()) * 18), 17) AS b, avg(amp) AS a FROM ph GROUP BY ALL), q AS (SELECT session_id, channel, a / sum(a) OVER (PARTITION BY session_id, channel) AS p FROM b)
 SELECT session_id, channel, r{(ln(18) + sum(p * ln(p))) / ln(18)} AS mi FROM q GROUP BY ALL""", READS)
def c14_modulation_index(spark, s):
    return cp.modulation_index(phases(spark, s), ["session_id", "channel"])


@query("SELECT session_id, channel, r{sqrt(avg(amp * cos(phase)) ** 2 + avg(amp * sin(phase)) ** 2) / avg(amp)} AS mvl FROM ph GROUP BY ALL", READS)
def c15_vector_length(spark, s):
    return cp.vector_length(phases(spark, s), ["session_id", "channel"])


@query("""SELECT a.session_id, a.channel, l::INT AS lag, r{corr(a.x, b.x)} AS r FROM samples a, range(-6, 7) q(l), samples b WHERE b.session_id = a.session_id AND b.idx = a.idx - l AND b.channel = 'view' AND a.channel <> 'view' GROUP BY a.session_id, a.channel, l""")
def c19_lag_correlation(spark, s):
    return cp.lag_correlation(s, REFERENCE, 6)


@query(""", d AS (SELECT session_id, channel, phase - lag(phase) OVER (PARTITION BY session_id, channel ORDER BY idx) AS d FROM ph) SELECT session_id, channel, r{sum(d - 2 * pi() * floor(d / (2 * pi()) + 0.5)) / (2 * pi())} AS turns FROM d GROUP BY ALL""", READS)
def c22_winding(spark, s):
    return cp.winding(phases(spark, s))


@query("SELECT session_id, idx, r{var_pop(x)} AS gfp FROM samples GROUP BY ALL")
def e1_field_power(spark, s):
    return ev.field_power(s)


_RUNS = "SELECT session_id, min(idx) AS start, max(idx) + 1 AS \"end\", count(*) AS n, r{max(x)} AS peak, arg_min(idx, -x * 100000 + idx) AS peak_idx FROM (SELECT *, idx - row_number() OVER (PARTITION BY session_id ORDER BY idx) AS g FROM q WHERE %s) GROUP BY session_id, g"


@query(", l AS (SELECT session_id, channel, avg(x) + 0.5 * stddev_samp(x) AS l FROM samples WHERE idx < 240 GROUP BY ALL), q AS (SELECT session_id, idx, (count(*) FILTER (x > l))::BIGINT AS x FROM samples JOIN l USING (session_id, channel) GROUP BY ALL) "
       + (_RUNS % "x >= 2").replace("r{max(x)}", "max(x)"))
def e2_spike_events(spark, s):
    return ev.spike_events(s, 0.5, 2, 1, F.col("idx") < 240)


@query(", q AS (SELECT session_id, idx, x FROM samples WHERE channel = 'view') " + _RUNS % "x >= 1" + " HAVING count(*) >= 2")
def e3_islands(spark, s):
    return ev.islands(s.where("channel = 'view'"), F.col("x") >= 1, ["session_id"], 2)


@query("""SELECT session_id, "end", start, merged FROM (SELECT session_id, min(a) AS start, max(b) AS "end", count(*) AS merged FROM (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY a) AS g FROM
 (SELECT session_id, a, b, CASE WHEN a > max(b) OVER (PARTITION BY session_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS n FROM (SELECT session_id, idx - 3 AS a, idx + 3 AS b FROM samples WHERE channel = 'error' AND x >= 1))) GROUP BY session_id, g)""")
def e5_merge_intervals(spark, s):
    spans = s.where("channel = 'error' and x >= 1").select("session_id", (F.col("idx") - 3).alias("start"), (F.col("idx") + 3).alias("end"))
    return ev.merge_intervals(spans, ["session_id"], 2)


@query(""", z AS (SELECT session_id, channel, idx, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12) AS z FROM samples WINDOW w AS (PARTITION BY session_id, channel)) SELECT session_id, idx, r{sum(greatest(z, 0))} AS activity, count(*) FILTER (z >= 1) AS overlap FROM z GROUP BY ALL""")
def e8_activity(spark, s):
    return ev.activity(cl.z_score(s), 1.0)


@query("""SELECT s.channel, s.idx - o.onset AS tau, r{avg(x)} AS mean, r{stddev_samp(x) / sqrt(count(x))} AS sem, count(x) AS n FROM samples s JOIN (VALUES (1, 100), (2, 300), (3, 715)) o(event_id, onset) ON s.idx BETWEEN o.onset - 6 AND o.onset + 12 GROUP BY ALL""")
def e14_event_average(spark, s):
    return ev.event_average(jn.epochs(s, _onsets(s), 6, 12), ["channel"])


@query(""", k AS (SELECT session_id, channel, idx, x, CASE WHEN x > l AND x >= r THEN 'p' WHEN x < l AND x <= r THEN 't' END AS k FROM (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM samples WINDOW w AS (PARTITION BY session_id, channel ORDER BY idx))),
 e AS (SELECT *, lead(idx) OVER w AS i1, lead(idx, 2) OVER w AS i2, lead(x) OVER w AS x1, lead(k) OVER w AS k1, lead(k, 2) OVER w AS k2 FROM k WHERE k IS NOT NULL WINDOW w AS (PARTITION BY session_id, channel ORDER BY idx))
 SELECT session_id, channel, idx, i2 - idx AS period, i1 - idx AS rise, i2 - i1 AS decay, r{x1 - x} AS height FROM e WHERE k = 't' AND k1 = 'p' AND k2 = 't'""")
def e17_cycles(spark, s):
    return ev.cycles(s)


@query(""", l AS (SELECT session_id, channel, quantile_cont(x, 0.9) AS l FROM samples GROUP BY ALL), a AS (SELECT session_id, channel, idx, x - l AS x, idx - row_number() OVER (PARTITION BY session_id, channel ORDER BY idx) AS g FROM samples JOIN l USING (session_id, channel) WHERE x > l)
 SELECT session_id, channel, min(idx) AS start, count(*) AS duration, r{sum(x)} AS size FROM a GROUP BY session_id, channel, g""")
def e18_avalanches(spark, s):
    return ev.avalanches(s, 0.9)


@query(""", y AS (SELECT session_id, channel, idx, sum(x - m) OVER (PARTITION BY session_id, channel ORDER BY idx) AS y FROM (SELECT *, avg(x) OVER (PARTITION BY session_id, channel) AS m FROM samples)),
 v AS (SELECT session_id, channel, s, idx // s AS g, (regr_syy(y, idx) - regr_sxy(y, idx) ** 2 / regr_sxx(y, idx)) / count(*) AS v FROM y, (VALUES (8), (16), (32), (64)) q(s) WHERE (idx // s + 1) * s <= 720 GROUP BY ALL),
 f AS (SELECT session_id, channel, s, sqrt(avg(v)) AS f FROM v GROUP BY ALL) SELECT session_id, channel, r{regr_slope(ln(f), ln(s))} AS alpha FROM f GROUP BY ALL""")
def x1_detrended_fluctuation(spark, s):
    return cx.detrended_fluctuation(s, [8, 16, 32, 64])


@query(""", p AS (SELECT session_id, channel, CASE WHEN a <= b AND b <= c THEN '012' WHEN a <= c AND c < b THEN '021' WHEN b < a AND a <= c THEN '102' WHEN b <= c AND c < a THEN '120' WHEN c < a AND a <= b THEN '201' ELSE '210' END AS p FROM
 (SELECT session_id, channel, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM samples WINDOW w AS (PARTITION BY session_id, channel ORDER BY idx)) WHERE c IS NOT NULL),
 q AS (SELECT session_id, channel, count(*) / sum(count(*)) OVER (PARTITION BY session_id, channel) AS q FROM p GROUP BY session_id, channel, p) SELECT session_id, channel, r{-sum(q * ln(q)) / ln(6)} AS entropy FROM q GROUP BY ALL""")
def x3_permutation_entropy(spark, s):
    return cx.permutation_entropy(s)


@query(", a AS (SELECT a.session_id, a.channel, l, corr(a.x, b.x) AS r FROM samples a, range(1, 13) q(l), samples b WHERE b.session_id = a.session_id AND b.channel = a.channel AND b.idx = a.idx - l GROUP BY ALL) SELECT session_id, channel, (min(l) FILTER (r <= exp(-1)))::INT AS tau FROM a GROUP BY ALL")
def x7_delay(spark, s):
    return cx.delay_of(cx.autocorrelation(s, 12))


@query("SELECT session_id, channel, idx, r{x} AS p0, r{b} AS p1, r{c} AS p2 FROM (SELECT *, lead(x, 2) OVER w AS b, lead(x, 4) OVER w AS c FROM samples WINDOW w AS (PARTITION BY session_id, channel ORDER BY idx)) WHERE c IS NOT NULL")
def x8_embedding(spark, s):
    return cx.embed(s, 3, 2).select("session_id", "channel", "idx", *[F.col("point")[k].alias(f"p{k}") for k in range(3)])


@query(""", m AS (SELECT session_id, channel, avg(x * x) AS power FROM samples GROUP BY ALL), q AS (SELECT session_id, power / sum(power) OVER w AS q, row_number() OVER (PARTITION BY session_id ORDER BY power DESC, channel) AS k, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY session_id))
 SELECT session_id, r{-sum(q * ln(q))} AS entropy, r{1 / sum(q * q)} AS participation, r{sum(q) FILTER (k <= ceil(n * 0.1))} AS top_share FROM q GROUP BY ALL""")
def x14_spectrum_breadth(spark, s):
    return cx.spectrum_breadth(s.groupBy("session_id", F.col("channel").alias("mode")).agg(F.avg(F.col("x") ** 2).alias("power")), ["session_id"])


@query(", g AS (SELECT session_id, idx, var_pop(x) AS gfp FROM samples GROUP BY ALL) SELECT session_id, idx, r{gfp} AS gfp FROM (SELECT *, max(round(gfp, 9)) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM g) WHERE round(gfp, 9) = m AND gfp > 1e-9")
def m1_field_peaks(spark, s):
    return st.field_peaks(ev.field_power(s).withColumn("gfp", F.round("gfp", 9)), 3)


def _labels(s):
    return s.groupBy("session_id", "idx").agg(F.min_by("channel", F.struct(-F.col("x"), F.col("channel"))).alias("label"))


_LABELS = ", lb AS (SELECT session_id, idx, first(channel ORDER BY x DESC, channel) AS label FROM samples GROUP BY ALL)"


@query(_LABELS + """, g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - row_number() OVER (PARTITION BY session_id, label ORDER BY idx) AS g FROM lb), u AS (SELECT session_id, label, count(*) AS n FROM g GROUP BY session_id, label, g)
 SELECT session_id, label, r{sum(n) / 720} AS coverage, count(*) AS runs, r{avg(n)} AS mean_length FROM u GROUP BY ALL""")
def m5_state_metrics(spark, s):
    return st.state_metrics(_labels(s))


@query(_LABELS + """, n AS (SELECT *, lead(label) OVER (PARTITION BY session_id ORDER BY idx) AS "to" FROM lb) SELECT session_id, label, "to", count(*) AS n, r{count(*) / sum(count(*)) OVER (PARTITION BY session_id, label)} AS p FROM n WHERE "to" IS NOT NULL AND "to" <> label GROUP BY session_id, label, "to\"""")
def m5_transitions(spark, s):
    return st.transitions(_labels(s))


@query("SELECT session_id, ch_i, ch_j, r{w} AS w FROM (SELECT *, rank() OVER (PARTITION BY session_id ORDER BY w DESC) AS k FROM edges) WHERE k <= 4", READS)
def g1_strongest(spark, s):
    return gr.strongest(edges(spark, s), ["session_id"], 0.4)


@query(""", b AS (SELECT session_id, ch_i AS node, w FROM edges UNION ALL SELECT session_id, ch_j, w FROM edges) SELECT session_id, node, r{sum(w)} AS strength, count(*) FILTER (w > 0) AS degree, row_number() OVER (PARTITION BY session_id ORDER BY round(sum(w), 9) DESC, node)::INT AS hub_rank FROM b GROUP BY session_id, node""", READS)
def g2_node_strength(spark, s):
    return gr.node_strength(edges(spark, s), ["session_id"])


@query(""", t AS (SELECT session_id, ch_i, ch_j, w / max(w) OVER (PARTITION BY session_id) AS w FROM edges), b AS (SELECT session_id, ch_i AS n, ch_j AS p, w FROM t UNION ALL SELECT session_id, ch_j, ch_i, w FROM t)
 SELECT x.session_id, x.n AS node, r{avg((x.w * y.w * z.w) ** (1.0 / 3))} AS clustering FROM b x JOIN b y ON x.session_id = y.session_id AND x.n = y.n AND x.p < y.p JOIN b z ON z.session_id = x.session_id AND z.n = x.p AND z.p = y.p GROUP BY x.session_id, x.n""", READS)
def g3_weighted_clustering(spark, s):
    return gr.weighted_clustering(edges(spark, s), ["session_id"])


@query(""", b AS (SELECT session_id, ch_i AS node, ch_j AS peer, w FROM edges UNION ALL SELECT session_id, ch_j, ch_i, w FROM edges), k AS (SELECT session_id, node, roi, sum(w) AS k FROM b JOIN regions ON peer = channel GROUP BY ALL)
 SELECT session_id, node, r{1 - sum(k * k) / sum(k) ** 2} AS participation FROM k GROUP BY ALL""", READS)
def g5_participation(spark, s):
    return gr.participation(edges(spark, s), spark.createDataFrame(REGIONS, "roi string, channel string"), ["session_id"])


@query()
def g7_min_cut_and_entropy(spark, s):
    return gr.matrix_measures(edges(spark, s), ["session_id"])


@query()
def c1_band_phase(spark, s):
    found = sp.band_phase(sp.blocks_of(s, 240, 96, 1.0), spark.createDataFrame([("daily", 0.03, 0.06)], "band string, f_lo double, f_hi double"))
    return found.select("session_id", "channel", "band", "idx", "amp", "phase")


@query("SELECT session_id, channel, rep::INT AS rep, (idx + rep * 37) % 720 AS idx, x FROM samples, range(1, 4) q(rep)")
def i1_circular_shift(spark, s):
    return inf.circular_shift(s, 3, 37).select("session_id", "channel", "rep", "idx", "x")


@query(""", o AS (SELECT a.session_id, a.channel, round(corr(a.x, b.x), 9) AS r FROM samples a JOIN samples b ON a.session_id = b.session_id AND a.idx = b.idx WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL),
 n AS (SELECT a.session_id, a.channel, rep, round(corr(a.x, b.x), 9) AS v FROM samples a, range(1, 20) q(rep), samples b WHERE a.session_id = b.session_id AND (a.idx + rep * 37) % 720 = b.idx AND b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL)
 SELECT session_id, channel, r{any_value(r)} AS r, r{(count(*) FILTER (v >= r) + 1) / (count(*) + 1)} AS p, r{quantile_cont(v, 0.95)} AS null95, r{(any_value(r) - avg(v)) / (stddev_pop(v) + 1e-12)} AS z FROM o JOIN n USING (session_id, channel) GROUP BY ALL""")
def i9_metric_against_surrogates(spark, s):
    reference = s.where(F.col("channel") == REFERENCE).select("session_id", "idx", F.col("x").alias("_r"))
    metric = lambda rows, by: rows.join(reference, ["session_id", "idx"]).groupBy(*by).agg(F.corr("x", "_r").alias("r"))
    return inf.metric_against_surrogates(s.where(F.col("channel") != REFERENCE), metric, ["session_id", "channel"], "r", 19, 37)


@query(""", st AS (SELECT rep, b, (rep * 7919 + b * 104729) % 697 AS a FROM range(1, 21) q(rep), range(30) u(b)), m AS (SELECT session_id, channel, rep, avg(x) AS m FROM samples JOIN st ON idx >= a AND idx < a + 24 GROUP BY ALL)
 SELECT session_id, channel, r{quantile_cont(m, 0.025)} AS low, r{quantile_cont(m, 0.975)} AS high FROM m GROUP BY ALL""", places=9)
def i4_block_bootstrap(spark, s):
    return inf.block_bootstrap(s, ["session_id", "channel"], 24, 20)


# The surrogates above with as many replicates as the survey and the reference take.
@query(""", b AS (SELECT rep, session_id, (frame + rep) % 29 AS frame, f0, re, im FROM rd, range(1, 29) q(rep) WHERE channel = 'view'),
 z AS (SELECT a.session_id, a.channel, a.f0, rep, (avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / (avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2)) AS v
   FROM rd a JOIN b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 WHERE a.channel <> 'view' GROUP BY ALL)
 SELECT session_id, channel, r{f0} AS f0, r{quantile_cont(v, 0.95)} AS null95, count(*) AS reps FROM z GROUP BY session_id, channel, f0""", READS)
def f11_coherence_null_full(spark, s):
    return sp.every_shifted_coherence(reads(spark, s), REFERENCE, 200).groupBy("session_id", "channel", "f0").agg(F.percentile("msc", 0.95).alias("null95"), F.count("*").alias("reps"))


@query("SELECT session_id, channel, rep::INT AS rep, (idx + rep * 37) % 720 AS idx, x FROM samples, range(1, 101) q(rep)")
def i1_circular_shift_full(spark, s):
    return inf.circular_shift(s, 100, 37).select("session_id", "channel", "rep", "idx", "x")


@query("SELECT session_id, channel, rep::INT AS rep, row_number() OVER (PARTITION BY session_id, channel, rep ORDER BY md5(rep || ':' || session_id || ':' || channel || ':' || idx)) - 1 AS idx, x FROM samples, range(1, 101) q(rep)")
def i2_time_shuffle_full(spark, s):
    return inf.time_shuffle(s, 100).select("session_id", "channel", "rep", "idx", "x")


@query(""", o AS (SELECT a.session_id, a.channel, round(corr(a.x, b.x), 9) AS r FROM samples a JOIN samples b ON a.session_id = b.session_id AND a.idx = b.idx WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL),
 n AS (SELECT a.session_id, a.channel, rep, round(corr(a.x, b.x), 9) AS v FROM samples a, range(1, 101) q(rep), samples b WHERE a.session_id = b.session_id AND (a.idx + rep * 37) % 720 = b.idx AND b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL)
 SELECT session_id, channel, r{any_value(r)} AS r, r{(count(*) FILTER (v >= r) + 1) / (count(*) + 1)} AS p, r{quantile_cont(v, 0.95)} AS null95, r{(any_value(r) - avg(v)) / (stddev_pop(v) + 1e-12)} AS z FROM o JOIN n USING (session_id, channel) GROUP BY ALL""")
def i9_metric_against_surrogates_full(spark, s):
    reference = s.where(F.col("channel") == REFERENCE).select("session_id", "idx", F.col("x").alias("_r"))
    return inf.correlation_against_shifts(s.where(F.col("channel") != REFERENCE), reference, 100, 37)


@query(""", st AS (SELECT rep, b, ('0x' || substr(md5(rep || ':' || b), 1, 12))::BIGINT % 720 AS a FROM range(1, 1001) q(rep), range(20) u(b)),
 e AS (SELECT session_id, channel, idx, x FROM samples UNION ALL SELECT session_id, channel, idx + 720, x FROM samples),
 w AS (SELECT session_id, channel, a, avg(x) AS v FROM e JOIN (SELECT DISTINCT a FROM st) ON idx >= a AND idx < a + 36 GROUP BY ALL), m AS (SELECT session_id, channel, rep, avg(v) AS m FROM w JOIN st USING (a) GROUP BY ALL)
 SELECT session_id, channel, r{quantile_cont(m, 0.025)} AS low, r{quantile_cont(m, 0.975)} AS high FROM m GROUP BY ALL""", places=9)
def i4_block_bootstrap_full(spark, s):
    return inf.circular_block_bootstrap(s, ["session_id", "channel"], 36, 1000)


@query("SELECT session_id, channel, count(x) AS n, r{avg(x)} AS mean, r{stddev_samp(x)} AS sd, r{stddev_samp(x) / sqrt(count(x))} AS sem, r{quantile_cont(x, 0.5)} AS median, r{quantile_cont(x, 0.25)} AS q1, r{quantile_cont(x, 0.75)} AS q3 FROM samples GROUP BY ALL")
def t1_summary(spark, s):
    return inf.summary(s, ["session_id", "channel"], "x")


@query("SELECT session_id, channel, x, count(*) AS n, r{count(*) / sum(count(*)) OVER (PARTITION BY session_id, channel)} AS share FROM samples GROUP BY session_id, channel, x")
def t1_value_shares(spark, s):
    return inf.value_shares(s, ["session_id", "channel"], "x")


@query("SELECT session_id, channel, idx, t, x, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, channel ORDER BY x DESC, idx)::INT AS rank FROM samples) WHERE rank <= 3")
def t3_top_rows(spark, s):
    return inf.top_rows(s, ["session_id", "channel"], "x", ["idx"], 3)


@query(""", v AS (SELECT session_id, channel, avg(x) FILTER (t >= 240 AND t < 288 OR t >= 480 AND t < 528) AS e, avg(x) FILTER (NOT (t >= 240 AND t < 336 OR t >= 480 AND t < 528)) AS b FROM samples GROUP BY ALL) SELECT session_id, channel, r{e} AS in_state, r{b} AS in_base, r{e - b} AS delta FROM v""")
def t4_state_contrast(spark, s):
    labelled = jn.label_state(s, windows(spark), ["event", "rebound"], "baseline")
    return inf.state_contrast(labelled.groupBy("session_id", "channel", "state").agg(F.avg("x").alias("value")), ["session_id", "channel"])


@query("SELECT a.session_id, a.channel, round(a.f::DOUBLE, 2) AS f, r{avg(a.p)} AS p_a, r{avg(a.p) * 2} AS p_b FROM spectra a GROUP BY ALL", SPECTRA)
def t5_aligned_tables(spark, s):
    p = spectra(s)
    return inf.aligned_tables(p, p.withColumn("p", F.col("p") * 2), ["session_id", "channel"])


@query("SELECT session_id, channel, idx, CASE WHEN idx % 5 = 0 THEN 0 ELSE x END AS x FROM samples")
def p1_numeric(spark, s):
    return cl.numeric(s.withColumn("x", F.when(F.col("idx") % 5 == 0, "none").otherwise(F.col("x").cast("string")))).select("session_id", "channel", "idx", "x")


_SHARES = """, bp AS (SELECT session_id, channel, band, power / sum(power) OVER (PARTITION BY session_id, channel) AS share FROM
 (SELECT session_id, channel, band, sum((f1 - f) * (p + p1) / 2) AS power FROM (SELECT *, lead(f) OVER w AS f1, lead(p) OVER w AS p1 FROM spectra WINDOW w AS (PARTITION BY session_id, channel ORDER BY f)) JOIN bands ON f >= f_lo AND f1 <= f_hi GROUP BY ALL))"""


def _share_table(spark, s):
    return sp.relative_power_table(sp.band_power(spectra(s), bands(spark), ["session_id", "channel"]), [b[0] for b in BANDS])


@query(_SHARES + " SELECT channel, r{avg(share) FILTER (band = 'slow')} AS slow, r{avg(share) FILTER (band = 'mid')} AS mid, r{avg(share) FILTER (band = 'fast')} AS fast FROM bp GROUP BY ALL", SPECTRA)
def f3_relative_power_table(spark, s):
    return _share_table(spark, s)


@query(_SHARES + " SELECT channel AS electrode, 'ALL' AS condition, 'rel' AS kind, band, r{avg(share)} AS value FROM bp GROUP BY channel, band", SPECTRA)
def p16_band_table_to_long(spark, s):
    return cl.band_table_to_long(_share_table(spark, s).withColumnsRenamed({"channel": "electrode"} | {b[0]: f"rel_{b[0]}" for b in BANDS}))


@query(""", w AS (SELECT session_id, channel, avg(p) FILTER (abs(f - f0) <= 0.011) / avg(p) FILTER (abs(f - f0) > 0.011) AS w FROM spectra JOIN lines ON abs(f - f0) <= 0.15 WHERE f0 < 0.05 GROUP BY session_id, channel)
 SELECT session_id, idx, r{sum(w * x) / sum(w)} AS x FROM samples JOIN w USING (session_id, channel) GROUP BY ALL""", SPECTRA)
def p17_virtual_channel(spark, s):
    weights = sp.line_snr(spectra(s), lines(spark).where("f0 < 0.05"), ["session_id", "channel"], 0.011, 0.15)
    return cl.virtual_channel(s, weights.select("session_id", "channel", F.col("snr").alias("w")))


_SLIDING = """, sl AS (SELECT a.session_id, a.channel, k AS "at", a.f0, (avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / (avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2)) AS msc, count(*) AS frames
 FROM range(3, 26) q(k) JOIN rd a ON a.frame BETWEEN k - 3 AND k + 3 JOIN rd b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY a.session_id, a.channel, k, a.f0)"""


@query(_SLIDING + ' SELECT session_id, channel, "at", r{f0} AS f0, r{msc} AS msc, frames FROM sl', READS)
def f12_sliding_coherence(spark, s):
    return sp.sliding_coherence(reads(spark, s), REFERENCE, 3)


@query(_SLIDING + " SELECT session_id, r{f0} AS f0, r{quantile_cont(msc, 0.5)} AS median, r{max(msc)} AS largest, r{avg((msc > 0.3)::INT)} AS coverage FROM sl GROUP BY session_id, f0", READS)
def f13_trace_summary(spark, s):
    return sp.trace_summary(sp.sliding_coherence(reads(spark, s), REFERENCE, 3), ["session_id", "f0"], "msc", 0.3)


@query(" SELECT session_id, channel, frame, r{first(f0 ORDER BY round(re * re + im * im, 6) DESC, f0)} AS f, r{max(re * re + im * im)} AS p FROM rs WHERE f0 BETWEEN 0.02 AND 0.25 GROUP BY ALL", SPECTRA, 5)
def f16_ridge(spark, s):
    return sp.ridge(sp.frame_spectra(s, WIN, STEP, 1.0, 0.02, 0.25))


@query(" SELECT session_id, channel, frame, r{sum(re * re + im * im) FILTER (f0 >= 0.02 AND f0 < 0.1)} AS slow, r{sum(re * re + im * im) FILTER (f0 >= 0.1 AND f0 < 0.25)} AS mid, r{sum(re * re + im * im) FILTER (f0 >= 0.25 AND f0 < 0.5)} AS fast FROM rs GROUP BY ALL", SPECTRA, 5)
def m7_band_features(spark, s):
    return sp.band_features(sp.frame_spectra(s, WIN, STEP, 1.0, 0.0, 0.5), bands(spark), [b[0] for b in BANDS])


@query(" SELECT session_id, channel, r{(avg(p) FILTER (abs(f - 4 / 48.0) < 0.005) + avg(p) FILTER (abs(f - 6 / 48.0) < 0.005) + avg(p) FILTER (abs(f - 8 / 48.0) < 0.005)) / avg(p) FILTER (abs(f - 2 / 48.0) < 0.005)} AS stack_index FROM spectra GROUP BY ALL", SPECTRA, 5)
def e11_overtone_index(spark, s):
    return sp.overtone_index(spectra(s), ["session_id", "channel"], 1 / 24, 0.005, 4)


_REGION = """, rg AS (SELECT session_id, roi AS channel, frame, f0, avg(re) AS re, avg(im) AS im FROM rd JOIN regions USING (channel) GROUP BY ALL)"""


@query(_REGION + """ SELECT a.session_id, a.channel, r{a.f0} AS f0, r{(avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / (avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2))} AS msc, count(*) AS frames
 FROM rg a JOIN rd b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 WHERE b.channel = 'view' GROUP BY a.session_id, a.channel, a.f0""", READS)
def c4_region_coherence(spark, s):
    regions = cl.region_mean(s, spark.createDataFrame(REGIONS, "roi string, channel string")).withColumnRenamed("roi", "channel")
    both = regions.unionByName(s.where(F.col("channel") == REFERENCE).select(*regions.columns))
    return sp.coherence(reads(spark, both), REFERENCE)


@query(""", l AS (SELECT DISTINCT session_id, channel, idx, phase FROM ph) SELECT a.session_id, a.channel, k AS "at", r{sqrt(avg(cos(a.phase - b.phase)) ** 2 + avg(sin(a.phase - b.phase)) ** 2)} AS plv
 FROM range(3, 26) q(k) JOIN l a ON a.idx BETWEEN k - 3 AND k + 3 JOIN l b ON a.session_id = b.session_id AND a.idx = b.idx WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL""", READS)
def c10_sliding_locking(spark, s):
    return cp.sliding_locking(phases(spark, s), REFERENCE, 3)


_MSC = """, ms AS (SELECT a.session_id, a.channel, a.f0, (avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / (avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2)) AS msc
 FROM rd a JOIN rd b ON a.session_id = b.session_id AND a.frame = b.frame AND a.f0 = b.f0 WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY a.session_id, a.channel, a.f0)"""


@query(_MSC + " SELECT session_id, channel, r{sum(msc / round(f0 * 24)) / sum(1 / round(f0 * 24))} AS score FROM ms GROUP BY ALL", READS)
def c11_weighted_score(spark, s):
    found = sp.coherence(reads(spark, s), REFERENCE)
    return cp.weighted_score(found.select("session_id", "channel", F.col("msc").alias("v"), F.round(F.col("f0") * 24).alias("k")), ["session_id", "channel"])


@query(" SELECT a.session_id, a.channel, r{avg((round(sin(a.phase - b.phase), 9) > 0)::INT)} AS lead FROM ph a JOIN ph b ON a.session_id = b.session_id AND a.idx = b.idx WHERE b.channel = 'view' AND a.channel <> 'view' GROUP BY ALL", READS)
def c20_phase_lead(spark, s):
    return cp.phase_lead(phases(spark, s), REFERENCE)


@query(""", k AS (SELECT session_id, channel, frame, f0, atan2(im, re) AS phase, sqrt(re * re + im * im) AS amp FROM rs WHERE round(f0 * 48) IN (2, 4, 8)),
 b AS (SELECT p.session_id, p.channel, p.f0 AS fp, a.f0 AS fa, least(floor((p.phase + pi()) / (2 * pi()) * 6), 5) AS b, avg(a.amp) AS a FROM k p JOIN k a ON p.session_id = a.session_id AND p.channel = a.channel AND p.frame = a.frame AND p.f0 < a.f0 GROUP BY ALL),
 q AS (SELECT session_id, channel, fp, fa, a / sum(a) OVER (PARTITION BY session_id, channel, fp, fa) AS p FROM b)
 SELECT session_id, channel, r{fp} AS f_phase, r{fa} AS f_amp, r{(ln(6) + sum(p * ln(p))) / ln(6)} AS mi FROM q GROUP BY session_id, channel, fp, fa""", SPECTRA)
def c16_comodulogram(spark, s):
    own = sp.lock_in(cl.frames(s, WIN, STEP), spark.createDataFrame([(k / 48,) for k in (2, 4, 8)], "f0 double"), WIN, 1.0)
    return cp.comodulogram(own, 6)


@query(_MSC + " SELECT e.session_id, ch_i, ch_j, r{w * sqrt(i.msc * j.msc)} AS w FROM edges e JOIN ms i ON e.session_id = i.session_id AND ch_i = i.channel JOIN ms j ON e.session_id = j.session_id AND ch_j = j.channel WHERE i.f0 < 0.05 AND j.f0 < 0.05", READS)
def c30_scaled_edges(spark, s):
    nodes = sp.coherence(reads(spark, s).where("f0 < 0.05"), REFERENCE).select("session_id", "channel", F.col("msc").alias("v"))
    return gr.scaled_by_nodes(edges(spark, s), nodes, ["session_id"]).select("session_id", "ch_i", "ch_j", "w")


@query(""", e AS (SELECT session_id, channel, idx FROM (SELECT *, lag(x >= 1, 1, false) OVER (PARTITION BY session_id, channel ORDER BY idx) AS was FROM samples) WHERE x >= 1 AND NOT was),
 t AS (SELECT session_id, channel, min(idx) AS onset FROM e GROUP BY ALL UNION ALL SELECT e.session_id, e.channel, min(e.idx) FROM t JOIN e ON t.session_id = e.session_id AND t.channel = e.channel AND e.idx - onset >= 12 GROUP BY e.session_id, e.channel)
 SELECT session_id, channel, onset FROM t""", f"RECURSIVE {SAMPLES}")
def e4_burst_onsets(spark, s):
    return ev.debounced_onsets(s, F.col("x") >= 1, ["session_id", "channel"], 12)


@query(""", n AS (SELECT session_id, channel, t, CASE WHEN t - lag(t) OVER w <= 1 THEN 0 ELSE 1 END AS n FROM samples WHERE x >= 1 WINDOW w AS (PARTITION BY session_id ORDER BY t, channel)),
 g AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY t, channel ROWS UNBOUNDED PRECEDING) AS grp FROM n) SELECT session_id, grp::BIGINT AS grp, min(t) AS t0, max(t) AS t1, count(*) AS n, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM g GROUP BY session_id, grp""")
def e7_coincident_groups(spark, s):
    return ev.coincident_groups(s.where("x >= 1"), 1.0)


@query(""", z AS (SELECT session_id, channel, idx, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12) AS z FROM samples WINDOW w AS (PARTITION BY session_id, channel)), l AS (SELECT session_id, channel, min(idx) - 240 AS l FROM z WHERE idx >= 240 AND z >= 1 GROUP BY ALL)
 SELECT session_id, first(channel ORDER BY l, channel) AS seed, max(l) - min(l) AS spread, r{quantile_cont(l, 0.5)} AS median_latency FROM l GROUP BY ALL""")
def e12_seed_channel(spark, s):
    return ev.seed_channel(ev.latencies(cl.z_score(s), 1.0, 240))


@query(""", g AS (SELECT session_id, idx, round(var_pop(x), 9) AS gfp FROM samples GROUP BY ALL), k AS (SELECT session_id, idx FROM (SELECT *, max(gfp) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM g) WHERE gfp = m AND gfp > 0),
 v AS (SELECT session_id, idx, channel, x - avg(x) OVER (PARTITION BY session_id, idx) AS v FROM samples JOIN k USING (session_id, idx)), u AS (SELECT session_id, idx, channel, v / sqrt(sum(v * v) OVER (PARTITION BY session_id, idx)) AS v FROM v),
 f AS (SELECT session_id, idx, mode AS k, abs(sum(v * w)) AS r FROM u JOIN basis USING (channel) GROUP BY ALL) SELECT session_id, idx, first(k ORDER BY round(r, 9) DESC, k) AS k, r{max(r)} AS fit FROM f GROUP BY ALL""")
def m3_backfit(spark, s):
    peaks = st.field_peaks(ev.field_power(s).withColumn("gfp", F.round("gfp", 9)), 3)
    return st.backfit(st.topographies(s, peaks), spark.createDataFrame(BASIS, "k int, channel string, w double"))


@query(_LABELS + """ SELECT tau, label, count(*) AS n, r{count(*) / sum(count(*)) OVER (PARTITION BY tau)} AS share FROM (SELECT l.label, l.idx - o.onset AS tau FROM lb l JOIN (VALUES (100), (300), (715)) o(onset) ON l.idx BETWEEN o.onset - 6 AND o.onset + 12) GROUP BY tau, label""")
def m9_occupancy(spark, s):
    return st.occupancy(jn.epochs(_labels(s), _onsets(s), 6, 12))


@query("SELECT session_id, channel, rep::INT AS rep, row_number() OVER (PARTITION BY session_id, channel, rep ORDER BY md5(rep || ':' || session_id || ':' || channel || ':' || idx)) - 1 AS idx, x FROM samples, range(1, 4) q(rep)")
def i2_time_shuffle(spark, s):
    return inf.time_shuffle(s, 3).select("session_id", "channel", "rep", "idx", "x")


@query("SELECT channel, state, count(*) AS n, r{avg(x)} AS mean, r{stddev_samp(x)} AS sd, r{stddev_samp(x) / sqrt(count(*))} AS sem FROM samples JOIN windows ON t >= t0 AND t < t1 GROUP BY ALL")
def t2_condition_means(spark, s):
    return inf.summary(jn.in_windows(s, windows(spark)), ["channel", "state"], "x").select("channel", "state", "n", "mean", "sd", "sem")


@query()
def x5_gaussian_information(spark, s):
    return cx.gaussian_information(s)


@query()
def p6_band_pass(spark, s):
    return c1_band_phase(spark, s).select("session_id", "channel", "band", "idx", (F.col("amp") * F.cos("phase")).alias("x"))


@query(""", pl AS (SELECT session_id, ch_i, ch_j, CASE WHEN idx IN (10, 11, 20, 21) THEN 'event' WHEN idx IN (12, 13) THEN 'rebound' ELSE 'baseline' END AS state, sqrt(avg(cos(p1 - p2)) ** 2 + avg(sin(p1 - p2)) ** 2) AS plv FROM pr GROUP BY ALL),
 m AS (SELECT session_id, avg(plv) FILTER (state = 'event') AS e, avg(plv) FILTER (state = 'baseline') AS b FROM pl GROUP BY ALL) SELECT count(*) AS n, r{avg(e - b)} AS mean, r{stddev_samp(e - b) / sqrt(count(*))} AS sem FROM m""", READS)
def g11_state_locking(spark, s):
    labelled = jn.label_state(phases(spark, s).withColumn("t", F.col("idx") * STEP), windows(spark), ["event", "rebound"], "baseline")
    mean = cp.phase_edges(labelled, ["session_id", "state"]).groupBy("session_id", "state").agg(F.avg("plv").alias("value"))
    delta = inf.state_contrast(mean, ["session_id"])
    return delta.agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), (F.stddev_samp("delta") / F.sqrt(F.count("delta"))).alias("sem"))
