"""Kernels over blocks, windows and tiles against brute force, and measures with planted answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectralake.functions import kernels
from spectralake.functions.order_statistics import rolling_median_and_deviation
from spectralake.operators import cleaning, complexity, coupling, events, graphs, inference, joins, spectral, states, timefreq, windows
from spectralake.sources import recordings


def series(spark, session="a", idx=None, **channels):
    out = []
    for c, x in channels.items():
        at = np.arange(len(x)) if idx is None else np.asarray(idx)
        out.append(pd.DataFrame({"session_id": session, "channel": c, "idx": at, "t": at * 1.0, "x": np.asarray(x, float)}))
    return spark.createDataFrame(pd.concat(out))


@pytest.mark.parametrize("values", [3, 1000])
def test_medians_of_windows(values):
    rng = np.random.default_rng(values)
    for _ in range(40):
        n, half = int(rng.integers(1, 80)), int(rng.integers(0, 40))
        idx, x, at = np.sort(rng.choice(120, n, replace=False)), rng.integers(0, values, n).astype(float), np.arange(-3, 123)
        middle, deviation = rolling_median_and_deviation(idx, x, at, half)
        for i, a in enumerate(at):
            w = x[np.abs(idx - a) <= half]
            assert np.isnan(middle[i]) if not len(w) else (middle[i], deviation[i]) == (np.median(w), np.median(np.abs(w - np.median(w))))


@pytest.mark.parametrize("mirror", [False, True])
def test_rolling_robust_z_over_blocks(spark, mirror):
    rng = np.random.default_rng(0)
    x = rng.normal(size=700).round(1)
    x[40:45] = np.nan
    got = cleaning.rolling_robust_z(series(spark, a=x), 20, mirror=mirror, size=100).toPandas().sort_values("idx")
    wide = np.r_[x[20:0:-1], x, x[-2:-22:-1]] if mirror else np.r_[np.full(20, np.nan), x, np.full(20, np.nan)]
    around = np.lib.stride_tricks.sliding_window_view(wide, 41)
    middle = np.nanmedian(around, axis=1)
    want = (x - middle) / (1.4826 * np.nanmedian(np.abs(around - middle[:, None]), axis=1) + 1e-12)
    assert len(got) == 700 and np.allclose(got.z, want, equal_nan=True)


def test_cost_of_a_rolling_window_follows_the_samples():
    """As many steps for a window of 15,361 samples as for one of 201: a recording of 76,800 samples takes seconds."""
    import time

    x, took = np.random.default_rng(1).normal(size=76_800), []
    for half in (100, 7680):
        began = time.process_time()
        rolling_median_and_deviation(np.arange(len(x)), x, np.arange(len(x)), half)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 1


@pytest.mark.parametrize("step", [1, 7])
def test_wavelets_have_no_seams(spark, step):
    rng = np.random.default_rng(2)
    x, win, fs = rng.normal(size=900) + 50, 41, 2.0
    x[300] = np.nan
    lines = spark.createDataFrame([(0.1,), (0.23,)], "f0 double")
    small = timefreq.morlet(series(spark, a=x), lines, win, step, fs, size=1).toPandas().set_index(["frame", "f0"]).sort_index()
    k = np.arange(-20, 21)
    for (frame, f0), r in small.iterrows():
        part = x[frame * step : frame * step + win]
        g = np.exp(-k * k / (2 * (6 / (2 * np.pi * f0) * fs) ** 2))
        z = ((part - part.mean()) * g * np.exp(-2j * np.pi * f0 * k / fs)).sum() / np.sqrt((g * g).sum())
        assert abs(z - (r.re + 1j * r.im)) < 1e-9
    frames = [f for f in range((900 - win) // step + 1) if not f * step <= 300 < f * step + win]
    assert sorted(set(small.index.get_level_values(0))) == frames


def test_ridge_follows_a_drifting_tone(spark):
    t = np.arange(6000)
    f = 0.05 + 0.004 * np.sin(2 * np.pi * t / 6000)
    x = np.sin(2 * np.pi * np.cumsum(f)) + 0.05 * np.random.default_rng(3).normal(size=6000)
    x[3000:3060] *= 6
    grid = spark.createDataFrame([(1, float(0.05 + d)) for d in np.arange(-0.006, 0.0061, 0.001)], "k int, f0 double")
    got = timefreq.ridge_tracks(series(spark, a=x), grid, 121, 1.0, 10, size=500).toPandas().sort_values("idx")
    assert len(got) == 6000 - 120 and np.abs(got.f.to_numpy() - f[60:-60]).mean() < 0.001
    spikes = timefreq.drifting_spikes(series(spark, a=x), grid, 121, 1.0, 10, 5, 1000, 6.0, 20).toPandas()
    assert len(spikes) == 1 and abs(spikes.peak_idx[0] - 3030) < 20 and abs(spikes.peak_f[0] - f[3030]) < 0.002


def test_products_of_channels_block_by_block(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4, 300)) + np.array([[1e6], [0], [3], [-5]])
    x[2] += x[3]
    rows = pd.concat([pd.DataFrame({"session_id": "a", "channel": f"c{i}", "idx": np.arange(300), "x": x[i], "phase": x[i] % 6 - 3}) for i in range(4)])
    rows = rows[~((rows.channel == "c1") & rows.idx.between(50, 80))]  # not all channels at all times
    given = spark.createDataFrame(rows)
    got = joins.gram(given, size=37).toPandas().set_index(["ch_i", "ch_j"])
    edges = coupling.phase_edges(given, size=37).toPandas().set_index(["ch_i", "ch_j"])
    assert len(got) == len(edges) == 6
    for (a, b), r in got.iterrows():
        both = rows[rows.channel == a].merge(rows[rows.channel == b], on="idx")
        assert np.allclose([r["cov"], r["r"]], [np.cov(both.x_x, both.x_y, bias=True)[0, 1], np.corrcoef(both.x_x, both.x_y)[0, 1]], atol=1e-7)
        d, e = both.phase_x - both.phase_y, edges.loc[(a, b)]
        assert np.allclose([e.plv, e.pli, e.dpli], [abs(np.exp(1j * d).mean()), abs(np.sign(np.sin(d)).mean()), (np.sin(d) > 0).mean()])


def test_sliding_sums_over_gaps_and_blocks(spark):
    rng = np.random.default_rng(5)
    idx = np.sort(rng.choice(500, 440, replace=False)) - 7
    x = rng.normal(size=440)
    rows = spark.createDataFrame(pd.DataFrame({"k": "a", "idx": idx, "x": x, "half": 3})).unionByName(spark.createDataFrame(pd.DataFrame({"k": "b", "idx": idx, "x": 2 * x, "half": 0})))
    got = windows.sliding_sums(rows, ["k"], "idx", {"x": F.col("x")}, F.col("half")).toPandas()
    at = dict(zip(idx.tolist(), x.tolist(), strict=True))
    whole = {i: sum(at[j] for j in range(i - 3, i + 4)) for i in range(-10, 500) if all(j in at for j in range(i - 3, i + 4))}
    a, b = (got[got.k == k].set_index("at").x for k in "ab")
    assert sorted(a.index) == sorted(whole) and np.allclose([a[i] for i in whole], list(whole.values())) and np.allclose(b.sort_index(), 2 * x)
    summed = windows.running_sums(rows.where("k = 'a'"), ["k"], "idx", ["x"], block=50).toPandas().sort_values("idx")
    assert np.allclose(summed.x, np.cumsum(x))


def points(spark, x):
    data = [("a", "c", i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(data, "session_id string, channel string, idx long, point array<double>")


@pytest.mark.parametrize("size", [16, 23, 512])
def test_recurrence_lines_over_tiles(spark, size):
    rng = np.random.default_rng(6)
    x = np.stack([np.sin(np.arange(130) / 5), np.cos(np.arange(130) / 5)], 1) + 0.1 * rng.normal(size=(130, 2))
    given = points(spark, x)
    near = ((x[:, None] - x[None]) ** 2).sum(2) < (0.5 * np.sqrt(x.var(0).sum())) ** 2
    np.fill_diagonal(near, False)

    def lengths(lines):
        return sorted(n for line in lines for n in map(len, "".join("1" if v else " " for v in line).split()))

    want = {"diagonal": lengths(np.diag(near, d) for d in range(1, 130)), "column": lengths(near)}
    got = complexity.recurrence_runs(given, 0.5, size).toPandas()
    for kind, found in want.items():
        own = got[got.kind == kind]
        assert sorted(np.repeat(own.n, own.c)) == found
    m = complexity.recurrence_measures(given, 0.5, size=size).first()
    d = np.array(want["diagonal"])
    assert np.isclose(m.rate, near.sum() / (130 * 129)) and np.isclose(m.det, d[d >= 2].sum() / d.sum()) and m.lmax == d.max()
    pairs = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(130, 1)] / np.sqrt(x.var(0).sum())
    assert {r.r: r.c for r in complexity.correlation_sums(given, [0.2, 0.7], size).collect()} == {r: int((pairs < r).sum()) for r in (0.2, 0.7)}


def test_covariance_spread_by_pairs(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3, 400)) * np.linspace(1, 4, 400)
    got = complexity.covariance_spread(series(spark, a=x[0], b=x[1], c=x[2]), 40, 20, size=4).first()
    logs = []
    for s in range(0, 361, 20):
        values, axes = np.linalg.eigh(np.cov(x[:, s : s + 40]) + 1e-9 * np.eye(3))
        logs.append((axes * np.log(values)) @ axes.T)
    d = np.array([np.linalg.norm(a - b) for i, a in enumerate(logs) for b in logs[i + 1 :]])
    assert got.frames == len(logs) and np.isclose(got.spread, d.mean()) and np.isclose(got.rms, np.sqrt((d**2).mean()))


def test_grid_clusters_find_what_is_planted(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 6, 20))
    x[:, 2:4, 8:14] += 2
    data = [(f"t{t}", r, c, float(x[t, r, c])) for t in range(12) for r in range(6) for c in range(20)]
    got = inference.sign_flip_grid_clusters(spark.createDataFrame(data, "trial string, row long, col long, x double"), 100).toPandas().sort_values("mass", ascending=False)
    top = got.iloc[0]
    assert top.significant and top.p < 0.05 and top.low_row <= 2 and top.high_row >= 3 and top.low_col <= 8 and top.high_col >= 13 and top.cells >= 12
    assert not got.significant.iloc[1:].any()
    labels = kernels.grid_components(np.array([0, 0, 0, 1, 1, 2]), np.array([0, 1, 3, 1, 4, 4]))
    assert labels.tolist() == [0, 0, 2, 0, 4, 4]


def test_component_weights_recover_a_source(spark):
    rng = np.random.default_rng(9)
    n, mix = 6000, np.array([1.0, -0.8, 0.5, 0.1])
    t = np.arange(n)
    source = np.sin(2 * np.pi * 0.05 * t)
    noise = np.convolve(rng.normal(size=n + 20), np.ones(21) / 21, "valid")  # strong, broad and common to all channels
    x = mix[:, None] * source + np.array([[3.0], [3.0], [3.0], [3.0]]) * noise + 0.3 * rng.normal(size=(4, n))
    given = series(spark, **{f"c{i}": x[i] for i in range(4)})
    w = spectral.component_weights(given, 0.05, 0.003, 0.02, 1.0, size=2000, halo=500)
    out = spectral.weighted_sum(given, w).toPandas().sort_values("idx").x
    plain = (x * x.var(1)[:, None]).sum(0)
    assert abs(np.corrcoef(out, source)[0, 1]) > 0.9 > abs(np.corrcoef(plain, source)[0, 1])
    found = w.toPandas().sort_values("channel")
    assert np.isclose((found.w**2).sum(), 1) and (found.ratio > 10).all()
    pca = spectral.component_weights(given, 0.05, 0.003, 0.02, 1.0, "pca", size=2000, halo=500).toPandas()
    assert np.isclose((pca.w**2).sum(), 1) and (pca.ratio <= 1).all()


def test_conditional_granger(spark):
    """z drives x and y one after the other: x seems to drive y until z's past is known; by least squares."""
    rng = np.random.default_rng(10)
    n, z, x, y = 900, rng.normal(size=900), np.zeros(900), np.zeros(900)
    for t in range(2, n):
        x[t] = 0.9 * z[t - 1] + 0.3 * rng.normal()
        y[t] = 0.9 * z[t - 2] + 0.3 * rng.normal()
    got = coupling.conditional_granger(series(spark, x=x, y=y, z=z), 2, 300, 100, frames_each=3).toPandas()
    assert sorted(set(got.frame)) == [1, 2, 3, 4, 5, 6] or sorted(set(got.frame)) == [0, 1, 2, 3, 4, 5, 6]
    own = got[(got.source == "x") & (got.target == "y")]
    assert (own.f_pair > 20).all() and (own.f < 6).all() and (got[(got.source == "z") & (got.target == "y")].f > 100).all()
    frame = own.frame.max()
    at = np.arange(frame * 100, frame * 100 + 300)
    lags = {c: np.stack([v[at - k] for k in (1, 2)], 1) for c, v in (("x", x), ("y", y), ("z", z))}

    def rss(*names):
        a = np.column_stack([np.ones(300), *[lags[c] for c in names]])
        return ((y[at] - a @ np.linalg.lstsq(a, y[at], rcond=None)[0]) ** 2).sum()

    full, less = rss("x", "y", "z"), rss("y", "z")
    r = own[own.frame == frame].iloc[0]
    assert np.isclose(r.f, (less - full) / 2 / (full / (300 - 7)), rtol=1e-6) and np.isclose(r.log_gain, np.log(less / full), rtol=1e-6)
    assert np.isclose(r.log_gain_pair, np.log(rss("y") / rss("x", "y")), rtol=1e-6)


def test_transfer_entropy_against_shifts(spark):
    rng = np.random.default_rng(11)
    n = 720
    ref, driven, alone = rng.normal(size=n), np.zeros(n), {f"alone{i}": rng.normal(size=n) for i in range(8)}
    driven[2:] = 0.8 * ref[:-2] + 0.3 * rng.normal(size=n - 2)
    got = coupling.transfer_entropy(series(spark, ref=ref, driven=driven, **alone), "ref", [2], reps=39).toPandas().set_index(["channel", "direction"])
    assert got.p["driven", "from_reference"] == 1 / 40 and got.te["driven", "from_reference"] > 0.3
    others = got.p[[c for c in got.index if c[0].startswith("alone")]]
    assert (others <= 0.05).sum() <= 2 and 0.3 < others.mean() < 0.7
    plain = coupling.transfer_entropy(series(spark, ref=ref, driven=driven), "ref", [2]).toPandas().set_index("direction")
    assert np.isclose(plain.te["from_reference"], got.te["driven", "from_reference"], atol=1e-8)


def test_bispectral_direction(spark):
    """The channel holds the overtone of the reference with its phase: the reference leads."""
    rng = np.random.default_rng(12)
    frames = 80
    phase = rng.uniform(0, 2 * np.pi, frames)
    noise = lambda: 0.3 * (rng.normal(size=frames) + 1j * rng.normal(size=frames))
    made = {("ref", 3): np.exp(1j * phase) + noise(), ("ref", 6): noise(), ("own", 3): noise(), ("own", 6): np.exp(2j * phase) + noise()}
    rows = [("a", c, f, k, float(z[f].real), float(z[f].imag)) for (c, k), z in made.items() for f in range(frames)]
    got = timefreq.bispectral_direction(spark.createDataFrame(rows, "session_id string, channel string, frame long, k int, re double, im double"), "ref", [3], 99).first()
    assert got.sse > 0.8 and got.ees < 0.3 and got.p == 0.01 and np.isclose(got.difference, got.sse - got.ees, atol=1e-8)


def left_to_right(labels, least):
    """Runs shorter than ``least`` join a neighbour one after another, on the list itself."""
    own, start = list(labels), 0
    while start < len(own):
        end = start + 1
        while end < len(own) and own[end] == own[start]:
            end += 1
        if end - start < least:
            a, b = start - 1, end
            while a > 0 and own[a - 1] == own[start - 1]:
                a -= 1
            while b < len(own) - 1 and own[b + 1] == own[end]:
                b += 1
            if start == 0:
                new = own[end] if end < len(own) else own[0]
            else:
                new = own[start - 1] if end == len(own) or start - a >= b - end + 1 else own[end]
            own[start:end] = [new] * (end - start)
        start = end
    return own


@pytest.mark.parametrize("least", [2, 4])
def test_label_smoothing_from_left_to_right(spark, least):
    rng = np.random.default_rng(least)
    labels = {s: np.repeat(rng.integers(0, 3, 150), rng.integers(1, 7, 150)).tolist() for s in "abc"} | {"d": [1], "e": [1, 2]}
    rows = [(s, i, f"m{v}") for s, own in labels.items() for i, v in enumerate(own)]
    got = states.smoothed_labels(spark.createDataFrame(rows, "session_id string, idx long, label string"), least).toPandas().sort_values(["session_id", "idx"])
    for s, own in labels.items():
        assert got[got.session_id == s].label.tolist() == [f"m{v}" for v in left_to_right(own, least)]


def test_binomial_tail_of_many_draws(spark):
    for n, k, p in [(4, 2, 0.05), (25, 3, 0.05), (200, 30, 0.1), (25, 0, 0.3), (25, 25, 0.5), (5000, 300, 0.05)]:
        got = spark.range(1).select(spectral.binomial_tail(F.lit(n), F.lit(k), p).alias("p")).first().p
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k, n + 1))
        assert got == pytest.approx(min(want, 1), rel=1e-6)


def test_control_windows_stay_within_a_stretch(spark):
    idx = np.r_[0:30, 50:100]
    got = inference.control_windows(series(spark, idx=idx, a=idx * 1.0), 20, 60).toPandas()
    assert len(got) == 60 and ((got.start + 19 < 30) | (got.start >= 50)).all() and np.allclose(got["mean"], got.start + 9.5)
    assert {s for s in got.start if s < 30} and {s for s in got.start if s >= 50}
    assert inference.control_windows(series(spark, idx=idx, a=idx * 1.0), 60, 5).count() == 0


def test_shifts_of_series_with_a_gap(spark):
    idx = np.array([0, 1, 2, 5, 6, 9])
    got = inference.circular_shift(series(spark, idx=idx, a=idx * 10.0), 6, 1).toPandas()
    assert all(sorted(own.idx) == list(range(6)) and sorted(own.x) == [0, 10, 20, 50, 60, 90] for _, own in got.groupby("rep"))
    assert got[(got.rep == 6)].sort_values("idx").x.tolist() == [0, 10, 20, 50, 60, 90]
    phases = series(spark, idx=idx, ref=idx * 0.3, own=idx * 0.3 + 1).withColumnRenamed("x", "phase")
    moved = coupling.shifted(phases, F.col("channel") == "ref", 5).toPandas()
    assert all(sorted(own.idx) == list(range(6)) for _, own in moved.groupby(["rep", "channel"]))
    locked = coupling.locking_with_null(phases, "ref", [(1, 1)], 5).first()
    assert np.isclose(locked.plv, 1) and locked.p == 1 / 6


@pytest.mark.parametrize("n, block", [(29, 4), (20, 5), (7, 10)])
def test_resampled_blocks_of_any_length(spark, n, block):
    import hashlib

    x = np.random.default_rng(n).normal(size=n)
    given = series(spark, a=x)
    means, tops = [], []
    for rep in range(1, 41):
        built = []
        for b in range(-(-n // block)):
            start = int(hashlib.md5(f"{rep}:{b}".encode()).hexdigest()[:12], 16) % n
            built += [x[(start + k) % n] for k in range(min(block, n - b * block))]
        means.append(np.mean(built))
        tops.append(np.max(built))
    got = inference.circular_block_bootstrap(given, ["session_id"], block, 40).first()
    assert np.allclose([got.low, got.high], np.quantile(means, [0.025, 0.975]))
    assert np.isclose(inference.max_of_resampled(given, ["session_id"], block, 40).first().threshold, np.quantile(tops, 0.95))


def test_betweenness_of_equal_ways(spark):
    """A square has two shortest ways across: each of the nodes between has half of that pair."""
    edges = spark.createDataFrame([("s", "a", "b", 1.0), ("s", "b", "c", 1.0), ("s", "c", "d", 1.0), ("s", "a", "d", 1.0), ("s", "d", "e", 1.0)], "session_id string, ch_i string, ch_j string, w double")
    got = {r.node: r.betweenness for r in graphs.betweenness(edges, ["session_id"]).collect()}
    # Pairs of the four others of each node: a: b-d; b: a-c; c: b-d; d: a-c half, e with a, b, c; e: none.
    assert got == pytest.approx({"a": (0.5 + 0.5) / 6, "b": 0.5 / 6, "c": (0.5 + 0.5) / 6, "d": (0.5 + 1 + 1 + 1) / 6, "e": 0})


def test_onsets_move_among_the_times_there_are(spark):
    idx = np.array([0, 1, 2, 10, 11, 12])
    curve = series(spark, idx=idx, a=idx * 1.0).select("session_id", "idx", "x")
    onsets = spark.createDataFrame([("a", 1, 10), ("a", 2, 5)], "session_id string, event_id int, onset long")
    placed, moved = windows.moved_onsets(curve, onsets, 2, 4)
    assert sorted((r.idx, r.x) for r in placed.collect()) == list(zip(range(6), idx.tolist(), strict=True))
    assert sorted((r.event_id, r.rep, r.onset) for r in moved.collect()) == [(1, 0, 3), (1, 1, 1), (1, 2, 5), (2, 0, 3), (2, 1, 1), (2, 2, 5)]


@pytest.mark.parametrize("size", [4, 100])
def test_neighbourhoods_and_silhouettes_by_tiles(spark, size):
    rng = np.random.default_rng(13)
    n, k = 30, 4
    x = rng.normal(size=(n, 3)).round(1)  # with ties
    state = rng.choice(["p", "q"], n)
    given = spark.createDataFrame([("a", i, *map(float, x[i]), str(state[i])) for i in range(n)], "session_id string, idx long, u double, v double, w double, state string")

    def distances(columns):
        return np.sqrt(((x[:, None, columns] - x[None, :, columns]) ** 2).sum(2)).round(9)

    def ranks(d):
        order = [[j for j in sorted(range(n), key=lambda j: (d[i, j], j)) if j != i] for i in range(n)]
        return np.array([[order[i].index(j) + 1 if i != j else 0 for j in range(n)] for i in range(n)])

    high, low = ranks(distances([0, 1, 2])), ranks(distances([0, 1]))
    scale = 2 / (n * k * (2 * n - 3 * k - 1))
    lost = lambda a, b: sum(b[i, j] - k for i in range(n) for j in range(n) if i != j and a[i, j] <= k < b[i, j])
    got = states.neighbourhood_preservation(given, ["u", "v", "w"], ["u", "v"], k, size).first()
    assert np.allclose([got.trustworthiness, got.continuity], [1 - scale * lost(low, high), 1 - scale * lost(high, low)])
    d = distances([0, 1, 2])

    def silhouette(s):
        out = []
        for i in range(n):
            own = [d[i, j] for j in range(n) if j != i and s[j] == s[i]]
            far = [d[i, j] for j in range(n) if s[j] != s[i]]
            out.append((np.mean(far) - np.mean(own)) / (max(np.mean(far), np.mean(own)) + 1e-12))
        return np.mean(out)

    observed, null = silhouette(state), [silhouette(np.roll(state, r)) for r in range(1, 11)]
    got = states.silhouette_with_null(given, ["u", "v", "w"], 10, size).first()
    assert np.isclose(got.silhouette, observed, atol=1e-8) and np.isclose(got.null95, np.quantile(null, 0.95), atol=1e-8)


def test_sliding_edges_by_stretches(spark):
    rng = np.random.default_rng(14)
    phase = rng.uniform(-3, 3, (3, 90))
    rows = [("a", f"c{c}", i, float(phase[c, i])) for c in range(3) for i in range(90) if (c, i) != (1, 40)]
    got = coupling.sliding_edges(spark.createDataFrame(rows, "session_id string, channel string, idx long, phase double"), 4, 16).toPandas()
    want = {(i, f"c{a}", f"c{b}"): abs(np.exp(1j * (phase[a] - phase[b])[i - 4 : i + 5]).mean()) for a in range(3) for b in range(a + 1, 3) for i in range(4, 86) if 1 not in (a, b) or abs(i - 40) > 4}
    found = {(r.at, r.ch_i, r.ch_j): r.plv for r in got.itertuples()}
    assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()))


def test_widths_at_half_prominence(spark):
    x = [0, 1, 4, 8, 6, 2, 0, 0, 3, 0]
    curve = series(spark, a=x).select("session_id", "idx", "x")
    peaks = spark.createDataFrame([("a", 3, 8.0, 8.0), ("a", 8, 3.0, 3.0)], "session_id string, idx long, x double, prominence double")
    got = {r.idx: (r.left, r.right, r.width) for r in events.peak_widths(curve, peaks, ["session_id"], 6).collect()}
    assert np.allclose(got[3], (2, 4.5, 2.5)) and np.allclose(got[8], (7.5, 8.5, 1))


def test_which_way_phase_and_amplitude_go(spark):
    """The amplitude follows the reference's phase by two steps."""
    rng = np.random.default_rng(15)
    phase = np.cumsum(0.6 + 0.5 * rng.normal(size=400))
    amp = np.r_[1, 1, 2 + np.cos(phase[:-2])] + 0.2 * rng.normal(size=400)
    rows = [("a", "ref", i, float(np.angle(np.exp(1j * phase[i]))), 1.0) for i in range(400)] + [("a", "own", i, 0.0, float(amp[i])) for i in range(400)]
    given = spark.createDataFrame(rows, "session_id string, channel string, idx long, phase double, amp double")
    got = coupling.phase_amplitude_direction(given, "ref", 3, 60).toPandas().set_index("direction")
    assert got.lag["phase_to_amplitude"] == 2 and got.p["phase_to_amplitude"] < 0.05 and got.gain["phase_to_amplitude"] > 3 * got.gain["amplitude_to_phase"]
    # Against least squares.
    y, a, s, c = amp[2:], amp[:-2], np.sin(phase[:-2]), np.cos(phase[:-2])
    r2 = lambda *cols: 1 - ((y - (m := np.column_stack([np.ones(398), *cols])) @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert np.isclose(got.gain["phase_to_amplitude"], r2(a, s, c) - r2(a), atol=1e-7)


def test_hours_follow_the_table(spark, tmp_path):
    """Events ahead of and behind the 720 hours, and those without a user, are in the grid; those without a time are not."""
    rows = [(1, "view", "2023-12-31 23:30:00"), (2, "view", "2024-01-01 00:10:00"), (None, "view", "2024-02-10 05:00:00"), (3, "click", None)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = recordings.hourly_events(spark, str(tmp_path))
    last = 40 * 24 + 5
    ends = got.agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n"), F.sum("x").alias("x")).first()
    assert (ends.a, ends.b, ends.x) == (-1, last, 3) and ends.n == 5 * 2 * (last + 2)
    assert {(r.session_id, r.idx) for r in got.where("x > 0").collect()} == {("1", -1), ("2", 0), ("none", last)}


@pytest.mark.parametrize("win, nw", [(48, 2.5), (101, 4.0)])
def test_slepian_tapers(win, nw):
    """Orthonormal, and the eigenvectors of the matrix of sinc(2 W (i - j)): nearly all of their power is within the band."""
    got = kernels.slepian(win, nw, 4)
    t = np.arange(win)
    band = 2 * nw / win * np.sinc(2 * nw / win * (t[:, None] - t[None]))
    share = (got @ band * got).sum(1)
    assert np.allclose(got @ got.T, np.eye(4)) and np.allclose(got @ band, share[:, None] * got, atol=1e-8)
    assert (np.diff(share) < 0).all() and share[0] > 0.9999 and np.allclose(np.linalg.eigvalsh(band)[::-1][:4], share)


def drawn_values(x, block, reps):
    """What each rep of the circular blocks draws, one by one."""
    import hashlib

    n = len(x)
    for rep in range(1, reps + 1):
        yield np.concatenate([[x[(int(hashlib.md5(f"{rep}:{b}".encode()).hexdigest()[:12], 16) + k) % n] for k in range(min(block, n - b * block))] for b in range(-(-n // block))])


@pytest.mark.parametrize("stretch", [7, 1 << 16])
def test_circular_bootstrap_makes_no_rows_of_draws(spark, monkeypatch, stretch):
    """Draws as rows, joined to the sums, were taken for a small table and broadcast: a thousand replicates of 200 series ended the executors."""
    monkeypatch.setattr(inference, "STRETCH", stretch)
    x, y = np.random.default_rng(3).normal(size=50), np.arange(3.0)
    got = inference.circular_block_bootstrap(series(spark, a=x, b=y), ["channel"], 6, 40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan
    for r in got.collect():
        means = [v.mean() for v in drawn_values({"a": x, "b": y}[r.channel], 6, 40)]
        assert np.allclose([r.low, r.high], np.quantile(means, [0.025, 0.975]))


@pytest.mark.parametrize("stretch", [7, 1 << 16])
def test_block_bootstrap_makes_no_rows_of_draws(spark, monkeypatch, stretch):
    """Blocks are made in the kernel; a series shorter than a block goes, a null counts as 0."""
    monkeypatch.setattr(inference, "STRETCH", stretch)
    x, y = np.random.default_rng(4).normal(size=50), np.arange(5.0)
    z = np.where(np.arange(8) == 2, np.nan, 1.0)
    rows = series(spark, a=x, b=y, c=z).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = inference.block_bootstrap(rows, ["channel"], 6, 40)
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.channel: (r.low, r.high) for r in got.collect()}
    assert set(found) == {"a", "c"}
    for c, v in (("a", x), ("c", np.nan_to_num(z))):
        means = [np.mean([v[(7919 * rep + 104729 * b) % (len(v) - 5) :][:6] for b in range(len(v) // 6)]) for rep in range(1, 41)]
        assert np.allclose(found[c], np.quantile(means, [0.025, 0.975]))


@pytest.mark.parametrize("stretch", [7, 1 << 16])
def test_largest_of_circular_blocks_makes_no_rows_of_draws(spark, monkeypatch, stretch):
    monkeypatch.setattr(inference, "STRETCH", stretch)
    x, y = np.random.default_rng(5).normal(size=50), np.arange(3.0)
    rows = series(spark, a=x, b=y, c=np.full(9, np.nan)).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = inference.max_of_resampled(rows, ["channel"], 6, 40)
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.channel: r.threshold for r in got.collect()}
    assert found["c"] is None
    for c, v in (("a", x), ("b", y)):
        assert np.isclose(found[c], np.quantile([d.max() for d in drawn_values(v, 6, 40)], 0.95))


@pytest.mark.parametrize("size", [16, 1 << 13])
def test_correlations_of_all_shifts_send_each_sample_once(spark, size):
    """Against each shift as rows: gaps in channels and reference, nulls, several stretches; no row for each sample and rep."""
    rng = np.random.default_rng(6)
    rows = series(spark, view=rng.normal(size=60), a=rng.normal(size=60), b=rng.normal(size=60))
    rows = rows.where("not (channel = 'a' and idx in (3, 40)) and not (channel = 'view' and idx = 17)").withColumn("x", F.when(F.expr("not (channel = 'b' and idx = 5)"), F.col("x")))
    other, reference = rows.where("channel <> 'view'"), rows.where("channel = 'view'").select("session_id", "idx", F.col("x").alias("_r"))
    metric = lambda t, by: t.join(reference, ["session_id", "idx"]).groupBy(*by).agg(F.corr("x", "_r").alias("r"))
    want = inference.metric_against_surrogates(other, metric, ["session_id", "channel"], "r", 20, 7).toPandas().set_index("channel").sort_index()
    made = inference.correlation_against_shifts(other, reference, 20, 7, size)
    got = made.toPandas().set_index("channel").sort_index()
    assert list(got.index) == ["a", "b"] and np.allclose(got[["r", "p", "null95", "z"]], want[["r", "p", "null95", "z"]], atol=1e-8)


@pytest.mark.parametrize("packed", [5, 1 << 14])
def test_shuffles_send_each_sample_once(spark, packed):
    """Channels up to a size are put in order where they are, longer ones by a window; both as a digest says."""
    import hashlib

    rows = series(spark, a=np.arange(5.0), b=np.arange(9.0) * 2)
    got = inference.time_shuffle(rows, 3, packed).toPandas()
    assert len(got) == 42 and set(got.columns) == {"session_id", "channel", "idx", "t", "x", "rep"}
    for c, n, f in (("a", 5, 1), ("b", 9, 2)):
        for rep in (1, 2, 3):
            order = sorted(range(n), key=lambda k: hashlib.md5(f"{rep}:a:{c}:{k}".encode()).hexdigest())
            assert list(got[(got.channel == c) & (got.rep == rep)].sort_values("idx").x) == [k * f for k in order]


def test_spatial_mode_of_nearly_equal_components(spark):
    """Two channels out of step with nearly the same power: the 1024th power of their covariance, as in the SQL, still has both components."""
    rows = [("s", c, i, 0.1, amp * math.cos(i * math.pi / 2 + turn), 0.0) for i in range(8) for c, amp, turn in (("a", 1.0, 0.0), ("b", 0.9999, math.pi / 2))]
    got = states.spatial_mode(spark.createDataFrame(rows, "session_id string, channel string, frame long, f0 double, re double, im double")).first()
    weight = 1 / (1 + 0.9999 ** (2 * 1024))
    assert 0.5 < weight < 0.6
    assert np.isclose(got.share, (weight + (1 - weight) * 0.9999**2) / (1 + 0.9999**2)) and np.isclose(got.in_phase, math.sqrt(0.5))


def test_best_cell_by_the_places_of_the_table(spark):
    """Two cells equal to five places: the one of the lower lines, as the SQL has it, though the other's index is larger by less."""
    cells = spark.createDataFrame([("s", 0.1, 0.2, 0.012651, 1.0), ("s", 0.2, 0.4, 0.012654, 2.0)], "session_id string, f_phase double, f_amp double, mi double, z double")
    of = lambda *places: coupling.best_cell(cells, ["session_id"], *places).first().f_phase
    assert of(5) == 0.1 and of() == 0.2
