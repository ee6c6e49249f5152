"""Operators on signals with known answers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spectralake.functions import kernels
from spectralake.operators import cleaning, complexity, coupling, events, graphs, inference, joins, spectral, states
from spectralake.sources import recordings


def series(spark, **channels):
    out = [pd.DataFrame({"session_id": "a", "channel": c, "idx": np.arange(len(x)), "t": np.arange(len(x)) * 1.0, "x": np.asarray(x, float)}) for c, x in channels.items()]
    return spark.createDataFrame(pd.concat(out))


def test_line_amplitude_and_phase(spark):
    t = np.arange(512)
    got = spectral.lock_in(cleaning.frames(series(spark, a=3 * np.cos(2 * np.pi * t / 16 + 0.5) + 2), 64, 64), spark.createDataFrame([(1 / 16,)], "f0 double"), 64, 1.0).toPandas()
    assert np.allclose(np.hypot(got.re, got.im) / 16, 3, atol=1e-6) and np.allclose(np.arctan2(got.im, got.re), 0.5, atol=1e-6)


def test_blocks_with_halo_equal_the_whole_signal(spark):
    rng = np.random.default_rng(1)
    x = np.sin(2 * np.pi * np.arange(960) / 20) + 0.1 * rng.normal(size=960)
    blocks = spectral.blocks_of(series(spark, a=x), 240, 200, 1.0)
    got = spectral.band_phase(blocks, spark.createDataFrame([("b", 0.03, 0.08)], "band string, f_lo double, f_hi double")).toPandas().sort_values("idx")
    whole = kernels.analytic_band(x, 1.0, 0.03, 0.08)
    assert len(got) == 960 and np.abs(got.amp.to_numpy() - np.abs(whole))[240:720].max() < 0.02


def test_intervals_onsets_and_fill(spark):
    s = series(spark, a=[0, 1, 1, 0, 1, 0, 0, 1, 1, 1])
    got = events.islands(s, s.x > 0, ["session_id"], 2).toPandas().sort_values("start")
    assert got[["start", "end"]].values.tolist() == [[1, 3], [7, 10]]
    onsets = events.debounced_onsets(s, s.x > 0, ["session_id"], 4).toPandas()
    assert sorted(onsets.onset) == [1, 7]


def test_graph_kernels():
    k4 = np.ones((4, 4)) - np.eye(4)
    assert kernels.min_cut(k4) == 3 and abs(kernels.laplacian_entropy(k4) - np.log(3)) < 1e-9
    assert np.allclose(np.abs(np.fft.rfft(kernels.phase_randomised(np.arange(9.0), 1))), np.abs(np.fft.rfft(np.arange(9.0))))


def test_csv_layouts(spark, tmp_path):
    (tmp_path / "one.csv").write_text("meta,1\nTimestamp,EEG.F3,Other,EEG.F4\n1000,1,9,2\n1008,3,9,4\n")
    got = recordings.read_headset_csv(spark, str(tmp_path / "one.csv"), ["F3", "F4", "O1"]).orderBy("Timestamp").toPandas()
    assert got["EEG.F4"].tolist() == [2, 4] and got["EEG.O1"].isna().all() and set(got.session_id) == {"one"}
    long = recordings.to_long(recordings.normalised_time(recordings.read_headset_csv(spark, str(tmp_path / "one.csv"), ["F3", "F4"])), ["session_id", "idx", "t"]).toPandas()
    assert len(long) == 4


def windows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id string, state string, window_id int, t0 double, t1 double")


def test_windows_hold_for_their_own_session(spark):
    s = spark.createDataFrame([(k, "c", i, float(i), 1.0) for k in "ab" for i in range(4)] * 2, "session_id string, channel string, idx long, t double, x double")
    w = windows_of(spark, ("a", "event", 1, 0.0, 2.0), ("a", "rebound", 2, 1.0, 3.0), ("b", "event", 1, 3.0, 4.0))
    got = joins.label_state(s, w, ["event", "rebound"])
    assert got.count() == 16  # repeated rows stay
    found = {(r.session_id, r.idx): r.state for r in got.collect()}
    assert [found["a", i] for i in range(4)] == ["event", "event", "rebound", "other"] and [found["b", i] for i in range(4)] == ["other", "other", "other", "event"]
    assert sorted({(r.session_id, r.idx) for r in joins.outside_windows(s, w).collect()}) == [("a", 3), ("b", 0), ("b", 1), ("b", 2)]
    assert joins.in_windows(s, w).count() == 2 * (2 + 2 + 1) and joins.in_windows(s, w.where("false")).count() == 0
    assert joins.outside_windows(s, w.where("false")).count() == 16 and set(joins.label_state(s, w.where("state = 'x'"), ["event"]).toPandas().state) == {"other"}


def test_second_device_goes_by_names(spark, tmp_path):
    (tmp_path / "one.csv").write_text("note,eeg_2,timestamps,eeg_1,eeg_4,eeg_3\na,2,0,1,4,3\nb,,1,1,4,3\n")
    (tmp_path / "two.csv").write_text("timestamps,eeg_1,eeg_2,eeg_3,eeg_4\n5,1,2,3,4\n")
    got = recordings.read_second_device_csv(spark, str(tmp_path)).toPandas().sort_values("session_id")
    assert got[["EEG.AF7", "EEG.AF8", "EEG.TP9", "EEG.TP10"]].values.tolist() == [[1, 2, 3, 4]] * 2 and got.Timestamp.tolist() == [0, 5]


def test_ties_with_a_null_count(spark):
    observed = spark.createDataFrame([("a", 0.1 + 0.2)], "k string, v double")
    null = spark.createDataFrame([("a", 0.3), ("a", 0.1)], "k string, v double")
    assert abs(inference.against_null(observed, null, ["k"], "v").first().p - 2 / 3) < 1e-9


def test_debounce_over_crowds(spark):
    rng = np.random.default_rng(3)
    x = (rng.random(400) < 0.3).astype(float)
    edges = [i for i in range(400) if x[i] and not (i and x[i - 1])]
    want, last = [], -99
    for i in edges:
        if i - last >= 7:
            want.append(i)
            last = i
    s = series(spark, a=x)
    assert sorted(events.debounced_onsets(s, s.x > 0, ["session_id"], 7).toPandas().onset) == want


def test_spectra_of_blocks_equal_lock_in(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=1000)
    s = series(spark, a=x).where("idx not in (300, 301)")  # frames with a gap go
    bins = spark.createDataFrame([(k / 32,) for k in range(17)], "f0 double")
    want = spectral.lock_in(cleaning.frames(s, 32, 16), bins, 32, 1.0).toPandas().sort_values(["frame", "f0"])
    got = spectral.frame_transform(s, 32, 16, 5).toPandas().sort_values(["frame", "k"])
    assert len(got) == len(want) and np.allclose(got[["re", "im"]].to_numpy(), want[["re", "im"]].to_numpy(), atol=1e-9)
    power = spectral.welch(s, 32, 1.0, 5).toPandas().sort_values("f")
    sided = np.where(np.isin(np.arange(17), (0, 16)), 1, 2)
    assert np.allclose(power.p, (want.assign(p=want.re**2 + want.im**2).groupby("f0").p.mean().to_numpy() / (32 * 0.375)) * sided, atol=1e-9)


def test_high_pass(spark):
    t = np.arange(960)
    got = spectral.high_pass(spectral.blocks_of(series(spark, slow=np.sin(2 * np.pi * t / 400), fast=np.sin(2 * np.pi * t / 8)), 240, 200, 1.0), 0.05).toPandas()
    rms = got[got.idx.between(200, 760)].groupby("channel").x.std()
    assert rms["slow"] < 0.05 and abs(rms["fast"] - 2**-0.5) < 0.02


def test_band_decomposition_parts_the_power(spark):
    t = np.arange(720)
    s = series(spark, a=2 * np.sin(2 * np.pi * t / 24) + np.sin(2 * np.pi * t / 5))
    bands = spark.createDataFrame([("low", 0.03, 0.06), ("high", 0.15, 0.25)], "band string, f_lo double, f_hi double")
    got = spectral.band_decomposition(spectral.band_phase(spectral.blocks_of(s, 240, 96, 1.0), bands)).toPandas()
    inner = got[got.idx.between(150, 560)]
    assert np.allclose(inner.groupby("idx").share.sum(), 1) and 3 < (inner[inner.band == "low"].power.mean() / inner[inner.band == "high"].power.mean()) < 5


def test_granger_against_least_squares(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=600), np.zeros(600)
    for i in range(2, 600):
        y[i] = 0.4 * y[i - 1] + 0.6 * x[i - 2] + rng.normal()
    got = coupling.granger(series(spark, x=x, y=y), 3).toPandas().set_index(["source", "target"])
    xs, ys = x - x.mean(), y - y.mean()

    def rss(p, use):
        past = [v[3 - k : 600 - k] for v in use for k in range(1, p + 1)]
        return np.linalg.lstsq(np.array(past).T, ys[3:], rcond=None)[1][0]

    f = [((rss(p, [ys]) - rss(p, [ys, xs])) / p) / (rss(p, [ys, xs]) / (597 - 2 * p)) for p in (1, 2, 3)]
    assert abs(got.loc[("x", "y"), "f"] - max(f)) < 1e-6 * max(f) and got.loc[("x", "y"), "f"] > 20 * got.loc[("y", "x"), "f"]


def test_lempel_ziv_phrases(spark):
    assert complexity.phrases("0001101001000101") == 6  # 0|001|10|100|1000|101
    assert complexity.phrases("") == 0 and complexity.phrases("0") == 1
    got = complexity.lempel_ziv(series(spark, flat=[0, 1] * 120, noise=np.random.default_rng(1).normal(size=240)), 120).toPandas()
    mean = got.groupby("channel").complexity.mean()
    assert mean["noise"] > 2 * mean["flat"]


def test_states_and_modes(spark):
    rng = np.random.default_rng(6)
    maps = np.linalg.qr(rng.normal(size=(5, 5)))[0][:3]
    maps = maps - maps.mean(1, keepdims=True)
    rows = [("a", i, f"c{c}", float(v)) for i in range(90) for c, v in enumerate(maps[i % 3] / np.linalg.norm(maps[i % 3]) * (-1) ** (i // 3))]
    at = spark.createDataFrame(rows, "session_id string, idx long, channel string, v double")
    gfp = spark.createDataFrame([("a", i, 1.0) for i in range(90)], "session_id string, idx long, gfp double")
    got = states.microstate_maps(at, gfp, [3, 4]).toPandas()
    assert got.k.nunique() == 3 and got.explained.iloc[0] > 0.999
    labels = spark.createDataFrame([("a", i, s) for i, s in enumerate("xxxxyzzzzwxxx")], "session_id string, idx long, label string")
    smooth = "".join(states.smoothed_labels(labels, 2).orderBy("idx").toPandas().label)
    assert smooth == "xxxxxzzzzzxxx"
    points = spark.createDataFrame([("a", i, float(x), float(3 * x + 0.1 * y)) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))], "session_id string, idx long, p double, q double")
    pc = states.principal_components(points, ["p", "q"], 2).toPandas()
    x = points.toPandas()[["p", "q"]].to_numpy()
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(pc.share.iloc[0], values / values.sum(), atol=1e-6)
    mixed = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(np.r_[rng.normal(0, 1, 60), rng.normal(20, 1, 40)])], "session_id string, idx long, f double")
    state = states.mixture_states(mixed, ["f"], 2).toPandas().sort_values("idx")
    assert state.state.tolist() == [0] * 60 + [1] * 40 and state.posterior.min() > 0.99
    both = states.connectivity_states(mixed.withColumn("g", mixed.f * 0), ["f", "g"], [2, 3]).toPandas()
    assert both.k.iloc[0] == 2 and both.sort_values("idx").state.iloc[:60].nunique() == 1


def test_spatial_mode_and_eigenmodes(spark):
    rows = [("a", c, i, 0.1, float(w * np.cos(i)), float(w * np.sin(i))) for i in range(20) for c, w in (("p", 1), ("q", 2), ("r", 2))]
    got = states.spatial_mode(spark.createDataFrame(rows, "session_id string, channel string, frame long, f0 double, re double, im double")).first()
    assert abs(got.share - 1) < 1e-9 and abs(got.in_phase - 5 / 3 / 3**0.5) < 1e-9
    edges = spark.createDataFrame([("a", "p", "q", 1.0), ("a", "q", "r", 1.0), ("a", "p", "r", 0.5)], "session_id string, ch_i string, ch_j string, w double")
    modes = graphs.eigenmodes(edges, ["session_id"]).toPandas()
    w = modes.pivot(index="channel", columns="mode", values="w").to_numpy()
    lap = np.array([[1.5, -1, -0.5], [-1, 2, -1], [-0.5, -1, 1.5]])
    assert np.allclose(w.T @ lap @ w, np.diag(modes.groupby("mode").value.first()), atol=1e-9)
    paths = graphs.shortest_paths(edges, ["session_id"], 3).toPandas().set_index(["a", "b"]).d
    assert paths["p", "r"] == 2 and paths["p", "q"] == 1
    cut = graphs.matrix_measures(edges, ["session_id"]).first()
    assert abs(cut.min_cut - 1.5) < 1e-9


def test_sign_flip_clusters(spark):
    rng = np.random.default_rng(7)
    rows = [(f"t{k}", t, float(rng.normal() + (2 if 5 <= t < 9 else 0))) for k in range(30) for t in range(20)]
    got = inference.sign_flip_clusters(spark.createDataFrame(rows, "trial string, tau long, x double"), 100).toPandas()
    best = got.sort_values("mass").iloc[-1]
    assert best.start <= 5 and best.end >= 9 and best.significant


def test_directed_spectra_follow_the_flow(spark):
    rng = np.random.default_rng(8)
    x, y, z = (np.zeros(2000) for _ in "xyz")
    for i in range(1, 2000):
        e = rng.normal(size=3)
        x[i], y[i], z[i] = 0.5 * x[i - 1] + e[0], 0.4 * y[i - 1] + 0.6 * x[i - 1] + e[1], 0.3 * z[i - 1] + e[2]
    found = coupling.directed_spectra(series(spark, x=x, y=y, z=z), 3, [0.1], 1.0)
    got = found.toPandas().set_index(["source", "target"])
    a = np.array([[0.5, 0, 0], [0.6, 0.4, 0], [0, 0, 0.3]])
    b = np.eye(3) - a * np.exp(-0.2j * np.pi)
    h, p = np.abs(np.linalg.inv(b)) ** 2, np.abs(b) ** 2
    assert set(got.order) == {1} and abs(got.loc[("x", "y"), "dtf"] - h[1, 0] / h[1].sum()) < 0.05 and abs(got.loc[("x", "y"), "pdc"] - p[1, 0] / p[:, 0].sum()) < 0.05
    assert got.drop(("x", "y")).dtf.max() < 0.02
    net = coupling.net_flow(found).toPandas().set_index("channel").net
    assert net["x"] > 0.2 > -0.2 > net["y"]


def test_blocks_join_up(spark):
    x = np.array([np.nan, 1, np.nan, np.nan, np.nan, np.nan, np.nan, 8, 9, np.nan])
    s = series(spark, a=x).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    for block in (2, 3, 100):
        got = cleaning.fill_gaps(s, block).orderBy("idx").toPandas().x
        assert np.allclose(got, [1, 1, 13 / 6, 20 / 6, 27 / 6, 34 / 6, 41 / 6, 8, 9, 9])
        total = cleaning.running_sum(series(spark, a=np.arange(10)), "x", "y", block).orderBy("idx").toPandas().y
        assert np.allclose(total, np.cumsum(np.arange(10)))


def test_transfer_entropy_follows_the_drive(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=720), np.zeros(720)
    for i in range(1, 720):
        y[i] = 0.9 * x[i - 1] + 0.3 * rng.normal()
    got = coupling.transfer_entropy(series(spark, x=x, y=y), "x", [1]).toPandas().set_index("direction").te
    assert got["from_reference"] > 0.4 > 0.2 > got["to_reference"]
    assert abs(kernels.knn_entropy(rng.normal(size=(800, 1))) - 0.5 * np.log(2 * np.pi * np.e)) < 0.1 and abs(kernels.digamma(1.0) + 0.5772156649) < 1e-8


def test_integration_tells_the_coupled(spark):
    rng = np.random.default_rng(10)
    rows = []
    for i in range(60):
        base = rng.normal()
        for c in "pqr":
            both = base if i < 30 else rng.normal()
            rows.append(("a", c, i, float(both + 0.05 * rng.normal()), float(3 + both + 0.3 * rng.normal())))
    p = spark.createDataFrame(rows, "session_id string, channel string, idx long, phase double, amp double")
    got = complexity.integration(p, 6).toPandas().sort_values("at")
    assert len(got) == 48 and got.score.iloc[:15].min() > got.score.iloc[-15:].max()
    envelope = spark.createDataFrame([("a", i, 1.0 if i < 30 else 0.0) for i in range(60)], "session_id string, at long, amp double")
    assert complexity.against_envelope(complexity.integration(p, 6), envelope, 20).first().r > 0.7


def test_a_line_is_no_fractal(spark):
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.normal(size=4096)) * 0.2
    x -= x.mean()
    got = spectral.fractal_split(series(spark, a=x + 3 * np.sin(2 * np.pi * 0.125 * np.arange(4096))), 256, 1.0).toPandas().set_index("f")
    base = got.fractal[(got.index > 0.1) & (got.index < 0.15)].median()
    assert got.p[0.125] > 20 * base and got.fractal[0.125] < 4 * base and got.oscillatory[0.125] > 0.8 * got.p[0.125]


def test_slow_phase_of_an_envelope(spark):
    t = np.arange(1440)
    x = (2 + np.cos(2 * np.pi * t / 120)) * np.sin(2 * np.pi * t / 24)
    fast = spectral.band_phase(spectral.blocks_of(series(spark, a=x), 480, 240, 1.0), spark.createDataFrame([("d", 0.025, 0.07)], "band string, f_lo double, f_hi double"))
    slow = spectral.band_phase(spectral.blocks_of(fast.withColumnRenamed("amp", "x").select("session_id", "channel", "idx", "x"), 480, 480, 1.0), spark.createDataFrame([("s", 0.004, 0.015)], "band string, f_lo double, f_hi double"))
    got = slow.where("idx between 400 and 1000").orderBy("idx").toPandas()
    assert np.abs(np.angle(np.exp(1j * (got.phase - 2 * np.pi * got.idx / 120)))).max() < 0.3 and abs(got.amp.mean() - 1) < 0.15


def test_changes_follow_the_amplitude(spark):
    rng = np.random.default_rng(12)
    label, rows, amps = "x", [], []
    for i in range(400):
        amp = rng.random()
        if amp > 0.7 and rng.random() < 0.9:
            label = "y" if label == "x" else "x"
        rows.append(("a", i, label))
        amps.append(("a", i, float(amp)))
    labels, amplitude = spark.createDataFrame(rows, "session_id string, idx long, label string"), spark.createDataFrame(amps, "session_id string, idx long, amp double")
    model, auc = states.change_regression(labels, amplitude).first(), states.change_auc(labels, amplitude).first()
    assert model.coefficient > 3 and model.auc > 0.9 and abs(model.auc - auc.auc) < 0.02
