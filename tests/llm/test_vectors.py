"""Whitening, quality and clustering against brute force, planted answers and odd rows."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from spectralake.llm import centroid_clustering as cc
from spectralake.llm import quality, whitening

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", "d", 1.0) for r in rows], "vec_id long, embedding array<double>, x string, n string, size double")


@pytest.mark.parametrize("kind", ["apart", "near", "one cluster", "equal", "zero"])
@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_refined_eigenvectors(n, kind):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(n) - q.T @ q) / 2
    values = np.sort(rng.random(n))[::-1].astype(np.longdouble) * 5
    if kind == "near" and n > 4:
        values[1:4] = values[0] - np.array([1e-9, 3e-9, 3.1e-9], np.longdouble)
    if kind == "one cluster":
        values = 3 + np.longdouble(1e-8) * np.sort(rng.random(n))[::-1]
    if kind in ("equal", "zero"):
        values[:] = 2 * (kind == "equal")
    values = np.sort(values)[::-1]
    found, x = whitening.refined_eigh((q * values) @ q.T)
    assert np.abs(found - values).max() < 1e-17 and np.abs(x.T @ x - np.eye(n)).max() < 1e-17
    assert np.abs((q * values) @ q.T @ x - x * found).max() < 1e-17
    gap = np.abs(np.diff(values)).min(initial=1)
    if gap > 1e-12:  # single eigenvalues: the vectors are those of the construction
        assert np.abs(np.abs((x * q).sum(0)) - 1).max() < 1e-6


def whitened(rows, components):
    """By numpy, on the whole table."""
    x = np.floor(64 * np.array(rows)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes / np.sqrt(values), values / np.trace((fit - s / n).T @ (fit - s / n) / n)


def test_whitening_by_numpy(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20)) / 4
    rows[300:] = rows[7]  # a hot copy
    given = vectors(spark, [(i, r.tolist()) for i, r in enumerate(rows)] + [(900, None), (901, [None] * 20), (902, [NAN] * 20), (903, [INF] * 20), (904, [])])
    got = {r.vec_id: r for r in whitening.whiten(given.repartition(7), 16).collect()}
    n, deviation, want, explained = whitened(rows, 16)
    assert sorted(got) == list(range(400)) and {r.n for r in got.values()} == {n}
    assert [got[i].deviation for i in range(400)] == deviation.tolist()
    found = np.array([got[i].whitened for i in range(400)])
    sign = np.sign((found * want).sum(0))
    assert np.abs(found * sign - want).max() < 1e-9 and np.abs(np.array(got[0].explained) - explained).max() < 1e-12
    assert {r.identity_error for r in got.values()} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_whitening_of_odd_rows(spark):
    rows = [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, 2.0]), (2, [1e300, 2.0]), (3, [5.0]), (4, [5.0]), (5, [1.0, 2.0, 3.0]), (6, [2.0, 2.5, 3.0]), (7, [])]
    got = whitening.whiten(vectors(spark, rows), 16).collect()
    assert sorted(r.vec_id or 0 for r in got) == [0, 1, 1, 2, 3, 4, 5, 6]
    by = {(r.vec_id, len(r.whitened)): r for r in got}
    assert by[3, 1].whitened == [0.0] and by[3, 1].explained == [0.0] and by[3, 1].deviation == 0 and by[3, 1].n == 1  # nothing varies
    assert by[5, 3].explained[0] == pytest.approx(1) and by[5, 3].explained[1:] == [0, 0] and by[5, 3].whitened[1:] == [0, 0]
    # 1e300 counts as 2^40: its deviation needs more than 64 bits.
    assert by[2, 2].deviation is None and by[2, 2].n == 3 and by[2, 2].identity_error < 1e-4
    assert whitening.whiten(vectors(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0


def clustered(ids, x, k, rounds, seed=3):
    """Plain Lloyd rounds in Python integers."""
    first = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i]))[:k]
    centers = [list(x[i]) for i in first]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    put = lambda: [min((apart(v, c), j) for j, c in enumerate(centers)) for v in x]
    for _ in range(rounds):
        own = put()
        for j in range(len(centers)):
            mine = [v for v, (_, c) in zip(x, own, strict=True) if c == j]
            if mine:
                centers[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    own = put()
    return [(i, c, d, sum(e for e, b in own if b == c), sum(e for e, _ in own), digests[c]) for i, (d, c) in zip(ids, own, strict=True)]


@pytest.mark.parametrize("k, rounds, span", [(8, 10, 3), (8, 10, 40), (3, 2, 5), (1, 3, 5), (5, 0, 9), (40, 4, 2)])
def test_clustering_by_plain_rounds(spark, monkeypatch, k, rounds, span):
    monkeypatch.setattr(cc, "BLOCK", 37)
    rng = np.random.default_rng(k)
    x = rng.integers(-span, span + 1, (300, 4))
    x[200:] = x[5]  # a third are copies
    given = vectors(spark, [(i, (r / 1024 + 1e-7).tolist()) for i, r in enumerate(x)])
    got = [tuple(r) for r in cc.cluster(given.repartition(3), k, rounds, dimensions=4).collect()]
    assert sorted(got) == sorted(clustered(list(range(300)), x.tolist(), k, rounds))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("clustering_")]


def test_search_leaves_out_work():
    """The bounds spare most distances once the centroids settle."""
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(6, 8)) * 3000)[rng.integers(0, 6, 5000)].astype(np.int64) + rng.integers(-200, 200, (5000, 8))
    centers, before, work = x[:6].copy(), None, []
    own, second, upper, lower = np.zeros(5000, np.int32), np.ones(5000, np.int32), np.full(5000, np.inf), np.zeros(5000)
    for _ in range(8):
        ball = cc.Ball(centers, before)
        if before is not None:
            upper, lower = ball.loosened(own, upper, lower)
        work.append(ball.search(x, own, second, upper, lower))
        assert (own == ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)).all()
        before, centers = centers, np.stack([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else centers[j] for j in range(6)])
    assert work[-1] < 0.2 * 6 * 5000


def test_clustering_of_odd_rows(spark):
    full = lambda v: [float(v)] * 64
    rows = [(None, full(1)), (1, full(1)), (1, full(2)), (2, full(1e300)), (2, full(-1e300)), (3, [1.0] * 63), (4, None), (5, [None] * 64), (6, full(NAN)), (7, full(INF)), (8, [])]
    got = cc.cluster(vectors(spark, rows)).collect()
    assert sorted(r.vec_id or 0 for r in got) == [0, 1, 1, 2, 2] and all(r.distance == 0 for r in got)
    assert {r.inertia for r in got} == {0} and len({r.cluster for r in got}) == 4
    # Components beyond 2^27 count as that: squared distances fit, their sum need not.
    far = cc.cluster(vectors(spark, [(1, full(1e300))] * 3 + [(2, full(-1e300))] * 3), k=1, rounds=0).collect()
    assert {r.distance for r in far} == {0, 1 << 62} and {r.inertia for r in far} == {None}
    assert cc.cluster(vectors(spark, rows).limit(0)).count() == 0 and cc.cluster(vectors(spark, [(None, full(1))])).count() == 0


def plain_statistics(text):
    """Some of the statistics, word by word."""
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    raw = text.split()
    angle = lambda part, whole: math.asin(math.sqrt(min(1, part / max(1, whole))))
    data = text.encode()
    pairs = list(zip(words, words[1:], strict=False))
    return {
        "words": math.log1p(len(words)), "bytes": math.log1p(len(data)), "distinct": angle(len(set(words)), len(words)), "top": angle(max((words.count(w) for w in words), default=0), len(words)),
        "pairs": angle(len(set(pairs)), len(pairs)), "word_mean": math.log1p(sum(len(w.encode()) for w in words) / max(1, len(words))), "word_longest": math.log1p(max((len(w.encode()) for w in words), default=0)),
        "digits": angle(sum(c.isascii() and c.isdigit() for c in text), len(data)), "capitalised": angle(sum("A" <= w[0] <= "Z" for w in raw), len(raw)),
        "entropy": -sum(words.count(w) / len(words) * math.log(words.count(w) / len(words)) for w in set(words)) / math.log(max(2, len(words))) if words else 0.0,
    }


def test_statistics_by_hand():
    texts = ["", "One two, two THREE 44 é", "a", "\n\n", "same same same same", None, "x " * 3000 + "End.", "Tail|of words!! ß\nnew line"]
    got = quality.statistics(pa.array(texts))
    assert np.isfinite(got).all() and got.shape == (len(texts), len(quality.STATISTICS))
    for row, text in zip(got, texts, strict=True):
        for name, value in plain_statistics(text or "").items():
            assert row[quality.STATISTICS.index(name)] == pytest.approx(value, abs=1e-12), (text, name)
    # No text's statistics depend on its neighbours.
    assert np.allclose(got, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts]))


def test_log_densities():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 6))
    cov, mean, x = a @ a.T + np.eye(6), rng.normal(size=6), rng.normal(size=(9, 6))
    want = [-0.5 * ((v - mean) @ np.linalg.inv(cov) @ (v - mean) + np.log(np.linalg.det(cov))) for v in x]
    assert np.allclose(quality.Gaussian.of(mean, cov).log_density(x), want)


def made_documents(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["ba", "do", "ri", "mel", "ta", "on", "is", "qu", "en", "la"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(5, 120))]
        bad = rng.random() < 0.25
        if bad:
            kind = rng.integers(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else words[:1] * len(words) if kind == 1 else [w + rng.choice(["###", "$$$"]) for w in words]
        out.append((i, " ".join(words), int(not bad)))
    return out


def test_quality_learns_and_ignores_held_out_labels(spark):
    rows = made_documents(900, 4)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert len(held) > 100 and np.mean([p == q for p, q in held]) > 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    # Labels of held-out rows, langs and sources change nothing.
    other = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs.withColumn("lang", quality.F.lit(None).cast("string")), other).collect()}
    assert max(abs(again[i] - got[i].score) for i in got) < 1e-9


def test_quality_of_odd_rows(spark):
    rows = [(None, None), (None, "one two"), (1, ""), (1, "one two"), (1, "one two"), (2, "word " * 60_000), (3, " \t\n"), (4, "é 日本")]
    docs = spark.createDataFrame([(*r, "x", "q", 0.0) for r in rows], "doc_id long, text string, x string, quality string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 1, 1, 2, 3, 4] and not any(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got}) == 1  # too few labels
    assert quality.score_quality(docs.limit(0), labels).count() == 0 and quality.score_quality(docs, labels.limit(0)).first().score == 0.5
    # With enough of them, and none alike: still a score between 0 and 1 for each.
    many = docs.union(spark.createDataFrame([(100 + i, f"{'same ' * 9}", "x", "q", 0.0) for i in range(80)], docs.schema))
    taught = spark.createDataFrame([(100 + i, i % 2) for i in range(80)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(many, taught).collect())
