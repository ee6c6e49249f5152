"""Small numpy kernels for what SQL does not express: one-FFT band signals, spectra, graph and matrix measures."""

from __future__ import annotations

import numpy as np


def band_response(n: int, fs: float, lo: float, hi: float, order: int = 4) -> np.ndarray:
    """Power response of a Butterworth band-pass run forwards and backwards, at the bins of a real FFT of n samples."""
    hi, lo = min(hi, 0.49 * fs), max(lo, 1e-4 * fs)
    w, w1, w2 = (np.tan(np.pi * np.asarray(f) / fs) for f in (np.minimum(np.fft.rfftfreq(n, 1 / fs), 0.4999 * fs), lo, hi))
    with np.errstate(divide="ignore", over="ignore"):
        return 1 / (1 + ((w * w - w1 * w2) / ((w2 - w1) * w)) ** (2 * order))


def high_response(n: int, fs: float, lo: float, order: int = 2) -> np.ndarray:
    """Power response of a Butterworth high-pass run forwards and backwards, at the bins of a real FFT of n samples."""
    w, w1 = (np.tan(np.pi * np.minimum(f, 0.4999 * fs) / fs) for f in (np.fft.rfftfreq(n, 1 / fs), lo))
    with np.errstate(divide="ignore"):
        return 1 / (1 + (w1 / w) ** (2 * order))


def high_passed(x: np.ndarray, fs: float, lo: float, order: int = 2) -> np.ndarray:
    """Series without what is slower than ``lo``. Ends are extended by odd reflection."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    ext = np.r_[2 * x[0] - x[n - 1 : 0 : -1], x, 2 * x[-1] - x[-2::-1]]
    return np.fft.irfft(np.fft.rfft(ext - ext.mean()) * high_response(len(ext), fs, lo, order), len(ext))[n - 1 : 2 * n - 1]


def analytic_band(x: np.ndarray, fs: float, lo: float, hi: float, order: int = 4) -> np.ndarray:
    """Complex signal of the band: amplitude is its envelope, angle its phase. Ends are extended by odd reflection."""
    n = len(x)
    ext = np.r_[2 * x[0] - x[n - 1 : 0 : -1], x, 2 * x[-1] - x[-2::-1]] if n > 1 else x
    m = len(ext)
    spectrum = np.zeros(m, complex)
    half = np.fft.rfft(ext - ext.mean()) * band_response(m, fs, lo, hi, order)
    spectrum[: len(half)] = half * 2
    spectrum[0] /= 2
    return np.fft.ifft(spectrum)[n - 1 : 2 * n - 1] if n > 1 else np.zeros(n, complex)


def laplacian_entropy(w: np.ndarray) -> float:
    """Entropy of the nonzero Laplacian eigenvalues of a symmetric weight matrix, as shares of their sum."""
    values = np.linalg.eigvalsh(np.diag(w.sum(1)) - w)
    values = values[values > 1e-10]
    p = values / values.sum() if len(values) else np.ones(1)
    return float(-(p * np.log(p)).sum())


def min_cut(w: np.ndarray) -> float:
    """Least total weight of edges that part the graph in two, by repeated maximum-adjacency orders."""
    w, best = w.astype(float).copy(), np.inf
    np.fill_diagonal(w, 0)
    alive = list(range(len(w)))
    while len(alive) > 1:
        reach, order = {v: 0.0 for v in alive}, []
        while reach:
            v = max(reach, key=lambda u: (reach[u], -u))
            order.append((v, reach.pop(v)))
            for u in reach:
                reach[u] += w[v, u]
        (s, _), (t, cut) = order[-2:]
        best = min(best, cut)
        w[s] += w[t]
        w[:, s] += w[:, t]
        w[s, s] = 0
        alive.remove(t)
    return float(best) if np.isfinite(best) else 0.0


def phase_randomised(x: np.ndarray, seed: int) -> np.ndarray:
    """A series with the same amplitude spectrum and random phases."""
    spectrum = np.fft.rfft(x)
    turn = np.exp(2j * np.pi * np.random.default_rng(seed).random(len(spectrum)))
    turn[0] = 1
    if len(x) % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(spectrum * turn, len(x))


def gaussian_measures(cov: np.ndarray) -> tuple[float, float, float]:
    """Total correlation, dual total correlation and O-information of a Gaussian, from its covariance."""
    cov = cov + 1e-9 * np.trace(cov) / len(cov) * np.eye(len(cov))
    logdet = np.linalg.slogdet(cov)[1]
    total = 0.5 * (np.log(np.diag(cov)).sum() - logdet)
    # Entropy of a variable given all others is that of 1 / its diagonal entry of the inverse.
    dual = 0.5 * (logdet + np.log(np.diag(np.linalg.inv(cov))).sum())
    return float(total), float(dual), float(total - dual)


def digamma(x: float) -> float:
    """Logarithmic derivative of the gamma function, by recurrence up to 6 and its asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def knn_entropy(points: np.ndarray, k: int = 4) -> float:
    """Entropy of a sample (rows) from the distance (largest coordinate) of each point to its k-th neighbour."""
    n, d = points.shape
    gap = np.abs(points[:, None, :] - points[None, :, :]).max(2)
    radius = np.maximum(np.partition(gap, k, axis=1)[:, k], 1e-12)
    return float(digamma(n) - digamma(k) + d * np.log(2 * radius).mean())


def welch_power(x: np.ndarray, win: int, fs: float) -> np.ndarray:
    """Power density of a series by half-overlapping Hann frames without their mean."""
    rows = np.lib.stride_tricks.sliding_window_view(x, win)[:: win // 2]
    z = np.fft.rfft((rows - rows.mean(1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)), axis=1)
    return (np.abs(z) ** 2).mean(0) * 2 / (fs * win * 0.375)


def fractal_power(x: np.ndarray, win: int, fs: float, factors: np.ndarray) -> np.ndarray:
    """Spectrum that stays when the time axis is stretched: for each factor the geometric mean of the spectra of the series stretched and
    shrunk by it, and the median over factors. Lines move with the axis, and so fall out of the median."""
    at, found = np.arange(len(x)), []
    for h in factors:
        longer, shorter = (np.interp(np.arange(0, len(x) - 1, step), at, x) for step in (1 / h, h))
        found.append(np.sqrt(welch_power(longer, win, fs) * welch_power(shorter, win, fs)))
    return np.median(found, axis=0)


def grid_components(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For cells of a grid (in order of row, then column) the index of the first cell that each is joined with by cells with a side in common."""
    n = len(row)
    place = {cell: i for i, cell in enumerate(zip(row.tolist(), col.tolist(), strict=True))}
    links = [(i, place[near]) for (r, c), i in place.items() for near in ((r, c + 1), (r + 1, c)) if near in place]
    label = np.arange(n)
    if links:
        a, b = np.array(links).T
        while True:
            low, new = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return label


def betweenness(length: np.ndarray) -> np.ndarray:
    """For each node the mean, over the connected pairs of other nodes, of the share of their shortest ways that go by it (lengths to nine places);
    NaN without such pairs. ``length``: of each edge, infinite where there is none."""
    n = len(length)
    edge = length.copy()
    np.fill_diagonal(edge, np.inf)
    d = edge.copy()
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    ways = np.eye(n)
    for a in range(n):
        for v in np.argsort(d[a], kind="stable"):
            if v != a and np.isfinite(d[a, v]):
                ways[a, v] = ways[a, np.abs(d[a] + edge[:, v] - d[a, v]) < 1e-9].sum()
    out = np.full(n, np.nan)
    for v in range(n):
        a, b = np.triu_indices(n, 1)
        keep = (a != v) & (b != v) & np.isfinite(d[a, v]) & np.isfinite(d[v, b])
        a, b = a[keep], b[keep]
        if len(a):
            on = np.abs(d[a, v] + d[v, b] - d[a, b]) < 1e-9
            out[v] = np.where(on, ways[a, v] * ways[v, b] / ways[a, b], 0).mean()
    return out


def slepian(win: int, nw: float, tapers: int) -> np.ndarray:
    """The ``tapers`` sequences of ``win`` samples and unit energy that hold most of their power within nw / win of frequency 0: eigenvectors of a
    tridiagonal matrix. Even ones have a positive sum, odd ones begin above 0."""
    t = np.arange(win)
    m = np.diag(((win - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * nw / win))
    off = t[1:] * (win - t[1:]) / 2
    m += np.diag(off, 1) + np.diag(off, -1)
    found = np.linalg.eigh(m)[1][:, ::-1][:, :tapers].T
    for k, own in enumerate(found):
        own *= np.sign(own.sum() if k % 2 == 0 else own[: win // 2].sum())
    return found
