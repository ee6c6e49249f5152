"""Quality: regularised quadratic discriminant over transformed statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, WHITE, Words, forget, joined_bytes, list_matrix, rolled, slices, starts_of, summed, written
from .toxicity import held_out

#: Labelled rows whose statistics choose the shrinkage and calibrate the scores (those with the smallest hash of their id), and
#: rows of either class without which nothing is learned.
MAX_CALIBRATION, LEAST = 20_000, 20
#: Shrinkage towards the pooled covariance, and from there towards a multiple of the identity.
POOLED, ROUND = (0.0, 0.1, 0.3, 0.6), (0.001, 0.01, 0.1)
#: The score at which a document counts as good.
LIMIT = 0.3

STATISTICS = ["words", "bytes", "letters", "capitals", "digits", "stops", "marks", "wide", "lines", "word_mean", "word_spread", "word_longest", "short", "distinct", "entropy", "top", "pairs", "triples", "repeat", "marked", "shouted", "capitalised", "bars"]


def _of(test) -> np.ndarray:
    return np.array([test(c) for c in range(256)])


_LOWER, _UPPER, _DIGIT = _of(lambda c: 0x61 <= c <= 0x7A), _of(lambda c: 0x41 <= c <= 0x5A), _of(lambda c: 0x30 <= c <= 0x39)
_STOP = _of(lambda c: c in b".,;:'")
_MARK = _of(lambda c: 0x21 <= c < 0x7F and not chr(c).isalnum() and c not in b".,;:'")
_HIGH = _of(lambda c: c >= 0x80)
_BAR, _LINE = _of(lambda c: c in b"|<>{}[]\\"), _of(lambda c: c == 0x0A)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share as an angle, which spreads out what lies near 0 and 1."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the values that each of n owners has: how many different ones, the times of the most frequent, and the sum of times x log(times); and the rows' times."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])]) if len(o) else np.empty(0, np.int64)
    times, mine = np.diff(np.r_[new, len(o)]), o[new]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, mine, times)
    return np.bincount(mine, minlength=n), top, np.bincount(mine, times * np.log(np.maximum(times, 1)), n), times


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each whole text (null counts as empty): counts as logarithms, shares as angles.

    Of letters, marks and lines; of the words' lengths; of how often words, pairs and triples of words repeat.
    """
    n = len(texts)
    data, offsets = joined_bytes(texts)
    size = np.diff(offsets)
    words = Words.of(texts, WHITE, FOLDED)
    count = words.sizes
    owner = np.repeat(np.arange(n), count)

    def of_bytes(table: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(table[data])][offsets])

    lower, upper, digit, stop, mark, high, bar, line = (of_bytes(t) for t in (_LOWER, _UPPER, _DIGIT, _STOP, _MARK, _HIGH, _BAR, _LINE))
    length = (words.ends - words.starts).astype(np.float64)
    by_word = lambda x: np.bincount(owner, x, n)
    mean = by_word(length) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(by_word(length**2) / np.maximum(count, 1) - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    begins, ends = data[words.starts], data[words.ends - 1]
    upper_before = np.r_[0, np.cumsum(_UPPER[data])]
    shouted = (upper_before[words.ends] - upper_before[words.starts]) * 2 > length
    hashes = words.hashes()
    kinds, top, logs, _ = _distinct(owner, hashes, n)
    entropy = np.log(np.maximum(count, 1)) - logs / np.maximum(count, 1)
    repeats = []
    for width in (2, 3):
        every = rolled(hashes, width)
        inside = owner[: len(every)] == owner[width - 1 :] if len(every) else np.empty(0, bool)
        mine, most, _, _ = _distinct(owner[: len(every)][inside], every[inside], n)
        whole = np.maximum(count - width + 1, 0)
        repeats.append((_share(mine, whole), most, whole))
    letters = lower + upper + high
    columns = [
        np.log1p(count), np.log1p(size), _share(letters, size), _share(upper, letters), _share(digit, size), _share(stop, count), _share(mark, count), _share(high, size), np.log1p(line * 100 / np.maximum(size, 1)),
        np.log1p(mean), np.log1p(spread), np.log1p(longest), _share(by_word(length <= 3), count), _share(kinds, count), entropy / np.log(np.maximum(count, 2)), _share(top, count), repeats[0][0], repeats[1][0], _share(repeats[1][1], repeats[1][2]),
        _share(by_word(_MARK[ends]), count), _share(by_word(shouted), count), _share(by_word(_UPPER[begins]), count), _share(bar, count),
    ]
    return np.stack(columns, 1)


def statistics_rows(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and ``x``, the statistics of each row's text; a pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(part.column("text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), flat], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


@dataclass
class Gaussian:
    """A class: its mean and the Cholesky factor of its covariance, kept inverted together with the log of its determinant."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Up to a constant: minus half the squared Mahalanobis distance and the log of the determinant."""
        z = (x - self.mean) @ self.inverse.T
        return -0.5 * ((z * z).sum(1) + self.log_det)


@dataclass
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None
    slope: float = 1.0
    shift: float = 0.0
    shrinkage: tuple[float, float] = (0.0, 0.0)

    @classmethod
    def fit(cls, labelled: DataFrame, most: int = MAX_CALIBRATION, least: int = LEAST) -> QualityModel:
        """``labelled``: doc_id, x and quality (0 or 1) of the rows to learn from.

        Means and covariances come from all of them, summed where they lie. Those whose hash falls in one of five folds are left
        out of the moments that judge the shrinkage: it is the pair of shares with the least log loss over at most ``most`` of these rows,
        on which the scores are calibrated as well. Then the moments of all rows take their place.
        """
        folded = labelled.withColumn("fold", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).cast("int"))
        moments = _moments(folded)
        p = len(STATISTICS)
        own = {key: moments.get(key, np.zeros(1 + p + p * p)) for key in ((q, f) for q in (0, 1) for f in (0, 1))}
        counts = [own[q, 0][0] + own[q, 1][0] for q in (0, 1)]
        if min(counts) < least or min(own[q, 0][0] for q in (0, 1)) < 2:
            share = (counts[1] + 1) / (sum(counts) + 2)
            return cls(np.zeros(p), np.ones(p), None, shift=float(np.log(share / (1 - share))))
        aside = folded.where("fold = 1").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "x").limit(most).select("x", "quality").toPandas()
        x, y = np.stack(aside["x"]) if len(aside) else np.zeros((0, p)), aside["quality"].to_numpy(np.float64)
        parts = [own[q, 0] for q in (0, 1)]
        tried = [cls._of(parts, a, b) for a in POOLED for b in ROUND]
        if len(set(y.tolist())) == 2:
            losses = [m._calibrated(x, y) for m in tried]
            best = tried[int(np.argmin(losses))]
        else:
            best = tried[len(tried) // 2]
        final = cls._of([own[q, 0] + own[q, 1] for q in (0, 1)], *best.shrinkage)
        final.slope, final.shift = best.slope, best.shift
        return final

    @classmethod
    def _of(cls, parts: list[np.ndarray], pooled: float, round_: float) -> QualityModel:
        p = len(STATISTICS)
        n = np.array([part[0] for part in parts])
        means = [part[1 : p + 1] / part[0] for part in parts]
        spreads = [part[p + 1 :].reshape(p, p) / part[0] - np.outer(m, m) for part, m in zip(parts, means, strict=True)]
        center = (n[0] * means[0] + n[1] * means[1]) / n.sum()
        inner = (n[0] * spreads[0] + n[1] * spreads[1]) / n.sum()
        scale = np.sqrt(np.maximum(np.diag(inner), 1e-8))
        spreads, inner = [s / np.outer(scale, scale) for s in spreads], inner / np.outer(scale, scale)
        classes = []
        for m, s in zip(means, spreads, strict=True):
            c = (1 - pooled) * s + pooled * inner
            c = (1 - round_) * c + round_ * max(np.trace(c) / p, 0.01) * np.eye(p)
            classes.append(Gaussian.of((m - center) / scale, c))
        return cls(center, scale, tuple(classes), shrinkage=(pooled, round_))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The difference of the classes' log densities, its size on a logarithmic scale."""
        if self.classes is None:
            return np.zeros(len(x))
        z = (x - self.center) / self.scale
        return np.arcsinh(self.classes[1].log_density(z) - self.classes[0].log_density(z))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))

    def _calibrated(self, x: np.ndarray, y: np.ndarray) -> float:
        """Fits slope (above 0) and shift by Newton's steps, with a little weight on slope 1 and shift 0; returns the log loss."""
        t, w = self.margin(x), np.array([1.0, 0.0])
        design = np.stack([t, np.ones(len(t))], 1)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
            step = np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]) + np.eye(2), design.T @ (q - y) + (w - [1.0, 0.0]))
            w = w - step / max(1, np.abs(step).max())
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(max(w[0], 0.01)), float(w[1])
        q = np.clip(self.score(x), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())


def _moments(labelled: DataFrame) -> dict[tuple, np.ndarray]:
    """For each class and fold the number, sum and sum of products of ``x``; a task sends one row for each."""
    p = len(STATISTICS)
    schema = pa.schema([("quality", pa.int32()), ("fold", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = list_matrix(batch.column("x"), p)
            quality, fold = (batch.column(c).to_numpy() for c in ("quality", "fold"))
            for key in set(zip(quality.tolist(), fold.tolist(), strict=True)):
                own = x[(quality == key[0]) & (fold == key[1])]
                found[key] = found.get(key, 0) + np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        for (q, f), sums in found.items():
            yield pa.RecordBatch.from_pylist([{"quality": q, "fold": f, "sums": sums.tolist()}], schema=schema)

    rows = labelled.select(F.col("quality").cast("int").alias("quality"), "fold", "x").mapInArrow(run, "quality int, fold int, sums array<double>")
    return {key: np.array(own) for key, own in summed(rows, ["quality", "fold"], "sums", "double").items()}


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits a :class:`QualityModel` on the labelled documents that are not held out, and scores every whole text.

    Returns doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.3). Statistics of all texts are computed once and
    written; labels join them, not the texts. Only statistics of the text are inputs of a score.

    Null and empty texts have the statistics of a text without words. A null doc_id is not held out and has no label; of an
    id's labels the larger counts, and one that is neither 0 nor 1 not at all; a row gives a row, and each row of a repeated id is
    learned from. With fewer than 20 labelled rows of either class all scores are the same, the share of class 1 (one row of either
    class added). Other columns are ignored; no rows give no rows.
    """
    rows = written(statistics_rows(docs), "statistics")
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    labelled = written(rows.where(~F.col("held_out")).join(known, "doc_id").select("doc_id", "x", "quality"), "labelled")
    model = QualityModel.fit(labelled)
    forget(labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(list_matrix(batch.column("x"), len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
