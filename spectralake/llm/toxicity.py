"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, NO_WORD, Words, forget, mix, slices, starts_of, written

#: A fit goes ROUNDS times over all labelled rows. They lie in blocks of about so many bytes of text, each with some SHARE rows of
#: either class at least: those of a rarer class lie in several blocks.
ROUNDS, BLOCK_BYTES, SHARE = 6, 8 << 20, 64
#: Steps that a fit takes at least, and rows of either class without which nothing is learned.
STEPS, LEAST = 1400, 20
#: So many ids with their labels are broadcast at most, so that no text moves to find its label; more of them are joined as Spark sees fit.
MAX_BROADCAST = 1_000_000
#: Thresholds that are tried.
TRIED = np.linspace(0.05, 0.95, 91)
#: What blocks change is added up in whole numbers of this size, so that no order of adding shows in a model.
UNIT = 2.0**-20
#: Size of the text slices that are scored at a time.
SCORE_BYTES = 1 << 20


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    return (part.column("text") for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), limit=SCORE_BYTES))


@dataclass
class ConvClassifier:
    """A word is the sum of three rows of one hashed embedding table: those of the word and of its first four and
    five bytes, so that inflected forms of a stem share what is learned; filters of several widths slide over the sums; the maximum
    of each filter over the whole text goes to a logistic unit. Its size is fixed by its parameters."""

    rows: int = 1 << 19
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    seed: int = 1

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.table = rng.normal(0, 0.03, (self.rows + 1, self.dim)).astype(np.float32)
        self.table[self.rows] = 0  # stands for what is before and after a text
        self.kernels = [rng.normal(0, 0.3, (w, self.dim, self.filters)).astype(np.float32) for w in self.widths]
        self.bias = [np.zeros(self.filters, np.float32) for _ in self.widths]
        self.out = rng.normal(0, 0.3, len(self.widths) * self.filters).astype(np.float32)
        self.out_bias = np.float32(0)

    def word_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(3, n) table rows of all words, each text followed by as many empty places as a filter may stick out."""
        words = Words.of(texts, NO_WORD, FOLDED)
        sizes, pad = words.sizes, max(self.widths)
        total = sizes + pad
        place = np.arange(len(words.starts)) + np.repeat(np.arange(len(sizes)) * pad, sizes)
        rows = np.full((3, int(total.sum())), self.rows, np.int32)
        for k, most in enumerate((None, 4, 5)):
            rows[k, place] = mix(words.hashes(most) + np.uint64(k)) % np.uint64(self.rows)
        return rows, total

    def pooled(self, rows: np.ndarray, sizes: np.ndarray, where: bool = False):
        """Maximum of each filter over each text (at least 0) and, if asked, its place."""
        x = self.table[rows[0]] + self.table[rows[1]] + self.table[rows[2]]
        starts = starts_of(sizes)
        values, places = [], []
        for kernel, bias in zip(self.kernels, self.bias, strict=True):
            w = len(kernel)
            y = x @ kernel[0]
            for k in range(1, w):
                y[:-k] += x[k:] @ kernel[k]
            top = np.maximum.reduceat(y, starts, axis=0)
            values.append(np.maximum(top + bias, 0))
            if where:
                places.append(np.stack([s + y[s : s + n].argmax(0) for s, n in zip(starts, sizes, strict=True)]))
        return np.concatenate(values, 1), places, x

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        logits = self.pooled(rows, sizes)[0].astype(np.float64) @ self.out.astype(np.float64) + float(self.out_bias)
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))

    def fit(self, texts: pa.Array, labels: np.ndarray, batch: int = 32, rate: float = 0.01, least: int = 3) -> ConvClassifier:
        """Learns from texts in memory, as one block."""
        block = Block.of(self, [texts], labels, np.ones(len(labels), bool))
        self.keep_only(np.flatnonzero(block.often(self.rows) >= least))
        self.learn(block, 0, 1, batch, rate)
        return self

    def keep_only(self, learned: np.ndarray) -> None:
        """All other rows of the table are zero, and stay so: they would be learned by heart."""
        own = self.table[learned]
        self.table = np.zeros_like(self.table)
        self.table[learned] = own
        self.learned = learned

    def params(self) -> np.ndarray:
        """What is learned, in rows of ``dim`` numbers: those of the table, then all others."""
        rest = np.concatenate([p.ravel() for p in [*self.kernels, *self.bias, self.out, np.atleast_1d(self.out_bias)]])
        rest = np.concatenate([rest, np.zeros(-len(rest) % self.dim, np.float32)])
        return np.concatenate([self.table[self.learned], rest.reshape(-1, self.dim)])

    def set_params(self, params: np.ndarray) -> None:
        self.table[self.learned] = params[: len(self.learned)]
        rest, at = params[len(self.learned) :].ravel().astype(np.float32), 0
        for p in [*self.kernels, *self.bias, self.out]:
            p[...] = rest[at : at + p.size].reshape(p.shape)
            at += p.size
        self.out_bias = np.float32(rest[at])

    def learn(self, block: Block, turn: int, turns: int, batch: int = 32, rate: float = 0.01) -> None:
        """Adam on the log loss of batches that are half of either class, at a rate that falls to zero with the last of ``turns``.

        Every row takes part in each of at least ROUNDS / turns passes, those of the smaller class more than once.
        Only the places that the pooling picks pass gradients on.
        """
        rng = np.random.default_rng([self.seed, turn])
        labels = block.labels.astype(np.float32)
        classes = [c for c in (np.flatnonzero(labels == k) for k in (0, 1)) if len(c)]
        half, passes = batch // 2, -(-ROUNDS // turns)
        steps = max(passes * -(-max(map(len, classes)) // half), -(-STEPS // turns))
        queues = [np.concatenate([rng.permutation(c) for _ in range(-(-steps * half // len(c)))]) for c in classes]
        # Only rows that are learned take part: the others are one row of zeros, the last.
        learned = self.learned
        place = np.full(self.rows + 1, len(learned), np.int32)
        place[learned] = np.arange(len(learned))
        word_rows, starts = place[block.word_rows], starts_of(block.sizes)
        whole, self.table = self.table, np.concatenate([self.table[learned], np.zeros((1, self.dim), np.float32)])
        params = [self.table, *self.kernels, *self.bias, self.out]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        widths, last = len(self.widths), turns * steps + 1
        for step in range(1, steps + 1):
            own = np.concatenate([q[(step - 1) * half : step * half] for q in queues])
            rows, sizes = np.concatenate([word_rows[:, block.words[starts[i] : starts[i] + block.sizes[i]]] for i in own], 1), block.sizes[own]
            pooled, places, x = self.pooled(rows, sizes, where=True)
            error = ((1 / (1 + np.exp(-(pooled @ self.out + self.out_bias)))) - labels[own]).astype(np.float32) / batch
            grads = [None] + [np.zeros_like(k) for k in self.kernels] + [np.zeros_like(b) for b in self.bias] + [pooled.T @ error]
            back = error[:, None] * self.out[None, :] * (pooled > 0)
            touched, moved = [], []
            for i, (kernel, spots) in enumerate(zip(self.kernels, places, strict=True)):
                g = back[:, i * self.filters : (i + 1) * self.filters]
                grads[1 + widths + i] = g.sum(0)
                for k in range(len(kernel)):
                    spot = np.minimum(spots + k, x.shape[0] - 1)
                    grads[1 + i][k] = np.einsum("nfd,nf->df", x[spot], g)
                    touched.append(rows[:, spot].reshape(3, -1))
                    moved.append((g[:, :, None] * kernel[k].T[None]).reshape(-1, self.dim))
            now = rate * (1 - (turn * steps + step) / last)
            self.out_bias = np.float32(self.out_bias - 10 * now * error.sum())
            scale = now * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            cells, inverse = np.unique(np.concatenate([t[j] for j in (0, 1, 2) for t in touched]), return_inverse=True)
            sparse = np.zeros((len(cells), self.dim), np.float32)
            np.add.at(sparse, inverse, np.concatenate(moved * 3))
            sparse[cells == len(learned)] = 0
            for k, p in enumerate(params):
                at_ = cells if k == 0 else slice(None)
                g = sparse if k == 0 else grads[k]
                first[k][at_] = 0.9 * first[k][at_] + 0.1 * g
                second[k][at_] = 0.999 * second[k][at_] + 0.001 * g * g
                p[at_] -= scale * first[k][at_] / (np.sqrt(second[k][at_]) + 1e-6)
        whole[learned] = self.table[:-1]
        self.table = whole

    def __getstate__(self) -> dict:
        """Without the table's rows of zeros, which are most of it: so a broadcast model is small."""
        filled = np.flatnonzero(self.table.any(1))
        return self.__dict__ | {"table": (filled, self.table[filled])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        filled, values = state["table"]
        self.table = np.zeros((self.rows + 1, self.dim), np.float32)
        self.table[filled] = values


@dataclass
class Block:
    """Texts to learn from: table rows of its different words (3, k), the words of all texts one after the other, and of each text
    its size in words, its label and whether it lies in no block before."""

    word_rows: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    fresh: np.ndarray

    @classmethod
    def of(cls, model: ConvClassifier, texts: list[pa.Array], labels: np.ndarray, fresh: np.ndarray) -> Block:
        keys, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part in (part for own in texts for part in _parts(own)):
            rows, own = model.word_rows(part)
            keys.append((rows[0].astype(np.int64) << 40) | (rows[1].astype(np.int64) << 20) | rows[2])
            sizes.append(own)
        different, words = np.unique(np.concatenate(keys), return_inverse=True)
        rows = np.stack([different >> 40, (different >> 20) & 0xFFFFF, different & 0xFFFFF]).astype(np.int32)
        return cls(rows, words.astype(np.int32), np.concatenate(sizes).astype(np.int32), labels.astype(np.int8), fresh.astype(np.int8))

    def often(self, rows: int) -> np.ndarray:
        """How many texts have each of the table's rows."""
        found = np.zeros(rows + 1, np.int64)
        for start, size, fresh in zip(starts_of(self.sizes), self.sizes, self.fresh, strict=True):
            if fresh:
                found[np.unique(self.word_rows[:, np.unique(self.words[start : start + size])])] += 1
        return found[:rows]

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.word_rows, self.words, self.sizes, self.labels, self.fresh)]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Block:
        rows, words, sizes, labels, fresh = (np.frombuffer(p, kind) for p, kind in zip(parts, (np.int32, np.int32, np.int32, np.int8, np.int8), strict=True))
        return cls(rows.reshape(3, -1), words, sizes, labels, fresh)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labels_to_learn(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of all labels that are 0 or 1 and not of held-out ids; of an id's labels the larger counts."""
    return labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def labelled_rows(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """All rows of ``docs`` with a label to learn from: doc_id, text, lang, size, toxic. Each row of a repeated id is one."""
    text = F.coalesce("text", F.lit(""))
    return docs.where(~held_out()).select("doc_id", text.alias("text"), "lang", F.octet_length(text).alias("size")).join(usable, "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """The rows of :func:`labelled_rows` in the driver, for small tables."""
    rows = labelled_rows(docs, labels_to_learn(labels)).drop("size").toPandas()
    return rows.assign(lang=rows["lang"].fillna("")).sort_values(["doc_id", "text"], ignore_index=True)


def _blocks(rows: DataFrame, bytes_: int, counts: dict[int, int], block_bytes: int, model: ConvClassifier) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text, toxic) as packed blocks, written, and how many there are.

    A row's block follows from a hash. Of a class with fewer than SHARE rows a block, each lies in as many blocks as it takes. Rows that
    a hash cannot part (repeated ones) begin a new block beyond twice ``block_bytes``.
    """
    n = max(1, -(-bytes_ // block_bytes))
    copies = {k: min(n, -(-SHARE * n // counts[k])) for k in (0, 1)}
    by_class = lambda of: F.when(F.col("toxic") == 1, F.lit(of(copies[1]))).otherwise(F.lit(of(copies[0])))
    copied = rows.select("doc_id", "text", "toxic", F.explode(F.sequence(F.lit(0), by_class(lambda c: c - 1))).alias("copy"))
    block = F.pmod(F.xxhash64("doc_id", "text") % n + F.col("copy") * by_class(lambda c: n // c), F.lit(n)).cast("int")
    placed = copied.select("doc_id", "text", "toxic", (F.col("copy") == 0).alias("fresh"), block.alias("block"))
    names, hasher = ["word_rows", "words", "sizes", "labels", "fresh"], copy.copy(model)
    hasher.table = np.zeros_like(model.table)  # words are hashed without it
    shared = rows.sparkSession.sparkContext.broadcast(hasher)

    def pack(own: list[pa.RecordBatch]) -> pa.RecordBatch:
        labels, fresh = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in own]) for c in ("toxic", "fresh"))
        found = Block.of(shared.value, [b.column("text") for b in own], labels, fresh)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in found.packed()], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for batch in batches:
            for part in slices(batch, limit=SCORE_BYTES):
                own.append(part)
                size += part.column("text").nbytes
                if size > 2 * block_bytes:
                    yield pack(own)
                    own, size = [], 0
        if own:
            yield pack(own)

    # A partition is a block.
    parted = placed.repartitionById(n, F.col("block")).sortWithinPartitions("doc_id", "text", "toxic", "fresh")
    return written(parted.select("text", "toxic", "fresh").mapInArrow(run, ", ".join(f"{c} binary" for c in names)), "toxicity-blocks"), n


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block.unpacked([column[i].as_py() for column in batch.columns])


def _often_enough(blocks: DataFrame, rows: int, least: int) -> np.ndarray:
    """The table's rows that at least ``least`` texts have; as many numbers as the table has rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sum((block.often(rows) for block in _each(batches)), np.zeros(rows, np.int64))
        for own in np.array_split(some := np.flatnonzero(found), -(-len(some) // 20_000) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(found[own])], ["row", "n"])

    counted = blocks.mapInArrow(run, "row int, n long").groupBy("row").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(counted.select("row").toArrow().column("row").to_numpy())


def _round(blocks: DataFrame, model: ConvClassifier, turn: int, turns: int) -> None:
    """Every block learns from the same model on; each number then moves by the mean of the blocks that moved its row.

    Sums by row are what comes to the driver: as many as the model has numbers, and no more with more texts.
    """
    shared, names = blocks.sparkSession.sparkContext.broadcast(model), [f"x{k}" for k in range(model.dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value.params()
        total, times = np.zeros(before.shape, np.int64), np.zeros(len(before), np.int64)
        for block in _each(batches):
            own = copy.deepcopy(shared.value)
            own.learn(block, turn, turns)
            moved = np.rint((own.params().astype(np.float64) - before) / UNIT).astype(np.int64)
            total += moved
            times += moved.any(1)
        for own in np.array_split(some := np.flatnonzero(times), -(-len(some) // 20_000) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(times[own]), *map(pa.array, total[own].T)], ["row", "n", *names])

    moved = blocks.mapInArrow(run, f"row int, n long, {', '.join(f'{c} long' for c in names)}")
    means = moved.groupBy("row").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in names]).toArrow()
    params, at = model.params().astype(np.float64), means.column("row").to_numpy()
    params[at] += np.stack([means.column(c).to_numpy() for c in names], 1) * UNIT
    model.set_params(params.astype(np.float32))
    shared.destroy()


def _limit(counts: pd.DataFrame) -> float:
    """The tried threshold of best F1, of equal ones the nearest to 0.5, from rows (toxic, place, n): n rows reach the first ``place`` thresholds."""
    n = np.zeros((2, len(TRIED) + 1))
    np.add.at(n, (counts["toxic"].to_numpy(np.int64), counts["place"].to_numpy(np.int64)), counts["n"].to_numpy(np.float64))
    hit = n[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    f1 = 2 * hit[1] / np.maximum(1, hit.sum(0) + n[1].sum())
    near = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(TRIED[near[np.abs(TRIED[near] - 0.5).argmin()]])


def _enough(counts: pd.DataFrame, least: int) -> bool:
    return min(counts["n"][counts["toxic"] == k].sum() for k in (0, 1)) >= least


def _calibrated(rows: DataFrame, model: ConvClassifier, least: int) -> tuple[dict[str, float], float]:
    """Thresholds by language and of all languages, from all of ``rows`` (text, lang, toxic): counts for each language, class and place."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SCORE_BYTES):
                score = shared.value.score(*shared.value.word_rows(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(np.searchsorted(TRIED, score, "right"))], ["lang", "toxic", "place"])

    scored = rows.select("text", "lang", "toxic").mapInArrow(run, "lang string, toxic int, place long")
    counts = written(scored.groupBy("lang", "toxic", "place").agg(F.count("*").alias("n")), "toxicity-places")

    def of_language(own: pd.DataFrame) -> pd.DataFrame:
        found = [(own["lang"].iloc[0], _limit(own))] if _enough(own, least) else []
        return pd.DataFrame(found, columns=["lang", "threshold"])

    limits = counts.where("lang is not null").groupBy("lang").applyInPandas(of_language, "lang string, threshold double").orderBy("lang").collect()
    every = counts.groupBy("toxic", "place").agg(F.sum("n").alias("n")).toPandas()
    forget(counts)
    return {r.lang: r.threshold for r in limits}, _limit(every)


def fit_toxicity(docs: DataFrame, labels: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, max_broadcast: int = MAX_BROADCAST, **shape) -> ToxicityModel:
    """A model fitted on every labelled row that is not held out, where the rows lie.

    Four fifths, by a hash of the id, train the classifier: blocks of them learn side by side from the same model on, and the mean of what they
    changed is the next model, ROUNDS times; a single block learns all at once. The other fifth calibrates each language's threshold,
    as in :meth:`ToxicityModel.fit`. Blocks and sums follow from the rows alone, whatever Spark's partitions.
    """
    usable = labels_to_learn(labels)
    if usable.count() <= max_broadcast:
        usable = F.broadcast(usable)
    rows = labelled_rows(docs, usable).withColumn("aside", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4)
    counts = rows.groupBy("toxic", "aside").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    n = {(k, aside): sum(r.n for r in counts if (r.toxic, r.aside) == (k, aside)) for k in (0, 1) for aside in (False, True)}
    model = ConvClassifier(**shape)
    if min(n[k, False] + n[k, True] for k in (0, 1)) < least or not (n[0, False] and n[1, False]):
        return ToxicityModel.untaught(model)
    blocks, many = _blocks(rows.where(~F.col("aside")), sum(r.bytes for r in counts if not r.aside), {k: n[k, False] for k in (0, 1)}, block_bytes, model)
    model.keep_only(_often_enough(blocks, model.rows, 3))
    turns = ROUNDS if many > 1 else 1
    for turn in range(turns):
        _round(blocks, model, turn, turns)
    forget(blocks)
    return ToxicityModel(model, *_calibrated(rows.where("aside"), model, least))


@dataclass
class ToxicityModel:
    classifier: ConvClassifier
    thresholds: dict[str, float]
    default: float = 0.5

    @classmethod
    def untaught(cls, model: ConvClassifier) -> ToxicityModel:
        model.out[:] = 0
        model.out_bias = np.float32(-1)
        return cls(model, {})

    @classmethod
    def fit(cls, sample: pd.DataFrame, least: int = LEAST, **shape) -> ToxicityModel:
        """Trains on four fifths of a frame in memory; the rest calibrates each language's threshold, by its best F1.

        Of equal F1 the threshold nearest 0.5 is taken. Languages with fewer than ``least`` rows of either class
        in the calibration part use the threshold of all languages together. A sample with fewer than ``least`` rows of
        either class teaches nothing: all scores are then the same, below the threshold.
        """
        texts, y = pa.array(sample["text"], pa.string()), sample["toxic"].to_numpy(np.float32)
        model = ConvClassifier(**shape)
        if min((y == k).sum() for k in (0, 1)) < least:
            return cls.untaught(model)
        aside = np.arange(len(y)) % 5 == 4
        model.fit(texts.filter(pa.array(~aside)), y[~aside])
        score = np.concatenate([model.score(*model.word_rows(part)) for part in _parts(texts.filter(pa.array(aside)))])
        counts = pd.DataFrame({"lang": sample["lang"].to_numpy()[aside], "toxic": y[aside], "place": np.searchsorted(TRIED, score, "right"), "n": 1})
        return cls(model, {lang: _limit(own) for lang, own in counts.groupby("lang") if _enough(own, least)}, _limit(counts))

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.classifier.score(*self.classifier.word_rows(texts))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``score`` (0 to 1) of every whole text of ``docs``, with the calibrated threshold of its language.

    Returns doc_id, held_out, score, predicted (score >= 0.5), threshold and rejected (score >= threshold). Only the
    text is an input of the score. Null and empty texts are scored as texts without words. A null
    doc_id is not held out; a null or unknown lang has the threshold of all languages; a row gives a row,
    repeated or not; other columns are ignored. The model (a few megabytes, fixed by its parameters) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, limit=SCORE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("threshold"), pa.array(own.score(part.column("text")))], ["doc_id", "held_out", "threshold", "score"])

    threshold = F.lit(model.default)
    for lang, value in model.thresholds.items():
        threshold = F.when(F.col("lang") == lang, F.lit(value)).otherwise(threshold)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"), threshold.alias("threshold"))
    scored = scored.mapInArrow(run, "doc_id long, held_out boolean, threshold double, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns, in one pass without a shuffle.

    Null and empty texts are scored as texts without words; a null or unknown lang has the threshold of all languages;
    ids play no part, so null and repeated ids and repeated rows stay or go by their text; a score equal to the
    threshold is rejected; no rows give no rows.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, limit=SCORE_BYTES):
                score = own.score(part.column("text"))
                limit = np.array([own.thresholds.get(x, own.default) for x in part.column("lang").to_pylist()])
                if (keep := score < limit).any():
                    yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep)).columns, names)

    return docs.mapInArrow(run, docs.schema)
