"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, rolled, slices, starts_of, written

#: N-grams of up to ORDER words; longer than one word they need CUTOFF occurrences, else they back off by ALPHA.
ORDER, CUTOFF, ALPHA = 2, 2, 0.4
#: Bytes of text that are counted in one piece, and that one bucket of the count tables stands for.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 4 << 20


def ngrams(texts: pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length 1 to ``order`` the hash of the n-gram that ends at each word (0: it would begin before its text); texts are hashed slice by slice."""
    whole = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts = [_ngrams(part.column("text"), order) for part in slices(pa.RecordBatch.from_arrays([whole], ["text"]))] or [_ngrams(whole, order)]
    return [np.concatenate([grams[k] for grams, _ in parts]) for k in range(order)], np.concatenate([sizes for _, sizes in parts])


def _ngrams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    found = Words.of(texts)
    words, sizes = found.hashes(), found.sizes
    place = np.arange(len(words)) - np.repeat(starts_of(sizes), sizes)
    out = []
    for k in range(1, order + 1):
        own = np.zeros(len(words), np.uint64)
        own[k - 1 :] = mix(rolled(words, k) + np.uint64(k)) | np.uint64(1)
        own[place < k - 1] = 0
        out.append(own)
    return out, sizes


def _plane(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, so that equal high bytes compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplane(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _distinct(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all lengths in order of their hash, and how often each stands there."""
    found = [np.unique(g[g != 0], return_counts=True) for g in ngrams(texts, order)[0]]
    every, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order_ = np.argsort(every, kind="stable")
    every, counts = every[order_], counts[order_]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(counts, first) if len(first) else counts


def _dealt(values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that sorted hashes fall in: buckets are equal ranges of hashes."""
    own = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.empty(0, np.int64)
    return [(int(own[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def score_documents(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF, alpha: float = ALPHA) -> DataFrame:
    """Stupid-backoff log scores of all documents under the n-gram counts of the whole corpus.

    A word scores count(n-gram) / count(its first n - 1 words) of the longest n-gram ending at it, of up to ``order``
    words and within its document, that occurs ``cutoff`` times or more; each step to a shorter one
    costs a factor ``alpha``; a single word scores its share of all words. Words are what ASCII white
    space parts, as written.

    Blocks of documents count their own distinct n-grams first, so a frequent n-gram is one entry a block. The
    entries go to the bucket of their hash, where the corpus' counts are summed: a count table partitioned by
    hash. Joined back to each block's entries they return to the block, whose documents sum their words'
    scores. Entries travel as sorted hashes of 64 bits; a block makes no more rows than it has entries, however many
    buckets there are.

    Returns doc_id, n_words, score (sum of natural logs) and mean_score (null without words). Null and empty texts have
    no words and score 0. Ids may be null or repeat, a row gives a row; other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = int(max(32, -(-size // BLOCK_BYTES))), int(max(64, -(-size // BUCKET_BYTES)))
    own = docs.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def ask(rows: pa.Table) -> pa.Table:
        distinct, counts = _distinct(rows.column("text"), order)
        block = rows.column("block")[0].as_py()
        out = [(block, b, _plane(np.diff(distinct[x:y], prepend=np.uint64(0))), _plane(counts[x:y].astype(np.uint64))) for b, x, y in _dealt(distinct, buckets)]
        return pa.Table.from_pylist([dict(zip(asked.names, r, strict=True)) for r in out], schema=asked)

    def answer(rows: pa.Table) -> pa.Table:
        entries = [np.cumsum(_unplane(x), dtype=np.uint64) for x in rows.column("hashes").to_pylist()]
        counts = [_unplane(x) for x in rows.column("counts").to_pylist()]
        _, where = np.unique(np.concatenate(entries), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts)).astype(np.int64)[where]
        parts = np.split(total, np.cumsum([len(e) for e in entries])[:-1])
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array([_plane(p) for p in parts], pa.binary())], schema=answered)

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        grams, sizes = ngrams(rows.column("text"), order)
        distinct = np.unique(np.concatenate([np.unique(g[g != 0]) for g in grams]))
        found = sorted(zip(known.column("bucket").to_pylist(), known.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([_unplane(x, np.int64) for _, x in found]) if found else np.empty(0, np.int64)
        n = len(grams[0])
        count = [np.where(g != 0, totals[np.minimum(np.searchsorted(distinct, g), max(0, len(totals) - 1))], 0) if n else np.empty(0) for g in grams]
        value, done = np.zeros(n), np.zeros(n, bool)
        for k in range(order - 1, 0, -1):
            use = ~done & (count[k] >= cutoff)
            before = np.r_[0, count[k - 1][:-1]] if n else count[k - 1]
            value[use] += np.log(count[k][use]) - np.log(before[use])
            done |= use
            value[~done] += np.where(grams[k] != 0, math.log(alpha), 0.0)[~done]
        value[~done] += np.log(count[0][~done])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return pa.table([rows.column("doc_id"), pa.array(sizes), pa.array(np.bincount(owner, value, len(sizes))), pa.array(np.bincount(owner[~done], minlength=len(sizes)))], schema=scored)

    asked = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
    answered = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])
    scored = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("value", pa.float64()), ("singles", pa.int64())])
    requests = own.groupBy("block").applyInArrow(ask, "block int, bucket int, hashes binary, counts binary")
    answers = requests.groupBy("bucket").applyInArrow(answer, "block int, bucket int, totals binary")
    values = written(own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, value double, singles long"), "scores")
    words = values.agg(F.sum("n_words")).first()[0] or 0
    total = F.col("value") - F.col("singles") * F.lit(math.log(words) if words else 0.0)
    return values.select("doc_id", "n_words", total.alias("score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_score"))
