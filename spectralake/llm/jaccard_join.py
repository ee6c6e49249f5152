"""N-gram Jaccard self-join by PartEnum signatures, and the components of its links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, Words, connected_components, forget, mix, rolled, shuffles_go, slices, starts_of, union_all, written

#: Sets link when DEN * intersection >= NUM * union.
NUM, DEN, WIDTH = 75, 100, 5
#: Signatures a bucket of the join gets on average; there are as many buckets as that takes.
BUCKET_SIGNATURES = 400_000
#: Size bands that end below this use elements themselves as signatures.
SMALL = 16
#: Signatures beyond k that a set keeps, which linked sets then have in common (see PartEnum).
COMMON = 4
#: Signatures with at least HOT documents have these compared in blocks of BLOCK documents or BLOCK_ELEMENTS elements.
HOT, BLOCK, BLOCK_ELEMENTS = 64, 1000, 500_000
#: Elements that a round of such comparisons sends at least, if there are more.
ROUND_ELEMENTS = 50_000_000
#: Times that documents which cannot link are taken out of the groups.
PASSES = 2
#: Pairs of sets that share a rare element which are counted in one go.
COUNTED = 1_000_000
#: Document ids that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles; a shorter text is one shingle."""
    own = Words.of(texts, values=FOLDED)
    hashes, sizes = own.hashes(), own.sizes
    every, out = rolled(hashes, width), []
    for start, n in zip(starts_of(sizes).tolist(), sizes.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(every[start : start + n - width + 1]))
        elif n:
            out.append(mix(rolled(hashes[start : start + n], n) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class PartEnum:
    """Signatures such that any two sets of the required similarity share one.

    Sizes fall into bands so that linked sets are in one band or in neighbouring ones; key j joins band j with
    itself and with band j + 1. Within a key, linked sets differ in at most k elements. The domain of
    elements is hashed into k + t partitions: at most k of them hold a difference, so the sets agree on at least
    t partitions. A signature is a partition with all its elements in the set. By the same order in every set
    (more elements first, then by hash) a set keeps its first k + COMMON signatures: of t or more common ones,
    the first COMMON are among these on both sides. So light and empty partitions, which say little, are left
    out, no link is lost, and sets that share fewer need not be compared; by their own sizes sets often must
    share more yet (``surely_common``). In the lowest bands every element is a partition of its own, and one
    common signature is all that is sure.
    """

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.lows: list[int] = [1]
        self._k: dict[int, int] = {}

    def top(self, band: int) -> int:
        return self.lows[band] * self.den // self.num

    def band(self, n: int) -> int:
        while self.top(len(self.lows) - 1) < n:
            self.lows.append(self.top(len(self.lows) - 1) + 1)
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def differences(self, key: int) -> int:
        """The most elements in which linked sets of this key may differ."""
        if key not in self._k:
            most = self.top(key) + self.top(key) * self.den // self.num
            least_common = lambda t: -(-self.num * t // (self.num + self.den))
            self._k[key] = max(t - 2 * least_common(t) for t in range(max(0, most - 20), most + 1))
        return self._k[key]

    def surely_common(self, size, other, largest: int):
        """A column: the least number of signatures that linked sets of these sizes (columns) share, over all their keys.

        Sets that differ in d elements agree on all but d partitions; each leaves out all but k + COMMON. In the
        lowest bands a set keeps only the elements of which one is sure to be common, so one is all that is asked.
        """
        self.band(largest)
        kept = [1 if self.top(j) < SMALL else self.differences(j) + COMMON for j in range(len(self.lows) - 1)]
        band = lambda n: F.size(F.filter(F.array(*map(F.lit, self.lows)), lambda x: x <= n))  # noqa: E731  counted from 1
        total = size + other
        d = total - 2 * F.ceil(self.num * total / (self.num + self.den))
        of_key = lambda j: F.when(j < 1, 0).otherwise(F.greatest(F.lit(1), F.coalesce(F.get(F.array(*map(F.lit, kept or [1])), j - 1), F.lit(1)) - d))
        low, high = F.least(band(size), band(other)), F.greatest(band(size), band(other))
        return F.when(low == high, of_key(low - 1) + of_key(low)).otherwise(of_key(low))

    def least_common(self, size, largest: int):
        """A column: no set of this size (a column) shares fewer signatures with any set of up to ``largest`` that it links with.

        That is ``surely_common`` at its least over the sizes of a partner in its own band, the next and the one before; sets that differ in d
        elements and link have d <= (den - num) / (den + num) of their sizes' sum, which grows with the partner.
        """
        self.band(largest * self.den // self.num + 1)
        lows, tops = self.lows, [self.top(j) for j in range(len(self.lows))]
        kept = [1 if self.top(j) < SMALL else self.differences(j) + COMMON for j in range(len(self.lows) - 1)]
        at = lambda values, j: F.get(F.array(*map(F.lit, values)), j)
        j = F.size(F.filter(F.array(*map(F.lit, lows)), lambda x: x <= size)) - 1
        of_key = lambda j, other: F.when(j < 0, 0).otherwise(F.greatest(F.lit(1), F.coalesce(at(kept, j), F.lit(1)) - F.floor((self.den - self.num) * (size + other) / (self.den + self.num))))
        most, low, top = F.floor(size * self.den / self.num), at(lows, j), at(tops, j)
        own = of_key(j - 1, F.least(most, top)) + of_key(j, F.least(most, top))
        above, below = F.when(most > top, of_key(j, most)), F.when((j > 0) & (self.den * (low - 1) >= self.num * size), of_key(j - 1, low - 1))
        return F.least(own, above, below)

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """64-bit signatures of a set (sorted distinct hashes)."""
        n = len(elements)
        if not n:
            return elements
        band = self.band(n)
        return np.concatenate([self._of_key(elements, key) for key in (band - 1, band) if key >= 0])

    def _of_key(self, elements: np.ndarray, key: int) -> np.ndarray:
        n, salt = len(elements), np.uint64((key + 1) * 0xA24BAED4963EE407 % (1 << 64))
        if self.top(key) < SMALL:
            keep = n - -(-self.num * n // self.den) + 1
            return mix(np.sort(mix(elements ^ salt))[:keep])
        k = self.differences(key)
        parts = k + COMMON + k // 2
        scrambled = mix(elements + salt)
        part = ((scrambled >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
        order = np.argsort(part, kind="stable")
        own = part[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        filled, counts = own[starts], np.diff(np.r_[starts, n])
        content = mix(np.add.reduceat(scrambled[order], starts) + filled * np.uint64(0xE7037ED1A0B428DB))
        first = np.lexsort((content, -counts))[: k + COMMON]
        kept = content[first]
        if len(kept) < k + COMMON:  # too few partitions have elements: empty ones count too, in the same order everywhere
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), filled)
            kept = np.r_[kept, np.sort(mix(empty * np.uint64(0x8EBC6AF09C88C6E3) + salt))[: k + COMMON - len(kept)]]
        return kept


def set_rows(docs: DataFrame, arrays: bool = False) -> DataFrame:
    """doc_id, n (size of the set), set_hash (128 bits; null for empty sets) and, if asked, the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())]
                more = [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))] if arrays else []
                yield pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "n", "set_hash", "elements"][: 3 + arrays])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, set_hash binary" + ", elements array<long>" * arrays)


def packed_signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """For each slice of ``docs`` and bucket of signatures one row: signatures (32 further bits) and steps of doc_id.

    A signature only proposes pairs, which are verified, so bits that the bucket does not imply may be cut.
    Of equal sets in a slice one stands for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = PartEnum()
        for batch in batches:
            for part in slices(batch):
                own: dict[bytes, tuple[int, np.ndarray]] = {}
                for doc, s in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text")), strict=True):
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    if doc is not None and len(s) and (key not in own or doc < own[key][0]):
                        own[key] = (doc, s)
                if not own:
                    continue
                found = [scheme.signatures(s) for _, s in own.values()]
                signatures, owners = np.concatenate(found), np.repeat(np.array([d for d, _ in own.values()], np.int64), [len(f) for f in found])
                bucket = ((signatures >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                order = np.lexsort((owners, bucket))
                signatures, owners, bucket = signatures[order].astype(np.uint32), owners[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                rows = [(int(bucket[a]), signatures[a:b].tobytes(), np.diff(owners[a:b], prepend=0).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "signatures", "steps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket int, signatures binary, steps binary")


def _shared(own: pd.DataFrame) -> pd.DataFrame:
    """Documents of one bucket that share a signature, as groups: equal groups once, with their number of signatures."""
    signatures = np.concatenate([np.frombuffer(x, np.uint32) for x in own["signatures"]])
    docs = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in own["steps"]])
    order = np.lexsort((docs, signatures))
    signatures, docs = signatures[order], docs[order]
    new = np.r_[True, (signatures[1:] != signatures[:-1]) | (docs[1:] != docs[:-1])]
    signatures, docs = signatures[new], docs[new]
    starts = np.flatnonzero(np.r_[True, signatures[1:] != signatures[:-1]])
    sizes = np.diff(np.r_[starts, len(docs)])
    group = mix(np.add.reduceat(mix(docs.view(np.uint64)), starts) + sizes.astype(np.uint64))
    _, first, number, times = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    once = np.zeros(len(starts), bool)
    once[first] = True
    take = np.repeat(once & (sizes > 1), sizes)
    return pd.DataFrame({"gid": np.repeat(group, sizes)[take].view(np.int64), "doc": docs[take], "times": np.repeat(times[number], sizes)[take]})


def _open(rows: DataFrame) -> DataFrame:
    """The rows (gid, doc, component, ...) of groups with several components, with m, the group's number of documents, and cluster, its smallest."""
    of = rows.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.min("doc").alias("cluster")).where("low < high")
    return rows.join(of.select("gid", "m", "cluster"), "gid")


def _may_link(open_: DataFrame, largest: int) -> DataFrame:
    """Without the documents that share, in all groups taken together, fewer signatures than any link across components takes.

    Documents of different components share none but those of open groups. What goes makes groups smaller, some of which are no longer open.
    """
    for _ in range(PASSES):
        enough = F.sum("times") >= PartEnum().least_common(F.max("size"), largest)
        able = open_.groupBy("doc").agg(enough.alias("_able")).where("_able").select("doc")
        less = written(_open(open_.drop("m", "cluster").join(able, "doc", "left_semi")), "open")
        forget(open_)
        open_ = less
    return open_


def _elements_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and elements of the documents ``ids`` (id) names; only these are read again."""
    named = written(ids, "ids")
    small = F.broadcast(named) if named.count() <= MAX_BROADCAST else named
    wanted = docs.select("doc_id", "text").join(small, F.col("doc_id") == F.col("id"), "left_semi")
    out = written(set_rows(wanted, arrays=True).select("doc_id", "elements"), "elements")
    forget(named)
    return out


def _similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, compared exactly."""
    sets = _elements_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs)
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    links = written(pairs.join(a, "a").join(b, "b").where(DEN * common >= NUM * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    forget(sets)
    return links


def _common(a: list[np.ndarray], b: list[np.ndarray], rare: int = 256, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``.

    An element in few pairs of sets is counted pair by pair; of the others, few, the element matrices are
    multiplied, ``width`` columns at a time.
    """
    _, number = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    counts = [np.array([len(s) for s in sets]) for sets in (a, b)]
    cut, n = int(counts[0].sum()), int(number.max(initial=-1)) + 1
    sides = []
    for at, sizes in ((number[:cut], counts[0]), (number[cut:], counts[1])):
        order = np.argsort(at, kind="stable")
        own = np.bincount(at, minlength=n)
        sides.append((np.repeat(np.arange(len(sizes)), sizes)[order], own, np.cumsum(own) - own))
    (rows, fa, sa), (columns, fb, sb) = sides
    few = np.flatnonzero((fa > 0) & (fb > 0) & (fa * fb <= rare))
    pairs = fa[few] * fb[few]
    out = np.zeros(len(a) * len(b), np.float32)
    piece = np.cumsum(pairs) // COUNTED
    for own in np.split(np.arange(len(few)), np.flatnonzero(np.diff(piece)) + 1) if len(few) else []:
        some, n = few[own], pairs[own]
        element, k = np.repeat(some, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat = rows[sa[element] + k // fb[element]] * len(b) + columns[sb[element] + k % fb[element]]
        out += np.bincount(flat, minlength=len(out))
    out = out.reshape(len(a), len(b))
    many = np.flatnonzero(fa * fb > rare)
    for start in range(0, len(many), width):
        some = many[start : start + width]
        matrices = []
        for own, f, s, size in ((rows, fa, sa, len(a)), (columns, fb, sb, len(b))):
            matrix = np.zeros((size, len(some)), np.float32)
            at = np.repeat(np.arange(len(some)), f[some])
            matrix[own[np.repeat(s[some], f[some]) + np.arange(len(at)) - np.repeat(np.cumsum(f[some]) - f[some], f[some])], at] = 1
            matrices.append(matrix)
        out += matrices[0] @ matrices[1].T
    return out


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) that are not the smallest of their component, and that smallest one."""
    nodes, inverse = np.unique(np.r_[a, b], return_inverse=True)
    x, y, label = inverse[: len(a)], inverse[len(a) :], np.arange(len(nodes))
    while True:
        new, low = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes[label != np.arange(len(nodes))], nodes[label[label != np.arange(len(nodes))]]
        label = new


def _cell_links(cell: pd.DataFrame) -> pd.DataFrame:
    """Components joined by the links between the two blocks of a cell, as stars: no more rows than documents."""
    a, b = cell[cell["own"] == cell["i"]], cell[cell["own"] == cell["j"]]
    if not len(a) or not len(b):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    x, y = list(a["elements"]), list(b["elements"])
    total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    left, right = a["component"].to_numpy(), b["component"].to_numpy()
    rows, columns = np.nonzero((NUM + DEN) * _common(x, y).astype(np.int64) >= NUM * total)
    across = left[rows] != right[columns]
    rows, columns = rows[across], columns[across]
    node, root = _stars(left[rows], right[columns])
    return pd.DataFrame({"a": node, "b": root})


def _hot_links(hot: DataFrame, docs: DataFrame) -> DataFrame:
    """Links across components among documents that share a signature of many, compared block against block.

    ``hot`` has cluster (the signature's smallest document), doc, size and component. A cluster's documents are dealt
    into blocks of bounded size; a cell is two blocks of a cluster, and a task works on one cell at a time. Every pair of a
    cluster meets in a cell; a cell returns the components that its links join, never its pairs. Cells are worked off in rounds, each of which
    sends no more than twice the sets of all these documents, or ROUND_ELEMENTS.
    """
    members = written(hot.select("cluster", "doc", "size", "component").distinct(), "hot")
    once = members.groupBy("doc").agg(F.max("size").alias("size")).agg(F.sum("size")).first()[0] or 0
    number = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_ELEMENTS)).alias("blocks"))
    placed = members.join(number, "cluster").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = written(placed.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "component", "size"), "placed")
    sent = placed.agg(F.sum("size")).first()[0] or 0
    rounds = max(1, math.ceil(sent / max(ROUND_ELEMENTS, 2 * once)))
    sets = _elements_of(members.select(F.col("doc").alias("id")).distinct(), docs)
    found = []
    for k in range(rounds):
        own = placed.where(F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(rounds)) == k)
        cells = own.join(sets, own["doc"] == sets["doc_id"]).select("cluster", "i", "j", "own", "component", "elements")
        found.append(written(cells.groupBy("cluster", "i", "j").applyInPandas(_cell_links, "a long, b long"), "hot-links"))
    forget(sets, members, placed)
    return union_all(found)


@shuffles_go
def jaccard_components(docs: DataFrame) -> DataFrame:
    """Links documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more; exact.

    Returns doc_id, n_shingles (size of the set) and component_id (smallest doc_id reachable by links, itself
    included) for each row. Equal sets are one node from the start, so copies cost a row each and are never
    paired. Of the others, each first meets the smallest document of all it shares a signature with; only
    where that leaves a signature's documents in several components are the pairs across these compared as well:
    one by one where few documents have the signature, else block against block, which emits no pairs.
    Every comparison left out is between documents that are connected already or share too few signatures.

    Null and empty texts have empty sets and link with nothing. Rows that repeat an id are one node with the
    links of all their texts; rows without an id get the component of an equal set that has one, else null.
    Other columns are ignored; no rows give no rows.
    """
    rows = written(set_rows(docs), "sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = int(min(1 << 20, max(64, 0.7 * total / BUCKET_SIGNATURES)))
    nodes = rows.where("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"))
    nodes = written(nodes, "nodes")
    shared = packed_signatures(docs, buckets).groupBy("bucket").applyInPandas(lambda own: _shared(own), "gid long, doc long, times long")
    # A slice's stand-in for a set need not be the set's node: put the node in its place.
    node_of = rows.where("n > 0").join(nodes, "set_hash").select(F.col("doc_id").alias("doc"), "node", nodes["n"].alias("size"))
    shared = shared.groupBy("gid", "doc").agg(F.sum("times").alias("times"))
    groups = written(shared.join(node_of, "doc").groupBy("gid", "node").agg(F.max("times").alias("times"), F.max("size").alias("size")).withColumnRenamed("node", "doc"), "groups")
    fits = f"{DEN} * least(size, other) >= {NUM} * greatest(size, other)"
    largest = nodes.agg(F.max("n")).first()[0] or 1
    enough = F.col("times") >= PartEnum().surely_common(F.col("size"), F.col("other"), largest)
    center = groups.groupBy("gid").agg(F.min("doc").alias("b"), F.min_by("size", "doc").alias("other"), F.count("*").alias("m")).where("m > 1").drop("m")
    # All signatures that a document shares with the smallest of its partners are counted: in each of them that one is the smallest.
    first = groups.join(center, "gid").where("doc > b").groupBy("doc", "b").agg(F.sum("times").alias("times"), F.max("size").alias("size"), F.max("other").alias("other"))
    first = first.groupBy("doc").agg(F.min_by(F.struct("b", "times", "size", "other"), "b").alias("p")).select(F.col("doc").alias("a"), "p.*").where(fits).where(enough)
    links = _similar(written(first.select("a", "b"), "first"), docs)
    labels = connected_components(links)
    labelled = groups.join(labels, groups["doc"] == labels["node"], "left").select("gid", "doc", "times", "size", F.coalesce("component", "doc").alias("component"))
    labelled = written(labelled, "labelled")
    open_ = _may_link(written(_open(labelled), "open"), largest)
    left, hot = open_.where(F.col("m") < HOT), open_.where(F.col("m") >= HOT)
    other = left.select("gid", F.col("doc").alias("b"), F.col("size").alias("other"), F.col("component").alias("other_component"))
    across = left.join(other, "gid").where(f"doc > b and component <> other_component and {fits}")
    across = across.groupBy(F.col("doc").alias("a"), "b").agg(F.sum("times").alias("times"), F.max("size").alias("size"), F.max("other").alias("other")).where(enough)
    more = _similar(written(across.select("a", "b"), "across"), docs).union(_hot_links(hot, docs))
    labels = connected_components(links.union(more)) if more.limit(1).count() else labels
    final = nodes.join(labels, nodes["node"] == labels["node"], "left").select("set_hash", F.coalesce("component", nodes["node"]).alias("component"))
    full = rows.where("n > 0").join(final, "set_hash").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return full.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with all their columns; rows without an id stay."""
    kept = jaccard_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.where("id is not null").join(kept, F.col("id") == F.col("kept_id"), "left_semi").union(rows.where("id is null")).select("row.*")
