"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import joined_bytes, slices

MARK = "▁"
_MARK = MARK.encode()
#: A character that no piece covers costs this much less than the least likely piece.
UNKNOWN_PENALTY = 10.0
#: Segments of up to so many bytes are solved side by side with others of about their length; a longer one is solved alone.
SIDE_BY_SIDE = (6, 9, 12, 15, 18, 24, 40, 64)
#: Text bytes that are encoded, and ids that are decoded, in one go.
ENCODE_BYTES, DECODE_IDS = 4 << 20, 1 << 20


def zipf_scores(ranks: list[float]) -> list[float]:
    """Log probabilities of ranks 0, 1, ... by Zipf's law (shifted by 2.7), which sum to about one."""
    return [-math.log(r + 2.7) - math.log(math.log(len(ranks) + 2.7)) for r in ranks]


class DoubleArray:
    """Pieces' bytes as a double-array trie: from state s, byte b leads to base[s] + b + 1 if check there is s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        self.base, self.check, self.value = [0], [-2], [-1]
        self._tried: dict[int, int] = {}
        keys = sorted(keys)
        todo = [(0, 0, 0, len(keys))]
        while todo:
            state, depth, start, end = todo.pop()
            if start < end and len(keys[start][0]) == depth:
                self.value[state] = keys[start][1]
                start += 1
            children, i = [], start
            while i < end:
                byte, j = keys[i][0][depth], i
                while i < end and keys[i][0][depth] == byte:
                    i += 1
                children.append((byte, j, i))
            if children:
                base = self.base[state] = self._place([c[0] for c in children])
                for byte, j, i in children:
                    self.check[base + byte + 1] = state
                    todo.append((base + byte + 1, depth + 1, j, i))
        # Every base has room for 256 children, so that no step leaves the arrays.
        room = max(self.base) + 257 - len(self.check)
        self.base, self.check, self.value = (np.array(own + [fill] * max(0, room), np.int32) for own, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))

    def _place(self, values: list[int]) -> int:
        """A base whose cells for ``values`` are free; searched from where the last node of this many children went."""
        base = self._tried.get(len(values), 0)
        while True:
            if (more := base + 258 - len(self.check)) > 0:
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more
            if self.check[base + values[0] + 1] == -1 and all(self.check[base + v + 1] == -1 for v in values):
                self._tried[len(values)] = base
                return base
            base += 1


class PieceModel:
    """Pieces with their log scores; ``solve`` finds the likeliest pieces of segments of text."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], plain: list[bool]):
        self.pieces, self.scores, self.byte_ids = pieces, np.array(scores), byte_ids
        self.byte_of = {i: b for b, i in byte_ids.items()}
        usable = [(p, i) for i, p in enumerate(pieces) if plain[i]]
        self.trie = DoubleArray([(p.encode(), i) for p, i in usable])
        self.unknown = min(scores[i] for _, i in usable) - UNKNOWN_PENALTY
        # No piece may go on over a mark: texts part there into segments that are solved one by one.
        assert not any(MARK in p.lstrip(MARK) or "\0" in p for p, _ in usable)
        self.line_parts = not any("\n" in p for p, _ in usable)
        self.surface = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)], pa.binary())
        self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), list(scores)
        self.is_byte = np.isin(np.arange(len(pieces)), list(self.byte_of))
        self.id_of_byte = np.array([byte_ids[b] for b in range(256)], np.int32)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Reads a model file. A file of merge ranks has no log scores: they follow from the ranks by Zipf's law."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces, found = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        ranked = sum(x == int(x) for x in found) == n
        return cls(pieces, zipf_scores([max(0.0, -x) for x in found]) if ranked else found, byte_ids, plain)

    def solve(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest pieces of each segment (spaces for marks): all ids, where each one's begin, their number, and the scores.

        A segment that is a mark of the text's own goes by bytes, so that it does not become a space.
        """
        data, offsets = joined_bytes(segments)
        literal = np.flatnonzero(np.diff(offsets) == len(_MARK))
        literal = literal[(data[offsets[literal][:, None] + np.arange(len(_MARK))] == list(_MARK)).all(1)]
        space = data == 0x20
        moved = np.r_[0, np.cumsum(np.where(space, len(_MARK), 1))]
        data = np.repeat(data, np.where(space, len(_MARK), 1))
        for k, byte in enumerate(_MARK):
            data[moved[:-1][space] + k] = byte
        offsets = moved[offsets]
        sizes = np.diff(offsets)
        group = np.searchsorted(SIDE_BY_SIDE, sizes)
        groups = [np.flatnonzero(group == k) for k in range(len(SIDE_BY_SIDE) + 1)]
        ids, total = [], 0
        begin, many, score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        for k, own in enumerate(groups):
            if len(own):
                flat, many[own], score[own] = (self._side_by_side if k < len(SIDE_BY_SIDE) else self._one_by_one)(data, offsets[own], sizes[own])
                begin[own] = total + np.cumsum(many[own]) - many[own]
                ids.append(flat)
                total += len(flat)
        ids.append(self.id_of_byte[list(_MARK)])
        begin[literal], many[literal], score[literal] = total, len(_MARK), self.unknown
        return np.concatenate(ids), begin, many, score

    def _side_by_side(self, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi from left to right over all segments (begin, size) at once: their ids in a row, numbers of ids, scores.

        Of equal scores, the way found first from the left stays. Below, row j has the j-th byte of every segment.
        """
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        most, count = int(n.max()), len(n)
        # A zero stands after a segment's end; no piece has one, so no way goes on there.
        text = np.zeros((most, count), np.uint8)
        for j in range(most):
            inside = n > j
            text[j, inside] = data[at[inside] + j]
        width = np.select([text < 0x80, text < 0xC0, text < 0xE0, text < 0xF0], [1, 0, 2, 3], 4).astype(np.int8)
        best = np.full((most + 1, count), -math.inf)
        origin, used = np.zeros(best.shape, np.int16 if most < 1 << 15 else np.int32), np.full(best.shape, -1, np.int32)
        best[0] = 0.0
        for i in range(most):
            begun = np.flatnonzero((n > i) & (width[i] > 0))
            here, wide = best[i], width[i]
            covered = np.zeros(count, bool)
            rows, state = begun, np.zeros(len(begun), np.int32)
            for j in range(i, most):
                step = base[state] + text[j][rows] + 1
                on = check[step] == state
                rows, state = rows[on], step[on]
                if not len(rows):
                    break
                piece = value[state]
                is_piece = piece >= 0
                ends, piece = rows[is_piece], piece[is_piece]
                covered[ends[wide[ends] == j + 1 - i]] = True
                score = here[ends] + scores[piece]
                won = score > best[j + 1][ends]
                ends = ends[won]
                best[j + 1][ends], origin[j + 1][ends], used[j + 1][ends] = score[won], i, piece[won]
            bare = begun[~covered[begun]]
            end, score = i + wide[bare].astype(np.int64), here[bare] + self.unknown
            won = score > best[end, bare]
            bare, end = bare[won], end[won]
            best[end, bare], origin[end, bare], used[end, bare] = score[won], i, -1
        taken, end = np.zeros((count, most + 1), bool), n.copy()
        open_ = np.arange(count)
        while len(open_):
            taken[open_, end[open_]] = True
            end[open_] = origin[end[open_], open_]
            open_ = open_[end[open_] > 0]
        row, end = np.nonzero(taken)
        piece, start = used[end, row], origin[end, row].astype(np.int64)
        size = np.where(piece >= 0, 1, end - start)
        each = np.repeat(np.arange(len(row)), size)
        ids = piece[each]
        bare = ids < 0
        place = start[each] + np.arange(len(each)) - (np.cumsum(size) - size)[each]
        ids[bare] = self.id_of_byte[text[place[bare], row[each[bare]]]]
        return ids, np.bincount(row, size, count).astype(np.int64), best[n, np.arange(count)]

    def _one_by_one(self, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for segments that are long and few."""
        ids, many, scores = [], [], []
        for start, size in zip(at.tolist(), n.tolist(), strict=True):
            own, score = self.segment(data[start : start + size].tobytes())
            ids += own
            many.append(len(own))
            scores.append(score)
        return np.array(ids, np.int32), np.array(many), np.array(scores)

    def segment(self, data: bytes) -> tuple[list[int], float]:
        """Ids of one segment's likeliest pieces, and their score."""
        base, check, value, scores = self._lists
        n = len(data)
        best, origin, used = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i, c in enumerate(data):
            if 0x80 <= c < 0xC0:
                continue
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here, state, covered = best[i], 0, False
            for j in range(i, n):
                step = base[state] + data[j] + 1
                if check[step] != state:
                    break
                state = step
                if (piece := value[state]) >= 0:
                    covered |= j + 1 - i == width
                    if (s := here + scores[piece]) > best[j + 1]:
                        best[j + 1], origin[j + 1], used[j + 1] = s, i, piece
            if not covered and (s := here + self.unknown) > best[i + width]:
                best[i + width], origin[i + width], used[i + width] = s, i, -1
        out: list[int] = []
        end = n
        while end > 0:
            start, piece = origin[end], used[end]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(data[start:end])]
            end = start
        return out[::-1], best[n]

    def parted(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """All segments of ``texts``, each with a space put before it, and the number of the first one of each text.

        A segment begins with a run of spaces, at a line's end or after it, and at a mark that the text itself has.
        """
        data, offsets = joined_bytes(texts)
        starts = offsets[:-1] + np.arange(len(texts))
        data = np.insert(data, offsets[:-1], 0x20)
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if self.line_parts:
            line = data == 0x0A
            begins |= line
            begins[1:] |= line[:-1]
        mark = np.flatnonzero((data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2]))
        begins[mark] = True
        begins[(mark + 3)[mark + 3 < len(data)]] = True
        begins[starts] = True
        at = np.flatnonzero(begins)
        segments = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[at, len(data)].astype(np.int64)), pa.py_buffer(data)])
        return segments.dictionary_encode(), np.searchsorted(at, starts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in a row, where each text's begin (one more: the end), and each text's score."""
        segments, first = self.parted(texts)
        which = segments.indices.to_numpy()
        ids, begin, sizes, scores = self.solve(segments.dictionary)
        many = sizes[which]
        ends = np.cumsum(many)
        flat = ids[np.repeat(begin[which] - (ends - many), many) + np.arange(ends[-1])]
        return flat, np.r_[(ends - many)[first], ends[-1]], np.add.reduceat(scores[which], first)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: bytes joined, without a leading space; null for null."""
        sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        flat = self.surface.take(ids.flatten())
        if len(flat):
            places, data = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1], np.frombuffer(flat.buffers()[2], np.uint8)
        else:
            places, data = np.zeros(1, np.int32), np.empty(0, np.uint8)
        offsets = places[np.r_[0, np.cumsum(sizes)]]
        led = (np.diff(offsets) > 0) & (np.append(data, np.uint8(0))[offsets[:-1]] == 0x20)
        data, offsets = np.delete(data[: offsets[-1]], offsets[:-1][led]), offsets - np.r_[0, np.cumsum(led)]
        joined = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        joined = pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.binary()))
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            return pa.array([x if x is None else x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


@functools.lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel.load(path)


def encode_pieces(docs: DataFrame, model: str, verify: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) with ``ids`` (pieces of the likeliest segmentation), ``score`` (its log probability)
    and ``n_bytes`` (ids that stand for single bytes); one pass, no shuffle.

    ``model`` is the path of a model file that every executor has. Spaces become marks after one leading mark;
    pieces never go on over a mark, so the best segmentation of a text is that of its segments. A slice of
    text is parted into segments at once, each distinct one of which is solved once. Characters without a piece fall back to
    their bytes. ``verify``: in the same pass the ids are decoded again, and ``round_trip``, whether they give the text, takes
    the place of the text. Null stays null with no ids (null), and goes round; an empty text is a lone mark. Ids may be
    null or repeat: a row gives a row. Other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            for part in slices(batch, limit=ENCODE_BYTES):
                texts = part.column("text").cast(pa.string())
                none = texts.is_null().to_numpy(zero_copy_only=False)
                flat, offsets, scores = own.encode(texts)
                n_bytes = np.diff(np.r_[0, np.cumsum(own.is_byte[flat])][offsets])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array(none))
                second = pc.fill_null(pc.equal(own.decode(ids), texts), True) if verify else texts
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), second, ids, pa.array(scores, mask=none), pa.array(n_bytes, mask=none)], ["doc_id", "round_trip" if verify else "text", "ids", "score", "n_bytes"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {'round_trip boolean' if verify else 'text string'}, ids array<int>, score double, n_bytes long")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (any columns, with ``ids``) plus ``decoded``: bytes joined, marks as spaces, the leading one gone.

    Bytes that are no UTF-8 become U+FFFD; null ids give null, no ids the empty text, a null among ids nothing.
    A column ``decoded`` that the input has is replaced; a row gives a row.
    """
    encoded = encoded.drop("decoded")
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            k = batch.schema.get_field_index("ids")
            sizes = pc.list_value_length(batch.column(k)).fill_null(0).to_numpy(zero_copy_only=False)
            run_ = np.cumsum(sizes.astype(np.int64)) // DECODE_IDS
            starts = np.flatnonzero(np.r_[True, np.diff(run_) > 0]) if len(sizes) else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, own.decode(part.column(k))], [*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
