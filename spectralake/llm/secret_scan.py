"""Secret scans: probabilistic automata inferred from labelled credentials score every candidate's format."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, runs_of, slices, written

# The patterns whose matches are always reported.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Least lengths of the credentials of each kind, and of any candidate.
LEAST = {"assign": 6, "access": 20, "hex": 24}
LEAST_CANDIDATE = 6
#: Labelled credentials of each kind that a fit reads at most (those with the smallest hash).
MAX_LABELLED = 400

#: Classes of characters and their sizes: an automaton reads classes, and a class spreads evenly over its characters.
CLASSES = {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "+": "+/_.=-"}
_CLASS_OF = {c: k for k, own in CLASSES.items() for c in own}
_BITS = {k: math.log2(len(own)) for k, own in CLASSES.items()}


_HEX, _CREDENTIAL, _DIGIT, _LETTER = (np.isin(np.arange(256), list(own.encode())) for own in ("0123456789abcdef", "".join(CLASSES.values()), CLASSES["0"], CLASSES["a"] + CLASSES["g"] + CLASSES["A"] + CLASSES["G"]))

Span = tuple[str, int, int, str]


def found_in(texts: pa.Array) -> tuple[list[list[Span]], list[list[Span]]]:
    """For each text its base matches and its candidates, as (kind, start, end, credential); places are code points.

    The base patterns' matches are leftmost and do not overlap within a kind; short ones are dropped. They are looked for
    only in texts that have one of their words. Candidates are the runs of credential characters, without
    dots and hyphens at their ends, and what follows the last '=' and the last '/' inside a run, each with a digit, a
    letter and LEAST_CANDIDATE characters or more; those of one run are neighbours in the list and share its end.
    """
    data, offsets = joined_bytes(texts)
    raw = data.tobytes()
    base: list[list[Span]] = [[] for _ in range(len(texts))]
    more: list[list[Span]] = [[] for _ in range(len(texts))]
    owner = lambda at: np.searchsorted(offsets, at, side="right") - 1
    lower = raw.lower()
    for i in sorted({int(owner(m.start())) for k in KEYWORDS for m in re.finditer(re.escape(k), lower)}):
        base[i] += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(texts[i].as_py()) if len(m[2]) >= LEAST["assign"]]
    for i in sorted({int(owner(m.start())) for m in re.finditer(b"AKIA", raw)}):
        base[i] += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(texts[i].as_py()) if len(m[0]) >= LEAST["access"]]
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    starts, ends = runs_of(_HEX[data], offsets)
    long = ends - starts >= LEAST["hex"]
    starts, ends = starts[long], ends[long]
    for i, a, b in zip(owner(starts).tolist(), starts.tolist(), ends.tolist(), strict=True):
        at = int(points[a] - points[offsets[i]])
        base[i].append(("hex", at, at + b - a, raw[a:b].decode()))
    digits, letters = np.r_[0, np.cumsum(_DIGIT[data])], np.r_[0, np.cumsum(_LETTER[data])]
    starts, ends = runs_of(_CREDENTIAL[data], offsets)
    good = (ends - starts >= LEAST_CANDIDATE) & (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
    starts, ends = starts[good], ends[good]
    for i, a, b in zip(owner(starts).tolist(), starts.tolist(), ends.tolist(), strict=True):
        run = raw[a:b].decode()
        whole, at = run.strip(".-"), int(points[a] - points[offsets[i]]) + len(run) - len(run.lstrip(".-"))
        inner = whole.rstrip("=")
        for cut in sorted({0, inner.rfind("=") + 1, inner.rfind("/") + 1}):
            own = whole[cut:]
            if len(own) >= LEAST_CANDIDATE and any(c.isdigit() for c in own) and any(c.isalpha() for c in own):
                more[i].append(("", at + cut, at + len(whole), own))
    return [sorted(own, key=lambda m: (m[1], KINDS.index(m[0]))) for own in base], more


def _symbols(text: str) -> str:
    return "".join(map(_CLASS_OF.__getitem__, text))


@dataclass
class Automaton:
    """A probabilistic automaton over character classes, got by merging the states of a prefix tree."""

    go: list[dict] = field(default_factory=lambda: [{}])
    count: list[dict] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def fit(cls, texts: list[str], alpha: float = 0.05) -> Automaton:
        """Counts a prefix tree, then merges states whose futures pass Hoeffding's test at ``alpha``, breadth first."""
        own = cls()
        for text in texts:
            state = 0
            for s in _symbols(text):
                if s not in own.go[state]:
                    own.go[state][s] = len(own.go)
                    own.go.append({})
                    own.count.append({})
                    own.ends.append(0)
                own.count[state][s] = own.count[state].get(s, 0) + 1
                state = own.go[state][s]
            own.ends[state] += 1
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], [(0, s) for s in sorted(own.go[0])]
        while blue:
            parent, s = blue.pop(0)
            state = own.go[parent][s]
            target = next((r for r in red if own._alike(r, state, bound)), None)
            if target is None:
                red.append(state)
                blue += [(state, x) for x in sorted(own.go[state])]
            else:
                own.go[parent][s] = target
                own._fold(target, state)
                known = set(red)
                blue = [(r, x) for r in red for x in sorted(own.go[r]) if own.go[r][x] not in known]
        return own

    def _seen(self, state: int) -> int:
        return self.ends[state] + sum(self.count[state].values())

    def _alike(self, a: int, b: int, bound: float) -> bool:
        """No outcome of the two states, nor of the states they lead to, differs by more than chance allows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            m, n = self._seen(a), self._seen(b)
            if not m or not n:
                continue
            gap = bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.ends[a] / m - self.ends[b] / n) > gap:
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(s, 0) / m - self.count[b].get(s, 0) / n) > gap:
                    return False
                if s in self.go[a] and s in self.go[b]:
                    todo.append((self.go[a][s], self.go[b][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the counts of a subtree of the prefix tree to ``into`` and what it leads to."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for s, n in self.count[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + n
                if s in self.go[a]:
                    todo.append((self.go[a][s], self.go[b][s]))
                else:
                    self.go[a][s] = self.go[b][s]

    def bits(self, text: str) -> float:
        """Mean bits a character (the end included) that the automaton needs for ``text``; fewer is likelier."""
        state, total = 0, 0.0
        for s in _symbols(text):
            n = self._seen(state) if state >= 0 else 0
            total += _BITS[s] - math.log2((self.count[state].get(s, 0) + 0.02) / (n + 0.14)) if state >= 0 else _BITS[s] + math.log2(7)
            state = self.go[state].get(s, -1) if state >= 0 else -1
        n = self._seen(state) if state >= 0 else 0
        end = (self.ends[state] + 0.02) / (n + 0.14) if state >= 0 else 1 / 7
        return (total - math.log2(end)) / (len(text) + 1)


@dataclass
class FormatModel:
    """One automaton, limit and least length for each kind that has labelled credentials."""

    automata: dict[str, Automaton]
    limits: dict[str, float]
    least: dict[str, int]

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], share: float = 0.95, least: int = 8, slack: float = 0.05) -> FormatModel:
        """Learns from (kind, credential): each automaton from four fifths of its kind's distinct credentials, its limit from the rest.

        A kind's limit is what ``share`` of the credentials set aside keep to, plus ``slack`` bits. Kinds with fewer than
        ``least`` credentials are left out. A format's least length is that of the shortest labelled credential.
        """
        automata, limits, lengths = {}, {}, {}
        for kind in KINDS:
            own = sorted({c for k, c in labelled if k == kind and len(c) >= LEAST_CANDIDATE})
            if len(own) >= least:
                aside = own[4::5]
                automata[kind] = Automaton.fit([c for i, c in enumerate(own) if i % 5 != 4])
                scores = sorted(automata[kind].bits(c) for c in aside)
                limits[kind] = scores[min(len(aside) - 1, int(share * len(aside)))] + slack
                lengths[kind] = min(map(len, own))
        return cls(automata, limits, lengths)

    def best(self, text: str) -> tuple[str | None, float]:
        """The kind whose format ``text`` keeps to best, and by how many bits a character; (None, ..) if to none."""
        found = [(self.limits[k] - a.bits(text), k) for k, a in self.automata.items() if len(text) >= self.least[k]]
        gain, kind = max(found, default=(-1.0, None))
        return (kind if gain >= 0 else None), gain


SPAN = "struct<kind:string,start:long,end:long,value:string>"
ADDED = "struct<kind:string,start:long,end:long,value:string,gain:double>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
_ADDED = pa.struct([*_SPAN, ("gain", pa.float64())])


def find_matches(docs: DataFrame) -> DataFrame:
    """Base matches and candidates of every whole text: doc_id, base, candidates (arrays of spans); one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = lambda own: pa.array([[dict(zip(("kind", "start", "end", "value"), m, strict=True)) for m in ms] for ms in own], pa.list_(_SPAN))
        for batch in batches:
            for part in slices(batch):
                base, more = found_in(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans(base), spans(more)], ["doc_id", "base", "candidates"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, base array<{SPAN}>, candidates array<{SPAN}>")


def labelled_credentials(found: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, str]]:
    """A bounded sample of the distinct credentials of each kind, as the base matches label them."""
    pairs = found.select(F.explode("base").alias("b")).select("b.kind", "b.value").where(F.length("value").between(LEAST_CANDIDATE, 256)).distinct()
    picks = [pairs.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(most) for k in KINDS]
    return [(r.kind, r.value) for p in picks for r in p.collect()]


def scan_secrets(docs: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """Secrets in every whole text of ``docs``: doc_id, base, added (arrays of kind, start, end, value; added has gain too),
    n_candidates and top_gain.

    base are the matches of the fixed patterns. Every candidate, also one that a base match holds, is scored by the
    automata inferred from ``labelled`` (kind, credential), by default a bounded sample of the corpus' own
    base matches. Of each run of credential characters the candidate that keeps best to a format is added, if it does keep
    to one and no base match has just its place: so a value is told from the name before it, and a credential is
    found where no base pattern stands. gain is by how many bits a character it stays under its format's limit (top_gain: the
    largest of all the text's candidates, added or not; null without any); its
    kind is that of the automaton with 'like_' before it; of equal gains the longer candidate counts. Places are
    code points, ends exclusive; spans are in order of start. Null and empty texts have none; ids may be null or
    repeat, a row gives a row; other columns are ignored; no rows give no rows; without labels nothing is added.
    Only the finds, not the texts, are written between the two passes.
    """
    found = written(find_matches(docs), "matches")
    model = FormatModel.fit(labelled_credentials(found) if labelled is None else labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str | None, float]] = {}
        for batch in batches:
            added, counts, tops = [], [], []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                taken, own = {(b["start"], b["end"]) for b in base}, {}
                for m in more:
                    if len(known) > 100_000:
                        known.clear()
                    if m["value"] not in known:
                        known[m["value"]] = model.best(m["value"])
                    kind, gain = known[m["value"]]
                    if kind and (m["end"] not in own or gain > own[m["end"]]["gain"]):
                        own[m["end"]] = m | {"kind": f"like_{kind}", "gain": gain}
                added.append([m for m in own.values() if (m["start"], m["end"]) not in taken])
                counts.append(len(more))
                tops.append(max((known[m["value"]][1] if m["value"] in known else model.best(m["value"])[1] for m in more), default=None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(added, pa.list_(_ADDED)), pa.array(counts, pa.int64()), pa.array(tops, pa.float64())], ["doc_id", "base", "added", "n_candidates", "top_gain"])

    return found.mapInArrow(run, f"doc_id long, base array<{SPAN}>, added array<{ADDED}>, n_candidates long, top_gain double")
