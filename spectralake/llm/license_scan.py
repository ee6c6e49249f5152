"""License scans: matching statistics against a generalised suffix automaton, chained into template spans."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, utf8

# Phrases whose places are always reported, with their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices of public licences, as text, with their labels.
TEMPLATES = (
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("This work is licensed under a Creative Commons Attribution NonCommercial license, CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike license, CC BY-SA 4.0", "cc-by-sa"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("All rights reserved. No part of this publication may be reproduced without permission", "all-rights-reserved"),
)
#: ASCII letters become small, digits stay, all other ASCII parts words; what is not ASCII belongs to words.
_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

SCHEMA = "doc_id long, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,start:long,end:long,coverage:double>>, coverage double"


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.translate(_WORD_BYTES).split()


@dataclass
class SuffixAutomaton:
    """Every run of tokens of every template, in one automaton.

    ``at`` has, for each state, where its strings end: every position in every template.
    """

    next: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    at: list[dict] = field(default_factory=lambda: [{}])

    def _state(self, length: int, at: dict) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.at.append(at)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The strings of ``q`` that are no longer than one token after ``p``, as a state of their own."""
        clone = self._state(self.length[p] + 1, {k: [*at] for k, at in self.at[q].items()})
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, template: int, tokens: list[int]) -> None:
        last = 0
        for i, token in enumerate(tokens):
            p, q = last, self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
            else:
                last = self._state(self.length[p] + 1, {})
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][token]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
            v = last
            while v > 0:
                self.at[v].setdefault(template, []).append(i + 1)
                v = self.link[v]

    def walk(self, tokens: list[int]) -> int:
        state = 0
        for t in tokens:
            state = self.next[state][t]
        return state

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each place, the state and the length of the longest run ending there that some template has."""
        state = length = 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(t, 0)
            length = length + 1 if state else 0
            yield state, length


class Scanner:
    """The automaton of ``templates`` and ``phrases`` with what a scan needs; a few kilobytes, sent with the tasks."""

    def __init__(self, phrases=BASE_PHRASES, templates=TEMPLATES, least: int = 3, gap: int = 8, cover: float = 0.6):
        self.phrases, self.least, self.gap, self.cover = [(words(p.encode()), label) for p, label in phrases], least, gap, cover
        self.templates = [(words(t.encode()), label) for t, label in templates]
        vocabulary = sorted({w for ws, _ in [*self.phrases, *self.templates] for w in ws})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = SuffixAutomaton()
        for k, (ws, _) in enumerate([*self.templates, *self.phrases]):
            self.automaton.add(k, [self.ids[w] for w in ws])
        own: dict[int, list[int]] = {}
        for k, (ws, _) in enumerate(self.phrases):
            own.setdefault(self.automaton.walk([self.ids[w] for w in ws]), []).append(k)
        self.ending: list[list[int]] = []  # phrases that end wherever a state's longest string ends
        for v in range(len(self.automaton.next)):
            found, u = [], v
            while u > 0:
                found += own.get(u, [])
                u = self.automaton.link[u]
            self.ending.append(found)
        self.shortest = min([least, *(len(ws) for ws, _ in self.phrases)])

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Chains of matches (text start, template start, length) as (start, end, template words they cover).

        In a chain both starts and both ends grow, and at most ``gap`` words of the text lie between a match and the next.
        Each match ends the best chain that can lead to it; of all these the best that do not meet in the text are
        taken, of equal ones the first. Matches are no longer than a template, so few can come before another.
        """
        matches = sorted(set(matches))
        covers, begins, first = [], [], 0
        longest = max(n for _, _, n in matches)
        for j, (a, b, n) in enumerate(matches):
            best, begin = n, a
            while matches[first][0] + longest + self.gap < a:
                first += 1
            for i in range(first, j):
                a0, b0, n0 = matches[i]
                if a0 < a and b0 < b and a0 + n0 < a + n and b0 + n0 < b + n and a - a0 - n0 <= self.gap:
                    own = covers[i] + n - max(0, a0 + n0 - a, b0 + n0 - b)
                    if own > best:
                        best, begin = own, begins[i]
            covers.append(best)
            begins.append(begin)
        taken: list[tuple[int, int, int]] = []
        for j in sorted(range(len(matches)), key=lambda j: (-covers[j], begins[j], matches[j])):
            start, end = begins[j], matches[j][0] + matches[j][2]
            k = bisect.bisect(taken, (start, end, 0))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (start, end, covers[j]))
        return taken

    def scan(self, found: list[bytes]) -> tuple[list, list, float]:
        """Places of the base phrases (label, word), template spans (label, start, end, coverage) of a text's words, and the
        largest coverage of any chain, be it a span or not."""
        get = self.ids.get
        ids = np.array([get(w, -1) for w in found], np.int32)
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        places, matches = [], {}
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start < self.shortest:
                continue
            steps = [*self.automaton.statistics(ids[start:end].tolist()), (0, 0)]
            for i, (state, length) in enumerate(steps[:-1]):
                for k in self.ending[state]:
                    if len(self.phrases[k][0]) <= length:
                        places.append((self.phrases[k][1], start + i + 1 - len(self.phrases[k][0])))
                if length >= self.least and steps[i + 1][1] != length + 1:  # it cannot be made longer
                    for t, stops in self.automaton.at[state].items():
                        if t < len(self.templates):
                            matches.setdefault(t, []).extend((start + i + 1 - length, stop - length, length) for stop in stops)
        spans, top = [], 0.0
        for t, own in matches.items():
            ws, label = self.templates[t]
            chains = [(label, a, b, c / len(ws)) for a, b, c in self._chains(own)]
            top = max([top, *(c[3] for c in chains)])
            spans += [c for c in chains if c[3] >= self.cover]
        return sorted(places, key=lambda x: (x[1], x[0])), sorted(spans, key=lambda x: (x[1], x[2], x[0], -x[3])), top


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Licence phrases and notices in every whole text of ``docs`` (doc_id, text), in one pass without a shuffle.

    Returns doc_id, n_words, places (each base phrase's label and first word) and spans: runs of words that a
    licence notice covers, by chaining its long matches, with the part of the notice they cover (at least
    ``cover``), and coverage: the largest part of a notice that any chain covers, spans or not. The automaton only ever sees runs of licence words, since no match can reach across others.
    Null and empty texts have no words and no finds; ids may be null or repeat, a row gives a row; other
    columns are ignored. Places may overlap and are all given, in order of word and label.
    """
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = {"doc_id": part.column("doc_id"), "n_words": [], "places": [], "spans": [], "coverage": []}
                for text in utf8(part.column("text")):
                    found = words(text)
                    places, spans, coverage = scanner.scan(found)
                    out["n_words"].append(len(found))
                    out["coverage"].append(coverage)
                    out["places"].append([{"label": a, "word": b} for a, b in places])
                    out["spans"].append([dict(zip(("label", "start", "end", "coverage"), s, strict=True)) for s in spans])
                yield pa.RecordBatch.from_pydict(out, schema=ARROW)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))), ("coverage", pa.float64()),
])
