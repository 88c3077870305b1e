"""Licence scans with a generalised suffix automaton.

One automaton holds the words of all licence templates and base phrases. A document is streamed through it once,
which gives at each word the longest run ending there that also occurs in a template (matching statistics). Long
runs are chained, in order in both the document and the template, into spans with the share of the template
that they cover; base phrases are read off the same states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases the contract names, then public licence notices as their texts have them.
BASE_PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}

#: Bytes that part words; A-Z become a-z.
SPLIT = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))
MIN_RUN = 3
MAX_GAP = 12
MIN_COVER = 0.8

SPANS = "array<struct<label:string,start:long,stop:long,cover:double>>"
FOUND = f"doc_id long, n_words long, base array<struct<label:string,start:long>>, spans {SPANS}"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SPLIT).split()


class LicenceAutomaton:
    """Generalised suffix automaton over word numbers (0 is a word that no template has)."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES):
        self.texts = [(label, words_of(t)) for label, ts in templates.items() for t in ts]
        self.phrases = [(label, words_of(t)) for label, t in phrases.items()]
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.texts + self.phrases):
            at = 0
            for i, w in enumerate(words):
                at = self._extend(at, self.number.setdefault(w, len(self.number) + 1))
                if k < len(self.texts):
                    ends.setdefault(at, []).append((k, i))
        #: Where in the templates a state's strings end, its own ends and those of the longer strings below it.
        self.ends: list[list[tuple[int, int]]] = [list(ends.get(s, ())) for s in range(len(self.next))]
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]].extend(self.ends[s])
        #: The phrases that are suffixes of a state's strings, by their lengths.
        own: dict[int, list[tuple[str, int]]] = {}
        for label, words in self.phrases:
            at = 0
            for w in words:
                at = self.next[at][self.number[w]]
            own.setdefault(at, []).append((label, len(words)))
        self.phrase_at: list[list[tuple[str, int]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.phrase_at[s] = own.get(s, []) + self.phrase_at[self.link[s]]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's string followed by c, with no longer string in it."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """The base phrases with their starts, and the spans (label, start, stop, cover)."""
        follow, link, length, get = self.next, self.link, self.length, self.number.get
        base, runs, state, run, before = [], [], 0, 0, -2
        for i, c in [(i, c) for i, w in enumerate(words) if (c := get(w))]:
            was, was_run = state, run
            if i != before + 1:
                state = run = 0
            while state and c not in follow[state]:
                state = link[state]
                run = length[state]
            if was_run >= MIN_RUN and (not state or run < was_run):
                runs.append((before, was_run, was))  # a run that goes no further
            state = follow[state].get(c, 0)
            run = run + 1 if state else 0
            before = i
            for label, n in self.phrase_at[state]:
                if n <= run:
                    base.append((label, i - n + 1))
        if run >= MIN_RUN:
            runs.append((before, run, state))
        return base, self._chain(runs)

    def _chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Greedy chains in document order, one per template at a time; a break in order or a wide gap ends one."""
        open_, done = {}, []
        for end, n, state in runs:
            for k, at in sorted(set(self.ends[state])):
                if at - n + 1 < 0:
                    continue
                size, chain = len(self.texts[k][1]), open_.get(k)
                if chain and at > chain[2] and end - n - chain[1] <= MAX_GAP:
                    fresh = min(n, at - chain[2], end - chain[1])
                    open_[k] = (chain[0], end, at, chain[3] + max(fresh, 0), size)
                elif not chain or chain[3] / chain[4] < MIN_COVER and n >= chain[3]:
                    open_[k] = (end - n + 1, end, at, n, size)
                elif end - chain[1] > MAX_GAP:
                    done.append((k, chain))
                    open_[k] = (end - n + 1, end, at, n, size)
        done.extend(open_.items())
        best = [(self.texts[k][0], a, b, min(1.0, n / size)) for k, (a, b, _, n, size) in done if n / size >= MIN_COVER]
        return sorted(set(best), key=lambda s: (s[1], s[2], s[0]))


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base phrases (label, start) and template spans.

    A null text is an empty one and gives empty lists. Whole texts are streamed, a batch of rows at a time; nothing
    is shuffled. Repeated rows are scanned each; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    wide = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LicenceAutomaton()
        for batch in batches:
            counts, bases, spans = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                base, found = automaton.scan(words)
                counts.append(len(words))
                bases.append([{"label": a, "start": b} for a, b in base])
                spans.append([{"label": a, "start": b, "stop": c + 1, "cover": d} for a, b, c, d in found])
            columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(bases, kind), pa.array(spans, wide)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, FOUND)


def licence_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns. Labels are '' where there are none; score is the largest cover, 1 for a base phrase."""
    found, base, spans = scan_licences(docs), F.col("base"), F.col("spans")
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        names(base["label"]).alias("base_labels"),
        names(F.concat(base["label"], spans["label"])).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(spans["cover"]), F.lit(0.0))).alias("score"),
    )
