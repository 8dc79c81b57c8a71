"""License scan: matching statistics of whole texts against a generalised suffix automaton of license templates."""

from __future__ import annotations

import functools
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that are reported wherever they stand, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public license notices and the operative sentences of public licenses (fixed values), by label.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

# Matches of at least so many words are chained, over gaps of at most so many words, into a span of their template.
LONG, GAP = 3, 12
# A span that covers this share of its template gives the template's label.
COVERED = 0.75
# Word bytes after translation: digits, lower-case letters and everything beyond ASCII; the rest separates.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of the text: A-Z lower-cased, cut at ASCII characters that are neither letter nor digit."""
    return text.encode().translate(_TABLE).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; ``ends`` has, by state, the sequences (as bits) that contain its words, ``at`` where they end in each."""

    step: list[dict[int, int]]
    link: list[int]
    longest: list[int]
    ends: list[int]
    at: list[dict[int, tuple[int, ...]]]

    @classmethod
    def of(cls, sequences: list[list[int]]) -> Automaton:
        self = cls([{}], [-1], [0], [0], [{}])
        for bit, sequence in enumerate(sequences):
            last, spine = 0, []
            for word in sequence:
                last = self._extend(last, word)
                spine.append(last)
            for place, state in enumerate(spine):
                while state > 0:
                    self.ends[state] |= 1 << bit
                    self.at[state][bit] = (*self.at[state].get(bit, ()), place)
                    state = self.link[state]
        return self

    def _new(self, longest: int, like: int | None = None) -> int:
        self.step.append({} if like is None else dict(self.step[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.ends.append(0 if like is None else self.ends[like])
        self.at.append({} if like is None else dict(self.at[like]))
        self.longest.append(longest)
        return len(self.step) - 1

    def _extend(self, last: int, word: int) -> int:
        if (known := self.step[last].get(word)) is not None and self.longest[known] == self.longest[last] + 1:
            return known
        state = self._new(self.longest[last] + 1) if known is None else -1
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
            return state
        q = self.step[p][word]
        target = q
        if self.longest[q] != self.longest[p] + 1:
            target = self._new(self.longest[p] + 1, like=q)
            while p >= 0 and self.step[p].get(word) == q:
                self.step[p][word] = target
                p = self.link[p]
            self.link[q] = target
        if state < 0:
            return target
        self.link[state] = target
        return state

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word, the state and length of the longest match that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.longest[state]
            state = self.step[state].get(word, 0)
            length = length + 1 if state else 0
            yield state, length


class Scanner:
    """Templates and phrases compiled once per process."""

    def __init__(self, templates: tuple, phrases: tuple):
        texts = [words_of(p) for p, _ in phrases] + [words_of(t) for _, t in templates]
        self.phrases, self.templates = phrases, templates
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        numbered = [[self.numbers[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in numbered[len(phrases) :]]
        self.automaton = Automaton.of(numbered)
        # The state of each phrase, for finding it as a suffix of a match.
        self.phrase_at: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(numbered[: len(phrases)]):
            state = 0
            for word in sequence:
                state = self.automaton.step[state][word]
            self.phrase_at.setdefault(state, []).append((len(sequence), k))
        # Phrases of one word have no neighbour that would mark them.
        self.alone = np.unique([s[0] for s in numbered if len(s) == 1]).astype(np.int32)
        n = len(self.numbers)
        self.pairs = np.zeros((n + 1, n + 1), bool)
        for sequence in numbered:
            self.pairs[sequence[:-1], sequence[1:]] = True

    def scan(self, text: str) -> tuple:
        """Words, phrase places (first word, phrase), template spans (first, last word, template, share covered)."""
        words = words_of(text)
        get, none = self.numbers.get, len(self.numbers)
        ids = np.fromiter((get(w, none) for w in words), np.int32, len(words))
        # A match of two words or more runs over neighbours that stand so in a template; only such stretches are streamed.
        joined = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        places, matches = [], []
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            self._stretch(ids[begin : end + 1].tolist(), begin, places, matches)
        if len(self.alone):
            apart = np.isin(ids, self.alone)
            if len(ids) > 1:
                apart[:-1] &= ~joined
                apart[1:] &= ~joined
            for begin in np.flatnonzero(apart).tolist():
                self._stretch([int(ids[begin])], begin, places, matches)
        return len(words), places, self._chains(matches)

    def _stretch(self, ids: list[int], begin: int, places: list, matches: list) -> None:
        a, before = self.automaton, (0, 0)
        for i, (state, length) in enumerate(a.statistics(ids)):
            if before[1] >= length and before[1] >= LONG:  # the match before this word could not be prolonged
                matches.append((begin + i - 1, before[1], a.at[before[0]]))
            before = state, length
            while state > 0:
                for size, k in self.phrase_at.get(state, ()):
                    if size <= length:
                        places.append((begin + i - size + 1, k))
                state = a.link[state]
        if before[1] >= LONG:
            matches.append((begin + len(ids) - 1, before[1], a.at[before[0]]))

    def _chains(self, matches: list) -> list[tuple[int, int, int, float]]:
        """Spans: chains of matches that advance in the text and in the template, with the share of the template's words in them."""
        spans, skip = [], len(self.phrases)
        pieces = defaultdict(list)
        for last, length, at in matches:
            for bit, places in at.items():
                if bit >= skip:
                    pieces[bit - skip].extend((last, place, length) for place in places)
        for t, parts in pieces.items():
            todo = [parts]
            while todo:
                parts = todo.pop()
                found = _best_chains(parts, COVERED * self.sizes[t])
                spans.extend((first, last, t, covered / self.sizes[t]) for first, last, covered in found)
                if found:  # what lies between the chains may hold others
                    todo.extend(_between(parts, [(first, last) for first, last, _ in found]))
        return sorted(spans)


def _best_chains(parts: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """First word, last word and covered template words of disjoint chains of at least ``least`` words, in text order.

    The fullest chain goes first, of equally full ones the shortest. A part is its last word in the text, the one in the template, and its length; parts come by last word. Where two overlap on either
    side, the later one gives up its first words, so no word of the text or the template counts twice. A chain advances in the template
    with every part, so only parts near in the text are compared, however long the text is.
    """
    best: list[tuple[int, int]] = []  # by part, covered words and first word of the fullest chain that ends with it
    for i, (last, place, length) in enumerate(parts):
        own = length, last - length + 1
        for j in range(i - 1, -1, -1):
            before, there, _ = parts[j]
            if last - length + 1 - before > GAP:
                break
            lost = max(0, before - last + length, there - place + length)
            if lost < length and last - length + 1 + lost - before <= GAP:
                own = max(own, (best[j][0] + length - lost, best[j][1]))
        best.append(own)
    ranked = sorted((-covered, last - first, last) for (covered, first), (last, _, _) in zip(best, parts) if covered >= least)
    chosen: list[tuple[int, int, int]] = []
    for minus, extent, last in ranked:
        place = bisect(chosen, (last,))
        first = last - extent
        if (place == 0 or chosen[place - 1][1] < first) and (place == len(chosen) or chosen[place][0] > last):
            chosen.insert(place, (first, last, -minus))
    return chosen


def _between(parts: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """The parts, cut to each stretch of text before, between and after the taken ones (in text order), where ``LONG`` words are left."""
    free: list[list[tuple[int, int, int]]] = [[] for _ in range(len(taken) + 1)]
    for last, place, length in parts:
        k = bisect(taken, (last - length + 1, -1))
        while k <= len(taken):
            low = taken[k - 1][1] + 1 if k else 0
            high = taken[k][0] - 1 if k < len(taken) else last
            if low > last:
                break
            cut = max(0, last - high)
            left = last - cut - max(low, last - length + 1) + 1
            if left >= LONG:
                free[k].append((last - cut, place - cut, left))
            k += 1
    return [sorted(f) for f in free if f]


@functools.cache
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(templates, phrases)


RESULT = (
    "n_words long, phrases array<struct<word:long,label:string>>, "
    "spans array<struct<first_word:long,last_word:long,label:string,template:int,covered:double>>, score double"
)


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``RESULT``: every phrase place, every covered template span, and a score.

    The score is the largest share of a template that a span covers, at least 0.5 where a phrase stands, else 0. Texts are read
    whole; null and empty ones have no words. Repeated rows and null ids give a row each; other columns are not returned; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    templates, listed = tuple(templates), tuple(phrases.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, listed)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, places, spans = scanner.scan(text.as_py() or "")
                score = max([0.5 if places else 0.0, *(s[3] for s in spans)])
                places = [{"word": w, "label": listed[k][1]} for w, k in sorted(places)]
                spans = [{"first_word": a, "last_word": b, "label": templates[t][0], "template": t, "covered": c} for a, b, t, c in spans]
                rows.append((n, places, spans, score))
            place = pa.struct([("word", pa.int64()), ("label", pa.string())])
            span = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("template", pa.int32()), ("covered", pa.float64())])
            kinds = (pa.int64(), pa.list_(place), pa.list_(span), pa.float64())
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "n_words", "phrases", "spans", "score"])

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)
