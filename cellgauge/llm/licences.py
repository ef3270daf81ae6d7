"""License scans: matching statistics of files against a suffix automaton of license texts.

One automaton holds every substring of all templates, by words. Files stream
through it once; at each word it knows the longest stretch ending there that
occurs in some template. Long stretches are chained in order per template, and
the share of the template that a chain covers is its score. Fixed phrases are
templates too and are read off the same walk.

The automaton is a constant of a few thousand words that travels with the
task; files are split over tasks by Spark and never shuffled. Words are found
and looked up in numpy; only stretches made of pairs that some template holds
are walked in Python, since no longer match can lie elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.text import OPAQUE, Texts, id_array, ids, span_hash

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as their licenses print them, and lines by which files name a license.
TEMPLATES: Sequence[tuple[str, str]] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("proprietary", "All rights reserved"),
)


def split_words(text: str) -> list[bytes]:
    flat = Texts.of(pa.array([text])).folded()
    starts, ends, _ = flat.tokens(OPAQUE)
    return [flat.buf[a:b].tobytes() for a, b in zip(starts, ends)]


class Automaton:
    """All substrings of several word sequences.

    ``step[s]`` maps a word to the next state, ``link[s]`` is the state of the
    longest suffix with other ends, ``length[s]`` its longest string, and
    ``ends[s]`` lists (sequence, end) of its occurrences.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._append(last, word)
        found: list[set[tuple[int, int]]] = [set() for _ in self.step]
        for k, sequence in enumerate(sequences):
            state = 0
            for i, word in enumerate(sequence):
                state = self.step[state][word]
                up = state
                while up > 0:
                    found[up].add((k, i + 1))
                    up = self.link[up]
        self.ends = [sorted(f) for f in found]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, at: int, word: int, old: int) -> int:
        """A copy of ``old`` for the strings that also end elsewhere."""
        copy = self._new(self.length[at] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = copy
        while at >= 0 and self.step[at].get(word) == old:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def _append(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:  # another sequence has been here
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state, at = self._new(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = state
            at = self.link[at]
        if at >= 0:
            old = self.step[at][word]
            self.link[state] = old if self.length[old] == self.length[at] + 1 else self._split(at, word, old)
        return state

    def walk(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match ending at each word."""
        state = length = 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.step[state]:
                state = self.step[state][word]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]], min_match: int, max_gap: int):
        self.min_match, self.max_gap = min_match, max_gap
        texts = [split_words(p) for p in phrases] + [split_words(t) for _, t in templates]
        self.names = [*phrases.values(), *(name for name, _ in templates)]
        self.n_phrases = len(phrases)
        self.sizes = [len(t) for t in texts]
        self.least = min([min_match, *self.sizes[self.n_phrases:]])  # of a stretch that can hold a match of any template
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        flat = Texts.of(pa.array([" ".join(w.decode() for w in vocabulary)]))
        starts, ends, _ = flat.tokens(OPAQUE)
        hashes = span_hash(flat.prefix(), starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.word_of, self.vocabulary = hashes[order], order, vocabulary
        sequences = [[number[w] for w in t] for t in texts]
        self.machine = Automaton(sequences)
        self.closing: list[list[int]] = []  # phrases that end where a match of the state ends
        for state in range(len(self.machine.step)):
            up, found = state, set()
            while up > 0:
                found |= {k for k, end in self.machine.ends[up] if k < self.n_phrases and end == self.sizes[k] <= self.machine.length[up]}
                up = self.machine.link[up]
            self.closing.append(sorted(found))
        n = len(vocabulary)
        self.pairs, self.phrase_pairs = np.zeros((n + 1, n + 1), bool), np.zeros((n + 1, n + 1), bool)
        for k, s in enumerate(sequences):
            for a, b in zip(s, s[1:]):
                self.pairs[a, b] = True
                self.phrase_pairs[a, b] |= k < self.n_phrases

    def scan(self, part: Texts) -> Iterator[tuple[int, list[tuple[int, int, int]], list[tuple[int, int, int, int]]]]:
        """For each text with any: its phrase places (phrase, start) and template spans (template, first, last, covered)."""
        low = part.folded()
        starts, ends, first = low.tokens(OPAQUE)
        yield -1, first, None
        if len(starts) < 2:
            return
        h = span_hash(low.prefix(), starts, ends)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        word = np.where(self.hashes[slot] == h, self.word_of[slot], len(self.vocabulary))
        ok = self.pairs[word[:-1], word[1:]]
        cut = first[1:-1]
        ok[cut[(cut > 0) & (cut < len(starts))] - 1] = False  # pairs across two texts
        told = self.phrase_pairs[word[:-1], word[1:]] & ok
        edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # words lo..hi, both included
        seen = np.concatenate(([0], np.cumsum(told)))
        keep = (hi - lo + 1 >= self.least) | (seen[hi] > seen[lo])
        lo, hi = lo[keep], hi[keep]
        owner = np.searchsorted(first, lo, side="right") - 1
        i = 0
        while i < len(lo):
            j = int(np.searchsorted(owner, owner[i], side="right"))
            base = int(first[owner[i]])
            places: list[tuple[int, int]] = []
            matches: dict[int, list[tuple[int, int, int]]] = {}
            for a, b in zip(lo[i:j].tolist(), hi[i:j].tolist()):
                words = word[a: b + 1].tolist()
                exact = all(low.buf[starts[a + k]: ends[a + k]].tobytes() == self.vocabulary[w] for k, w in enumerate(words))
                if exact:
                    self._walk(words, a - base, places, matches)
            yield int(owner[i]), places, [span for k, found in matches.items() for span in self._chain(k, found)]
            i = j

    def _walk(self, words: list[int], at: int, places: list, matches: dict) -> None:
        walked = list(self.machine.walk(words))
        for i, (state, length) in enumerate(walked):
            places += [(k, at + i + 1 - self.sizes[k]) for k in self.closing[state] if self.sizes[k] <= length]
            longest = i + 1 == len(walked) or walked[i + 1][1] != length + 1
            if longest:
                for k, end in self.machine.ends[state]:
                    if k >= self.n_phrases and length >= min(self.min_match, self.sizes[k]):
                        matches.setdefault(k, []).append((at + i + 1, end, length))

    def _chain(self, k: int, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """The best chain of matches (text end, template end, length) that keep their order with short gaps."""
        best: list[tuple[int, int]] = []  # words covered so far, first word of the chain
        low = 0
        for i, (text_end, end, length) in enumerate(found):
            top = (length, text_end - length)
            while low < i and found[low][0] < text_end - length - self.max_gap:
                low += 1
            for j in range(low, i):
                # overlapping matches count the overlap once
                new = min(length, text_end - found[j][0], end - found[j][1])
                if new > 0:
                    top = max(top, (best[j][0] + new, best[j][1]))
            best.append(top)
        if best:
            i = max(range(len(best)), key=lambda n: (best[n][0], -n))
            yield k, best[i][1], found[i][0] - 1, min(best[i][0], self.sizes[k])


def _task(scanner: Scanner, min_score: float):
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            words, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            low, high = np.full(n, -1), np.full(n, -1)
            base, labels, score, spans = [""] * n, [""] * n, np.zeros(n), [[] for _ in range(n)]
            for k, part in Texts.of(batch.column("_text")).chunks():
                for i, places, found in scanner.scan(part):
                    if i < 0:
                        words[k: k + len(part)] = np.diff(places)
                        continue
                    i += k
                    at = [p for _, p in places]
                    named = {scanner.names[p] for p, _ in places}
                    total[i] = len(at)
                    if at:
                        low[i], high[i] = min(at), max(at)
                    scores = [(scanner.names[t], a, b, c / scanner.sizes[t]) for t, a, b, c in found]
                    spans[i] = [dict(zip(("label", "first", "last", "score"), s)) for s in sorted(scores, key=lambda s: (s[1], s[2], s[0])) if s[3] >= min_score]
                    score[i] = max((s[3] for s in scores), default=0.0)
                    base[i], labels[i] = ",".join(sorted(named)), ",".join(sorted(named | {s["label"] for s in spans[i]}))
            none = low < 0
            yield pa.RecordBatch.from_arrays(
                [id_array(ids(batch.column("_id"))), pa.array(words), pa.array(total), pa.array(low, mask=none), pa.array(high, mask=none), pa.array(base), pa.array(labels), pa.array(score), pa.array(spans, pa.list_(span))],
                ["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return run


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, min_match: int = 4, max_gap: int = 12, min_score: float = 0.8,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Words are runs of digits, letters and non-ASCII characters with A-Z in
    lower case. ``n_base`` counts the places of ``phrases`` (two words at
    least), ``first_word`` and ``last_word`` are the smallest and largest
    start. ``spans`` are the chains that cover at least ``min_score`` of a
    template, the best of each template; ``labels`` joins their names to the
    phrases'. ``score`` is the largest share of any template that is covered.
    Matches shorter than ``min_match`` words count only where the template is
    as short. Null or empty text: no words, empty labels, score 0. Each row
    gets its row.
    """
    scanner = Scanner(phrases, templates, min_match, max_gap)
    schema = "_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, last: bigint, score: double>>"
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(_task(scanner, min_score), schema).withColumnRenamed("_id", id_col)
