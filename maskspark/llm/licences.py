"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every template. A text streams through it and gets matching statistics: at each word, the longest
sequence of words ending there that occurs in some template. Matches that can't be extended and are long enough are
chained, template by template, into covered spans, by dynamic programming over places in the text and in the template. Only stretches of words whose neighbours follow each other somewhere in
a template can match three words or more, so numpy picks these and nothing else enters the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .words import ALNUM, LOWER, Block, block_of, hash_of, hashes, lookup, spans

#: Phrases whose every place counts as a base place, with their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Labels with short notices and with longer passages of the licences' own texts.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-2", "licensed under the mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)
#: Words of a match that counts; words that a chain may skip; share of a template that names it; templates up to SHORT words must be whole.
LEAST, GAP, COVERAGE, SHORT = 4, 8, 0.6, 14


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (template, place of the last word)
    phrases: list[int] = field(default_factory=list)  # templates that end here whole, themselves or by links


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences, by online extension from the root for each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.sequences = sequences
        self.states = [State(0, -1)]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
        own: list[list[tuple[int, int]]] = [[] for _ in self.states]
        for k, sequence in enumerate(sequences):
            state = 0
            for at, token in enumerate(sequence):
                state = self.states[state].next[token]
                own[state].append((k, at))
            if self.states[state].length >= len(sequence):
                self.states[state].phrases.append(k)
        for i in sorted(range(1, len(self.states)), key=lambda i: -self.states[i].length):
            self.states[i].ends = sorted(set(own[i]))
            own[self.states[i].link].extend(own[i])
        for i in sorted(range(1, len(self.states)), key=lambda i: self.states[i].length):
            self.states[i].phrases += self.states[self.states[i].link].phrases

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        if (q := states[last].next.get(token)) is not None:
            return q if states[q].length == states[last].length + 1 else self._clone(last, q, token)
        now = len(states)
        states.append(State(states[last].length + 1, 0))
        p = last
        while p >= 0 and token not in states[p].next:
            states[p].next[token] = now
            p = states[p].link
        if p >= 0:
            q = states[p].next[token]
            states[now].link = q if states[q].length == states[p].length + 1 else self._clone(p, q, token)
        return now

    def _clone(self, p: int, q: int, token: int) -> int:
        states = self.states
        clone = len(states)
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next)))
        states[q].link = clone
        while p >= 0 and states[p].next.get(token) == q:
            states[p].next[token] = clone
            p = states[p].link
        return clone

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: the state and the length of the longest match that ends at each token."""
        states, state, length = self.states, 0, 0
        for token in tokens:
            while state and token not in states[state].next:
                state = states[state].link
                length = states[state].length
            if (q := states[state].next.get(token)) is not None:
                state, length = q, length + 1
            yield state, length


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        texts = [*base, *templates]
        self.labels = [label for label, _ in texts]
        self.n_base = len(base)
        words = [text.split() for _, text in texts]
        self.word_of = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        sequences = [[self.word_of[w] for w in ws] for ws in words]
        self.automaton = SuffixAutomaton(sequences)
        self.lengths = [len(s) for s in sequences]
        keys = np.array([hash_of(w) for w in self.word_of], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.follows = np.zeros((len(self.word_of),) * 2, bool)
        for s in sequences:
            self.follows[s[:-1], s[1:]] = True

    def stretches(self, block: Block) -> tuple[np.ndarray, Iterator[tuple[int, int, list[int]]]]:
        """The number of words of each text, and (text, first word, words' numbers) of all stretches that may match."""
        n = len(block.offsets) - 1
        low = LOWER[block.data] if len(block.data) else block.data
        a, z, t = spans(ALNUM[low] if len(low) else np.zeros(0, bool), block.offsets)
        counts = np.bincount(t, minlength=n)
        begins = np.cumsum(counts) - counts
        at = lookup(self.keys, hashes(low, a, z))
        code = np.where(at >= 0, self.order[np.maximum(at, 0)], -1)
        pair = np.zeros(len(code), bool)  # a word and its next
        pair[:-1] = (code[:-1] >= 0) & (code[1:] >= 0) & (t[:-1] == t[1:]) & self.follows[code[:-1], code[1:]]
        first, last, _ = spans(pair, np.array([0, len(pair)]))

        def found():
            for i, j in zip(first.tolist(), last.tolist()):
                if j - i < 2:
                    continue
                tokens = [self.word_of.get(low[a[k] : z[k]].tobytes().decode("utf-8", "replace"), -1) for k in range(i, j + 1)]
                yield int(t[i]), int(i - begins[t[i]]), tokens

        return counts, found()

    def scan(self, block: Block) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each text.

        spans: label:first:end (words, end exclusive) of the labelled templates' best chains, comma-joined by first.
        """
        counts, stretches = self.stretches(block)
        bases: dict[int, list[tuple[int, int]]] = {}
        matches: dict[int, list[tuple[int, int, int]]] = {}
        states = self.automaton.states
        for text, first, tokens in stretches:
            before = (0, 0)
            for i, (state, length) in enumerate(self.automaton.stream(tokens)):
                for k in states[state].phrases:
                    if k < self.n_base and length >= self.lengths[k]:
                        bases.setdefault(text, []).append((first + i - self.lengths[k] + 1, k))
                if before[1] >= LEAST and length <= before[1]:
                    matches.setdefault(text, []).append((first + i, *before))
                before = (state, length)
            if before[1] >= LEAST:
                matches.setdefault(text, []).append((first + len(tokens), *before))
        out = []
        for text, n in enumerate(counts.tolist()):
            base = bases.get(text, [])
            chains = self._chains(matches.get(text, []))
            named = {self.labels[k] for _, k in base}
            labels = named | {self.labels[k] for k, (_, _, _, whole) in chains.items() if whole}
            places = sorted({(a, z, self.labels[k]) for k, (_, a, z, whole) in chains.items() if whole} | {(p, p + self.lengths[k], self.labels[k]) for p, k in base})
            score = 1.0 if base else max((share for share, *_ in chains.values()), default=0.0)
            starts = [p for p, _ in base]
            out.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), score, ",".join(f"{x}:{a}:{z}" for a, z, x in places)))
        return out

    def _anchors(self, matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """For each template: (end in the text, end in the template, length) of the longest match at every pair of places where
        a match ends; shorter ones come by the suffix links."""
        states = self.automaton.states
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for end, state, length in matches:
            seen: set[tuple[int, int]] = set()
            while length >= LEAST:
                for k, at in states[state].ends:
                    if (k, at) not in seen:
                        anchors.setdefault(k, []).append((end, at + 1, length))
                seen.update(states[state].ends)
                state = states[state].link
                length = states[state].length
        return anchors

    def _chains(self, matches: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int, bool]]:
        """For each template: its best chain's share of it, first and end word in the text, and whether that names it.

        A chain is a sequence of matches that ascends in the text, skipping up to GAP words there, and in the template. A
        match adds the words that lie behind the chain in both. The best chain covers most; of equal ones, the one of fewest
        words in the text, then the first. Found by dynamic programming over the matches' ends.
        """
        best: dict[int, tuple[float, int, int, bool]] = {}
        for k, anchors in self._anchors(matches).items():
            anchors.sort()
            chains: list[tuple[int, int]] = []  # (covered, first) of the best chain that ends with each anchor
            top = (0, 0, 0)  # covered, minus its words in the text, minus its first word
            for i, (end, at, length) in enumerate(anchors):
                now = (length, end - length)
                for j in range(i - 1, -1, -1):
                    if anchors[j][0] < end - length - GAP:
                        break
                    new = min(length, end - anchors[j][0], at - anchors[j][1])
                    if new > 0:
                        now = max(now, (chains[j][0] + new, chains[j][1]))
                chains.append(now)
                top = max(top, (now[0], now[1] - end, -now[1]))
            covered, extent, first = top[0], -top[1], -top[2]
            share = min(1.0, covered / self.lengths[k])
            whole = covered == self.lengths[k] == extent if self.lengths[k] <= SHORT else share >= COVERAGE
            best[k] = (share, first, first + extent, whole)
        return best


@lru_cache(maxsize=4)
def scanner(base=BASE, templates=TEMPLATES) -> Scanner:
    """One per worker process."""
    return Scanner(base, templates)


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row, where it lies.

    Words are runs of ASCII letters, digits and any characters beyond ASCII, A-Z as a-z. score: the largest share of a
    template that a chain covers, 1 for a base phrase. Null and empty texts have no words and no labels. Equal rows give
    equal rows. Other columns are not read. An empty table gives no rows.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(base, templates).scan
        for batch in batches:
            for part in blocks(batch, "text"):
                columns = zip(*scan(block_of(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
