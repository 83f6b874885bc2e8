"""License scans (operator 5): matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds the word sequences of all templates and phrases. A text's words stream through it once; every
place gets the length of the longest run of words ending there that some template contains. Runs that are long enough
and stand in one template's order are chained into spans, and a template is found where its spans cover enough of it.
The base phrases are templates too: they are found through the automaton's suffix links wherever their words stand
consecutively.

Templates are passages that name a licence, and, in an automaton of their own, whole texts of short licences and the notices
of long ones (licences.WHOLE), to which a user may add. Of spans of whole texts that overlap, the one that covers more
words stays, so that licences which share clauses are told apart.

Null texts are empty; empty texts have no words, no places and score 0; texts are streamed whole; repeated rows give
repeated results; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from riskloom.llm.common import map_arrow, words_of
from riskloom.llm.licences import WHOLE

#: Fixed phrases and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed passages of widespread licences: label, then words that stand in its text or notice.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


class Automaton:
    """The suffix automaton of several word sequences; states are list positions, 0 is the root."""

    def __init__(self, sequences: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        self.sequences = sequences
        for n, words in enumerate(sequences):
            state = 0
            for at, word in enumerate(words):
                state = self._extend(state, self.ids.setdefault(word, len(self.ids)))
                self.places[state].add((n, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.places[self.link[state]] |= self.places[state]
        self.places[0] = set()

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state that state reaches by word, with exactly one word more than it; made by a clone if need be."""
        to = self.next[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        clone = self._state(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = clone
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def stream(self, words: list[bytes]):
        """(place, state, length) wherever at least two words match."""
        get, edges, link, length = self.ids.get, self.next, self.link, self.length
        state = size = 0
        for at, word in enumerate(map(get, words)):
            if word is None:
                state = size = 0
                continue
            while state and word not in edges[state]:
                state = link[state]
                size = length[state]
            if word in edges[state]:
                state, size = edges[state][word], size + 1
                if size > 1:
                    yield at, state, size


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], least: int = 3, gap: int = 3, share: float = 0.6):
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.n_phrases, self.least, self.gap, self.share = len(phrases), least, gap, share
        self.automaton = Automaton([words_of(text) for text in [*phrases, *(text for _, text in templates)]])
        a = self.automaton
        ends = {}
        for n in range(self.n_phrases):
            state = 0
            for word in a.sequences[n]:
                state = a.next[state][a.ids[word]]
            ends[state] = (n, len(a.sequences[n]))
        #: Of each state: the phrases that are suffixes of it.
        self.phrases: list[list[tuple[int, int]]] = []
        for state in range(len(a.next)):
            found, s = [], state
            while s > 0:
                if s in ends:
                    found.append(ends[s])
                s = a.link[s]
            self.phrases.append(found)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """The number of words; (start, phrase) of every base place; (start, end, template, covered share) of every span."""
        words = words_of(text)
        a, base = self.automaton, []
        stream = list(a.stream(words))
        for at, state, size in stream:
            base += ((at - k + 1, n) for n, k in self.phrases[state] if k <= size)
        return len(words), base, self.chain(self.runs(stream))

    def runs(self, stream) -> list[tuple[int, int, int]]:
        """(end, state, length) of the maximal matches of a stream that are long enough."""
        out, previous = [], None
        for at, state, size in stream:
            if previous and (at != previous[0] + 1 or size != previous[2] + 1) and previous[2] >= self.least:
                out.append(previous)
            previous = (at, state, size)
        return [*out, previous] if previous and previous[2] >= self.least else out

    def chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Joins matches of one template that follow each other, in its order and with small gaps, into spans."""
        spans: list[tuple[int, int, int, float]] = []
        open_: dict[int, tuple[int, int, int, int]] = {}  # template: text start, text end, template end, words covered

        def close(n):
            start, end, _, covered = open_.pop(n)
            if (part := covered / len(self.automaton.sequences[n])) >= self.share:
                spans.append((start, end + 1, n, min(1.0, part)))

        for end, state, size in runs:
            for n, last in sorted(self.automaton.places[state]):
                if n < self.n_phrases:
                    continue
                start, first = end - size + 1, last - size + 1
                if n in open_:
                    t0, t1, l1, covered = open_[n]
                    new = min(size, last - l1, end - t1)
                    if new > 0 and start - t1 <= self.gap + 1 and first - l1 <= self.gap + 1:
                        open_[n] = (t0, end, last, covered + new)
                        continue
                    if end - t1 <= 0:
                        continue
                    close(n)
                open_[n] = (start, end, last, size)
        for n in list(open_):
            close(n)
        return sorted(spans)


class WholeTexts(Scanner):
    """A scanner of whole licence texts, without phrases."""

    def __init__(self, texts: list[tuple[str, str]], share: float = 0.6):
        super().__init__({}, texts, share=share)

    def spans(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(start, end, text, covered share), without spans that mostly lie in one of another text that covers more words."""
        found = self.chain(self.runs(self.automaton.stream(words_of(text))))
        kept: list[tuple[int, int, int, float]] = []
        for x in sorted(found, key=lambda x: (-x[3] * len(self.automaton.sequences[x[2]]), -x[3], x[2])):
            if not any(2 * (min(x[1], k[1]) - max(x[0], k[0])) > x[1] - x[0] for k in kept):
                kept.append(x)
        return sorted(kept)


@lru_cache(4)
def scanners(more: tuple[tuple[str, str], ...] = ()) -> tuple[Scanner, WholeTexts]:
    return Scanner(PHRASES, TEMPLATES), WholeTexts([*WHOLE, *more])


def license_scan(docs: DataFrame, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans of every row of docs.

    score: 0 without any label, else 0.5 and half of the largest covered share of a template. more: labels and whole texts
    beside those of the module, a bounded list that goes to every task.
    """
    names = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_spans bigint"

    def make():
        s, whole = scanners(more)

        def one(text):
            n, base, spans = s.scan(text)
            texts = whole.spans(text)
            own = {s.labels[k] for _, k in base}
            every = own | {s.labels[k] for _, _, k, _ in spans} | {whole.labels[k] for _, _, k, _ in texts}
            spans = spans + texts
            starts = [at for at, _ in base]
            score = 0.5 + 0.5 * max([x[3] for x in spans], default=0.0) if every else 0.0
            return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(every)), score, len(spans)

        def step(rows):
            cols = list(zip(*map(one, rows["text"]), strict=True)) or [()] * 8
            return dict(zip([p.split()[0] for p in names.split(", ")], [rows["doc_id"], *map(list, cols)], strict=True))

        return step

    return map_arrow(docs, ["doc_id", "text"], names, make)
