"""License scans: matching statistics against a suffix automaton of license wordings.

All wordings are read into one generalised suffix automaton over words.  A text is streamed through it:
at each word the automaton holds the longest run of words ending there that occurs in some wording.  Runs
that cannot be extended to the right are maximal matches; those of one wording are chained in order, and a
wording is reported wherever a chain covers enough of it.

Defined results: null and empty texts have no words and no license; texts of any length are streamed in
full; repeated rows are judged one by one; the longer chain wins a tie of two wordings and both are
reported when both are covered; an empty table gives an empty table.  Only the named columns are read, so
further columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from callgrove.llm.texts import ALNUM, map_rows, utf8, word_hashes

# Phrases that count by themselves, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Standard wordings of public licenses (headers, grants and the usual one-line notices).
WORDINGS = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software"),
    ("apache", "Licensed under the Apache License Version 2 0 the License you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License Version 2 0"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4 0 International License"),
    ("cc-by", "Licensed under CC BY 4 0"),
    ("cc-by-nc", "Licensed under CC BY NC 4 0"),
    ("cc-by-sa", "Licensed under CC BY SA 4 0"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "All rights reserved"),
]


def _words(text: str) -> np.ndarray:
    return word_hashes(np.frombuffer(text.encode(), np.uint8), ALNUM)


@dataclass
class _State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: dict[int, int] = field(default_factory=dict)  # wording: a place in it where the words of this state end
    phrases: list[tuple[int, str]] = field(default_factory=list)


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; built once per task from the short wordings."""

    def __init__(self, wordings: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in wordings]
        texts = [_words(t) for _, t in wordings]
        marks = [_words(p) for p in phrases]
        self.sizes = [len(t) for t in texts]
        self.vocabulary = np.unique(np.concatenate([*texts, *marks]))
        self.states = [_State(0)]
        for k, words in enumerate([*texts, *marks]):
            last = 0
            for place, w in enumerate(np.searchsorted(self.vocabulary, words).tolist()):
                last = self._extend(last, w)
                if k < len(texts):
                    self.states[last].ends[k] = place
        for s in sorted(range(1, len(self.states)), key=lambda i: -self.states[i].length):
            above = self.states[self.states[s].link].ends
            for k, place in self.states[s].ends.items():
                above.setdefault(k, place)
        for words, label in zip(marks, phrases.values(), strict=True):
            s = 0
            for w in np.searchsorted(self.vocabulary, words).tolist():
                s = self.states[s].next[w]
            self.states[s].phrases.append((len(words), label))
        for s in sorted(range(1, len(self.states)), key=lambda i: self.states[i].length):
            self.states[s].phrases += self.states[self.states[s].link].phrases

    def _copy(self, p: int, w: int, q: int) -> int:
        """Split state q: its words of one more than p's length become a state of their own."""
        old = self.states[q]
        self.states.append(_State(self.states[p].length + 1, old.link, dict(old.next)))
        new = len(self.states) - 1
        old.link = new
        while p >= 0 and self.states[p].next.get(w) == q:
            self.states[p].next[w] = new
            p = self.states[p].link
        return new

    def _extend(self, last: int, w: int) -> int:
        if w in self.states[last].next:  # another wording has been here
            q = self.states[last].next[w]
            return q if self.states[q].length == self.states[last].length + 1 else self._copy(last, w, q)
        self.states.append(_State(self.states[last].length + 1))
        new, p = len(self.states) - 1, last
        while p >= 0 and w not in self.states[p].next:
            self.states[p].next[w] = new
            p = self.states[p].link
        if p < 0:
            self.states[new].link = 0
        else:
            q = self.states[p].next[w]
            self.states[new].link = q if self.states[q].length == self.states[p].length + 1 else self._copy(p, w, q)
        return new

    def matches(self, words: np.ndarray, least: int):
        """Places of the phrases as (start, label), and maximal matches of ``least`` words as (start, end, state)."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == words)
        places, runs, states = [], [], self.states
        s, length, before = 0, 0, -2
        for i, w in zip(known.tolist(), at[known].tolist(), strict=True):
            if i != before + 1 and length:
                if length >= least:
                    runs.append((before + 1 - length, before + 1, s))
                s, length = 0, 0
            if w not in states[s].next and length >= least:
                runs.append((i - length, i, s))
            while s and w not in states[s].next:
                s = states[s].link
                length = states[s].length
            if w in states[s].next:
                s, length = states[s].next[w], length + 1
            before = i
            for n, label in states[s].phrases:
                if length >= n:
                    places.append((i + 1 - n, label))
        if length >= least:
            runs.append((before + 1 - length, before + 1, s))
        return places, runs

    def covered(self, runs, slack: int, share: float) -> tuple[dict[int, float], list[tuple[int, int, int]]]:
        """The best share covered of each wording, and first word, end and wording of every chain that reaches ``share``.

        A chain goes forward in the text and in the wording; between two matches up to ``slack`` words of
        the text may stand that are not in the wording.  As matches come in text order, a chain is carried
        on or closed and begun anew at each match: anew if the match covers all the chain does, and if a
        chain that reaches the share would go back by more than ``slack`` words.
        """
        best: dict[int, float] = {}
        spans: list[tuple[int, int, int]] = []
        open_: dict[int, tuple[int, int, int, int]] = {}  # wording: words covered, start, end in text, end in wording

        def close(k):
            words, begun, end, _ = open_[k]
            best[k] = max(best.get(k, 0.0), min(1.0, words / self.sizes[k]))
            if words / self.sizes[k] >= share:
                spans.append((begun, end, k))

        for start, end, s in runs:
            for k, place in self.states[s].ends.items():
                n, first = end - start, place + 1 - (end - start)
                words, begun, lap = 0, start, 0
                if k in open_:
                    words, begun, text_end, own_end = open_[k]
                    twice = max(0, text_end - start)
                    lap = max(twice, own_end - first)
                    back = words / self.sizes[k] >= share and own_end - first > twice + slack
                    if start - text_end > slack + max(0, first - own_end) or lap >= min(n, words) or back:
                        close(k)
                        words, begun, lap = 0, start, 0
                open_[k] = (words + n - lap, begun, end, place + 1)
        for k in open_:
            close(k)
        return best, spans


def scan_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), wordings=WORDINGS, phrases=PHRASES,
                  least: int = 3, share: float = 0.8, slack: int = 8) -> DataFrame:
    """License notices in every whole text, one row per row of ``df``.

    Adds n_words; n_base, first_word, last_word and base_labels of the phrases; labels, which adds wordings
    whose chain of matches of ``least`` words covers ``share`` of them; spans of all such chains, every copy of a
    notice, as ``label:first word:end``; and score, the best share covered (1 where a phrase stands).
    """
    def start():
        sam = SuffixAutomaton(list(wordings), dict(phrases))

        def judge(value):
            words = word_hashes(utf8(value), ALNUM)
            places, runs = sam.matches(words, least)
            found, chains = sam.covered(runs, slack, share)
            base = sorted({label for _, label in places})
            labels = sorted({*base, *(sam.labels[k] for _, _, k in chains)})
            spans = sorted({(a, b, sam.labels[k]) for a, b, k in chains})
            score = 1.0 if places else max([0.0, *found.values()])
            starts = [p for p, _ in places]
            return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels),
                    ",".join(f"{label}:{a}:{b}" for a, b, label in spans), score)

        return judge

    fields = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
              "labels": "string", "spans": "string", "score": "double"}
    return map_rows(df, list(keep), text, fields, start)
