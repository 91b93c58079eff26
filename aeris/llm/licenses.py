"""Licence scan with a generalised suffix automaton.

The automaton is built over the words of all licence templates and base phrases. A text's words are streamed
through it; after each word the automaton's state gives the longest suffix of the words read so far that
occurs in some template (the matching statistic). A base phrase ends at a word exactly when its state lies on
the suffix links of the current state, so base phrases need no second scan. Matches of at least
``MIN_MATCH`` words that cannot be extended are looked up in the templates and chained per template in text
and template order (gaps of at most ``MAX_GAP`` words); the chain that covers most of a template is its
covered span, and a share of ``MIN_COVER`` or more labels the text.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Null and empty texts have no words
and no labels. Every row has one row in the result, repeated rows too; other columns are ignored; an empty
table gives an empty result. Only words of templates can match, so the stream skips runs of fewer than three
such words; nothing of a text is cut off.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeris.llm.common import as_bytes, sliced, words_of

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence notices (permission or notice paragraphs) and their labels.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "gpl-2": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License.""",
    "cc-by-sa": """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International
License.""",
    "cc-by-nc": """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International
License.""",
}

MIN_MATCH = 6
MAX_GAP = 40
MIN_COVER = 0.6


class LicenceAutomaton:
    """Generalised suffix automaton of word sequences; ``places[state]`` lists where (sequence, end) its words end."""

    def __init__(self, sequences: list[tuple[str, bool, list[bytes]]]):
        self.sequences = sequences
        #: shorter runs of known words hold neither a phrase nor a match
        self.least = min([MIN_MATCH, *(len(words) for _, base, words in sequences if base)])
        self.vocabulary: dict[bytes, int] = {}
        self.next, self.link, self.len, ends = [{}], [-1], [0], [[]]
        for k, (_, _, words) in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), ends)
                ends[last].append((k, i + 1))
        # ends flow up the suffix links, longest states first
        order = sorted(range(1, len(self.next)), key=lambda s: -self.len[s])
        all_ends = [set(e) for e in ends]
        for s in order:
            if self.link[s] > 0:
                all_ends[self.link[s]] |= all_ends[s]
        self.places = [sorted(e) for e in all_ends]
        # base phrases that end whenever the state is reached with at least that many words
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        own: dict[int, list[tuple[int, int]]] = {}
        for k, (_, base, words) in enumerate(sequences):
            if base:
                s = 0
                for w in words:
                    s = self.next[s][self.vocabulary[w]]
                own.setdefault(s, []).append((k, len(words)))
        for s in reversed(order):
            self.phrases[s] = own.get(s, []) + (self.phrases[self.link[s]] if self.link[s] > 0 else [])

    def _extend(self, last: int, symbol: int, ends: list) -> int:
        if symbol in self.next[last]:  # known from an earlier sequence
            q = self.next[last][symbol]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, symbol, q, ends)
        cur = self._state({}, 0, self.len[last] + 1, ends)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, symbol, q, ends)
        return cur

    def _clone(self, p: int, symbol: int, q: int, ends: list) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1, ends)
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _state(self, moves, link, length, ends) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        ends.append([])
        return len(self.next) - 1

    def stream(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base phrases ``(start, sequence)`` and unextendable matches ``(end, length, state)`` of a text's
        word codes (-1: not a template word). A word outside the vocabulary empties the match."""
        phrases: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        known = np.flatnonzero(codes >= 0)
        if not len(known):
            return phrases, matches
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        starts, stops = known[np.r_[0, cut]], known[np.r_[cut - 1, len(known) - 1]] + 1
        wide = stops - starts >= self.least
        nxt, link, size, base = self.next, self.link, self.len, self.phrases
        for a, b in zip(starts[wide].tolist(), stops[wide].tolist(), strict=True):
            state, length = 0, 0
            for i, c in enumerate(codes[a:b].tolist(), a):
                to = nxt[state].get(c)
                if to is None:
                    if length >= MIN_MATCH:
                        matches.append((i, length, state))
                    while state and to is None:
                        state = link[state]
                        length = size[state]
                        to = nxt[state].get(c)
                    if to is None:
                        continue
                state, length = to, length + 1
                for k, n in base[state]:
                    if length >= n:
                        phrases.append((i + 1 - n, k))
            if length >= MIN_MATCH:
                matches.append((b, length, state))
        return phrases, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Per template: the covered share of its best chain, and the chain's words in the text."""
        by_template: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, length, state in matches:
            for k, e in self.places[state]:
                if not self.sequences[k][1]:
                    by_template.setdefault(k, []).append((end - length, end, e - length, e))
        best: dict[int, tuple[float, int, int]] = {}
        for k, found in by_template.items():
            found.sort()
            score: list[tuple[int, int]] = []  # covered words of the best chain ending here, its start
            for i, (s, e, ts, te) in enumerate(found):
                top, begin = te - ts, s
                for j in range(i - 1, -1, -1):
                    ps, pe, pts, pte = found[j]
                    if s - ps > MAX_GAP + len(self.sequences[k][2]):
                        break
                    if s - pe <= MAX_GAP and pts < ts and pte < te and ps < s:
                        # overlapping ends (in either text) count once
                        gain = min(te - max(ts, pte), e - max(s, pe))
                        if gain > 0 and score[j][0] + gain > top:
                            top, begin = score[j][0] + gain, score[j][1]
                score.append((top, begin))
                share = top / len(self.sequences[k][2])
                if share > best.get(k, (0.0, 0, 0))[0]:
                    best[k] = (min(1.0, share), begin, e)
        return best


def automaton(templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> LicenceAutomaton:
    return LicenceAutomaton([(label, True, phrase.encode().split()) for phrase, label in base.items()]
                            + [(label, False, words_of(text.encode())) for label, text in templates.items()])


_KIND = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
         "score double, spans array<struct<label:string,first:long,end:long,share:double>>")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
                 base: dict[str, str] = BASE, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: word and base-phrase counts, first and last start of a base phrase (null without
    one), labels (distinct, sorted, comma-joined), ``score`` (1 with a base phrase, else the best covered
    share), and the covered template spans (word ranges ``[first, end)``)."""

    def run(batches):
        import pyarrow as pa
        auto = automaton(templates, base)
        lookup = auto.vocabulary.get
        for b in sliced(batches):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = words_of(text)
                codes = np.fromiter((lookup(w, -1) for w in words), np.int32, len(words))
                phrases, matches = auto.stream(codes)
                covered = {k: x for k, x in auto.spans(matches).items() if x[0] >= min_cover}
                own = {auto.sequences[k][0] for _, k in phrases}
                more = own | {auto.sequences[k][0] for k in covered}
                at = [s for s, _ in phrases]
                out.append({
                    "doc_id": doc_id, "n_words": len(words), "n_base": len(at), "first_word": min(at, default=None),
                    "last_word": max(at, default=None), "base_labels": ",".join(sorted(own)),
                    "labels": ",".join(sorted(more)),
                    "score": 1.0 if own else max((x[0] for x in covered.values()), default=0.0),
                    "spans": [{"label": auto.sequences[k][0], "first": f, "end": e, "share": s}
                              for k, (s, f, e) in sorted(covered.items())]})
            yield pa.RecordBatch.from_pylist(out, schema=_schema())

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, _KIND)


def _schema():
    import pyarrow as pa
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                      ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                      ("score", pa.float64()), ("spans", pa.list_(span))])
