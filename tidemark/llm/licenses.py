"""Licence scans with a generalised suffix automaton.

The automaton is built once per worker over the word sequences of licence notices and phrases. A text's words are
streamed through it; at each word it gives the longest run ending there that occurs in some notice (matching
statistics) and the places in notices that end with it. Long matches of one notice that lie in order and near each
other, in the text and in the notice, are chained into spans.

A span is a finding of its notice's licence if it covers enough of the notice and all its marked passages (in braces in
``NOTICES``: name, version, variant), each within one match. Findings that overlap in the text compete: the one that
covers more words wins, so a notice that another one contains, or resembles, gives way to it. An identifier that a hyphen
and a word go on from, other than ``-only`` and ``-or-later``, is another one and no finding. A span reaches over
``_reach`` words at most; matches are chained in windows of twice that, which overlap by half, so a text costs time in
proportion to its matches however many notices it holds.

Phrases (``PHRASES``) are part of the automaton: a phrase stands at a word if the state there has it as a suffix. Their
labels stay whatever the findings are.

Defined results: a null or empty text has no words and no findings, score 0; a null doc_id is kept; repeated rows give
repeated results; of findings that cover as many words the one of greater coverage wins, then the earlier, then the
first by label; an empty table gives no rows; extra columns are ignored. The score is 1 if a phrase stands in the text,
else the best coverage of any span, finding or not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Words of lower-cased text: ASCII letters and digits and everything beyond ASCII.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU%s General Public License as published by the Free Software Foundation, either version %s} of the License, or (at your option) any later version."
_GPL_SHORT = "licensed under the {GNU%s General Public License, version %s}"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials {provided with the distribution}."
_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."


def _gnu(kind: str, version: str) -> list[str]:
    return [_GPL % (kind, version), _GPL_SHORT % (kind, version)]


def _creative(name: str, short: str) -> list[str]:
    return [f"This work is licensed under a {{Creative Commons {name} {v}}} International License" for v in ("4.0", "3.0")] + [f"Licensed under {{{short} {v}}}" for v in ("4.0", "3.0")]


def _spdx(*names: str) -> list[str]:
    return [f"{{SPDX-License-Identifier: {n}}}" for n in names]


# Notices as their licences publish them, by label; in braces what tells a licence from those like it.
NOTICES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), {to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge}, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the {MIT License}",
        *_spdx("MIT"),
    ],
    "mit-0": [
        "{Permission is hereby granted, free of charge}, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), {to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge}, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        *_spdx("MIT-0"),
    ],
    "apache-1.1": ["Licensed under the {Apache License, Version 1.1}", "The {Apache Software License, Version 1.1}", *_spdx("Apache-1.1")],
    "apache-2": [
        "Licensed under the {Apache License, Version 2}.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the {Apache License, Version 2}.0",
        *_spdx("Apache-2.0"),
    ],
    "gpl-2": [*_gnu("", "2"), *_spdx("GPL-2.0")],
    "gpl-3": [*_gnu("", "3"), *_spdx("GPL-3.0")],
    "lgpl-2.1": [*_gnu(" Lesser", "2.1"), *_spdx("LGPL-2.1")],
    "lgpl-3": [*_gnu(" Lesser", "3"), *_spdx("LGPL-3.0")],
    "agpl-3": [*_gnu(" Affero", "3"), *_spdx("AGPL-3.0")],
    "bsd-2-clause": [f"{_BSD}{_AS_IS}", *_spdx("BSD-2-Clause")],
    "bsd-3-clause": [
        f"{_BSD} {{Neither the name of}} the copyright holder nor the names of its contributors {{may be used to endorse or promote products}} derived from this software without specific prior written permission.{_AS_IS}",
        *_spdx("BSD-3-Clause"),
    ],
    "bsd-3-clause-clear": [
        f"{_BSD.replace('are permitted provided', 'are permitted {(subject to the limitations in the disclaimer below)} provided')} {{Neither the name of}} the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {{NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS}} ARE GRANTED BY THIS LICENSE.{_AS_IS}",
        *_spdx("BSD-3-Clause-Clear"),
    ],
    "bsd-4-clause": [
        f"{_BSD} {{All advertising materials mentioning features or use of this software must display}} the following acknowledgement: This product includes software developed by the copyright holder. Neither the name of the copyright holder nor the names of its contributors {{may be used to endorse or promote products}} derived from this software without specific prior written permission.{_AS_IS}",
        *_spdx("BSD-4-Clause"),
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software {for any purpose with or without fee} is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        *_spdx("ISC"),
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        *_spdx("MPL-2.0"),
    ],
    "cc-by": _creative("Attribution", "CC BY") + _spdx("CC-BY-4.0", "CC-BY-3.0"),
    "cc-by-sa": _creative("Attribution-ShareAlike", "CC BY-SA") + _spdx("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
    "cc-by-nd": _creative("Attribution-NoDerivatives", "CC BY-ND") + _spdx("CC-BY-ND-4.0", "CC-BY-ND-3.0"),
    "cc-by-nc": _creative("Attribution-NonCommercial", "CC BY-NC") + _spdx("CC-BY-NC-4.0", "CC-BY-NC-3.0"),
    "cc-by-nc-sa": _creative("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA") + _spdx("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-3.0"),
    "cc-by-nc-nd": _creative("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND") + _spdx("CC-BY-NC-ND-4.0", "CC-BY-NC-ND-3.0"),
}

#: Words of a match that is chained; words between two matches of a span at most; part of a notice that a finding covers.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 40, 0.7


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


def marked(notice: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """A notice's words, and first word and end of each passage in braces."""
    words: list[bytes] = []
    passages, start = [], 0
    for piece in re.split(r"([{}])", notice):
        if piece == "{":
            start = len(words)
        elif piece == "}":
            passages.append((start, len(words)))
        else:
            words += words_of(piece)
    return words, passages


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the places of each state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # sequence to all positions where the state's strings end, in order
        for number, sequence in enumerate(sequences):
            last = 0
            for position, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, []).append(position)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[v]]
            for number, positions in self.ends[v].items():
                up[number] = sorted({*up.get(number, ()), *positions}) if self.link[v] else []
        self.ends[0] = {}

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the strings of ``q`` that ``p`` and a word give."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:  # an earlier sequence went this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def walk(self, words: list[int]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES):
        marks = [(label, *marked(t)) for label, ts in notices.items() for t in ts]
        texts = [(label, ws) for label, ws, _ in marks]
        spoken = [(label, words_of(t)) for t, label in phrases.items()]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in texts + spoken for w in ws))}
        ids = [[self.vocabulary[w] for w in ws] for _, ws in texts + spoken]
        self.notices = [(label, len(ws), passages) for label, ws, passages in marks]
        self.identifiers = {tuple(ws): (label, number) for number, (label, ws, _) in enumerate(marks) if ws[:3] == [b"spdx", b"license", b"identifier"]}
        self.named = {number for _, number in self.identifiers.values()}
        self.automaton = a = SuffixAutomaton(ids)
        own: dict[int, list[tuple[int, str]]] = {}
        for (label, ws), seq in zip(spoken, ids[len(texts) :], strict=True):
            own.setdefault(a.walk(seq), []).append((len(ws), label))
        self.accept: list[tuple] = [()] * len(a.next)  # phrases that are suffixes of a state's strings
        for v in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.accept[v] = (*self.accept[a.link[v]], *own.get(v, ()))
        self.shortest = min([MIN_MATCH, *(len(ws) for _, ws in spoken)])

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate([[0], ids >= 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(known))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # first word, words, state
        for lo, hi in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            self._stream(ids[lo:hi].tolist(), lo, places, matches)
        spans = self._chain(matches) if matches else []
        findings = [s for s in spans if s["coverage"] >= MIN_COVER and s["marked"]]
        if not self.named.isdisjoint(s["notice"] for s in findings):
            raw = text.encode("utf-8", "surrogatepass").lower()
            at = [m.span() for m in _WORDS.finditer(raw)]
            findings = [f for s in findings if (f := self._identified(raw, words, at, s) if s["notice"] in self.named else s)]
        findings = self._winners(findings)
        base = sorted({label for _, label in places})
        found = {s["label"] for s in findings}
        at = [p for p, _ in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(at, default=None),
            "last_word": max(at, default=None),
            "base_labels": base,
            "labels": sorted(found.union(base)),
            "score": 1.0 if base else max((s["coverage"] for s in spans), default=0.0),
            "spans": [{k: s[k] for k in ("label", "start", "end", "coverage")} for s in findings],
        }

    def _stream(self, run: list[int], offset: int, places: list, matches: list) -> None:
        a, accept = self.automaton, self.accept
        nexts, link, length = a.next, a.link, a.length
        state = size = 0
        for i, word in enumerate(run, offset):
            if word in nexts[state]:
                state, size = nexts[state][word], size + 1
            else:
                if size >= MIN_MATCH:
                    matches.append((i - size, size, state))
                while state and word not in nexts[state]:
                    state = link[state]
                    size = length[state]
                if word in nexts[state]:
                    state, size = nexts[state][word], size + 1
            for n, label in accept[state]:
                if n <= size:
                    places.append((i - n + 1, label))
        if size >= MIN_MATCH:
            matches.append((offset + len(run) - size, size, state))

    def _identified(self, raw: bytes, words: list[bytes], at: list[tuple[int, int]], span: dict) -> dict | None:
        """An identifier's span, if it stands in one piece and is not the beginning of a longer one; else the shorter one in it that is."""
        gap = lambda i: raw[at[i - 1][1] : at[i][0]] if i < len(words) else b""  # noqa: E731  before word i
        start = span["start"]
        for end in range(span["end"], start + 3, -1):
            known = self.identifiers.get(tuple(words[start:end]))
            whole = all(gap(i) in (b"-", b".") for i in range(start + 4, end))
            if known and whole and (gap(end) != b"-" or words[end] in (b"only", b"or")):
                return span | {"label": known[0], "notice": known[1], "end": end, "words": end - start, "coverage": 1.0}
        return None

    @staticmethod
    def _winners(findings: list[dict]) -> list[dict]:
        """Findings that do not overlap with one that covers more words; copies of one licence's notices count once."""
        kept: list[tuple[int, int]] = []  # starts and ends of disjoint findings, in order
        out: list[dict] = []
        for f in sorted(findings, key=lambda s: (-s["words"], -s["coverage"], s["start"], s["label"])):
            i = bisect_left(kept, (f["end"], 0))  # those from here on start at its end or later
            if i and kept[i - 1][1] > f["start"]:
                continue
            insort(kept, (f["start"], f["end"]))
            out.append(f)
        return sorted(out, key=lambda s: (s["start"], s["label"]))

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Spans: for each notice the best-covering chains of matches in order, in text and notice alike."""
        by_notice: dict[int, list[tuple[int, int, list[int]]]] = {}
        for first, size, state in matches:
            for number, ends in self.automaton.ends[state].items():
                if number < len(self.notices):
                    by_notice.setdefault(number, []).append((first, size, ends))
        spans = []
        for number, own in by_notice.items():
            group: list[tuple[int, int, list[int]]] = []
            for m in own:
                # A long gap: what came before is a span of its own.
                if group and m[0] - (group[-1][0] + group[-1][1]) > MAX_GAP:
                    spans += self._spans(number, group)
                    group = []
                group.append(m)
            spans += self._spans(number, group)
        return spans

    def _reach(self, number: int) -> int:
        """Words that a span of a notice reaches over at most: the notice's own, and a gap after each match."""
        total = self.notices[number][1]
        return total + MAX_GAP * (total // MIN_MATCH + 1)

    def _spans(self, number: int, group: list[tuple[int, int, list[int]]]) -> list[dict]:
        """The best chain of each window of a group, then the best of what lies before it there; the next window is what comes after."""
        out: list[dict] = []
        reach, firsts, i = self._reach(number), [m[0] for m in group], 0
        while i < len(group):
            part = group[i : bisect_left(firsts, firsts[i] + 2 * reach, i)]
            span = self._span(number, part)
            if span:
                out.append(span)
            if not span or span["coverage"] < MIN_COVER:
                i = max(i + 1, bisect_left(firsts, firsts[i] + reach, i)) if len(part) < len(group) - i else len(group)
                continue
            i = max(i + 1, bisect_left(firsts, span["end"], i))
            todo = [[m for m in part if m[0] + m[1] <= span["start"]]]
            while todo:
                rest = todo.pop()
                if rest and (more := self._span(number, rest)):
                    out.append(more)
                    if more["coverage"] >= MIN_COVER:
                        todo += [[m for m in rest if m[0] + m[1] <= more["start"]], [m for m in rest if m[0] >= more["end"]]]
        return out

    def _span(self, number: int, group: list[tuple[int, int, list[int]]]) -> dict | None:
        label, total, passages = self.notices[number]
        # Fenwick tree over notice positions: the chain of most words that ends before a position, as an index into links.
        best = [-1] * (total + 1)
        links: list[tuple[int, int, int, int, int]] = []  # words so far, first word, place in notice, words, link before
        text_end, top = -1, -1
        for first, size, ends in group:
            skip = max(0, text_end - first)
            if skip >= size:
                continue
            text_end, made = first + size, []
            for end in ends:
                at, before, i = end - size + 1 + skip, -1, end - size + 1 + skip
                while i > 0:
                    if best[i] >= 0 and (before < 0 or links[best[i]][0] > links[before][0]):
                        before = best[i]
                    i -= i & -i
                made.append((size - skip + (links[before][0] if before >= 0 else 0), first + skip, at, size - skip, before))
            for link in made:
                links.append(link)
                k, i = len(links) - 1, link[2] + link[3]
                while i <= total:
                    if best[i] < 0 or links[best[i]][0] < link[0]:
                        best[i] = k
                    i += i & -i
                if top < 0 or links[top][0] < link[0]:
                    top = k
        if top < 0:
            return None
        chain, k = [], top
        while k >= 0:
            chain.append(links[k])
            k = links[k][4]
        whole = all(any(at <= lo and hi <= at + size for _, _, at, size, _ in chain) for lo, hi in passages)
        words = links[top][0]
        return {"notice": number, "label": label, "start": chain[-1][1], "end": chain[0][1] + chain[0][3], "coverage": min(1.0, words / total), "words": words, "marked": whole}


@lru_cache(maxsize=1)
def default_scanner() -> Scanner:
    return Scanner()


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per text: words, phrase places, labels, score and the spans of notices found."""
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(), "spans": span}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = default_scanner()
        for b in batches:
            rows = [scanner.scan(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in types.items())], ["doc_id", *types])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label string, start long, end long, coverage double>>")


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    """Every whole document through the automaton."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")}).drop("spans")
