"""License scans: template markup compiled into token automata.

A template is words with two kinds of regions: ``[[words]]`` may be there or not (regions nest), and
``{{lo..hi}}`` stands for ``lo`` to ``hi`` words of any wording. All other words are mandatory. Each template
becomes a deterministic automaton over tokens; it accepts a place of a text if the words from there on match the mandatory
wording exactly, with each optional region present or absent and each replaceable one within its bounds. A text has a template's label if some place is accepted.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Only places whose word can start a template
are walked, all of a chunk at once; an automaton has no cycles, so a walk is at most as long as its template. Every text is read whole in one pass without a shuffle.

``score`` is 1 if a template is accepted, 0.5 if only a base phrase is there, else 0.

Defined cases: null texts count as empty; texts without words have no label and null places; repeated rows and rows with a
null doc_id are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.kernels import NON_WORD, Tokens, text_chunks

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The public wording of licenses, with what may be left out or replaced marked.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions [[{{0..1}}]] the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the {{1..6}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
    "or the use or other dealings in the software"
)
_BSD_OPENING = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_CONDITIONS = (
    "[[{{0..1}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[{{0..1}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = (
    "[[{{0..1}}]] neither the name of {{1..8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    "this software is provided by {{1..8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{1..8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
    "even if advised of the possibility of such damage"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and {{1..6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{1..6}} be liable for any "
    "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use or performance of this software"
)
_APACHE_NOTICE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license"
)

TEMPLATES = {
    "mit-notice": "[[{{0..3}} is]] released under [[the terms of]] the mit license",
    "mit-text": _MIT,
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]]",
    "gpl-3.0": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 3 [[0]] [[or {{0..2}} any later version]]",
    "gpl-2.0": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 2 [[0]] [[or {{0..2}} any later version]]",
    "cc-by-nc-4.0": "licensed under [[a {{0..2}}]] cc by nc 4 0 [[international]] [[license]]",
    "cc-by-4.0": "licensed under [[a]] [[the]] creative commons attribution 4 0 [[international]] [[public]] license",
    "bsd-2-clause": f"{_BSD_OPENING} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_OPENING} {_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "isc": _ISC,
    "apache-2.0-notice": _APACHE_NOTICE,
}

_PART = re.compile(r"\[\[|\]\]|\{\{(\d+)\.\.(\d+)\}\}|[^\s\[\]{}]+")
#: In a transition: any word, and no word (the text's end).
ANY = -1


def parse(markup: str) -> list:
    """Nested parts: a word, ``(lo, hi)``, or a list for an optional region."""
    stack: list[list] = [[]]
    for m in _PART.finditer(markup):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            done = stack.pop()
            stack[-1].append(done)
        elif m[1] is not None:
            stack[-1].append((int(m[1]), int(m[2])))
        else:
            stack[-1].append(m[0])
    if len(stack) != 1:
        raise ValueError(f"unbalanced optional region: {markup}")
    return stack[0]


def regex(markup: str) -> str:
    """The same language as a regular expression over words that each end in a blank."""

    def of(parts: list) -> str:
        return "".join(f"(?:{of(p)})?" if isinstance(p, list) else f"(?:[^ ]+ ){{{p[0]},{p[1]}}}" if isinstance(p, tuple) else f"{re.escape(p)} " for p in parts)

    return of(parse(markup))


class Automaton:
    """``table[state, word id]``: the next state; state 0 is dead, 1 the start; the last column is for words of no template, the one before for the end."""

    def __init__(self, markup: str, ids: dict[str, int]):
        edges: list[tuple[int, int | None, int]] = []
        self.size = 1

        def new() -> int:
            self.size += 1
            return self.size - 1

        def build(parts: list, at: int) -> int:
            for p in parts:
                if isinstance(p, list):
                    end = build(p, at)
                    skip = new()
                    edges.extend([(at, None, skip), (end, None, skip)])
                    at = skip
                elif isinstance(p, tuple):
                    stops = []
                    for k in range(p[1]):
                        if k >= p[0]:
                            stops.append(at)
                        nxt = new()
                        edges.append((at, ANY, nxt))
                        at = nxt
                    edges.extend((s, None, at) for s in stops)
                else:
                    nxt = new()
                    edges.append((at, ids[p], nxt))
                    at = nxt
            return at

        goal = build(parse(markup), 0)
        free: dict[int, list[int]] = {}
        for a, on, b in edges:
            if on is None:
                free.setdefault(a, []).append(b)

        def closure(states: frozenset[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for b in free.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            return frozenset(seen)

        width = len(ids) + 2
        start = closure(frozenset([0]))
        number, todo, rows = {frozenset(): 0, start: 1}, [start], {0: [0] * width}
        while todo:
            s = todo.pop()
            row = []
            for w in range(width):
                to = closure(frozenset(b for a, on, b in edges if a in s and on is not None and w != width - 2 and on in (w, ANY)))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows[number[s]] = row
        self.table = np.array([rows[i] for i in range(len(number))], np.int32)
        self.accepts = np.zeros(len(number), bool)
        for s, i in number.items():
            self.accepts[i] = goal in s

    def places(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Word indices from which the automaton accepts; ``ids`` has one entry more, for the end."""
        end = self.table.shape[1] - 2
        state = self.table[1, ids[:-1]]
        at = np.flatnonzero(state)
        state, found = state[at], []
        pos = at.copy()
        while len(at):
            ok = self.accepts[state]
            found.append(at[ok])
            at, pos, state = at[~ok], pos[~ok] + 1, state[~ok]
            inside = (pos < len(doc)) & (doc[np.minimum(pos, len(doc) - 1)] == doc[at])
            state = self.table[state, np.where(inside, ids[pos], end)]
            live = state > 0
            at, pos, state = at[live], pos[live], state[live]
        return np.sort(np.concatenate(found)) if found else at


class Scanner:
    def __init__(self, templates: dict[str, str], base: dict[str, str]):
        words = sorted({w for m in templates.values() for w in _words(parse(m))} | {w for p in base for w in p.split()})
        self.ids = {w: i for i, w in enumerate(words)}
        raw = " ".join(words).encode()
        h = Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NON_WORD).hashes()
        order = np.argsort(h)
        self.known, self.order = h[order], order
        self.automata = {label: Automaton(m, self.ids) for label, m in templates.items()}
        self.base = {label: [self.ids[w] for w in p.split()] for p, label in base.items()}

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of words, with one entry more for the end; words of no template are the last id."""
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        return np.append(np.where(self.known[at] == h, self.order[at], len(self.ids) + 1), len(self.ids))

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column(1)):
                t = Tokens(data, offs, NON_WORD)
                ids, rows = self.word_ids(t.hashes()), b - a
                n_base = np.zeros(rows, np.int64)
                first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                labels: tuple[dict, dict] = ({}, {})
                for label, phrase in self.base.items():
                    m = max(0, len(t.doc) - len(phrase) + 1)
                    hit = t.doc[:m] == t.doc[len(phrase) - 1 : len(phrase) - 1 + m]
                    for k, w in enumerate(phrase):
                        hit &= ids[k : k + m] == w
                    at = np.flatnonzero(hit)
                    doc = t.doc[at]
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(first, doc, at - t.first[doc])
                    np.maximum.at(last, doc, at - t.first[doc])
                    for d in np.unique(doc):
                        labels[0].setdefault(int(d), set()).add(label)
                for label, automaton in self.automata.items():
                    for d in np.unique(t.doc[automaton.places(ids, t.doc)]) if len(t.doc) else ():
                        labels[1].setdefault(int(d), set()).add(label)
                none = n_base == 0
                join = lambda sets: pa.array([",".join(sorted(set().union(*(s.get(d, ()) for s in sets)))) for d in range(rows)], pa.string())
                score = np.where([d in labels[1] for d in range(rows)], 1.0, np.where(none, 0.0, 0.5))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), pa.array(np.diff(t.first).astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), join(labels[:1]), join(labels), pa.array(score)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def _words(parts: list) -> Iterator[str]:
    for p in parts:
        if isinstance(p, list):
            yield from _words(p)
        elif isinstance(p, str):
            yield p


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    scanner = Scanner(TEMPLATES if templates is None else templates, BASE if base is None else base)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scanner.scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
