"""License scans: patience alignment of documents against license texts and notices."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesops import VALUE, batches_of, blank_marks, column_bytes, words
from .common import in_arrow, with_id

COVERAGE = 0.8
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_GNU_NAMES = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_GNU_VERSIONS = [("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")]
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
#: Whole texts (X-text, from `license_texts`), standard headers (X-header) and short notices.
TEMPLATES = {f"{p.stem}-text": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))} | {
    "MIT": "Released under the MIT License.",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD": "Released under the BSD License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "all-rights-reserved": "All rights reserved.",
}
#: Phrases, each word for word, without which a notice or header is another license's or another version's.
REQUIRED = {
    "MIT": ["MIT License"], "BSD": ["BSD License"], "Apache-2.0": ["Apache License", "Version 2.0"], "Apache-2.0-header": ["Apache License", "Version 2.0"],
    "MPL-2.0": ["Mozilla Public License", "2.0"], "MPL-2.0-header": ["Mozilla Public License", "2.0"], "all-rights-reserved": ["All rights reserved"],
    "Apache-2.0-text": ["Apache License Version 2.0"], "BSD-3-text": ["endorse or promote"], "CC-BY-SA-4.0-text": ["Attribution-ShareAlike 4.0 International"],
    "GPL-2.0-text": ["GNU General Public License Version 2"], "GPL-3.0-text": ["GNU General Public License Version 3"],
    "LGPL-2.0-text": ["GNU Library General Public License Version 2"], "LGPL-2.1-text": ["GNU Lesser General Public License Version 2.1"],
    "LGPL-3.0-text": ["GNU Lesser General Public License Version 3"], "MPL-1.1-text": ["Mozilla Public License Version 1.1"], "MPL-2.0-text": ["Mozilla Public License Version 2.0"],
}
for _kind, _version in _GNU_VERSIONS:
    _name, _short = _GNU_NAMES[_kind], _version.removesuffix(".0")
    TEMPLATES[f"{_kind}-{_version}"] = f"This work is licensed under the GNU {_name}, version {_short}."
    TEMPLATES[f"{_kind}-{_version}-header"] = _GNU.format(name=_name, version=_short)
    REQUIRED[f"{_kind}-{_version}"] = REQUIRED[f"{_kind}-{_version}-header"] = [f"GNU {_name}", f"version {_short}"]
for _kind, _name in _CC.items():
    TEMPLATES[f"CC-{_kind}-4.0"] = f"Licensed under CC {_kind} 4.0."
    TEMPLATES[f"CC-{_kind}-4.0-header"] = f"Licensed under a Creative Commons {_name} 4.0 International License."
    REQUIRED[f"CC-{_kind}-4.0"], REQUIRED[f"CC-{_kind}-4.0-header"] = [f"CC {_kind} 4.0"], [f"Creative Commons {_name} 4.0"]


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (rising in both lists) by patience alignment.

    Equal ends are matched first; words that occur once in each list are anchors; of these the longest increasing
    subsequence stays, and the gaps between are aligned the same way.  A gap without such words is aligned by a
    longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        at = {w: x for x, w in enumerate(b[k:m], k) if cb[w] == 1}
        anchors = [(x, at[w]) for x, w in enumerate(a[i:j], i) if ca[w] == 1 and w in at]
        if not anchors:
            if any(w in cb for w in ca):
                out += _common(a, b, i, j, k, m)
            continue
        tails: list[int] = []
        last: list[int] = []
        back = [-1] * len(anchors)
        for x, (_, y) in enumerate(anchors):
            p = bisect_left(tails, y)
            back[x] = last[p - 1] if p else -1
            tails[p : p + 1], last[p : p + 1] = [y], [x]
        x, chain = last[-1], []
        while x >= 0:
            chain.append(anchors[x])
            x = back[x]
        edge = (i, k)
        for x, y in reversed(chain):
            out.append((x, y))
            todo.append((edge[0], x, edge[1], y))
            edge = (x + 1, y + 1)
        todo.append((edge[0], j, edge[1], m))
    return sorted(out)


def _common(a: list, b: list, i: int, j: int, k: int, m: int) -> list[tuple[int, int]]:
    """Longest common subsequence of a[i:j] and b[k:m]; of equal choices the earlier words."""
    length = [[0] * (m - k + 1) for _ in range(j - i + 1)]
    for x in range(j - i - 1, -1, -1):
        for y in range(m - k - 1, -1, -1):
            length[x][y] = length[x + 1][y + 1] + 1 if a[i + x] == b[k + y] else max(length[x + 1][y], length[x][y + 1])
    out, x, y = [], 0, 0
    while x < j - i and y < m - k:
        if a[i + x] == b[k + y]:
            out.append((i + x, k + y))
            x, y = x + 1, y + 1
        elif length[x + 1][y] >= length[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def tighten(b: list, pairs: list[tuple[int, int]], a: list) -> list[tuple[int, int]]:
    """The same matched words of `a` on the shortest stretch of `b` that keeps the last match, then the first.

    From the end each match moves to the last place before its successor, which gives the latest start; then from the
    start each moves to the first place behind its predecessor, which gives the earliest end.
    """
    places = [y for _, y in pairs]
    for k in range(len(pairs) - 2, -1, -1):
        w, y = a[pairs[k][0]], places[k + 1] - 1
        while b[y] != w:
            y -= 1
        places[k] = y
    for k in range(1, len(pairs)):
        w, y = a[pairs[k][0]], places[k - 1] + 1
        while b[y] != w:
            y += 1
        places[k] = y
    return [(x, y) for (x, _), y in zip(pairs, places, strict=True)]


class Scanner:
    """Templates prepared for many texts."""

    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.coverage, self.list = coverage, []
        for name, text in sorted(templates.items()):
            t = word_hashes(text)
            if len(t):
                vocabulary, counts = np.unique(t, return_counts=True)
                phrases = [word_hashes(x) for x in REQUIRED.get(name, ()) if text == TEMPLATES[name]]
                self.list.append((name, t.tolist(), vocabulary, counts, max(1, int(np.ceil(coverage * len(t) - 1e-9))), phrases))
        self.vocabulary = np.unique(np.concatenate([x[2] for x in self.list])) if self.list else np.zeros(0, np.uint64)
        # for each word of all templates its place in the vocabulary of each template, or -1
        self.local = [np.full(len(self.vocabulary) + 1, -1) for _ in self.list]
        for x, to in zip(self.list, self.local, strict=True):
            to[np.searchsorted(self.vocabulary, x[2])] = np.arange(len(x[2]))

    def scan(self, h: np.ndarray) -> list[tuple[str, int, int, int, float]]:
        """(template, matched words, first word, last word, coverage) of each place of a text's word hashes.

        A place is a stretch of at most twice the template's words.  Candidates are the stretches with enough of the
        template's words, by count and then as a multiset, which bounds any alignment from above: none is missed.  A
        place is cut to its shortest stretch with the same matches, and aligned again from there, as long as this
        finds more.  A place without one of the template's required phrases is none.  Of overlapping places of several templates the
        one with the most matched words stays (ties: the higher coverage, then the earlier in the text).
        """
        out: list[tuple[str, int, int, int, float]] = []
        if not self.list:
            return out
        spot = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        spot[self.vocabulary[spot] != h] = len(self.vocabulary)
        for (name, t, _, counts, need, phrases), local in zip(self.list, self.local, strict=True):
            if len(h) < need or not all(_holds(h, x) for x in phrases):
                continue
            at = local[spot]
            inside = at >= 0
            hits = np.flatnonzero(inside)
            if len(hits) < need:
                continue
            span, done = 2 * len(t), -1
            # stretches start at a hit and hold `need` hits at least
            for s in hits[: len(hits) - need + 1][hits[need - 1 :] - hits[: len(hits) - need + 1] < span]:
                if s <= done:
                    continue
                here = at[s : s + span][inside[s : s + span]]
                lacks = need - np.minimum(np.bincount(here, minlength=len(counts)), counts).sum()
                if lacks > 0:
                    done = int(s) + int(lacks) - 1  # a stretch gains one word at most with each step
                    continue
                found = self._place(t, h, int(s), span, need)
                if found and all(_holds(h[found[1] : found[2] + 1], x) for x in phrases):
                    n, first, done = found
                    out.append((name, n, first, done, n / len(t)))
        kept: list[tuple[str, int, int, int, float]] = []
        for x in sorted(out, key=lambda x: (-x[1], -x[4], x[2], x[0])):
            if all(x[3] < y[2] or y[3] < x[2] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: (x[2], x[0]))


    def _place(self, t: list, h: np.ndarray, s: int, span: int, need: int) -> tuple[int, int, int] | None:
        """Matches, first and last word of the place that begins at `s` or, cut to where it is densest, behind."""
        best: tuple[int, int, int] | None = None
        while True:
            b = h[s : s + span].tolist()
            pairs = patience(t, b)
            if len(pairs) < need or best and len(pairs) <= best[0]:
                return best
            pairs = tighten(b, pairs, t)
            best = (len(pairs), s + pairs[0][1], s + pairs[-1][1])
            if len(pairs) == len(t) or best[1] == s:
                return best
            s = best[1]


def _holds(h: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether the words of `phrase` follow each other somewhere in `h`."""
    at = np.flatnonzero(h[: max(len(h) - len(phrase) + 1, 0)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return len(at) > 0


def scanner(templates: dict[str, str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scanner(templates, coverage)
        least = min((x[4] for x in tool.list), default=1)
        for batch in batches:
            raw, off = column_bytes(batch.column("text"))
            rows = []
            for i, j in batches_of(raw, off):
                part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                h, doc, start = words(part, o)
                at = np.searchsorted(tool.vocabulary, h)
                known = tool.vocabulary[np.minimum(at, len(tool.vocabulary) - 1)] == h if len(tool.vocabulary) else np.zeros(len(h), bool)
                enough = np.bincount(doc[known], minlength=j - i) >= least
                begin = np.searchsorted(doc, np.arange(j - i + 1))
                end = _ends(part, start) if enough.any() else start
                for d in np.flatnonzero(enough):
                    a, b = begin[d], begin[d + 1]
                    for name, n, first, last, share in tool.scan(h[a:b]):
                        x, y = int(start[a + first]), int(min(end[a + last], o[d + 1]))
                        head = bytes(part[o[d] : x]).decode("utf-8", "replace")
                        found = bytes(part[x:y]).decode("utf-8", "replace")
                        rows.append((int(i + d), name, n, round(share, 6), len(head), len(head) + len(found), found))
            of, *cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            names = ["doc_id", "license", "n_words", "coverage", "start", "end", "found"]
            ids = batch.column("doc_id").take(pa.array(list(of), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=names)

    return run


def _ends(part: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where each word ends: at the next byte that belongs to none."""
    v = VALUE[part]
    blank_marks(part, v)
    gaps = np.append(np.flatnonzero(v == 0), len(part))
    return gaps[np.searchsorted(gaps, start)]


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Every place in every document that a license template covers to `coverage` or more.

    Words are compared without ASCII case and punctuation.  A place is aligned by patience: anchors unique to both,
    their longest increasing subsequence, then the gaps.  Stretches that can't reach the coverage are left out by an
    upper bound on the common words, never by position.  One pass, no shuffle; the templates travel with the task.

    Result: doc_id (of any type), license, n_words (matched), coverage, start, end (characters, end exclusive), found.
    Null and empty texts have no place.  A null doc_id is kept.  Repeated rows are scanned each for itself; a notice
    that repeats in a text is found each time, places don't overlap, and of those that would, the template with the
    most matched words is taken.  A text of any length is scanned whole.  Of AGPL and of Creative Commons other than BY-SA and CC0 only notices and headers
    are known.  Without templates, or over an empty table, the result is empty.  Other columns are ignored.
    """
    d = docs.select("doc_id", "text").filter("text IS NOT NULL")
    schema = with_id(d, "license string, n_words bigint, coverage double, start bigint, end bigint, found string")
    return in_arrow(d, scanner(TEMPLATES if templates is None else templates, coverage), schema)
