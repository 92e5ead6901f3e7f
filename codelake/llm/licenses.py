"""License texts and notices found by patience alignment.

A region of a text around a word that starts a license notice is aligned with each template: words that are unique in both
are paired, the longest increasing run of those pairs is kept as anchors, and the gaps between anchors are aligned in the
same way, where other words become unique. Coverage is the share of the template's words that are aligned; a match has
COVERAGE or more and holds one of the KEYS. A region may hold several notices: literal copies of the template split it first,
each match splits it further, and where copies leave no unique words, the longest chains of equal words are looked for.

Defined cases: null or empty text: no match. Whole texts are read. Ties between templates go to the longer template, then
the name. Rows are independent, so repeated rows and ids give equal results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text

COVERAGE = 0.8
#: Words that every match must hold one of; regions of a text are searched around them.
KEYS = ("license", "licensed", "licence", "copyright", "permission", "redistribution", "cc")
KEY = "(?i)licen[cs]e|copyright|permission|redistribution|\\bcc\\b"
WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
#: Words that may stand between two aligned words of a notice, besides the template's own.
SLACK = 8

# Wordings of public licenses and their notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "MIT notice": "Released under the MIT License",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0 notice": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0 notice": "Licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License",
    "BSD-2-Clause notice": "Licensed under the BSD 2-Clause License",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, version 2.0",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC0-1.0 notice": "Released into the public domain under the CC0 1.0 License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their places in ``text``."""
    found = list(WORD.finditer(text.lower()))
    return [m[0] for m in found], [m.span() for m in found]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first) whose second numbers increase: patience sorting with back links."""
    tops, piles, back = [], [], {}
    for i, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tops, y)
        back[i] = piles[at - 1] if at else None
        tops[at : at + 1], piles[at : at + 1] = [y], [i]
    out, i = [], piles[-1] if piles else None
    while i is not None:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Pairs of places of equal words in ``a`` and ``b``, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        x0, x1, y0, y1 = todo.pop()
        while x0 < x1 and y0 < y1 and a[x0] == b[y0]:
            out.append((x0, y0))
            x0, y0 = x0 + 1, y0 + 1
        while x0 < x1 and y0 < y1 and a[x1 - 1] == b[y1 - 1]:
            x1, y1 = x1 - 1, y1 - 1
            out.append((x1, y1))
        if x0 == x1 or y0 == y1:
            continue
        ours, theirs = {}, {}
        for i in range(x0, x1):
            ours[a[i]] = -1 if a[i] in ours else i
        for i in range(y0, y1):
            theirs[b[i]] = -1 if b[i] in theirs else i
        anchors = increasing(sorted((i, theirs[w]) for w, i in ours.items() if i >= 0 and theirs.get(w, -1) >= 0))
        x, y = x0, y0
        for i, j in [*anchors, (x1, y1)] if anchors else []:
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        out += anchors
    return sorted((x + a0, y + b0) for x, y in out)


def regions(found: list[str], reach: int) -> list[tuple[int, int]]:
    """Ranges of words around the keys, overlapping ones together."""
    out: list[list[int]] = []
    for i, w in enumerate(found):
        if w in KEYS:
            lo, hi = max(0, i - reach), min(len(found), i + reach + 1)
            if out and out[-1][1] >= lo:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
    return [(a, b) for a, b in out]


_SPLIT = {name: words(text)[0] for name, text in TEMPLATES.items()}
_COUNTS = {name: Counter(template) for name, template in _SPLIT.items()}

Pairs = list[tuple[int, int]]


def joined(pairs: Pairs) -> list[Pairs]:
    """Runs of pairs without words between them that are too many for one notice."""
    out: list[Pairs] = []
    for p in pairs:
        if out and p[0] - out[-1][-1][0] <= p[1] - out[-1][-1][1] + SLACK:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def chains(part: list[str], template: list[str], need: int, at: int = 0) -> list[Pairs]:
    """Non-overlapping runs of ``need`` pairs or more, the longest first, the shortest in ``part`` of equally long ones."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(template):
        places.setdefault(w, []).append(j)
    spare = len(template) - need
    ends: list[tuple[int, int, int, int, int]] = []  # pairs so far, first word, last word, place in the template, place in ends of the one before
    recent = 0
    for i, w in enumerate(part):
        if w not in places:
            continue
        while recent < len(ends) and ends[recent][2] < i - spare - 1 - SLACK:
            recent += 1
        new = []
        for j in places[w]:
            most, first, back = 0, i, -1
            for e in range(recent, len(ends)):
                n, lo, x, y, _ = ends[e]
                if y < j and i - x <= j - y + SLACK and (n > most or n == most and lo > first):
                    most, first, back = n, lo, e
            if j - most <= spare:  # fewer words of the template are left out than may be
                new.append((most + 1, first, i, j, back))
        ends += new
    out: list[Pairs] = []
    taken: list[tuple[int, int]] = []
    for e in sorted((e for e in ends if e[0] >= need), key=lambda e: (-e[0], e[2] - e[1], e[1])):
        lo, hi = e[1], e[2]
        k = bisect.bisect(taken, (lo, hi))
        if (k and taken[k - 1][1] >= lo) or (k < len(taken) and taken[k][0] <= hi):
            continue
        run = [(e[2] + at, e[3])]
        while e[4] >= 0:
            e = ends[e[4]]
            run.append((e[2] + at, e[3]))
        if any(part[i - at] in KEYS for i, _ in run):
            out.append(run[::-1])
            taken.insert(k, (lo, hi))
    return out


def matches(found: list[str], lo: int, hi: int, name: str, coverage: float) -> list[Pairs]:
    """Every non-overlapping run in ``found[lo:hi]`` that covers the template."""
    template, counts = _SPLIT[name], _COUNTS[name]
    need = math.ceil(coverage * len(template) - 1e-9)
    out: list[Pairs] = []

    def rest(a: int, b: int, runs: list[Pairs]) -> list[tuple[int, int]]:
        """What ``runs`` leave of a range."""
        left = []
        for run in sorted(runs):
            left.append((a, run[0][0]))
            a = run[-1][0] + 1
        return [*left, (a, b)]

    whole, i = [], lo
    while i + len(template) <= hi:
        if found[i] == template[0] and found[i : i + len(template)] == template:
            whole.append([(i + j, j) for j in range(len(template))])
            i += len(template)
        else:
            i += 1
    out += whole
    todo = rest(lo, hi, whole)
    while todo:
        a, b = todo.pop()
        part = found[a:b]
        there = Counter(w for w in part if w in counts)
        if sum(min(n, counts[w]) for w, n in there.items()) < need or not any(w in KEYS for w in there):
            continue
        runs = [r for r in joined(align(part, template, a)) if len(r) >= need and any(found[i] in KEYS for i, _ in r)]
        runs = runs or chains(part, template, need, a)
        if runs:
            out += runs
            todo += rest(a, b, runs)
    return out


def find_licenses(text: str | None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) in code points, best first; of overlapping matches only the best."""
    if not text or not re.search(KEY, text):
        return []
    found, spans = words(text)
    hits = []
    for name, template in _SPLIT.items():
        for lo, hi in regions(found, len(template) + SLACK):
            for run in matches(found, lo, hi, name, coverage):
                hits.append((name, round(len(run) / len(template), 6), spans[run[0][0]][0], spans[run[-1][0]][1], len(run)))
    hits.sort(key=lambda h: (-h[4] * h[1], h[0], h[2]))
    out: list[tuple[str, float, int, int]] = []
    taken: list[tuple[int, int]] = []
    for name, share, start, end, _ in hits:
        k = bisect.bisect(taken, (start, end))
        if (not k or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
            out.append((name, share, start, end))
            taken.insert(k, (start, end))
    return out


def license_scan(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_matches, license (the best match; null without one), coverage, matches (license, coverage, start, end) for every row."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            rows = [[dict(zip(("license", "coverage", "start", "end"), m)) for m in find_licenses(texts[i].as_py(), coverage)] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "matches"])

    asked = id_and_text(docs).withColumn("text", F.when(F.col("text").rlike(KEY), F.col("text")))
    found = asked.mapInArrow(run, "doc_id long, matches array<struct<license:string,coverage:double,start:long,end:long>>")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.get("matches", F.lit(0))["license"].alias("license"), F.get("matches", F.lit(0))["coverage"].alias("coverage"), "matches")
