"""Operator 7: license scan by patience alignment.

A text's words are aligned with each template that it may hold: words unique to
both sides are anchors, their longest increasing subsequence fixes an order,
and the gaps between anchors are aligned the same way, small gaps without anchors
by their longest common subsequence. The share of template words that align is
the coverage.

A text is first cut into regions where a template's words follow each other, at
most the template's length apart, so that a second copy elsewhere does not take
an anchor's uniqueness away. A region is cut again where copies begin: a pair of
words that the template has tells where its copy would begin, and places that
many pairs agree on are beginnings. Pieces that hold no copy are joined with
their neighbours and aligned once more. Regions are dropped beforehand only if
too few of the template's words are there for the coverage to be reached.

A text of any length is scanned whole, as one list of words in its task. Null or empty text: no license. Repeated rows: each has its own row. An empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import batches_of, rows_of, texts

WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# License notices and texts, by SPDX-like name; whole texts lie in `license_texts`, a file each.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_3RD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. ")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU_NOTICE = (
    "This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the {license} as published by the "
    "Free Software Foundation{second} either version {version} of the License, or (at your option) any later version.")
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD-3-Clause": "Released under the BSD 3-Clause License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MIT (text)": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "ISC (text)": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Apache-2.0 (notice)": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "GPL (notice)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0 (notice)": _GNU_NOTICE.format(thing="program", mark=";", second=";", license="GNU General Public License", version="2"),
    "LGPL-2.1 (notice)": _GNU_NOTICE.format(thing="library", mark=";", second=";", license="GNU Lesser General Public License", version="2.1"),
    "LGPL-3.0 (notice)": _GNU_NOTICE.format(thing="program", mark=":", second=",", license="GNU Lesser General Public License", version="3"),
    "AGPL-3.0 (notice)": _GNU_NOTICE.format(thing="program", mark=":", second=",", license="GNU Affero General Public License", version="3"),
    "MPL-2.0 (notice)": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "EPL-2.0 (notice)": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available "
        "at https://www.eclipse.org/legal/epl-2.0/"),
    "CC0-1.0 (notice)": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to "
        "the public domain worldwide. This software is distributed without any warranty."),
    "Unlicense (text)": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment "
        "of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
        "rights to this software under copyright law."),
    "Zlib (text)": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    "BSD-2-Clause (text)": _BSD + _BSD_END,
    "BSD-3-Clause (text)": _BSD + _BSD_3RD + _BSD_END,
    **{f"{f.stem} (text)": f.read_text(encoding="utf-8") for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))},
}
#: Least share of a template's words that must align.
COVERAGE = 0.8
#: Most words that aren't the template's between two that are, inside a region; of a longer template, as many as it has.
GAP = 8
#: Most cells of the table by which a gap without anchors is aligned at once; a larger gap is halved first.
CELLS = 1 << 14
#: Templates that share so much of the smaller one's words are told apart by the words that one has and the other hasn't.
ALIKE = 0.8


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORDS.finditer(text)]


def patience(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned places (in `a`, in `b`) of equal words, ascending in both. Gaps are taken from a list, not by recursion."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, blo, bhi = todo.pop()
        while lo < hi and blo < bhi and a[lo] == b[blo]:
            out.append((lo, blo))
            lo, blo = lo + 1, blo + 1
        while lo < hi and blo < bhi and a[hi - 1] == b[bhi - 1]:
            hi, bhi = hi - 1, bhi - 1
            out.append((hi, bhi))
        if lo == hi or blo == bhi:
            continue
        n_a, n_b = Counter(a[lo:hi]), Counter(b[blo:bhi])
        place = {w: i for i, w in enumerate(b[blo:bhi], blo) if n_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[lo:hi], lo) if n_a[w] == 1 and w in place])
        if not anchors:
            out += common(a, b, lo, hi, blo, bhi)
            continue
        out += anchors
        edges = [(lo - 1, blo - 1), *anchors, (hi, bhi)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False) if q > p + 1 and s > r + 1]
    return sorted((i + a0, j + b0) for i, j in out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (ascending in the first) that ascends in the second, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[k] = piles[pile - 1] if pile else -1
        tops[pile : pile + 1] = [j]
        piles[pile : pile + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(a: list[str], b: list[str], lo: int, hi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Longest common subsequence of a[lo:hi] and b[blo:bhi] as pairs of places; memory in proportion to their lengths.

    A table that would be too large is halved along `a`: the best lengths of the two halves, from either end, tell where `b` is
    cut, and the parts are aligned alone."""
    shared = set(a[lo:hi]).intersection(b[blo:bhi])
    if not shared:
        return []
    number = {w: k for k, w in enumerate(shared)}
    rows, columns = ([i for i in range(x, y) if of[i] in shared] for of, x, y in ((a, lo, hi), (b, blo, bhi)))
    xs, ys = (np.array([number[of[i]] for i in at]) for of, at in ((a, rows), (b, columns)))
    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        r, re_, c, ce = todo.pop()
        if r == re_ or c == ce:
            continue
        if (re_ - r) * (ce - c) <= CELLS or re_ - r == 1:
            out += [(rows[i + r], columns[j + c]) for i, j in _by_table(xs[r:re_].tolist(), ys[c:ce].tolist())]
            continue
        half = (r + re_) // 2
        ahead, behind = _lengths(xs[r:half], ys[c:ce]), _lengths(xs[half:re_][::-1], ys[c:ce][::-1])[::-1]
        cut = c + int(np.argmax(ahead + behind))
        todo += [(r, half, c, cut), (half, re_, cut, ce)]
    return sorted(out)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of `a` and every beginning of `b`, a row at a time."""
    best = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (b == x)))
    return best


def _by_table(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for r in range(len(a) - 1, -1, -1):
        for c in range(len(b) - 1, -1, -1):
            best[r][c] = best[r + 1][c + 1] + 1 if a[r] == b[c] else max(best[r + 1][c], best[r][c + 1])
    out, r, c = [], 0, 0
    while r < len(a) and c < len(b):
        if a[r] == b[c]:
            out.append((r, c))
            r, c = r + 1, c + 1
        elif best[r + 1][c] >= best[r][c + 1]:
            r += 1
        else:
            c += 1
    return out


class Template:
    def __init__(self, name: str, words: list[str]) -> None:
        self.name, self.words, self.counts = name, words, Counter(words)
        self.pairs: dict[tuple[str, str], list[int]] = {}
        for j, x in enumerate(zip(words, words[1:], strict=False)):
            self.pairs.setdefault(x, []).append(j)
        # Pairs that the template has once vote for one beginning; others only where these are few.
        once = {x: js for x, js in self.pairs.items() if len(js) == 1}
        self.pairs = once if 2 * len(once) >= len(words) - 1 else self.pairs

    def possible(self, there: Counter, least: float) -> bool:
        """Whether so many of the template's words are there that a copy can be."""
        return sum(min(n, there[w]) for w, n in self.counts.items()) >= least * len(self.words)


def regions(words: list[str], template: Template, least: float, gap: int = GAP) -> Iterator[tuple[int, int]]:
    """Stretches of `words` where the template's words follow each other within `gap` or the template's length, and
    enough of them occur."""
    at = [i for i, w in enumerate(words) if w in template.counts]
    gap, start = max(gap, len(template.words)), 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] - at[k - 1] > gap:
            if template.possible(Counter(words[i] for i in at[start:k]), least):
                yield at[start], at[k - 1] + 1
            start = k


def beginnings(words: list[str], lo: int, hi: int, template: Template, gap: int = GAP) -> list[int]:
    """Places of words[lo:hi] where copies of the template begin, by the pairs of words that they share with it."""
    votes = Counter(i - j for i in range(lo, hi - 1) for j in template.pairs.get((words[i], words[i + 1]), ()))
    n = len(template.words)
    gap = min(gap, max(1, n // 2))
    found: list[int] = []
    group: list[int] = []
    for at in [*sorted(votes), None]:
        if group and (at is None or at - group[-1] > gap):
            # An eighth of the template's pairs makes a beginning; one less than half a copy further on is an insertion.
            if sum(votes[x] for x in group) >= max(1, n // 8) and (not found or group[0] >= found[-1] + max(1, n // 2)):
                found.append(max(lo, group[0]))
            group = []
        if at is not None:
            group.append(at)
    return found


def align(words: list[str], lo: int, hi: int, template: Template, least: float, gap: int = GAP) -> Iterator[tuple[int, int, int, frozenset]]:
    """(first, end, number of aligned words, which words) of copies of the template in words[lo:hi]."""
    n = len(template.words)

    def copy(s: int, e: int) -> tuple[int, int, int, frozenset] | None:
        if not template.possible(Counter(words[s:e]), least):
            return None
        # What follows a copy can take its words' uniqueness away: a window of the template's length stands beside the whole piece.
        ends = sorted({min(e, s + n), min(e, s + n + gap), min(e, s + n + n // 2), e})
        best = None
        for end in ends:
            pairs = patience(words[s:end], template.words, s)
            if pairs and len(pairs) >= least * n and (best is None or len(pairs) > best[2]):
                best = pairs[0][0], pairs[-1][0] + 1, len(pairs), frozenset(words[i] for i, _ in pairs)
        return best

    cuts = sorted({lo, *beginnings(words, lo, hi, template, gap), hi})
    open_: list[tuple[int, int]] = []

    def joined() -> Iterator[tuple[int, int, int, frozenset]]:
        """Copies in pieces that hold none by themselves, two neighbours together, else all."""
        k = 0
        hit = False
        while k + 1 < len(open_):
            if got := copy(open_[k][0], open_[k + 1][1]):
                yield got
                hit, k = True, k + 1
            k += 1
        if not hit and len(open_) > 2 and (got := copy(open_[0][0], open_[-1][1])):
            yield got

    for s, e in zip(cuts, cuts[1:], strict=False):
        if got := copy(s, e):
            yield from joined()
            open_ = [(got[1], e)] if got[1] < e else []
            yield got
        else:
            open_.append((s, e))
    yield from joined()


class Scanner:
    def __init__(self, templates: dict[str, str], least: float, gap: int) -> None:
        self.least, self.gap = least, gap
        self.templates = [Template(name, [w for w, _, _ in tokens(t)]) for name, t in templates.items()]
        self.known = frozenset().union(*(t.counts for t in self.templates))
        # Of each template, the words that tell it from each template alike.
        self.marks = {t.name: [marks for u in self.templates if u is not t and (t.counts & u.counts).total() >= ALIKE * min(len(t.words), len(u.words))
                               and (marks := frozenset(t.counts.keys() - u.counts.keys()))] for t in self.templates}

    def scan(self, text: str) -> list[dict]:
        """Found licenses in order. Of overlapping ones, a template all of whose words that tell it from one alike are missing
        comes last; then that with most aligned words, then the best covered, stays."""
        placed = tokens(text)
        words = [w for w, _, _ in placed]
        there = Counter(filter(self.known.__contains__, words))
        found = []
        for t in self.templates:
            # Distinct words first: at least so many of a copy's are there.
            if there.total() >= self.least * len(t.words) and len(there.keys() & t.counts.keys()) >= len(t.counts) - (1 - self.least) * len(t.words) and t.possible(there, self.least):
                for lo, hi in regions(words, t, self.least, self.gap):
                    found += [(n, n / len(t.words), t.name, s, e, any(own.isdisjoint(marks) for marks in self.marks[t.name]))
                              for s, e, n, own in align(words, lo, hi, t, self.least, self.gap)]
        kept: list[tuple] = []
        taken: set[int] = set()
        for x in sorted(found, key=lambda x: (x[5], -x[0], -x[1], x[2], x[3])):
            if taken.isdisjoint(range(x[3], x[4])):
                taken.update(range(x[3], x[4]))
                kept.append(x)
        return [{"license": name, "start": placed[s][1], "end": placed[e - 1][2], "coverage": round(c, 6)} for _, c, name, s, e, _ in sorted(kept, key=lambda x: x[3])]


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """(doc_id, found): licenses of every document as array<struct(license, start, end, coverage)>, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, gap)
        kind = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())])
        rows = ((i, scanner.scan(text)) for i, text in rows_of(batches, "doc_id", "text"))
        yield from batches_of(rows, pa.schema([("doc_id", pa.int64()), ("found", pa.list_(kind))]), 2_000)

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, found array<struct<license:string,start:int,end:int,coverage:double>>")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_licenses, license, coverage, spans): the best covered license, and all as name:start:end."""
    best = F.get(F.array_sort(F.transform("found", lambda x: F.struct((-x["coverage"]).alias("c"), x["license"].alias("l")))), 0)
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), best["l"].alias("license"),
                        (-best["c"]).alias("coverage"), spans.alias("spans"))
