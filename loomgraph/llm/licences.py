"""Licence scan: matching statistics of a generalised suffix automaton, chained to template spans.

A suffix automaton of the words of all licence templates (notices, and the full texts in `licence_texts`) is
built once on the driver; it is as large as the templates and doesn't grow with the corpus.  A text is streamed through
it: at each word the automaton knows the longest suffix of the text that occurs in a template (the matching
statistics) and, up its suffix links, the longest one for every other place of every template.  A match of at
least `min_match` words is put down for each place at which it can't go on in that template, though it may go on in
another.  A template's matches that go forward in the text and in the template, with at most `max_gap` words
between, are chained.  A chain that covers `min_cover` of its template is a find.

A match of min_match words needs one of the templates' min_match-grams; where a text has none (found
for all words of a batch at once), the state can't reach a match and the words aren't streamed.
That leaves out nothing.

Defined results: null and empty texts and an empty table have no row; repeated rows have theirs repeated; texts of any
length are read whole; extra columns, whatever their names, are ignored.  Where finds of
several templates overlap, the one stays whose matched words less the words that its template misses are more, so
that a text which breaks off isn't taken for a longer licence; then the larger share of its template, then the first by
name, then the earlier one.  start and finish are character offsets of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, batches, documents, map_arrow, row_grams, word_hashes

MIN_MATCH = 4
MAX_GAP = 20
MIN_COVER = 0.7

TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT notice 2": "Licensed under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0 long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
} | {f"{p.stem} text": p.read_text(encoding="utf-8").strip() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


class Automaton:
    """Generalised suffix automaton over the words of several texts."""

    def __init__(self, texts: list[list[int]], min_match: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sizes = [len(t) for t in texts]
        ends: list[set[tuple[int, int]]] = [set()]

        def state(length: int, moves: dict[int, int], link: int) -> int:
            self.next.append(moves)
            self.length.append(length)
            self.link.append(link)
            ends.append(set())
            return len(self.length) - 1

        def clone(p: int, c: int, q: int) -> int:
            new = state(self.length[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = new
            while p != -1 and self.next[p].get(c) == q:
                self.next[p][c] = new
                p = self.link[p]
            return new

        for number, text in enumerate(texts):
            last = 0
            for i, c in enumerate(text):
                q = self.next[last].get(c)
                if q is not None:  # the words so far are known from another text
                    last = q if self.length[q] == self.length[last] + 1 else clone(last, c, q)
                else:
                    p, last = last, state(self.length[last] + 1, {}, 0)
                    while p != -1 and c not in self.next[p]:
                        self.next[p][c] = last
                        p = self.link[p]
                    if p != -1:
                        q = self.next[p][c]
                        self.link[last] = q if self.length[q] == self.length[p] + 1 else clone(p, c, q)
                ends[last].add((number, i + 1))
        # where the words of a state end in the texts: its own ends and those of states that link to it
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= min_match:
                ends[self.link[s]] |= ends[s]

        def places(of: set[tuple[int, int]]) -> list[tuple[int, int, int | None]]:
            return [(k, e, texts[k][e] if e < len(texts[k]) else None) for k, e in sorted(of)]

        #: for each state its places (template, end, the template's next word), and those of shorter matches on
        #: the way to the root, with their length: every place has the longest match that ends there
        self.places = [places(e) if n >= min_match else [] for e, n in zip(ends, self.length)]
        self.shorter: list[list[tuple[int, int, int | None, int]]] = [[] for _ in ends]
        for s in sorted(range(1, len(self.length)), key=lambda s: self.length[s]):
            up = self.link[s]
            if self.length[up] >= min_match:
                self.shorter[s] = [(*x, self.length[up]) for x in places(ends[up] - ends[s])] + self.shorter[up]

    def matches(self, words: list[int], min_match: int) -> list[tuple[int, int, int, int]]:
        """(template, end in the template, end in the words, length) of all matches that can't be made longer
        at either end in their template, whatever other templates have there."""
        out = []
        s = n = 0
        for i, c in enumerate(words, 1):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            t = self.next[s].get(c)
            if t is None:
                s = n = 0
                continue
            s, n = t, n + 1
            if n < min_match:
                continue
            follows = words[i] if i < len(words) else None
            for k, e, then in self.places[s]:
                if then is None or then != follows:
                    out.append((k, e, i, n))
            for k, e, then, short in self.shorter[s]:
                if then is None or then != follows:
                    out.append((k, e, i, short))
        return out


def chains(matches: list[tuple[int, int, int, int]], sizes: list[int], max_gap: int, min_cover: float) -> list[tuple[int, int, int, int]]:
    """(template, first word, end word, matched words): for each match the chain that ends with it and
    covers most of the template, if that is enough; of equal ones that which starts last."""
    found = []
    by: dict[int, list[tuple[int, int, int]]] = {}
    for k, te, de, n in matches:
        by.setdefault(k, []).append((de, te, n))
    for k, own in by.items():
        if sum(n for _, _, n in own) < min_cover * sizes[k]:
            continue
        own.sort()
        de, te, n = np.array(own, dtype=np.int64).T
        first = np.searchsorted(de, de - n - max_gap)  # matches that end earlier are too far away
        score, start = n.copy(), de - n
        for i in range(len(own)):
            lo = first[i]
            if lo == i:
                continue
            d2, t2 = de[lo:i], te[lo:i]
            # an overlap in either text is counted once
            over = np.maximum(0, np.maximum(d2 - (de[i] - n[i]), t2 - (te[i] - n[i])))
            total = np.where((d2 < de[i]) & (t2 < te[i]) & (over < n[i]) & (te[i] - n[i] - t2 <= max_gap), score[lo:i] + n[i] - over, 0)
            best = total.max()
            if best >= score[i]:
                begin = start[lo:i][total == best].max()
                if (best, begin) > (score[i], start[i]):
                    score[i], start[i] = best, begin
        for i in np.flatnonzero(score >= min_cover * sizes[k]):
            found.append((k, int(start[i]), int(de[i]), int(score[i])))
    return found


def choose(finds: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Finds without overlap, in the order of the text; see the rules above."""
    kept: list[tuple[int, int, int, int]] = []
    for f in sorted(finds, key=lambda x: (sizes[x[0]] - 2 * x[3], -x[3] / sizes[x[0]], x[0], x[1], x[2])):
        at = bisect_left(kept, (f[1], f[2], f[0], f[3]), key=lambda x: (x[1], x[2], x[0], x[3]))
        if (at == 0 or kept[at - 1][2] <= f[1]) and (at == len(kept) or f[2] <= kept[at][1]):
            kept.insert(at, f)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, licence, start, finish, matched, words): spans of licence templates."""
    names = sorted(templates or TEMPLATES)
    hashes, offsets = word_hashes(pa.array([(templates or TEMPLATES)[n] for n in names]))
    texts = [hashes[offsets[i] : offsets[i + 1]].tolist() for i in range(len(names))]
    automaton = Automaton(texts, min_match)
    known = np.unique(row_grams(hashes, offsets, min_match)[0])
    id_type = docs.schema[id_col].dataType.simpleString()

    def finds(words: list[int], text: str):
        kept = choose(chains(automaton.matches(words, min_match), automaton.sizes, max_gap, min_cover), automaton.sizes)
        spans = [m.span() for m in WORD_RE.finditer(text)] if kept else []
        return [(names[k], spans[a][0], spans[b - 1][1], n, automaton.sizes[k]) for k, a, b, n in kept]

    def run(it):
        for b in it:
            for s in batches([b]):
                h, o = word_hashes(s.column(1))
                g, row, _ = row_grams(h, o, min_match)
                at = np.minimum(np.searchsorted(known, g), len(known) - 1) if len(known) else None
                hit = np.unique(row[known[at] == g]) if len(known) and len(g) else []
                rows, out = [], ([], [], [], [], [])
                for i in hit:
                    for f in finds(h[o[i] : o[i + 1]].tolist(), s.column(1)[int(i)].as_py()):
                        rows.append(i)
                        for column, x in zip(out, f):
                            column.append(x)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "licence", "start", "finish", "matched", "words"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"doc_id {id_type}, licence string, start int, finish int, matched int, words int")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


ORACLE_SQL = None
