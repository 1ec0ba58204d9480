"""License scans by patience alignment.

Words that occur once in the text and once in a template are anchors.  The
longest chain of anchors in the same order in both is kept, and the gaps between
them are aligned in the same way: there, more words occur once.  The share of the
template's words that are aligned is its coverage.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.chunks import slices
from touchline.llm.common import documents, inner

#: Notices, headers and texts of public licenses.
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT."""
LIABLE = """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def gnu(name: str, version: str) -> str:
    """The header that the licenses of the GNU project ask for."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version}
of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""


TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. """ + WARRANTY + " " + LIABLE,
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 terms": "under the terms of the GNU General Public License, version 3",
    "GPL-3.0 header": gnu("GNU General Public License", "3"),
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-2-Clause": BSD + " " + BSD_WARRANTY,
    "BSD-3-Clause": BSD + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission. """ + BSD_WARRANTY,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
#: Headers of other GNU licenses; the scan has them only if it is told so, as op2 does.
OTHERS = {
    "GPL-2.0 header": gnu("GNU General Public License", "2"),
    "LGPL-3.0 header": gnu("GNU Lesser General Public License", "3"),
    "LGPL-2.1 header": gnu("GNU Lesser General Public License", "2.1"),
    "AGPL-3.0 header": gnu("GNU Affero General Public License", "3"),
}
#: The least coverage that is reported, and the widest gap within a match, as a share of the template's length.
COVERED, GAP = 0.8, 0.5
#: Word for word within a match: what tells a license from others with nearly its text.
TELLING = {"Apache-2.0": ["apache license version 2 0"], "Apache-2.0 header": ["apache license version 2 0"], "MIT": ["mit license"], "GPL-3.0": ["gnu general public license", "version 3"],
           "GPL-3.0 terms": ["gnu general public license", "version 3"], "GPL-3.0 header": ["gnu general public license", "version 3"], "GPL-2.0 header": ["gnu general public license", "version 2 of"],
           "LGPL-3.0 header": ["gnu lesser general public license", "version 3"], "LGPL-2.1 header": ["gnu lesser general public license", "version 2 1"],
           "AGPL-3.0 header": ["gnu affero general public license", "version 3"], "MPL-2.0 header": ["mozilla public license v 2 0"], "CC-BY-NC-4.0": ["cc by nc 4 0"],
           "CC-BY-4.0": ["creative commons attribution 4 0"], "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0"], "BSD-3-Clause": ["promote products"]}
#: Words of the vocabulary that a notice may have too many of on either side of its telling phrase.
SPARE = 3
#: In a notice of at most NOTICE words one word makes another license: what is not of the notice must be one of NEUTRAL.
NOTICE, NEUTRAL = 20, {"a", "an", "the", "this", "these", "that", "of", "terms", "is", "and", "its"}
PLAIN = str.maketrans(dict.fromkeys(string.punctuation, " "))


def words(text: str) -> list[str]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().translate(PLAIN).split()


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, in which the second increases (patience sorting)."""
    tops, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1}
        anchors = chain([(i, place[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k - i > 1 and m - j > 1]
    return sorted(out)


def gap(b: list[str]) -> int:
    """How far apart two neighbouring aligned words of a match are at most, in words of the text."""
    return max(3, int(GAP * len(b)))


def clusters(ws: list[str], b: list[str], at: dict[str, list[int]]) -> Iterator[list[int]]:
    """The places of the template's words, apart where no match can go across; `at` has the places of each word.

    No word of the template, no match: the alignment of each cluster is all there is.
    """
    run: list[int] = []
    for i in sorted(i for w in set(b) for i in at.get(w, ())):
        if run and i - run[-1] > gap(b):
            yield run
            run = []
        run.append(i)
    if run:
        yield run


def accepted(ws: list[str], lo: int, hi: int, n: int, b: list[str], telling: list[list[str]]) -> bool:
    """Whether a stretch of the text with `n` aligned words is a match of the template."""
    if n < COVERED * len(b):
        return False
    stretch = ws[lo:hi + 1]
    if len(b) <= NOTICE and not NEUTRAL.union(b).issuperset(stretch):
        return False
    return all(any(stretch[k:k + len(p)] == p for k in range(len(stretch) - len(p) + 1)) for p in telling)


def best(ws: list[str], places: list[int], b: list[str], telling: list[list[str]]) -> tuple[int, int, int] | None:
    """The match of template `b` with the most aligned words: their number, first and last word of the text.

    Of equally good ones the first.  Where the alignment of all `places` gives none (a text that holds
    a template twice may have no anchor) they are halved, the halves overlapping by twice the template's length;
    a notice is aligned in every window about its telling phrase instead.
    """
    top = densest(ws, places, b, telling)
    if top is None and len(b) <= NOTICE:
        for window in around(ws, places, b, telling):
            found = densest(ws, window, b, telling)
            if found and (top is None or found[0] > top[0]):
                top = found
            if found and found[0] == len(b):
                break
    elif top is None and len(places) > 3 * len(b):
        mid, over = len(places) // 2, len(b)
        for half in (places[:mid + over], places[mid - over:]):
            if len(half) < len(places) and enough(Counter(ws[i] for i in half), b):
                found = best(ws, half, b, telling)
                if found and (top is None or found[0] > top[0]):
                    top = found
    return top


def densest(ws: list[str], places: list[int], b: list[str], telling: list[list[str]]) -> tuple[int, int, int] | None:
    """Of one alignment the accepted run, without a wider gap, of most words."""
    top, run = None, []
    for i in [*(places[i] for i, _ in aligned([ws[i] for i in places], b)), None]:
        if run and (i is None or i - run[-1] > gap(b)):
            if (top is None or len(run) > top[0]) and accepted(ws, run[0], run[-1], len(run), b, telling):
                top = len(run), run[0], run[-1]
            run = []
        run.append(i)
    return top


def around(ws: list[str], places: list[int], b: list[str], telling: list[list[str]]) -> Iterator[list[int]]:
    """The windows in which a notice can be: about each telling phrase, by as many words as the notice has on either side and SPARE more."""
    phrase = telling[0] if telling else b
    m = len(phrase)
    lead = next((k for k in range(len(b)) if b[k:k + m] == phrase), 0)
    for k in range(len(places) - m + 1):
        if ws[places[k]] == phrase[0] and ws[places[k]:places[k] + m] == phrase:
            for left in range(min(k, lead + SPARE) + 1):
                for right in range(min(len(places) - k - m, len(b) - lead - m + SPARE) + 1):
                    if left + m + right >= COVERED * len(b):
                        yield places[k - left:k + m + right]


def enough(have: Counter, b: list[str]) -> bool:
    """Whether the words of the template are there often enough for the coverage at all."""
    return sum(min(n, have[w]) for w, n in Counter(b).items()) >= COVERED * len(b)


def matched(text: str, wanted: dict[str, list[str]], telling: dict[str, list[list[str]]], vocabulary: set[str]) -> list[tuple[str, int, int, int]]:
    """License, aligned words, first and last word of each match in one text.

    A match within that of a template with more aligned words is a part of that license and not told.
    """
    ws = words(text)
    at: dict[str, list[int]] = {}
    for i, w in enumerate(ws):
        if w in vocabulary:
            at.setdefault(w, []).append(i)
    have, found = Counter({w: len(p) for w, p in at.items()}), []
    for k, b in wanted.items():
        if enough(have, b):
            tops = [t for run in clusters(ws, b, at) if enough(Counter(ws[i] for i in run), b) and (t := best(ws, run, b, telling.get(k, [])))]
            if tops:
                found.append((k, *max(tops, key=lambda t: (t[0], -t[1]))))
    return [x for x in found if not any(y[1] > x[1] and y[2] <= x[2] and x[3] <= y[3] for y in found)]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, telling: dict[str, list[str]] = TELLING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses found in each text: `id`, `license`, `coverage`, `n_aligned`, `first_word`, `last_word` (from 0, inclusive).

    One row per document and template of which COVERED or more is aligned within
    one stretch of the text, which holds the `telling` phrases of the template; in that of
    a notice of NOTICE words at most all other words are NEUTRAL.  Its best stretch if there are several,
    of equally good ones the first.  A stretch within that of a template with more aligned words is left out.
    Null and empty texts have none; repeated rows are scanned alike; an empty table gives no rows.
    A text of any length is held whole by one task, with the places of its words.
    """
    wanted = {k: words(t) for k, t in templates.items()}
    phrases = {k: [words(p) for p in ps] for k, ps in telling.items()}
    vocabulary = {w for t in wanted.values() for w in t}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = iter(batch.column("id").to_pylist()), []
            for text in (t for some in slices(batch.column("text")) for t in some):
                doc_id = next(ids)
                for k, n, lo, hi in matched(text, wanted, phrases, vocabulary):
                    found.append({"id": doc_id, "license": k, "coverage": n / len(wanted[k]), "n_aligned": n, "first_word": lo, "last_word": hi})
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_aligned", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    rows = inner(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(look, "id long, license string, coverage double, n_aligned long, first_word long, last_word long")


def op2_licenses(spark, sf_dir):
    """Licenses in all of `documents`."""
    return scan(documents(spark, sf_dir), TEMPLATES | OTHERS).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_licenses": op2_licenses}
ORACLE: dict[str, str] = {}
