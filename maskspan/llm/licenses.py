"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Shingles are pairs of neighbouring words.  For each template length the text is cut into overlapping windows that are SLACK
longer than the template, STEP of it apart, so that every occurrence lies whole in a window.  A window and a template that it
contains (CONTAINMENT of the template's shingles) have at least the Jaccard similarity floor(); the number of bands of ROWS
min-hashes is the least with which such a pair shares a band with probability CERTAINTY.  A window with fewer template
shingles of any kind than containment demands can't be verified and is passed over before hashing.  Retrieved templates are
verified by their exact containment.

Defined results: null, empty and one-word texts hold no license; a text of any length is scanned whole; every occurrence is told, of
overlapping windows the one of best containment, of equal ones the first; repeated rows give repeated results, a document may hold
several licenses; templates of fewer than two words match nothing; a document without doc_id is scanned, its rows have a null doc_id; columns other than
doc_id and text are ignored; an empty table gives no rows.

Scale: one narrow pass, no shuffle; the templates are a fixed list that travels with the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from ._text import Words, char_index, chunks, mix64

CONTAINMENT = 0.8
CERTAINTY = 0.999
ROWS = 2
SLACK = 0.25

TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "mit-line": "Released under the MIT License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-line": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0",
    "cc0-1.0-line": "Dedicated to the public domain under CC0 1.0",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2",
    "bsd-3-clause-line": "Released under the 3-Clause BSD License",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
#: Whole texts, without title and copyright line.
TEMPLATES |= {
    "mit": TEMPLATES["mit-grant"] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "bsd-2-clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_END,
    "bsd-3-clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END,
    "isc": TEMPLATES["isc-grant"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-whole": TEMPLATES["unlicense"] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.split(" AND NONINFRINGEMENT.")[0],
    "gpl-3.0-header": TEMPLATES["gpl-notice"] + ", either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "apache-2.0-header": TEMPLATES["apache-2.0-notice"] + " " + TEMPLATES["apache-2.0-warranty"] + " See the License for the specific language governing permissions and limitations under the License.",
}


def floor(n: int, window: int) -> float:
    """The least Jaccard similarity of a window (words) and a template (n shingles) that it contains."""
    return CONTAINMENT * n / (window - 1 + (1 - CONTAINMENT) * n)


def bands(similarity: float) -> int:
    """The least number of bands of ROWS rows with which a pair of this similarity collides with probability CERTAINTY."""
    return max(1, math.ceil(math.log(1 - CERTAINTY) / math.log1p(-min(similarity**ROWS, 1 - 1e-9))))


def _min_keys(shingles: np.ndarray, n_bands: int) -> np.ndarray:
    """Band keys (bands x sets) of sets of shingles, one a row of a matrix."""
    out = np.empty((n_bands, len(shingles)), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(n_bands):
            key = np.full(len(shingles), band, np.uint64)
            for row in range(ROWS):
                key = key * np.uint64(0xD6E8FEB86659FD93) + mix64(shingles, 300 + band * ROWS + row).min(axis=1, initial=np.uint64(0xFFFFFFFFFFFFFFFF))
            out[band] = mix64(key)
    return out


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = Words(pa.array([templates[x] for x in self.names], pa.string()))
        value, at = words.shingles(2)
        sets = [np.unique(value[words.doc[at] == k]) for k in range(len(self.names))]
        self.sets = sets
        self.any = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.groups = []
        sizes = np.diff(words.first)
        for n in np.unique(sizes[sizes >= 2]).tolist():
            own = np.flatnonzero(sizes == n)
            window = n + max(1, math.ceil(SLACK * n))
            stride = window - n + 1
            least = min(len(sets[k]) for k in own)
            n_bands = bands(floor(least, window))
            table: dict[int, list[int]] = {}
            for k in own.tolist():
                for key in _min_keys(sets[k][None, :], n_bands)[:, 0].tolist():
                    table.setdefault(key, []).append(k)
            keys = np.array(sorted(table), np.uint64)
            self.groups.append((window, stride, math.ceil(CONTAINMENT * least), n_bands, keys, [table[int(x)] for x in keys]))

    def scan(self, column: pa.Array) -> tuple[Words, list[tuple[int, int, float, int, int]]]:
        """(words, [(document, template, containment, first word, last word)]): of windows whose occurrences overlap the best one."""
        words = Words(column)
        value, at = words.shingles(2)
        pair = np.zeros(len(words), np.uint64)
        pair[at] = value
        known = np.zeros(len(words) + 1, np.int32)
        if not len(at) or not len(self.any):
            return words, []
        place = np.minimum(np.searchsorted(self.any, value), len(self.any) - 1)
        mine = np.zeros(len(words), bool)
        mine[at] = self.any[place] == value
        np.cumsum(mine, out=known[1:])
        hot = np.flatnonzero(mine)
        every: dict[tuple[int, int], set[tuple[float, int, int]]] = {}
        for window, stride, need, n_bands, keys, owners in self.groups:
            # windows begin at every stride-th word of a document; only those around a template's shingle can count
            doc = words.doc[hot]
            step = (hot - words.first[doc]) // stride
            reach = -(-window // stride)
            # a shingle a window back still lies in it
            start = step[:, None] - np.arange(reach + 1)
            begin = words.first[doc][:, None] + start * stride
            begin = np.unique(begin[start >= 0])
            owner = words.doc[begin]
            end = np.minimum(begin + window, words.first[owner + 1])
            live = known[np.maximum(begin, end - 1)] - known[begin] >= need
            begin, end, owner = begin[live], end[live], owner[live]
            for lo in range(0, len(begin), 20_000):
                b, e, d = begin[lo : lo + 20_000], end[lo : lo + 20_000], owner[lo : lo + 20_000]
                cell = b[:, None] + np.arange(window - 1)
                inside = cell < (e - 1)[:, None]
                shingles = pair[np.minimum(cell, len(pair) - 1)]
                shingles = np.where(inside, shingles, shingles[:, :1])
                got = _min_keys(shingles, n_bands)
                spot = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
                band, row = np.nonzero(keys[spot] == got)
                tried = {(r, k) for r, s in zip(row.tolist(), spot[band, row].tolist()) for k in owners[s]}
                for r, k in sorted(tried):
                    hit = np.isin(shingles[r], self.sets[k])
                    score = len(np.unique(shingles[r][hit])) / len(self.sets[k])
                    if score >= CONTAINMENT:
                        spots = np.flatnonzero(hit & inside[r])
                        every.setdefault((int(d[r]), k), set()).add((-score, int(b[r] + spots[0]), int(b[r] + spots[-1] + 1)))
        out = []
        for (doc, k), found in every.items():
            taken: list[tuple[int, int]] = []
            # the best containment first, then the first place
            for score, first, last in sorted(found):
                if all(last < x or first > y for x, y in taken):
                    taken.append((first, last))
                    out.append((doc, k, -score, first, last))
        return words, out


_ready: dict[tuple, Index] = {}


def _index(templates: dict[str, str]) -> Index:
    key = tuple(sorted(templates.items()))
    if key not in _ready:
        _ready[key] = Index(templates)
    return _ready[key]


def _scan(templates: dict[str, str]):
    def run(batches):
        index = _index(templates)
        names = np.array(index.names, object)
        for batch in batches:
            for part in chunks(batch, "text"):
                words, rows = index.scan(part.column(1))
                if not rows:
                    continue
                doc, template, score, first, last = (np.array(x) for x in zip(*sorted(rows)))
                chars = char_index(words.raw)
                base = chars[words.offsets[doc]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(names[template].tolist(), pa.string()), pa.array(score.round(4)), pa.array((chars[words.start[first]] - base).astype(np.int32)), pa.array((chars[words.end[last]] - base).astype(np.int32))],
                    names=["doc_id", "license", "containment", "start", "end"],
                )

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, start, end): every occurrence, in characters, of each license in each document."""
    _spark.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_scan(TEMPLATES if templates is None else templates), "doc_id bigint, license string, containment double, start int, end int")
