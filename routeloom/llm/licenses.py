"""Operator 5: license scans by Dice's coefficient over word bigrams.

A document is cut at empty lines, line ends and sentence ends.  A unit is any run
from the start of a paragraph, line or sentence to the end of one, so a license of
several paragraphs is found inside a longer document.  A unit's distinct word
bigrams are compared with those of each template; ``2 |A and B| / (|A| + |B|)`` of
at least THRESHOLD is a match.

A unit that matches template T has at least ``h = ceil(t |T| / (2 - t))`` of its
bigrams; documents with fewer are passed over, exactly, after a lookup of their
bigrams' hashes.  In the others units grow from the places of T's bigrams: the best
unit, and among equals the shortest, begins and ends in a piece with a bigram of T
that it has nowhere else, because it is no worse without any other piece; and it
has at most ``|T| (2 - t) / t`` distinct bigrams.

Result: one row for each document and matching license, with the best
coefficient and the place (character offsets) of the first shortest unit that
has it; of a license with several forms (line, notice, beginning, full text) that
is the place of the best form.  The three CC licenses have no template of their
full legal code.  Defined cases: null and empty texts, texts of a single word and empty
tables match nothing.  Each row is scanned by itself and to its end, so repeated rows give
repeated results; a null doc_id is kept, other ids have to be numbers.  Ties are decided as
told.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from importlib.resources import files
from math import ceil

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

THRESHOLD = 0.75

TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",  # as the scan normalises it
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>',
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
#: Licenses whose full text is in license_texts, besides the forms above.
WHOLE = ("Apache-2.0", "GPL-3.0", "MPL-2.0")
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_CUTS = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+|\n"))


def words(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def bigrams(w: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(w, w[1:]))


@cache
def library() -> tuple[list[tuple[int, int, str]], dict[tuple[str, str], int], np.ndarray, np.ndarray, np.ndarray]:
    """Templates (size, least common bigrams, license), numbers of their bigrams, which template has which, and the bigrams' sorted hashes with their numbers."""
    whole = [(name, (files(__package__) / "license_texts" / f"{name}.txt").read_text("utf-8")) for name in WHOLE]
    own = [(name, bigrams(words(t))) for name, t in [*((name, t) for name, texts in TEMPLATES.items() for t in texts), *whole]]
    number = {b: k for k, b in enumerate(sorted(set().union(*(b for _, b in own))))}
    has = np.zeros((len(number), len(own)), np.int32)
    for k, (_, b) in enumerate(own):
        has[[number[x] for x in b], k] = 1
    pairs = tk.tokens(pa.array([" ".join(b) for b in number]))
    hashes = np.concatenate([tk.ngrams(pairs.row(r), 2) for r in range(len(number))])
    order = np.argsort(hashes)
    return [(len(b), ceil(THRESHOLD * len(b) / (2 - THRESHOLD) - 1e-9), name) for name, b in own], number, has, hashes[order], order


def _cuts(text: str) -> tuple[list[int], list[int]]:
    """Sorted starts and ends of the paragraphs, lines and sentences."""
    starts, ends = {0}, {len(text)}
    for pattern in _CUTS:
        for m in pattern.finditer(text):
            ends.add(m.start())
            starts.add(m.end())
    return sorted(starts), sorted(ends)


def units(text: str) -> list[tuple[int, int]]:
    """Spans from any start of a paragraph, line or sentence to any end of one; scan() doesn't list them all."""
    starts, ends = _cuts(text)
    return [(a, b) for a in starts for b in ends if a < b]


def scan(text: str) -> dict[str, tuple[float, int, int]]:
    """Best (dice, start, end) by license."""
    templates, number, has, _, _ = library()
    starts, ends = _cuts(text)
    points = sorted({*starts, *ends})
    w: list[str] = []
    before = {}
    for p, q in zip(points, [*points[1:], len(text)]):
        before[p] = len(w)
        w += words(text[p:q])
    if len(w) < 2:
        return {}
    # of the spans with the same words, the shortest
    start_of = {before[a]: a for a in starts}
    end_of = {before[b]: b for b in reversed(ends)}
    first, last = np.array(sorted(start_of)), np.array(sorted(end_of))

    grams: dict[tuple[str, str], int] = {}
    code = np.array([grams.setdefault(b, len(grams)) for b in zip(w, w[1:])])
    n = len(code)
    ids = np.array([number.get(b, -1) for b in grams])
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    prev, after = np.full(n, -1), np.full(n, n)  # the same bigram's places before and after
    prev[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]

    best: dict[str, tuple[float, int, int]] = {}
    seen = has[ids[ids >= 0]].sum(axis=0)
    for k, (size, least, name) in enumerate(templates):
        if seen[k] < least:
            continue
        most = int(size * (2 - THRESHOLD) / THRESHOLD + 1e-9)
        own = ((ids >= 0) & (has[ids, k] > 0))[code]
        at = np.flatnonzero(own)
        stops = np.unique(last[np.searchsorted(last, at + 2)]) - 1  # ends that have a bigram of the template in their last piece
        piece = np.searchsorted(first, at, "right") - 1
        limit = np.zeros(len(first), np.int64)
        np.maximum.at(limit, piece, after[at])
        enough = np.searchsorted(at, limit) - np.searchsorted(at, first) >= least
        for f in np.flatnonzero(enough & (limit > first)):
            i, far = int(first[f]), int(limit[f])
            length = 2 * most
            while True:
                stop = min(far, i + length)
                new = prev[i:stop] < i
                count = np.cumsum(new)
                if stop == far or count[-1] > most:
                    break
                length *= 2
            e = stops[np.searchsorted(stops, i, "right") : np.searchsorted(stops, i + int(np.searchsorted(count, most, "right")), "right")]
            if not len(e):
                continue
            common = np.cumsum(new & own[i:stop])[e - i - 1]
            dice = 2 * common / (count[e - i - 1] + size)
            x = int(dice.argmax())  # the first is the shortest
            if dice[x] >= THRESHOLD:
                a, b, old = start_of[i], end_of[int(e[x]) + 1], best.get(name)
                if old is None or (-dice[x], b - a, a) < (-old[0], old[2] - old[1], old[1]):
                    best[name] = (float(dice[x]), a, b)
    return best


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, dice, start, stop) for each document and license that it has; dice has six decimals."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, _, has, need, ids_of = library()
        least = np.array([t[1] for t in templates])
        for batch in batches:
            for s in tk.slices(batch, "text"):
                column = s.column("text")
                t = tk.tokens(column)
                h = t.hashes
                pair = tk.mix((np.full(max(len(h) - 1, 0), 2, tk.U64) * tk.U64(tk._BASE) + h[:-1]) * tk.U64(tk._BASE) + h[1:])
                at = np.searchsorted(need, pair)
                at[at == len(need)] = 0
                hit = np.flatnonzero(need[at] == pair)
                held = np.unique((np.searchsorted(t.rows, hit, "right") - 1) * len(need) + ids_of[at[hit]])  # distinct bigrams of each row
                rows, begin = np.unique(held // len(need), return_index=True)
                if len(rows):
                    rows = rows[(np.add.reduceat(has[held % len(need)], begin) >= least).any(axis=1)]
                ids = s.column("doc_id")
                out = [(ids[int(r)].as_py(), name, round(d, 6), a, b) for r in rows for name, (d, a, b) in sorted(scan(column[int(r)].as_py()).items())]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()))], ["doc_id", "license", "dice", "start", "stop"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, license string, dice double, start int, stop int")
