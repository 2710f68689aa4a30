"""Licence scans: passages of a text against licence templates, by the Dice coefficient over word bigrams.

Passages are a text's lines, its paragraphs (parted by empty lines), the text itself, and windows that begin and end at any
word. A passage and a template are compared only if the numbers of their distinct bigrams allow the threshold: with
coefficient t, the smaller set has at least t / (2 - t) of the larger. What is left is decided on the bigrams themselves.
Of windows that overlap, the one with the largest coefficient is told, unless it lies in a line that is told with the same
template, or overlaps a line, paragraph or text that is told with it and whose coefficient is as large.

Null and empty texts, and passages of fewer than two words, match nothing. Each row is scanned for itself, so repeated rows
and ids give their matches again, and an empty table gives none. Templates with equal coefficients are all told. A blank
line may end in CR LF: it then parts no paragraph, and windows still find what stands around it. Texts are read whole; other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import license_texts
from attesta.llm.arrow_text import LOWER, lookup, mixed, runs, span_hashes, words

THRESHOLD = 0.8

# Notices as their licences word them, and licences whole.
TEMPLATES = {
    **license_texts.TEXTS,
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "This project is licensed under the terms of the MIT license.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}

#: Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case.
IS_WORD = lookup(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of neighbouring words, with the places where the first begins and the second ends."""
    starts, ends, _ = words(data, offsets, IS_WORD)
    w = span_hashes(data, starts, ends, LOWER)
    return mixed(w[:-1] * np.uint64(3) + w[1:]), starts[:-1], ends[1:]


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, kind) of lines (0), paragraphs of more than one line (1) and texts of more than one paragraph (2)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    line_end = np.flatnonzero((data == 10) | edge[1:]) + 1
    line_begin = np.concatenate(([0], line_end[:-1]))
    blank = (line_end - line_begin == 1) & (data[line_begin] == 10)
    last = blank | edge[line_end]
    after = np.concatenate(([True], last[:-1]))
    para_begin, para_end = line_begin[after], line_end[last]
    many = para_end - para_begin > np.maximum.reduceat(line_end - line_begin, np.flatnonzero(after)) if len(line_begin) else np.zeros(0, bool)
    row = np.searchsorted(offsets, para_begin, "right") - 1
    several = np.flatnonzero(np.bincount(row, minlength=len(offsets) - 1) > 1)
    begin = np.concatenate((line_begin, para_begin[many], offsets[several]))
    end = np.concatenate((line_end, para_end[many], offsets[several + 1]))
    return begin, end, np.repeat([0, 1, 2], [len(line_begin), int(many.sum()), len(several)])


def windows(keys: np.ndarray, own: np.ndarray, threshold: float) -> list[tuple[float, int, int]]:
    """(dice, from, to) of the best windows of one text's bigrams that do not overlap, against one template's bigrams.

    A best window, made as short as can be, begins and ends with known bigrams and holds its first one only once. So a
    start is followed up to the next place of its bigram at most: over all starts, that is a text's length for each bigram
    of the template.
    """
    best, parts = [], [(0, len(keys))]
    while parts:
        at, to = parts.pop()
        taken = _windows(keys[at:to], own, threshold)
        best += [(dice, a + at, b + at) for dice, a, b in taken]
        if taken:  # what lies between them may hold others
            edges = [at, *(x + at for _, a, b in sorted(taken, key=lambda x: x[1]) for x in (a, b)), to]
            parts += list(zip(edges[::2], edges[1::2], strict=True))
    return best


def _windows(keys: np.ndarray, own: np.ndarray, threshold: float) -> list[tuple[float, int, int]]:
    known = np.isin(keys, own)
    if known.sum() < threshold / (2 - threshold) * len(own) - 1e-9:
        return []
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    before, after = np.full(len(keys), -1), np.full(len(keys), len(keys))
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    high = (2 - threshold) / threshold * len(own)
    found = []
    for a in np.flatnonzero(known).tolist():
        size = int(2 * high) + 2
        while True:
            to = min(a + size, int(after[a]))
            new = before[a:to] < a
            n = np.cumsum(new)
            if to == after[a] or n[-1] > high:
                break
            size *= 2
        dice = 2 * np.cumsum(new & known[a:to]) / (n + len(own))
        b = int(np.argmax(dice))
        if dice[b] >= threshold:
            found.append((float(dice[b]), a, a + b + 1))
    taken, best = np.zeros(len(keys), bool), []
    for dice, a, b in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        if not taken[a:b].any():
            held = set(keys[a:b][known[a:b]].tolist())
            while a and not taken[a - 1] and int(keys[a - 1]) in held:  # repeated bigrams at its ends change no coefficient
                a -= 1
            while b < len(keys) and not taken[b] and int(keys[b]) in held:
                b += 1
            taken[a:b] = True
            best.append((dice, a, b))
    return best


def matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, begin, end, license, dice): passages with a template at the threshold or above.

    ``begin`` and ``end`` count code points of the text. A passage with several such templates has a row for each.
    """
    templates = TEMPLATES if templates is None else templates
    names = sorted(templates)
    sets = []
    for name in names:
        raw = np.frombuffer(templates[name].encode(), np.uint8)
        sets.append(np.unique(bigrams(raw, np.array([0, len(raw)]))[0]))
    low = [threshold / (2 - threshold) * len(s) for s in sets]
    high = [(2 - threshold) / threshold * len(s) for s in sets]
    vocabulary = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    member = [np.isin(vocabulary, s) for s in sets]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in runs(batches):
            out: list[tuple] = []
            if len(data) and len(vocabulary):
                keys, first, last = bigrams(data, offsets)
                at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
                is_known = vocabulary[at] == keys
                known = np.concatenate(([0], np.cumsum(is_known)))
                begin, end, kind = passages(data, offsets)
                lo, hi = np.searchsorted(first, begin), np.searchsorted(last, end, "right")
                hi = np.maximum(lo, hi)
                hit = known[hi] - known[lo]  # with repeats, so no less than any overlap
                likely = np.flatnonzero((hit >= threshold / 2 * min(map(len, sets))) & (hi > lo))
                doc_ids = rows.column("doc_id").to_pylist()

                def tell(r: int, begin: int, end: int, name: str, dice: float) -> None:
                    text = data[offsets[r] : end].tobytes()
                    start = len(text[: begin - offsets[r]].decode())
                    piece = text[begin - offsets[r] :].decode().rstrip("\n")
                    out.append((doc_ids[r], start, start + len(piece), name, round(dice, 6)))

                told: dict[tuple[int, int], list[tuple[float, int, int, bool]]] = {}
                for i in likely.tolist():
                    own = np.unique(keys[lo[i] : hi[i]])
                    for t, (name, s, a, b) in enumerate(zip(names, sets, low, high, strict=True)):
                        if a <= len(own) <= b and hit[i] * 2 >= threshold * (len(own) + len(s)):
                            dice = 2 * len(np.intersect1d(own, s, assume_unique=True)) / (len(own) + len(s))
                            if dice >= threshold:
                                r = int(np.searchsorted(offsets, begin[i], "right")) - 1
                                told.setdefault((r, t), []).append((dice, int(lo[i]), int(hi[i]), kind[i] == 0))
                                tell(r, begin[i], end[i], name, dice)
                # A window needs so many different bigrams of a template, and its text has them.
                row_lo = np.searchsorted(first, offsets[:-1])
                row_hi = np.maximum(row_lo, np.searchsorted(last, offsets[1:], "right"))
                place = np.flatnonzero(is_known)
                row = np.searchsorted(offsets, first[place], "right") - 1
                inside = place < row_hi[row]
                pair = np.unique(row[inside] * len(vocabulary) + at[place[inside]])
                row, term = np.divmod(pair, len(vocabulary))
                for t, name in enumerate(names):
                    if not len(sets[t]):
                        continue
                    held = np.bincount(row[member[t][term]], minlength=len(offsets) - 1)
                    for r in np.flatnonzero((held >= low[t] - 1e-9) & (held > 0)).tolist():
                        o = int(row_lo[r])
                        for dice, a, b in windows(keys[o : row_hi[r]], sets[t], threshold):
                            a, b = a + o, b + o
                            if not any(c < b and a < d and (dice <= x or (line and c <= a and b <= d)) for x, c, d, line in told.get((r, t), ())):
                                tell(r, first[a], last[b - 1], name, dice)
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "begin", "end", "license", "dice"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, begin long, end long, license string, dice double")
