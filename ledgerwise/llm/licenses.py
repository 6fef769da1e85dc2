"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case, words of letters and digits), turned into sets of word
bigrams and compared with every template whose size allows the threshold: with a Dice
coefficient of at least t, the smaller set has at least t / (2 - t) times the larger set's
size. A document is compared line by line, paragraph by paragraph and as a whole, since
licence notices mostly stand on lines of their own; and windows over its word sequence find
the others, in mid-line or over several paragraphs of a longer text.

A document's parts have no bigrams that it has not itself. So a template of which the document
holds too few bigrams is ruled out for all of its parts by one look at each bigram.
"""

from __future__ import annotations

import importlib.resources
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

THRESHOLD = 0.8
_WORDS = re.compile(r"[^\W_]+")

# -- fixed values: notices and short licence texts ----------------------------------------
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."),
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under CC BY-SA 4.0.",
    "cc0-notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}


def all_templates() -> dict[str, str]:
    """Name and text of ``TEMPLATES`` and of the files in ``license_texts``: full texts, headers."""
    files = [f for f in importlib.resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(files, key=lambda f: f.name)}
    if both := TEMPLATES.keys() & texts.keys():
        raise ValueError(f"two templates of one name: {sorted(both)}")
    return TEMPLATES | texts


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words; a single word counts as the pair of it and ''."""
    if len(words) == 1:
        return frozenset([(words[0], "")])
    return frozenset(zip(words, words[1:]))


class TemplateIndex:
    """Templates in the order of their sizes, so that a range of sizes is a slice."""

    def __init__(self, templates: dict[str, str], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        words = {name: words_of(t) for name, t in templates.items()}
        sets = [(len(b), name, b) for name, w in words.items() if (b := bigrams(w))]
        self.sets = sorted(sets, key=lambda x: x[:2])
        self.sizes, self.threshold = [x[0] for x in self.sets], threshold
        self.ratio = threshold / (2 - threshold)
        self.by_name = {name: b for _, name, b in self.sets}
        #: A window is at most so many bigrams long: the template's length over the ratio.
        self.longest = {name: int((len(words[name]) - 1) / self.ratio + 1e-9) for name in self.by_name}
        self.single = {name for name in self.by_name if len(words[name]) == 1}
        self.homes: dict[tuple[str, str], list[str]] = {}
        for _, name, b in self.sets:
            for g in b:
                self.homes.setdefault(g, []).append(name)
        self.known = frozenset(self.homes)

    def candidates(self, least: int, most: int) -> list:
        """Templates not ruled out for a text with ``least`` to ``most`` distinct bigrams."""
        return self.sets[bisect_left(self.sizes, least * self.ratio - 1e-9):
                         bisect_right(self.sizes, most / self.ratio + 1e-9)]

    def near(self, words: list[str]) -> set[str]:
        """Templates that some part of the words may match: enough of their bigrams are there."""
        n = Counter(name for g in self.known.intersection(zip(words, words[1:])) for name in self.homes[g])
        return self.single | {name for name, c in n.items() if c >= len(self.by_name[name]) * self.ratio - 1e-9}

    def best(self, words: list[str], near: set[str]) -> tuple[float, str] | None:
        """The nearest template at the threshold or above; ties go to the first name."""
        # every distinct word but the first ends some bigram, so there are at least as many bigrams
        if not words or not self.candidates(max(1, len(set(words)) - 1), max(1, len(words) - 1)):
            return None
        grams, found = bigrams(words), None
        for size, name, other in self.candidates(len(grams), len(grams)):
            dice = 2 * len(grams & other) / (len(grams) + size) if name in near else 0
            if dice >= self.threshold and (found is None or (-dice, name) < (-found[0], found[1])):
                found = dice, name
        return found


def template_windows(index: TemplateIndex, name: str, grams: list[tuple[str, str]], before: list[int]):
    """(dice, first, last) of stretches of ``grams`` near a template, none overlapping another.

    ``before`` has the place of each bigram's last occurrence, or -1. Every window at the
    threshold or above, at most ``longest`` long, overlaps one that is given: of overlapping
    ones the nearest is.
    """
    other, longest, t = index.by_name[name], index.longest[name], index.threshold
    n, least = len(other), len(other) * index.ratio - 1e-9
    hit = np.fromiter((g in other for g in grams), bool, len(grams))
    # a window has at most so many distinct bigrams that are not the template's
    slack, places, todo, out = n * (2 - 2 * t) / t + 1e-9, np.flatnonzero(hit).tolist(), [], []
    first = places[0] if places else 0
    for a, b in zip(places, [*places[1:], None]):
        if b is None or b - a - 1 > slack and len(set(grams[a + 1:b])) > slack:
            todo.append((first, a + 1))
            first = b
    while todo:
        lo, hi = todo.pop()
        if hit[lo:hi].sum() < least:
            continue
        # of the windows that begin at each place and end at j: distinct bigrams, and the template's among them
        size, same = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        floor, j, best = lo, lo, None
        while j < hi:
            s = max(floor, j - longest + 1)
            a = max(before[j] + 1, s)
            size[a - lo:j + 1 - lo] += 1
            done = False
            if hit[j]:
                same[a - lo:j + 1 - lo] += 1
                if same[s - lo] >= least:
                    dice = 2 * same[s - lo:j + 1 - lo] / (size[s - lo:j + 1 - lo] + n)
                    i = s + int(dice.argmax())
                    d = float(dice[i - s])
                    i += int(hit[i:].argmax())  # as near from its first bigram of the template on
                    if d >= t and (best is None or d > best[0] and i <= best[2] or (d, i) == best[:2]):
                        best = d, i, j
                    done = d >= t and i > best[2]
            if best and (done or j - best[2] >= longest or j == hi - 1):
                out.append(best)
                todo.append((floor, best[1]))
                size[best[2] + 1 - lo:j + 1 - lo] = 0
                same[best[2] + 1 - lo:j + 1 - lo] = 0
                floor, j, best = best[2] + 1, best[2], None
            j += 1
    return sorted(out, key=lambda x: x[1])


def spans_of_words(text: str) -> list[tuple[int, int]]:
    """Places of ``words_of(text)`` in the text; lower case may be longer than the text."""
    low = text.lower()
    spans = [m.span() for m in _WORDS.finditer(low)]
    if len(low) != len(text):
        place = [i for i, c in enumerate(text) for _ in c.lower()]
        spans = [(place[s], place[e - 1] + 1) for s, e in spans]
    return spans


def find_windows(index: TemplateIndex, text: str, words: list[str], near: set[str], units: list) -> list:
    """Findings of windows over the word sequence that ``units`` do not give already.

    Where two are over much the same text, the nearer one is given; one whose template is part
    of a longer finding's template, and which lies inside that finding, belongs to it.
    """
    grams, last, before, hits = list(zip(words, words[1:])), {}, [], []
    for i, g in enumerate(grams):
        before.append(last.get(g, -1))
        last[g] = i
    spans = spans_of_words(text)
    for name in sorted(near - index.single):
        hits += [("window", name, d, spans[i][0], spans[j + 1][1])
                 for d, i, j in template_windows(index, name, grams, before)]
    group, groups, end = [], [], -1
    for f in sorted([*units, *hits], key=lambda f: f[3:]):  # findings that overlap, directly or by others
        if f[3] >= end:
            group = []
            groups.append(group)
        group.append(f)
        end = max(end, f[4])
    out = []
    for group in groups:
        given = [f for f in group if f[0] != "window"]
        kept = given[:]
        for f in sorted((f for f in group if f[0] == "window"), key=lambda f: (-f[2], f[1], f[3])):
            if not any(_same_place(f, k) for k in kept):
                kept.append(f)
        out += [f for f in kept[len(given):] if not any(_part_of(index, f, k) for k in kept) and not any(
            k[1] == f[1] and k[3] < f[4] and f[3] < k[4] for k in given)]
    return sorted(out, key=lambda f: f[3:])


def _same_place(f, k) -> bool:
    """Whether ``k`` is over much the same text as ``f`` and at least as near."""
    common = min(f[4], k[4]) - max(f[3], k[3])
    return k[2] >= f[2] and 2 * common >= max(f[4] - f[3], k[4] - k[3])


def _part_of(index: TemplateIndex, f, k) -> bool:
    small, large = index.by_name[f[1]], index.by_name[k[1]]
    return (len(large) > len(small) and k[3] <= f[3] and f[4] <= k[4]
            and len(small & large) >= index.threshold * len(small))


def find_licenses(index: TemplateIndex, text: str) -> list[tuple[str, str, float, int, int]]:
    """(unit, licence, dice, start, end) of every line, paragraph (lines up to a blank one) and
    the whole text that is near a template, and of windows elsewhere; a unit equal to a smaller
    one is not repeated, nor a window of the same licence over a unit."""
    words = words_of(text)
    near = index.near(words)
    if not near:
        return []
    found = find_units(index, text, near)
    return found + find_windows(index, text, words, near, found)


def find_units(index: TemplateIndex, text: str, near: set[str]) -> list[tuple[str, str, float, int, int]]:
    """Findings of lines, paragraphs and the whole text."""
    found, at, block, whole, block_start = [], 0, [], [], 0
    lines = text.split("\n")

    def add(unit, words, start, end):
        if (got := index.best(words, near)) is not None:
            found.append((unit, got[1], got[0], start, end))

    n_block = n_blocks = block_end = 0
    for line in [*lines, None]:
        words = words_of(line) if line is not None else []
        if words:
            add("line", words, at, at + len(line))
            if not block:
                block_start = at
            block.append(words)
            n_block, block_end = n_block + 1, at + len(line)
        elif block:
            n_blocks += 1
            joined = [w for ws in block for w in ws]
            if n_block > 1:
                add("paragraph", joined, block_start, block_end)
            whole += joined
            block, n_block = [], 0
        at += len(line) + 1 if line is not None else 0
    if n_blocks > 1:
        add("whole", whole, 0, len(text))
    return found


FINDINGS = "unit string, license string, dice double, start int, end int"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per finding: ``key``, ``unit`` (line, paragraph, whole, window), ``license``, ``dice``,
    ``start``, ``end`` (code points, end exclusive). ``templates``: name to text, a bounded table
    (several for one licence are fine); by default ``all_templates()``.

    A null or empty text has no findings; repeated rows and null keys are scanned like any;
    of two templates equally near, the first name is given; empty in, empty out. Texts are
    read once, nothing is shuffled.
    """
    ship(docs.sparkSession)
    templates = all_templates() if templates is None else templates
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, threshold)
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1)):
                got = find_licenses(index, t.as_py())
                at += [i] * len(got)
                found += got
            cols = list(zip(*found)) if found else [[]] * 5
            types = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["key", "unit", "license", "dice", "start", "end"])

    return rows.mapInArrow(run, f"key {kind}, {FINDINGS}").withColumnRenamed("key", key)
