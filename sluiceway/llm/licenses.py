"""License scans by patience alignment with license texts.

A text and a template are rows of words. Words that occur once in both are anchors; the
longest increasing subsequence of their places is kept, and the gaps between anchors are
aligned the same way. The coverage is the share of the template's words that are aligned.

A text may hold several licenses, also the same one twice, among much else. So for each
template only windows are aligned that hold enough of its different words, each
a little longer than the template. Texts whose words cannot reach the coverage at all are left
after one comparison of word sets. Of matches that overlap, the one with more words counts.

Null and empty texts hold no license. Capitals, punctuation and line breaks make no
difference. Each row is scanned on its own, whatever its id; other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
# How much longer than the template a match may be.
SLACK = 1.5
SLACK_WORDS = 6
# Templates of so many words are aligned with windows of every length.
SHORT = 16

WORD = re.compile(r"[^\W_]+")

# License notices and texts, without names and years.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "MIT notice": "Released under the MIT License",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "All rights reserved": "All rights reserved",
    "Apache-2.0 header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MIT": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
        OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear
        in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
        TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "BSD-2-Clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions
        in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions
        in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
    "Unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as
        a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def rising(places: list[int]) -> list[int]:
    """Which entries make a longest increasing subsequence."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, place in enumerate(places):
        n = bisect_left(ends, place)
        before.append(last[n - 1] if n else -1)
        if n == len(ends):
            ends.append(place)
            last.append(i)
        else:
            ends[n], last[n] = place, i
    found, i = [], last[-1] if last else -1
    while i >= 0:
        found.append(i)
        i = before[i]
    return found[::-1]


def align(words: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Places of equal words in both, rising in both, by patience alignment."""
    found = []
    todo = [(0, len(words), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        # Equal ends need no anchors.
        while a < b and c < d and words[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and words[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        counts, own = Counter(words[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(words[a:b], a) if counts[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if own[w] == 1 and w in place]
        anchors = [anchors[i] for i in rising([i for i, _ in anchors])]
        if not anchors:
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(found)


class Scanner:
    """Templates as words."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = [(name, WORD.findall(text.lower())) for name, text in templates.items()]
        self.sets = [(name, own, Counter(own)) for name, own in self.templates]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """Name, start, end (in characters) and coverage of each license, by start."""
        if not text:
            return []
        present = set(WORD.findall(text.lower()))
        possible = []
        for name, own, counts in self.sets:
            if sum(n for word, n in counts.items() if word in present) >= self.coverage * len(own):
                possible.append((name, own, counts))
        if not possible:
            return []
        spots = list(WORD.finditer(text))
        words = [spot.group().lower() for spot in spots]
        matches = []
        for name, own, counts in possible:
            for first, last, share in self._matches(words, own, counts):
                matches.append((share * len(own), name, first, last, share))
        kept: list[tuple[str, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        for _, name, first, last, share in sorted(matches, key=lambda m: (-m[0], m[2], m[1])):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                kept.append((name, spots[first].start(), spots[last].end(), share))
        return sorted(kept, key=lambda m: m[1])

    def _matches(self, words: list[str], own: list[str], counts: Counter) -> Iterator[tuple[int, int, float]]:
        """First and last word and coverage of each match of one template."""
        hits = [i for i, word in enumerate(words) if word in counts]
        length = int(SLACK * len(own)) + SLACK_WORDS
        # A window may hold more than one copy, so shorter ones are aligned too; of few words, all.
        lengths = range(len(own) - 2, length + 1) if len(own) <= SHORT else (len(own), length)
        window: Counter = Counter()
        enough = self.coverage * len(own)
        # Words of the template that the window holds, each as often as in the template at most.
        held, at, end = 0, 0, 0
        # A stray word may open a window too early, so the best of the starts inside a match counts.
        best, fit = None, 0.0
        while at < len(hits) or best:
            if best and (at == len(hits) or hits[at] > best[1] or fit == 1):
                yield best
                # Back to the first word behind the match.
                at = end = bisect_right(hits, best[1])
                best, fit, held = None, 0.0, 0
                window.clear()
                continue
            hit = hits[at]
            while end < len(hits) and hits[end] < hit + length:
                word = words[hits[end]]
                window[word] += 1
                held += window[word] <= counts[word]
                end += 1
            if held >= enough:
                found, own_fit = None, 0.0
                for n in lengths:
                    aligned = align(words[hit : hit + n], own)
                    share = len(aligned) / len(own)
                    if share >= self.coverage:
                        first, last = hit + aligned[0][0], hit + aligned[-1][0]
                        # Words between count against a match, so that it does not reach into the next copy.
                        close = 2 * len(aligned) / (len(own) + last - first + 1)
                        if close > own_fit:
                            found, own_fit = (first, last, share), close
                # Another copy may overlap the end of a match; it is found when that is done.
                if found and own_fit > fit and (not best or 2 * (best[1] - found[0] + 1) > len(own)):
                    best, fit = found, own_fit
            word = words[hit]
            held -= window[word] <= counts[word]
            window[word] -= 1
            at += 1


def licenses(
    text: Column, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE
) -> Column:
    """The licenses of a text: an array of ``license``, ``start``, ``end`` and ``coverage``."""

    @F.pandas_udf("array<struct<license string, start int, end int, coverage double>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates, coverage)
        names = ("license", "start", "end", "coverage")
        for part in texts:
            yield pd.Series(
                [[dict(zip(names, m)) for m in scanner.scan(t if isinstance(t, str) else None)] for t in part],
                dtype=object,
            )

    return found(text)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its ``key`` and its ``licenses``."""
    return docs.select(F.col(f"`{key}`").alias(key), licenses(F.col(f"`{text}`")).alias("licenses"))
