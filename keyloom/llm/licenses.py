"""License scans by patience alignment.

A text is compared with each template that it shares enough different words with. Where a
window of the text holds enough words of the template, the two are aligned: words that occur
once in both are anchors, the longest increasing subsequence of them is kept, and the gaps
between anchors are aligned the same way. Aligned words over the template's words is the
coverage, and a window with enough coverage is a match. Of matches that overlap, the one with more aligned
words stays (then with more coverage), so a notice is named once though others are worded much like it.

Everything happens within a row; only the templates (a parameter of fixed size) go to all
tasks. Null, empty and wordless texts match nothing; every place where a template occurs is
reported, however long the text. Rows that repeat are scanned each; an empty table gives an empty
result; a column named ``licenses`` is replaced, others stay.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.store import table
from keyloom.llm.words import ALNUM, slices, split, text_buffers

# Names and texts of license notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}
COVERAGE = 0.8
#: A window is so many times as long as its template, which leaves room for inserted words.
ROOM = 1.5


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Longest increasing subsequence of (place in a, place in b) over the words that occur once in each."""
    in_a: dict = {}
    for i, w in enumerate(a):
        in_a[w] = -1 if w in in_a else i
    in_b: dict = {}
    for j, w in enumerate(b):
        in_b[w] = -1 if w in in_b else j
    pairs = sorted((i, in_b[w]) for w, i in in_a.items() if i >= 0 and in_b.get(w, -1) >= 0)
    tops, top_at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        tops[p : p + 1] = [j]
        top_at[p : p + 1] = [k]
        back.append(top_at[p - 1] if p else -1)
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two word lists: common beginning and end, then anchors and the gaps between them."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        i, ie, j, je = stack.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        found = [(i + x, j + y) for x, y in anchors(a[i:ie], b[j:je])]
        out += found
        for (x, y), (xe, ye) in zip([(i - 1, j - 1), *found], [*found, (ie, je)], strict=True):
            if found and x + 1 < xe and y + 1 < ye:
                stack.append((x + 1, xe, y + 1, ye))
    return sorted(out)


def apart(matches: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of (name, coverage, first word, end, aligned words) those that no better one overlaps, in text order."""
    ends: list[int] = []
    kept: list[tuple[str, float, int, int]] = []
    for name, share, first, end, _ in sorted(matches, key=lambda m: (-m[4], -m[1], m[2], m[0])):
        k = bisect_right(ends, first)  # the first kept match that ends after this one begins
        if k == len(ends) or kept[k][2] >= end:
            ends.insert(k, end)
            kept.insert(k, (name, share, first, end))
    return kept


@dataclass
class Library:
    """Templates as word hashes, and a bitmap of all their words."""

    names: list[str]
    words: list[list[int]]
    coverage: float = COVERAGE

    @staticmethod
    def of(templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> Library:
        offsets, data = text_buffers(pa.array(list(templates.values()), pa.string()))
        w = split(data, offsets, ALNUM)
        return Library(list(templates), [w.hashes[a:b].tolist() for a, b in zip(w.bounds, w.bounds[1:], strict=False)], coverage)

    def scan(self, column: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """(template, coverage, first word, end) of the matches of each text, in text order."""
        offsets, data = text_buffers(column)
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        vocabulary = np.array(sorted({x for t in self.words for x in t}), np.uint64)
        bitmap = np.zeros(2**16, bool)
        bitmap[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        member = np.zeros((len(self.words), len(vocabulary)), bool)
        for t, words in enumerate(self.words):
            member[t, np.searchsorted(vocabulary, np.array(words, np.uint64))] = True
        different, sizes = member.sum(axis=1), np.array([len(words) for words in self.words])
        for a, b in slices(offsets):
            w = split(data, offsets[a : b + 1], ALNUM)
            at = np.flatnonzero(bitmap[(w.hashes & np.uint64(0xFFFF)).astype(np.int64)])
            which = np.minimum(np.searchsorted(vocabulary, w.hashes[at]), len(vocabulary) - 1)
            real = vocabulary[which] == w.hashes[at]
            at, which = at[real], which[real]
            if not len(at):
                continue
            texts, row = np.unique(w.text[at], return_inverse=True)
            has = np.zeros((len(texts), len(vocabulary)), bool)
            has[row, which] = True
            # A word that is missing takes one of the template's words at least; repeated ones may all stay.
            enough = has.astype(np.int32) @ member.T.astype(np.int32) >= np.maximum(1, different - (1 - self.coverage) * sizes - 1e-9)
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            for r in np.flatnonzero(enough.any(axis=1)):
                i = int(texts[r])
                words = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                places, ids = at[bounds[r] : bounds[r + 1]] - w.bounds[i], which[bounds[r] : bounds[r + 1]]
                for t in np.flatnonzero(enough[r]):
                    out[a + i] += self._match(int(t), words, places[member[t, ids]])
                out[a + i] = apart(out[a + i])
        return out

    def _match(self, t: int, words: np.ndarray, places: np.ndarray) -> list[tuple[str, float, int, int, int]]:
        template = self.words[t]
        reach = int(np.ceil(ROOM * len(template)))
        inside = np.searchsorted(places, places + reach) - np.arange(len(places))
        found, after = [], -1
        for k in np.flatnonzero(inside >= self.coverage * len(template)):
            p = int(places[k])
            if p < after:
                continue
            pairs = align(words[p : p + reach].tolist(), template)
            share = len(pairs) / len(template)
            if share >= self.coverage and pairs[0][0] == 0:
                found.append((self.names[t], share, p, p + pairs[-1][0] + 1, len(pairs)))
                after = found[-1][3]
        return found


def scan(docs: DataFrame, library: Library | None = None, text_col: str = "text") -> DataFrame:
    """Every row with all its columns and ``licenses``, its matches in text order, which replaces any column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(library or Library.of())
    out = docs.withColumn("licenses", F.lit(None).cast("array<struct<name:string,coverage:double,first_word:int,end_word:int>>"))
    at, to = out.columns.index(text_col), out.columns.index("licenses")

    def run(batches):
        for b in batches:
            columns, kind = list(b.columns), b.column(to).type
            columns[to] = pa.array([[dict(zip(("name", "coverage", "first_word", "end_word"), m, strict=True)) for m in ms] for ms in shared.value.scan(b.column(at))], kind)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return out.mapInArrow(run, out.schema)


def op10_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.transform("licenses", lambda m: F.concat_ws(":", m["name"], m["first_word"].cast("string"), m["end_word"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(places, ",").alias("matches"), F.array_max(F.transform("licenses", lambda m: m["coverage"])).alias("coverage"))
