"""License scans: patience alignment of texts with license notices and texts.

Words that occur once in a part of the text and once in the template are anchors, their longest increasing subsequence is
kept, and the gaps between kept anchors are aligned likewise; what stands equal beside an anchor or a gap's end is matched
word by word. Coverage is the share of the template's words that are matched. A part is reported from a given coverage on;
of those that overlap, the one with the most matched words stands, then the one with the higher coverage, the earlier, the
shorter, the first by name. One-line notices also need the name of their license among the matched words.

Which parts are aligned is no guess: a part of at most a template's length and a quarter more can only be covered enough if
it holds that many of the template's words, counted with their repeats. A sliding count finds all places where one can
start, and windows over all of them are aligned.

Words are lower-cased runs of letters and digits; spans are code points of the text, end exclusive. Null and empty texts
match nothing. Every row is scanned by itself, in whole, without a shuffle, so repeated rows and ids give repeated results,
further columns have no influence, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import common

WORD = re.compile(r"[^\W_]+")
LEAST_COVERAGE = 0.8

#: Texts and notices as their licenses give them, and the words of a one-line notice that name its license. Fixed values.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", ("apache",)),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        (),
    ),
    "MIT": ("Released under the MIT License.", ("mit",)),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        (),
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
        "02110-1301 USA.",
        (),
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", ("gnu",)),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        (),
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        (),
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        (),
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        (),
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        (),
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        (),
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
        (),
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        (),
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
        (),
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following:",
        (),
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", ("cc", "nc")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", ("cc",)),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "sharealike")),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived",)),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        (),
    ),
}


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []  # the value that ends the best subsequence of each length
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both. Works on a list of gaps, so depth is no limit."""
    found, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        once = {w: n for n, w in enumerate(b[k:m], k) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = [(n, once[w]) for n, w in enumerate(a[i:j], i) if w in once]
        kept = [anchors[x] for x in longest_increasing([y for _, y in anchors])]
        if not kept:
            continue
        found += kept
        for (p, q), (r, s) in zip([(i - 1, k - 1), *kept], [*kept, (j, m)], strict=True):
            gaps.append((p + 1, r, q + 1, s))
    return sorted(found)


def windows(words: list[str], template: Counter, size: int, needed: float) -> list[tuple[int, int]]:
    """Windows of words that cover every part of at most `size` words that holds `needed` of the template's words or more,
    each word counted as often as the template has it at most."""
    step = max(1, size // 8)
    held: Counter = Counter()
    count, starts = 0, []
    for end in range(len(words) + size - 1):
        if end < len(words) and (w := words[end]) in template:
            held[w] += 1
            count += held[w] <= template[w]
        start = end - size + 1
        if count >= needed:
            starts.append(max(start, 0))
        if start >= 0 and (w := words[start]) in template:
            count -= held[w] <= template[w]
            held[w] -= 1
    kept: list[int] = []
    for s in starts:
        if not kept or s >= kept[-1] + step:
            kept.append(s)
    return [(s, min(len(words), s + size + step)) for s in kept]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES, least: float = LEAST_COVERAGE):
        self.least = least
        self.templates = []
        for name, (text, names) in templates.items():
            words = WORD.findall(text.lower())
            self.templates.append((name, words, Counter(words), names))

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, license, coverage) of the parts that stand, by start."""
        there = set(WORD.findall(text.lower()))
        likely = [t for t in self.templates if all(w in there for w in t[3]) and sum(n for w, n in t[2].items() if w in there) >= self.least * len(t[1])]
        if not likely:
            return []
        spots = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
        words = [w for _, _, w in spots]
        found = set()
        for name, template, counts, names in likely:
            for a, b in windows(words, counts, len(template) + len(template) // 4 + 3, self.least * len(template)):
                pairs = patience(words[a:b], template)
                if len(pairs) >= self.least * len(template) and set(names) <= {template[k] for _, k in pairs}:
                    found.add((len(pairs), len(pairs) / len(template), spots[a + pairs[0][0]][0], spots[a + pairs[-1][0]][1], name))
        stand: list[tuple[int, int, str, float]] = []
        for _, coverage, start, end, name in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3] - x[2], x[4])):
            if not any(s < end and start < e for s, e, _, _ in stand):
                stand.append((start, end, name, coverage))
        return sorted(stand)


def find(docs: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id and found, an array of (start, end, license, coverage), for every row."""
    held = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))

    def run(batches):
        scanner = Scanner(least=least)
        for batch in batches:
            spans = [[dict(zip(("start", "end", "license", "coverage"), x, strict=True)) for x in scanner.scan(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, held)], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<start:long,end:long,license:string,coverage:double>>")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, license (that of the most covered span, the first of equals; null without any), coverage, spans."""
    best = F.element_at(F.array_sort(F.transform("found", lambda x: F.struct((-x["coverage"]).alias("c"), x["start"].alias("s"), x["license"].alias("l")))), 1)
    spelled = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",")
    some = F.size("found") > 0
    return find(common.documents(spark, sf_dir)).select(
        "doc_id",
        F.size("found").cast("long").alias("n_licenses"),
        F.when(some, best["l"]).alias("license"),
        F.when(some, F.round(-best["c"], 6)).alias("coverage"),
        spelled.alias("spans"),
    )
