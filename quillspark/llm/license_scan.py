"""License scans by patience alignment.

A template and a stretch of text are aligned on the words that are unique in both: of these anchors the longest run that
is in order on both sides is kept (patience sorting), equal words next to the anchors join it, and the gaps between are
aligned in the same way, and gaps without such words by a longest common subsequence. The share of the template's words that the alignment covers decides.

Stretches are found by anchors: of a template's words the rarest are taken until they have one place more than a copy may
lack, so every copy at or above the coverage holds one of them. Each place of an anchor in the text is taken for each of its places in
the template, which tells where the copy would begin and end, with some slack. From there the stretch grows at both ends, a
slack at a time, while at least one word in DENSE of what is added is one that the template still lacks: words put in between make a copy
longer, not another text. So every mention in a long text is judged on its own, and a template that occurs twice is found twice.

Defined cases: a null or empty text has no license. Words are runs of letters and digits in lower case; offsets are
code points, ends exclusive. Of findings of one stretch that overlap, the one that matches more words stays, of equal ones
the one with the higher coverage, then the one that comes first in the table. Very long texts are scanned whole. Repeated rows give repeated results, rows with
a null id too. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, frame, id_type, small_batches, typed
from quillspark.llm.license_texts import TEXTS

#: License notices as they are published.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd-notice": "Released under the BSD License.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "epl-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "gpl-2.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "lgpl-2.1": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
}
#: Words too frequent in any text to look for first.
COMMON = frozenset("a all an and any are as at be but by for from have if in is it may not of on or other that the their this to under use was we which with you your".split())
#: A stretch grows while one in so many of the words added is still lacking; it may begin with this part of the words that a copy needs.
DENSE, FIRST = 5, 0.4
#: Gaps of at most so many pairs of words are aligned by a full table, larger ones are halved first.
TABLE = 2_500
COVERAGE = 0.75
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def longest_rise(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        tops[k:], at[k:] = ([v], [i]) if k == len(tops) else ([v, *tops[k + 1 :]], [i, *at[k + 1 :]])
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def common_length(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence, by bits of one long number."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def prefix_lengths(a: list[str], b: list[str]) -> list[int]:
    """Length of a longest common subsequence of a with every prefix of b, from the empty one on."""
    masks: dict[str, int] = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return [0, *accumulate(bit == "0" for bit in reversed(f"{v:0{len(b)}b}"))] if b else [0]


def common(a: list[str], b: list[str], i: int, ie: int, j: int, je: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two gaps, as places: one gap is halved and the other cut where both halves together match
    most, until the rest fits a table. Memory grows with the gaps' length, not with their product."""
    pairs, todo = [], [(i, ie, j, je)]
    while todo:
        i, ie, j, je = todo.pop()
        if i == ie or j == je:
            continue
        if ie - i > 1 and (ie - i) * (je - j) > TABLE:
            half, part = (i + ie) // 2, b[j:je]
            ahead, back = prefix_lengths(a[i:half], part), prefix_lengths(a[half:ie][::-1], part[::-1])
            k = max(range(len(part) + 1), key=lambda k: ahead[k] + back[len(part) - k])
            todo += [(i, half, j, j + k), (half, ie, j + k, je)]
        else:
            pairs += tabled(a, b, i, ie, j, je)
    return sorted(pairs)


def tabled(a: list[str], b: list[str], i: int, ie: int, j: int, je: int) -> list[tuple[int, int]]:
    """The same for small gaps."""
    rest = [[0] * (je - j + 1) for _ in range(ie - i + 1)]
    for x in range(ie - i - 1, -1, -1):
        for y in range(je - j - 1, -1, -1):
            rest[x][y] = rest[x + 1][y + 1] + 1 if a[i + x] == b[j + y] else max(rest[x + 1][y], rest[x][y + 1])
    pairs, x, y = [], 0, 0
    while x < ie - i and y < je - j:
        if a[i + x] == b[j + y]:
            pairs.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif rest[x + 1][y] >= rest[x][y + 1]:
            x += 1
        else:
            y += 1
    return pairs


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching places of a and b, in order on both sides."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            pairs.append((ie, je))
        if i == ie or j == je:
            continue
        once_a, once_b = Counter(a[i:ie]), Counter(b[j:je])
        where = {w: n for n, w in enumerate(b[j:je], j) if once_b[w] == 1}
        anchors = [(n, where[w]) for n, w in enumerate(a[i:ie], i) if once_a[w] == 1 and w in where]
        kept = [anchors[k] for k in longest_rise([y for _, y in anchors])]
        pairs += kept or common(a, b, i, ie, j, je)
        for (x, y), (xe, ye) in zip([(i - 1, j - 1), *kept], [*kept, (ie, je)], strict=True) if kept else ():
            todo.append((x + 1, xe, y + 1, ye))
    return sorted(pairs)


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    bag: Counter
    need: int  # words that a copy matches at least
    anchors: dict[str, list[int]]  # places of the rarest words, one place more than a copy may lack: every copy has one of them

    @property
    def slack(self) -> int:
        return len(self.words) // 6 + 2


def template(name: str, text: str, coverage: float) -> Template:
    words = words_of(text)[0]
    bag, need = Counter(words), max(1, ceil(coverage * len(words) - 1e-9))
    anchors: dict[str, list[int]] = {}
    for w in sorted(bag, key=lambda w: (w in COMMON, bag[w], -len(w), w)):
        if sum(map(len, anchors.values())) > len(words) - need:
            break
        anchors[w] = [i for i, x in enumerate(words) if x == w]
    return Template(name, words, bag, need, anchors)


@cache
def templates(coverage: float = COVERAGE) -> list[Template]:
    return [template(name, text, coverage) for name, text in (TEMPLATES | TEXTS).items()]


@cache
def anchor_words(coverage: float) -> frozenset[str]:
    return frozenset(w for t in templates(coverage) for w in t.anchors)


def grown(t: Template, words: list[str], low: int, high: int, free: int) -> tuple[int, int, int]:
    """The stretch low to high, grown at both ends while it takes in words that the template lacks, and how many of these it then has."""
    lack = t.bag - Counter(words[low:high])
    for step in (1, -1):
        while True:
            a, b = (high, min(len(words), high + t.slack)) if step > 0 else (max(free, low - t.slack), low)
            new = Counter(words[a:b]) & lack
            if a >= b or new.total() * DENSE < b - a:
                break
            lack -= new
            low, high = min(low, a), max(high, b)
    return low, high, len(t.words) - lack.total()


def copies(t: Template, words: list[str]) -> Iterator[list[tuple[int, int]]]:
    """Alignments of the template, as places in it and in the text, that cover enough; they don't overlap.
    A stretch has its words in the template's bag counted before it is aligned: places so near that the words which come in
    between can't make up what lacks are passed over."""
    m, slack, first = len(t.words), t.slack, max(1, int(FIRST * t.need))
    free = 0  # words before it belong to a finding of this template
    following = -len(words) - m  # the first begin that may be a copy's

    def pairs_at(low: int, high: int) -> list[tuple[int, int]]:
        part = words[low:high]
        pairs = align(t.words, part)
        if len(pairs) < t.need and common_length(t.words, part) >= t.need:  # unique words that moved misled the alignment
            pairs = common(t.words, part, 0, m, 0, len(part))
        return [(x, low + y) for x, y in pairs]

    for begin, p in sorted((p - i, p) for p, w in enumerate(words) if w in t.anchors for i in t.anchors[w]):
        if begin < following or p < free:
            continue
        low, high = max(free, begin - slack), min(len(words), max(begin + m + slack, free))
        have = Counter(words[low:high])
        held = sum(min(n, have[w]) for w, n in t.bag.items() if w in have)
        if held < first:
            following = begin + first - held
            continue
        low, high, held = grown(t, words, low, high, free)
        pairs = pairs_at(low, high) if held >= t.need else []
        if len(pairs) < t.need:  # a copy that begins within half a slack would lie in this stretch
            following = begin + max(1, slack // 2)
            continue
        a, b = pairs[0][1] - pairs[0][0], pairs[-1][1] + m - pairs[-1][0]  # the copy's own place, with room for what its ends may lack
        again = pairs_at(*grown(t, words, max(free, min(low, a - slack)), min(len(words), max(high, b + slack)), free)[:2])
        pairs = max(pairs, again, key=len)
        free = pairs[-1][1] + 1
        yield pairs


def scan(text: str, coverage: float = COVERAGE) -> list[dict]:
    """Findings in order of their start: license, start, end, matched, coverage."""
    words = [w.lower() for w in WORD.findall(text)]
    present = set(words)
    if present.isdisjoint(anchor_words(coverage)):
        return []
    found, spans = [], None
    for rank, t in enumerate(templates(coverage)):
        m = len(t.words)
        if len(words) < t.need or present.isdisjoint(t.anchors) or len(t.bag.keys() - present) > m - t.need:
            continue
        for pairs in copies(t, words):
            spans = spans or words_of(text)[1]
            found.append((len(pairs), len(pairs) / m, -rank, spans[pairs[0][1]][0], spans[pairs[-1][1]][1], t.name))
    kept: list[tuple] = []  # by start; they don't overlap
    for f in sorted(found, reverse=True):
        k = bisect_left(kept, f[3], key=lambda x: x[3])
        if (k == len(kept) or f[4] <= kept[k][3]) and (not k or kept[k - 1][4] <= f[3]):
            kept.insert(k, f)
    return [{"license": f[5], "start": f[3], "end": f[4], "matched": f[0], "coverage": f[1]} for f in kept]


ITEM = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64())])
SCANNED = pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(ITEM))])


def scan_batches(batches: Iterator[pa.RecordBatch], coverage: float) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        yield frame({"doc_id": b.column(0), "licenses": [scan(t or "", coverage) for t in b.column(1).to_pylist()]}, typed(SCANNED, b))


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, licenses array<struct<license, start, end, matched, coverage>>."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, lambda it: scan_batches(it, coverage), f"doc_id {id_type(rows)}, licenses array<struct<license string, start int, end int, matched int, coverage double>>")


def digest(scanned: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",")
    return scanned.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), listed.alias("licenses"), F.round(F.array_max(F.transform("licenses", lambda x: x["coverage"])), 6).alias("best_coverage"))
