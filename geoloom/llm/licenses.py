"""License scans by patience alignment.

A template is aligned with a stretch of text: words that occur once in either are anchors, the longest increasing
subsequence of their places is kept, and the gaps between kept anchors are aligned the same way until nothing unique
is left; equal words right before and after a match belong to it. Coverage is the share of the template's words so
matched; the words that identify a license must all be among them.

A match is narrowed to a stretch of which it fills a good part, so that two notices side by side are two. It does not
count if a word that names a sibling stands beside an identifying one (Library in a GNU license, the 0 of MIT-0), or if
what comes right before it says that it does not apply. Where an identifier line is found, all licenses of its
expression are listed, each if it is written out as it is known.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts of public license notices, by the name that is reported (what follows a space tells apart the
#: wordings of one license). Words in [] identify the license: a stretch that misses one of them is no match.
TEMPLATES = {
    "Apache-2.0": "Licensed under the [Apache] License, Version [2.0].",
    "Apache-2.0 notice": "Licensed under the [Apache] License, Version [2.0] (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 short notice": "Licensed under the [Apache] License, Version [2.0] (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 head": "[Apache] License Version [2.0], January 2004 http://www.apache.org/licenses/ [TERMS] AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSL-1.0": "Distributed under the [Boost] Software License, Version [1.0].",
    "BSL-1.0 text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, [execute], and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC0-1.0": "To the extent possible under law, the author has [waived] all copyright and related or neighboring rights to this work.",
    "CC0-1.0 short": "Released under [CC0] [1.0].",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the [Eclipse] Public License [2.0] which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-2.0 short": "Released under the [Eclipse] Public License, version [2.0].",
    "GPL short name": "Licensed under [GPL] [{v}].",
    "LGPL short name": "Licensed under [LGPL] [{v}].",
    "AGPL short name": "Licensed under [AGPL] [{v}].",
    "BSD": "Released under the [BSD] License.",
    "BSD-2-Clause": "Released under the [BSD] [2]-[Clause] License.",
    "BSD-3-Clause": "Released under the [BSD] [3]-[Clause] License.",
    "BSD-2-Clause text": "[Redistribution] and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following [disclaimer]. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause text": "[Redistribution] and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following [disclaimer]. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. [Neither] the name of the copyright holder nor the names of its contributors may be used to [endorse] or [promote] products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Released under the [ISC] License.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice [appear] in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER [TORTIOUS] ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU] [General] [Public] License as published by the Free Software Foundation, either version [{v}] of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL short notice": "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU] [General] [Public] License as published by the Free Software Foundation, either version [{v}] of the License, or (at your option) any later version.",
    "GPL": "This work is licensed under the [GNU] [General] [Public] License, version [{v}].",
    "LGPL": "This work is licensed under the [GNU] [Lesser] [General] [Public] License, version [{v}].",
    "LGPL short notice": "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU] [Lesser] [General] [Public] License as published by the Free Software Foundation; either version [{v}] of the License, or (at your option) any later version.",
    "AGPL": "This work is licensed under the [GNU] [Affero] [General] [Public] License, version [{v}].",
    "AGPL short notice": "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU] [Affero] [General] [Public] License as published by the Free Software Foundation, either version [{v}] of the License, or (at your option) any later version.",
    "MIT": "Released under the [MIT] License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, [sublicense], and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, [sublicense], and/or sell copies of the Software",
    "MPL-2.0": "Released under the [Mozilla] Public License, Version [2.0].",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the [Mozilla] Public License, v. [2.0]. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the [public] [domain]. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to [alter] it and redistribute it freely, subject to the following restrictions",
}
#: The versions of the GNU licenses, and the kinds and versions of the Creative Commons ones.
GNU_VERSIONS = {"GPL": ("1", "2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution ShareAlike", "BY-NC": "Attribution NonCommercial", "BY-ND": "Attribution NoDerivatives", "BY-NC-SA": "Attribution NonCommercial ShareAlike", "BY-NC-ND": "Attribution NonCommercial NoDerivatives"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def templates() -> dict[str, str]:
    """The templates with those of each version and kind written out, and each license's short identifier line."""
    out = {}
    for name, text in TEMPLATES.items():
        license, _, wording = name.partition(" ")
        for v in GNU_VERSIONS.get(license, ("",)):
            full = f"{license}-{v if '.' in v else v + '.0'}" if v else license
            short = v if "." in v or wording != "short name" else f"{v}.0"
            out[f"{full} {wording}".strip()] = text.format(v=short) if v else text
    marked = lambda words: " ".join(f"[{w}]" for w in re.split(r"[ -]", words))
    for kind, words in CC_KINDS.items():
        for v in CC_VERSIONS:
            out[f"CC-{kind}-{v}"] = f"Licensed under [CC] {marked(kind)} [{v}]."
            out[f"CC-{kind}-{v} name"] = f"This work is licensed under a Creative [Commons] {marked(words)} [{v}] International License."
    for license in sorted({name.split(" ")[0] for name in out}):
        out[f"{license} identifier"] = f"[SPDX] License [Identifier] {marked(license)}"
    return out


#: Words that make another license of a name beside them, and words that take a notice back.
SIBLINGS = (b"library", b"lesser", b"affero", b"gnu", b"apache", b"mozilla", b"eclipse", b"boost", b"mit", b"bsd", b"isc", b"sharealike", b"noncommercial", b"noderivatives", b"sa", b"nc", b"nd")
DENIALS = (b"not", b"never", b"neither", b"isn", b"aren", b"wasn")
#: Words of a stretch that a match fills at least.
DENSE = 0.6
_EXPRESSION = re.compile(rb"spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]+)")
_ID = re.compile(rb"[a-z0-9.+-]+")

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:\.[0-9]+)*")
_MARKED = re.compile(rb"\[([0-9a-z\x80-\xff]+(?:\.[0-9]+)*)\]|([0-9a-z\x80-\xff]+(?:\.[0-9]+)*)")


def _unique(words, lo: int, hi: int) -> dict[int, int]:
    once: dict[int, int] = {}
    for i in range(lo, hi):
        once[words[i]] = i if words[i] not in once else -1
    return {w: i for w, i in once.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending in the first) that also ascends in the second."""
    tops, piles, back = [], [], []
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            piles.append(n)
        else:
            tops[k], piles[k] = b, n
        back.append(piles[k - 1] if k else -1)
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(text, template) -> list[tuple[int, int]]:
    """(place in text, place in template) of the matched words, ascending in both; words are numbers."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = _unique(text, a, b), _unique(template, c, d)
        anchors = _increasing(sorted((i, there[w]) for w, i in here.items() if w in there))
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if r - p > 1 and s - q > 1:
                todo.append((p + 1, r, q + 1, s))
    return sorted(out)


class Templates:
    """Templates as numbers of words; `needed` are the places and `marks` the numbers of the words that identify each."""

    def __init__(self, texts: dict[str, str]):
        names, words, needed = [], [], []
        for name, text in sorted(texts.items()):
            found = [(m[1] or m[2]) for m in _MARKED.finditer((text or "").lower().encode())]
            if found:
                names.append(name)
                words.append(found)
                needed.append({i for i, m in enumerate(_MARKED.finditer(text.lower().encode())) if m[1]})
        self.names = names
        self.ids = {n.split(" ")[0].lower().encode(): n.split(" ")[0] for n in names}
        self.numbers = {w: n for n, w in enumerate(sorted({w for ws in words for w in ws}), 1)}
        self.words = [[self.numbers[w] for w in ws] for ws in words]
        self.needed = needed
        self.marks = [{ws[i] for i in need} for ws, need in zip(self.words, needed)]
        self.held = [np.bincount(ws, minlength=len(self.numbers) + 1) for ws in self.words]


def _stretches(ids: np.ndarray, template: list[int], held: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Stretches of a text that hold enough of a template's words for that coverage; together they hold every match.

    A match lies within 2 * n words of text for a template of n words, so the text is cut into stretches of 4 * n
    words that overlap by half. held: how often the template has each word; more than that cannot match.
    """
    n, mine = len(template), held[ids] > 0
    upto, out = np.r_[0, np.cumsum(mine)], []
    need = max(1, int(np.ceil(least * n)))
    if upto[-1] < need:
        return out
    starts = np.arange(0, max(1, len(ids) - 2 * n), 2 * n)
    ends = np.minimum(len(ids), starts + 4 * n)
    for k in np.flatnonzero(upto[ends] - upto[starts] >= need).tolist():
        a, b = int(starts[k]), int(ends[k])
        if np.minimum(np.bincount(ids[a:b], minlength=len(held)), held).sum() >= need:
            out.append((a, b))
    return out


def _within(matches: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The most matches that lie within 2 * n words of text."""
    best, lo = (0, 0), 0
    for hi in range(len(matches)):
        while matches[hi][0] - matches[lo][0] >= 2 * n:
            lo += 1
        best = max(best, (hi - lo + 1, -lo))
    return matches[-best[1] : -best[1] + best[0]]


def _dense(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The matches without those beyond the widest gaps, until they fill a good part of their stretch."""
    while len(matches) > 1 and len(matches) < DENSE * (matches[-1][0] - matches[0][0] + 1):
        gap = max(range(1, len(matches)), key=lambda k: matches[k][0] - matches[k - 1][0])
        matches = max(matches[:gap], matches[gap:], key=len)
    return matches


class _Words:
    """The words of a text with their places, looked at only where something was found."""

    def __init__(self, text: bytes):
        self.text, self._spans = text, None

    @property
    def spans(self) -> list[tuple[int, int]]:
        if self._spans is None:
            self._spans = [m.span() for m in _WORD.finditer(self.text)]
        return self._spans

    def word(self, k: int) -> bytes:
        return self.text[slice(*self.spans[k])]

    def sibling(self, k: int, own: set[bytes]) -> bool:
        """Whether a word right beside word k makes another license of it."""
        for q in (k - 1, k + 1):
            if 0 <= q < len(self.spans):
                between = self.text[self.spans[min(k, q)][1] : self.spans[max(k, q)][0]]
                w = self.word(q)
                if w not in own and (w in SIBLINGS and between in (b" ", b"-", b"/", b"+") or w.isdigit() and between == b"-"):
                    return True
        return False

    def denied(self, k: int) -> bool:
        """Whether one of the two words before word k takes back what follows."""
        return any(self.word(q) in DENIALS and b"." not in self.text[self.spans[q][1] : self.spans[k][0]] for q in range(max(0, k - 2), k))


def expressions(text: bytes, ids: dict[bytes, str]) -> list[tuple[str, int, int]]:
    """(license, start, end) in bytes of the known licenses in identifier lines; what is not known is not listed.

    Names may end in -only, -or-later or +; the words between names are or, and, with, and what follows `with` is an
    exception of the license before it.
    """
    out = []
    for line in _EXPRESSION.finditer(text):
        skip, expect = False, True
        for m in _ID.finditer(line[1]):
            word = m[0]
            if word in (b"or", b"and", b"with"):
                skip, expect = word == b"with", True
                continue
            if not expect:
                break  # the expression is over
            expect = False
            known = ids.get(re.sub(rb"(-only|-or-later|\+)$", b"", word))
            if known and not skip:
                out.append((known, line.start(1) + m.start(), line.start(1) + m.end()))
            skip = False
    return out


def scan_text(text: bytes, templates: Templates, least: float) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) in words of each stretch of text that covers a template well enough."""
    get = templates.numbers.get
    ids = np.array([get(w, 0) for w in _WORD.findall(text)], np.int64)
    present = set(np.unique(ids).tolist())
    every, words = [], _Words(text)
    for name, template, held, needed, marks in zip(templates.names, templates.words, templates.held, templates.needed, templates.marks):
        if not marks <= present:
            continue
        own = {w for w, n in templates.numbers.items() if n in set(template)} if needed else set()
        found = []
        for a, b in _stretches(ids, template, held, least):
            part = ids[a:b].tolist()
            todo, seen = [(0, len(part))], set()
            while todo:
                lo, hi = todo.pop()
                if (lo, hi) in seen:
                    continue
                seen.add((lo, hi))
                wide = _within(align(part[lo:hi], template), len(template))
                matches = _dense(wide)
                if len(matches) >= least * len(template) and needed <= {j for _, j in matches}:
                    s, e = lo + matches[0][0], lo + matches[-1][0] + 1
                    # an identifier line names its first license right behind the mark; the others come with the expression
                    apart = name.endswith(" identifier") and e - s > len(matches) or any(words.sibling(a + lo + i, own) for i, j in matches if j in needed)
                    if not apart and not words.denied(a + s):
                        found.append((len(matches), len(matches) / len(template), a + s, a + e))
                    todo += [(lo, s), (e, hi)]
                elif len(wide) > max(1, len(matches)) and len(wide) >= least * len(template):
                    # words of two notices: look on both sides of the widest gap, each without the other's words
                    gap = max(range(1, len(wide)), key=lambda k: wide[k][0] - wide[k - 1][0])
                    todo += [(lo, lo + wide[gap][0]), (lo + wide[gap - 1][0] + 1, hi)]
                elif hi - lo > 2 * len(template):
                    step = len(template)  # repeated copies hide each other's unique words: look closer
                    todo += [(x, min(hi, x + 2 * step)) for x in range(lo, hi - step, step)]
        every += [(-n, y - x, -c, name, x, y) for n, c, x, y in set(found)]
    out: list[tuple[str, float, int, int]] = []
    for _, _, c, name, x, y in sorted(every):  # the template with most words in a place takes it, in the least room
        if all(y <= s or e <= x for _, _, s, e in out):
            out.append((name.split(" ")[0], -c, x, y))
    if b"spdx-license-identifier:" in text:
        starts = [s for s, _ in words.spans]
        for license, x, y in expressions(text, templates.ids):
            i, j = bisect_left(starts, x), bisect_left(starts, y)
            if all(j <= s or e <= i for _, _, s, e in out):
                out.append((license, 1.0, i, j))
    return out


_SPAN = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def _scanned(sent, least: float):
    def scanned(batches):
        templates = sent.value
        numbered = {n: w for w, n in templates.numbers.items()}
        # each template needs one of its rarest words: a text without any of them holds none
        marks = sorted({max((numbered[n] for n in (need or set(words))), key=len) for need, words in zip(templates.marks, templates.words)}) if all(templates.marks) else None
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            out = []
            for k in range(batch.num_rows):
                text = bytes(raw[at[k] : at[k + 1]]).lower()
                found = scan_text(text, templates, least) if marks is None or any(m in text for m in marks) else []
                found.sort(key=lambda x: (x[2], x[3], x[0]))
                best = max(found, key=lambda x: (x[1], x[3] - x[2], x[0]), default=None)
                out.append((best and best[0], best[1] if best else 0.0, len(found), [dict(zip(("license", "coverage", "start", "end"), x)) for x in found]))
            cols = list(zip(*out)) if out else [()] * 4
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.list_(_SPAN)]
            yield pa.RecordBatch.from_arrays([batch.column("did"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["did", "license", "coverage", "n_spans", "spans"])

    return scanned


def scan(docs: DataFrame, texts: dict[str, str] | None = None, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """License notices in texts: a row (key, license, coverage, n_spans, spans) for each row of docs.

    spans lists every stretch that covers a template at least to `least` (license, coverage, start and end in words of
    letters, digits and characters beyond ASCII, case folded); license and coverage are those of the best one (of equal
    ones the longer, then the later name), else null and 0. A stretch that misses a word in [] of the template is none,
    so a near name or another version is not taken for it; of templates that cover the same words the one that matches
    most of them is listed. texts: templates by name, what follows a space in a name is not reported (default:
    `templates()`). A null or empty text has none; repeated rows, null keys and very long texts are like any others;
    other columns are ignored, also such that bear the result's names; an empty table gives an empty result. One pass,
    no shuffle; the templates are sent to the executors.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(key).alias("did"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["did"]
    sent = spark.sparkContext.broadcast(Templates(templates() if texts is None else texts))
    out = rows.mapInArrow(_scanned(sent, least), f"did {kind}, license string, coverage double, n_spans long, spans array<struct<license:string,coverage:double,start:long,end:long>>")
    return out.withColumnRenamed("did", key)
