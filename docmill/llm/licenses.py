"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import table, windows, word_hashes

#: Notices, headers of source files (of licenses too long to give whole) and whole texts of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
_TOKEN = re.compile(rb"[0-9a-z]+")
_BETWEEN = np.array([not (48 <= c < 58 or 97 <= c < 123) for c in range(256)])


def tokens(text: str) -> list[bytes]:
    return _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower())


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (the last of equals) of each window."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.empty(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(v)) + window - 1 - v.argmin(1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], k: int = 3, window: int = 3):
        self.k = k
        self.names, self.words = list(templates), [tokens(t) for t in templates.values()]
        entries = []
        for i, ws in enumerate(self.words):
            h = windows(word_hashes(b" ".join(ws), _BETWEEN)[0], k)
            entries += [(int(h[p]), i, int(p)) for p in winnow(h, window)]
        entries.sort()
        # words of the templates as numbers, and how often each template has them
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.numbered = [np.array([self.vocabulary[w] for w in ws], np.int64) for ws in self.words]
        self.counts = [np.bincount([self.vocabulary[w] for w in ws], minlength=len(self.vocabulary)) for ws in self.words]
        self.keys = np.array([e[0] for e in entries], np.uint64)
        self.where = [(i, p) for _, i, p in entries]

    def hits(self, data: bytes) -> list[tuple[int, int, int]]:
        """(template, word of the text, word of the template) of equal fingerprints."""
        h = word_hashes(data, _BETWEEN)[0]
        if len(h) < self.k:
            return []
        h = windows(h, self.k)
        lo = np.searchsorted(self.keys, h)
        at = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == h)
        out = []
        for j in at.tolist():
            e = int(lo[j])
            while e < len(self.keys) and self.keys[e] == h[j]:
                out.append((self.where[e][0], j, self.where[e][1]))
                e += 1
        return out


    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Words as numbers of the vocabulary; the number past its end for all others."""
        none = len(self.vocabulary)
        return np.array([self.vocabulary.get(w, none) for w in words], np.int64)

    def may_match(self, t: int, numbers: np.ndarray, lo: int, hi: int, coverage: float) -> bool:
        """Whether words lo to hi hold enough of template t's words, in any order, for a reported alignment: a bound that costs little."""
        found = np.bincount(numbers[max(0, lo) : max(0, hi)], minlength=len(self.vocabulary))[: len(self.vocabulary)]
        return int(np.minimum(found, self.counts[t]).sum()) >= coverage * len(self.words[t])


def align(template: np.ndarray, words: np.ndarray, start: int, band: int, lo: int, hi: int, coverage: float) -> tuple[int, int, int] | None:
    """Matched, first and last word of a common subsequence of the template and of words lo to hi, within ``band`` of the diagonal from ``start``.

    Both are arrays of numbers. It is the longest one that is at least ``coverage`` of the template and of its span; of equals the
    shortest, then the earliest. None if there is none. A whole copy in the band is that; without one, all diagonals take a
    template word in one step.
    """
    size, n = len(template), len(words)
    for s in range(max(lo, start - band), min(hi - size, start + band) + 1):
        if words[s] == template[0] and words[s + size - 1] == template[-1] and np.array_equal(words[s : s + size], template):
            return size, s, s + size - 1
    # best[d, m]: latest first word of m matches on a path that ends on diagonal d - band
    best = np.full((2 * band + 1, size + 1), -1)
    found, least = None, max(1, math.ceil(coverage * size - 1e-9))
    for i in range(size):
        first = start + i - band  # the word on the lowest diagonal
        a, b = max(lo, first, 0), min(hi, first + 2 * band + 1, n)
        on = np.flatnonzero(words[a:b] == template[i]) + a if a < b else ()
        new = best[:, : i + 2].copy()
        # a template word without partner moves a path one diagonal down; it ends on the same word, which can't match again
        np.maximum(new[:-1], best[1:, : i + 2], out=new[:-1])
        for j in on:
            d = j - first
            here = best[d, : i + 1].copy()
            here[0] = j
            np.maximum(new[d, 1:], here, out=new[d, 1:])
            if i + 1 >= least:  # so many matches can be enough
                m = np.arange(least, i + 2)
                at = here[m - 1]
                good = np.flatnonzero((at >= 0) & (m >= coverage * size) & (m >= coverage * (j - at + 1)))
                if len(good):
                    got, head = int(m[good[-1]]), int(at[good[-1]])
                    key = (got, head - int(j), -head)
                    if found is None or key > found[0]:
                        found = key, (got, head, int(j))
        np.maximum.accumulate(new, axis=0, out=best[:, : i + 2])
    return found[1] if found else None


def spans(template: np.ndarray, words: np.ndarray, at: int, start: int, band: int, lo: int, coverage: float) -> list[tuple[int, int, int]]:
    """Alignments around the equal fingerprint at word ``at``, in order: the best one, and towards ``at`` those that it leaves room for."""
    out, hi = [], len(words)
    while got := align(template, words, start, band, lo, hi, coverage):
        out.append(got)
        if got[1] > at:
            hi = got[1]
        elif got[2] < at:
            lo = got[2] + 1
        else:
            break
    return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, band: int = 8) -> DataFrame:
    """Where texts hold a template: doc_id, license, n_matched, coverage, start_char, end_char.

    Whole texts are looked through; words are runs of a-z and 0-9, A-Z lower-cased. Every three-word
    fingerprint of a text is looked up among the winnowed ones of the templates, so five equal words in a row
    always make a candidate. A candidate is aligned with its template in a band of diagonals, ``band`` to
    each side and at least as many as words may be missing or added at this coverage; it is
    reported where the matched words are at least ``coverage`` of the template's and of the span's; what a
    band holds too few words for is not aligned. Spans of one template don't overlap; a hit inside another
    template's span is reported too. Of equally long alignments the shortest span, then the earliest is taken. Null or empty text
    gives no rows, as does empty input. Repeated rows are reported each; other columns are ignored. A text is held
    as a whole, with its words.
    """
    texts = templates or TEMPLATES

    def run(batches):
        index = Index(texts)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hits = index.hits(x.as_buffer()) if x.is_valid else []
                if not hits:
                    continue
                data = x.as_py().encode("utf-8", "surrogatepass")
                words = _TOKEN.findall(data.lower())
                numbers = index.numbers(words)
                ends: dict[int, int] = {}
                offsets = None
                for t, j, p in hits:
                    template = index.numbered[t]
                    width = max(band, math.ceil(len(template) * (1 / coverage - 1)))
                    # the band's words hold every match of an alignment
                    if j < ends.get(t, 0) or not index.may_match(t, numbers, max(ends.get(t, 0), j - p - width), j - p + len(template) + width, coverage):
                        continue
                    for n, a, b in spans(template, numbers, j, j - p, width, ends.get(t, 0), coverage):
                        if offsets is None:
                            offsets = [m.span() for m in _TOKEN.finditer(data.lower())]
                            # a byte's character: its place less the bytes before it that go on with a character
                            inner = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)
                        ends[t] = b + 1
                        lo, hi = (e - int(np.searchsorted(inner, e)) for e in (offsets[a][0], offsets[b][1]))
                        for col, v in zip(out, (doc, index.names[t], n, n / len(template), lo, hi), strict=True):
                            col.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "license", "n_matched", "coverage", "start_char", "end_char"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, n_matched long, coverage double, start_char long, end_char long")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").where(F.col("text").isNotNull()))
