"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Words are lower-cased runs of letters and digits. Fingerprints of templates and texts are the smallest hash of every
WINDOW neighbouring K-word runs, so any shared run of K + WINDOW - 1 words has one in common; the inverted index maps a
fingerprint to its templates and places. A shared fingerprint puts the template's first word at a place of the text;
the words from a band before it to a band after its end are the candidate region; the band is a quarter of the template,
from 2 to BAND words, so that copies that follow one another do not hide each other. A region goes where fewer of its words
stand in the template than the least coverage needs (an upper bound of the matches, so no finding is lost); regions that
are left are aligned with the whole template in a band, all regions of a template at once. Of candidates of one template
whose places lie within half a band of an aligned one before, only the first is aligned: they share its band.

Reported are alignments that match at least `coverage` of the template's words. Of those that overlap, the ones with the
higher coverage, then more words, then the first name, then the higher score, then the later begin stay.

Templates are a list of (name, text) with at most MAX_WORDS words in all, so the index has a fixed bound. Null or empty
texts have no findings; null and repeated doc_ids are rows like others; texts of any length are read whole; other columns
are not looked at. A name given twice is two templates, of which equal findings are reported once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

K = 2
WINDOW = 2
BAND = 12
MAX_WORDS = 200_000
TABLE_LOG2 = 18
#: cells of one table of regions, for bounded memory
CELLS = 1 << 19

#: public license texts and notices (fixed values)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-header", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
]


def align(template: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, matches, begin and end in the region of the best alignment of the whole template with every region.

    A region has len(template) + 2 * band + 1 places, and template place i may match places i to i + 2 * band; numbers
    below -1 stand for no word. Scores: 2 for a match, -1 for any other word of either side within the alignment; of
    equal scores the one with more matches, then the later begin, then the earlier end counts.
    """
    # a cell is (score, matches, begin) in one number; column o of row i is the region's place i + o
    m, wide = len(template), regions.shape[1] - len(template)
    unit, one, off, none = np.int64(1) << 42, np.int64(1) << 21, np.arange(wide), np.iinfo(np.int64).min // 2
    there = regions >= -1  # words of a text stand together: before its place j comes a word or j is its first
    before = np.pad(there[:, :-1], ((0, 0), (1, 0)))
    row = np.where((there | before)[:, :wide], off, none)
    for i in range(1, m + 1):
        at = slice(i - 1, i - 1 + wide)  # the word that a diagonal step uses
        new = np.where(there[:, at], row + np.where(regions[:, at] == template[i - 1], 2 * unit + one, -unit), none)
        new[:, :-1] = np.maximum(new[:, :-1], row[:, 1:] - unit)
        # words of the text between: each costs one
        new = np.maximum.accumulate(np.maximum(new, none) + off * unit, axis=1) - off * unit
        row = np.where((there | before)[:, i : i + wide] & (new > none // 2), new, none)
    best = row.argmax(1)
    cell = row[np.arange(len(row)), best]
    return cell >> 42, (cell >> 21) & ((1 << 21) - 1), cell & ((1 << 21) - 1), best + m


def band_of(size: int) -> int:
    """Band of a template of that many words."""
    return min(BAND, max(2, size // 4))


class Index:
    """Inverted index of the templates' fingerprints, and for each template word the templates that hold it."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float = 0.8):
        self.names = [n for n, _ in templates]
        hashed = [words.word_hashes(pa.array([t], pa.string()), words.LETTER_WORDS)[0] for _, t in templates]
        if sum(map(len, hashed)) > MAX_WORDS:
            raise ValueError(f"templates have more than {MAX_WORDS} words")
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        self.words = [np.searchsorted(self.vocabulary, h) for h in hashed]
        self.least = [max(1, int(np.ceil(coverage * len(h) - 1e-9))) for h in hashed]
        keys, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, h in enumerate(hashed):
            r = words.runs(h, K)
            at = np.unique([k + int(r[k : k + WINDOW].argmin()) for k in range(max(1, len(r) - WINDOW + 1))]) if len(r) else np.zeros(0, np.int64)
            keys.append(r[at])
            owners.append(np.full(len(at), i))
            places.append(at)
        keys_, owners_, places_ = (np.concatenate(x) for x in (keys, owners, places))
        order = np.argsort(keys_, kind="stable")
        self.owners, self.places = owners_[order], places_[order]
        self.keys, self.begin = np.unique(keys_[order], return_index=True)
        self.size = np.diff(np.append(self.begin, len(order)))
        self.tables = [self._table(self.keys), self._table(self.vocabulary)]

    @staticmethod
    def _table(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << TABLE_LOG2, bool)
        out[(keys >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)] = True
        return out

    @staticmethod
    def _find(h: np.ndarray, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Numbers of the hashes among the keys, -1 for others."""
        out = np.full(len(h), -1)
        if len(keys):
            some = np.flatnonzero(table[(h >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
            yes = keys[at] == h[some]
            out[some[yes]] = at[yes]
        return out

    def candidates(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, text, place of the template's first word among all words; may lie outside the text), each once."""
        r, z = words.runs(h, K), np.zeros(0, np.int64)
        if not len(r) or not len(self.keys):
            return z, z, z
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(r)]
        at = words.winnow(r, np.arange(len(r)) + K <= first[1:][doc], WINDOW)
        k = self._find(r[at], self.keys, self.tables[0])
        at, k = at[k >= 0], k[k >= 0]
        n = self.size[k]
        pick = np.repeat(self.begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.stack((self.owners[pick], np.repeat(doc[at], n), np.repeat(at, n) - self.places[pick]), 1)
        order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
        found = found[order]
        new = np.ones(len(found), bool)
        new[1:] = (np.diff(found, axis=0) != 0).any(1)
        return tuple(found[new].T)

    @staticmethod
    def _regions(ids: np.ndarray, first: np.ndarray, doc: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
        """Words of the texts from every begin on; -2 outside the text."""
        at = begin[:, None] + np.arange(width)
        out = ids[np.clip(at, 0, len(ids) - 1)]
        return np.where((at >= first[:-1][doc][:, None]) & (at < first[1:][doc][:, None]), out, -2)

    def findings(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, str, int, int, int, int]]:
        """(text, name, begin, end, matched, size) for texts in a row, by text and begin; places are words of the text."""
        template, text, begin = self.candidates(h, first)
        if not len(template):
            return []
        ids = self._find(h, self.vocabulary, self.tables[1])
        rows: dict[int, set] = {}
        for i in np.unique(template).tolist():
            t, some = self.words[i], template == i
            band = band_of(len(t))
            doc, at, width = text[some], begin[some], len(t) + 2 * band + 1
            member = np.zeros(len(self.vocabulary) + 1, bool)
            member[t] = True
            sums = np.concatenate(([0], np.cumsum(member[ids])))
            lo, hi = np.maximum(at - band, first[:-1][doc]), np.minimum(at + len(t) + band, first[1:][doc])
            left, last = np.flatnonzero(sums[hi] - sums[lo] >= self.least[i]), (-1, 0)
            for k in range(0, len(left), max(1, CELLS // width)):
                part = left[k : k + max(1, CELLS // width)]
                regions = self._regions(ids, first, doc[part], at[part] - band, width)
                own, times = np.unique(t, return_counts=True)
                if len(own) <= 64:  # words that a region has more often than the template count no more than there
                    good = sum(np.minimum((regions == w).sum(1), n) for w, n in zip(own.tolist(), times.tolist())) >= self.least[i]
                    part, regions = part[good], regions[good]
                far = np.zeros(len(part), bool)
                for j, (d, a) in enumerate(zip(doc[part].tolist(), at[part].tolist())):
                    far[j] = d != last[0] or a - last[1] > band // 2
                    last = (d, a) if far[j] else last
                part, regions = part[far], regions[far]
                score, matched, a, b = align(t, regions)
                base = at[part] - band - first[:-1][doc[part]]
                for d, s, m, x, y in zip(doc[part].tolist(), score.tolist(), matched.tolist(), (base + a).tolist(), (base + b).tolist()):
                    if m >= self.least[i]:
                        rows.setdefault(d, set()).add((-m / len(t), -m, self.names[i], -s, -x, y, len(t)))
        out: list[tuple] = []
        for d in sorted(rows):
            mine: list[tuple] = []
            for _, m, name, _, x, y, size in sorted(rows[d]):
                x = -x
                if all(y <= o[2] or x >= o[3] for o in mine):
                    mine.append((d, name, x, y, -m, size))
            out += sorted(mine, key=lambda o: o[2])
        return out


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = 0.8) -> DataFrame:
    """One row per finding: doc_id, license, begin_word, end_word, begin_char, end_char, matched_words, coverage."""
    docs = common.one_column(documents, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, coverage))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for b in words.pieces(batch, "text"):
                data, offsets = words.bytes_of(b.column(1))
                begins, ends, first = words.spans(data, offsets, words.LETTER_WORDS)
                rows = []
                for d, name, lo, hi, m, size in index.findings(words.hashes(data, begins, ends), first):
                    f = int(first[d])
                    chars = [int(np.count_nonzero((data[offsets[d] : x] & 0xC0) != 0x80)) for x in (begins[f + lo], ends[f + hi - 1])]
                    rows.append((b.column(0)[d].as_py(), name, lo, hi, *chars, m, m / size))
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "license", "begin_word", "end_word", "begin_char", "end_char", "matched_words", "coverage"])

    return docs.mapInArrow(find, "doc_id long, license string, begin_word long, end_word long, begin_char long, end_char long, matched_words long, coverage double")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
