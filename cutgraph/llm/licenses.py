"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Shingles are five words in lower case without surrounding punctuation. A template of c distinct shingles is
looked for in windows of c consecutive shingles at every position, longer templates in parts of PART
shingles; a window's signature is the minimum of each of BANDS permutations of its shingles' hashes, one row
to a band. A text that contains 0.8 of a part has a window whose Jaccard similarity with that part is at
least 0.8 / 1.2 = 2/3 when the shared shingles stand in one window, so that it misses all bands with
probability (1/3) ** BANDS at most. A text without any shingle of a template shares no band and is left at once. Every template that any band of any window retrieves is verified: the share of its
shingles, as words, found in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHashes, mixed, rolled

WIDTH = 5
SIMILARITY = 0.8
BANDS = 8
PART = 16
_EDGE = b".,;:!?()[]{}\"'<>*#-_/"

# Notices as publishers print them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-3-clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-full": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


def scan_words(text: bytes) -> list[bytes]:
    """Words in lower case without punctuation at their edges; those of punctuation only are left out."""
    return [w for x in text.lower().split() if (w := x.strip(_EDGE))]


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width``, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _seeds() -> list[np.uint64]:
    return [np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)) for i in range(BANDS)]


class Templates:
    """Parts of the templates by number of shingles, with the band keys of each."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.words = [scan_words(texts[n].encode()) for n in self.names]
        short = [n for n, w in zip(self.names, self.words, strict=True) if len(w) < WIDTH]
        if short:
            raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
        self.sets = [_shingles(w) for w in self.words]
        hashes = WordHashes()
        keys: dict[int, list[list[tuple[int, int]]]] = {}
        for t, words in enumerate(self.words):
            h = rolled(hashes.of(words), WIDTH)
            for a in range(0, max(1, len(h) - PART + 1), PART // 2):
                part = h[a : a + PART]
                bands = keys.setdefault(len(part), [[] for _ in range(BANDS)])
                for band, seed in zip(bands, _seeds(), strict=True):
                    band.append((int(mixed(part ^ seed).min()), t))
        # a band that a text and a template share is a shingle that they share
        self.shingles = np.unique(np.concatenate([rolled(hashes.of(w), WIDTH) for w in self.words])) if self.words else np.zeros(0, np.uint64)
        self.first_bits = np.zeros(1 << 16, bool)
        self.first_bits[self.shingles >> np.uint64(48)] = True
        # per size and band: sorted keys with the templates they stand for
        self.keys = {size: [(np.array([k for k, _ in sorted(b)], np.uint64), [t for _, t in sorted(b)]) for b in bands] for size, bands in keys.items()}

    def retrieve(self, hashes: np.ndarray) -> set[int]:
        """Templates that share a band with any window of a text's shingle hashes."""
        found: set[int] = set()
        likely = hashes[self.first_bits[hashes >> np.uint64(48)]]
        if not len(likely) or not np.isin(likely, self.shingles).any():
            return found
        for i, seed in enumerate(_seeds()):
            values = mixed(hashes ^ seed)
            for size, bands in self.keys.items():
                least = _sliding_min(values, size) if len(values) >= size else values.min(keepdims=True)
                keys, owners = bands[i]
                hit = least[np.isin(least, keys)]
                if len(hit):
                    hit = set(np.unique(hit).tolist())
                    found.update(t for k, t in zip(keys.tolist(), owners, strict=True) if k in hit)
        return found

    def matches(self, text: bytes | None, hashes: WordHashes) -> list[tuple[str, float, int]]:
        """(template, containment, first word of its first shingle) of each that the text holds, by name."""
        words = scan_words(text) if text else []
        if len(words) < WIDTH:
            return []
        out = []
        for t in sorted(self.retrieve(rolled(hashes.of(words), WIDTH))):
            first: dict[tuple[bytes, ...], int] = {}
            wanted = self.sets[t]
            for i in range(len(words) - WIDTH + 1):
                s = tuple(words[i : i + WIDTH])
                if s in wanted:
                    first.setdefault(s, i)
            if len(first) >= SIMILARITY * len(wanted):
                out.append((self.names[t], len(first) / len(wanted), min(first.values())))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, first_word) for each template that a text holds.

    Null and empty texts hold none; a text that repeats a notice gives one row; repeated rows give their rows
    again; other columns are not read. Templates are a parameter and thereby bounded.
    """
    texts = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = Templates(texts), WordHashes()
        for batch in batches:
            rows = [(i.as_py(), *m) for i, t in zip(batch.column(0), batch.column(1), strict=True) for m in known.matches(t.as_py(), hashes)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "license", "containment", "first_word"])

    return docs.selectExpr("doc_id", "cast(text as binary) text").mapInArrow(run, "doc_id long, license string, containment double, first_word long")
