"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawloom.llm.batches import blocks, raw
from rawloom.llm.words import Words, mix, shingles, words
from rawloom.session import ship

#: Words of a shingle, and the share of a template's shingles that a text must have.
SHINGLE, CONTAINED = 5, 0.8
#: Windows by the length of a template: (span in shingles, stride, bands, rows of a band).  A template takes the first
#: whose span + stride - 1 it has, so that any copy of it holds a whole window of the grid.  Windows of equal content
#: always collide; windows of similarity 0.8 do in some band with probability 1 - (1 - 0.8^rows)^bands: 0.9997 for
#: spans of 8 and 0.998 for spans of 4.  Shorter windows are equal or at a third of similarity at most.
WINDOWS = ((8, 4, 8, 2), (4, 2, 6, 2), (2, 1, 2, 1), (1, 1, 1, 1))
#: Templates that may be searched for at once: the index is broadcast.
MOST_TEMPLATES, MOST_WORDS = 10_000, 2_000_000

#: Notices and headers of common licenses: fixed public wordings.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0/warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD/redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD/warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/deed": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT/conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT/warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT/short": "This project is licensed under the MIT License.",
    "Apache-2.0/spdx": "SPDX-License-Identifier: Apache-2.0",
    "GPL-2.0/spdx": "SPDX-License-Identifier: GPL-2.0",
    "GPL-3.0/spdx": "SPDX-License-Identifier: GPL-3.0",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL/warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL/copy": "You should have received a copy of the GNU General Public License along with this program. If not, see",
    "ISC/permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC/warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD/source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD/binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause/endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD/liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib/warranty": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib/permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense/dedication": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0/header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0.",
}

_FACTORS = (np.random.default_rng(80).integers(1, 1 << 62, max(b * r for _, _, b, r in WINDOWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def class_of(n: int) -> int:
    """The kind of windows for a template of n shingles."""
    return next(k for k, (span, stride, _, _) in enumerate(WINDOWS) if n >= span + stride - 1)


def signatures(hashes: np.ndarray, starts: np.ndarray, kind: int) -> np.ndarray:
    """MinHash band keys (windows x bands) of the windows of shingle hashes that begin at starts."""
    span, _, bands, rows = WINDOWS[kind]
    keys = np.full((len(starts), bands), kind, np.uint64)
    if not len(starts):
        return keys
    for k, factor in enumerate(_FACTORS[: bands * rows]):
        h = (hashes * factor) >> np.uint64(32)
        least = h[starts]
        for j in range(1, span):
            np.minimum(least, h[starts + j], out=least)
        keys[:, k // rows] = keys[:, k // rows] * np.uint64(0x9E3779B97F4A7C15) + least
    return mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(found: Words, first: int, last: int) -> set[bytes]:
    """The shingles of a run of words, as text in lower case."""
    tokens = [found.text(k).decode("utf-8", "replace").lower() for k in range(first, last)]
    return {" ".join(tokens[k : k + SHINGLE]) for k in range(len(tokens) - SHINGLE + 1)}


@dataclass
class TemplateIndex:
    """names; shingles of each template as text; band keys, sorted, with the templates that have them, and a bit table
    of them for each kind of windows."""

    names: list[str]
    shingles: list[set]
    keys: np.ndarray
    owner: np.ndarray
    bits: dict[int, np.ndarray]


def index_of(templates: dict[str, str]) -> TemplateIndex:
    """Index templates of SHINGLE words or more: the bands of their windows at every offset."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"over {MOST_TEMPLATES} templates")
    names, sets, keys, owner, total = [], [], [], [], 0
    bits: dict[int, np.ndarray] = {}
    for name, text in templates.items():
        found = words([text.encode()])
        hashes = shingles(found.hashes, SHINGLE)
        if not len(hashes):
            raise ValueError(f"{name} has fewer than {SHINGLE} words")
        if (total := total + len(hashes)) > MOST_WORDS:
            raise ValueError(f"templates have over {MOST_WORDS} words")
        kind = class_of(len(hashes))
        made = signatures(hashes, np.arange(len(hashes) - WINDOWS[kind][0] + 1), kind).ravel()
        bits.setdefault(kind, np.zeros(1 << 18, bool))[(made & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        keys.append(made)
        owner.append(np.full(len(made), len(names), np.uint64))
        names.append(name)
        sets.append(shingle_set(found, 0, len(found.hashes)))
    pairs = np.unique(np.stack([np.concatenate(keys), np.concatenate(owner)], axis=1), axis=0) if keys else np.zeros((0, 2), np.uint64)
    return TemplateIndex(names, sets, np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64), bits)


def candidates(index: TemplateIndex, found: Words) -> dict[tuple[int, int], list[int]]:
    """(text, template) to the first words of the windows that collide with one of the template."""
    hashes, doc = shingles(found.hashes, SHINGLE), found.doc
    places: dict[tuple[int, int], list[int]] = {}
    for kind, table in index.bits.items():
        span, stride, bands, _ = WINDOWS[kind]
        starts = np.arange(0, max(0, len(hashes) - span + 1), stride)
        starts = starts[doc[starts] == doc[starts + span + SHINGLE - 2]]
        keys = signatures(hashes, starts, kind)
        for b in range(bands):
            for at in np.flatnonzero(table[(keys[:, b] & np.uint64((1 << 18) - 1)).astype(np.int64)]):
                first, last = np.searchsorted(index.keys, keys[at, b]), np.searchsorted(index.keys, keys[at, b], side="right")
                for t in index.owner[first:last]:
                    places.setdefault((int(doc[starts[at]]), int(t)), []).append(int(starts[at]))
    return places


def scan_texts(index: TemplateIndex, texts: list[bytes]) -> list[tuple[int, str, float, int, int, int]]:
    """(text, template, containment, first word, words, places) of every template that a text contains.

    Candidate places come from band collisions; containment is exact, over the text of the shingles around the
    place; the best place is returned, the first one among equals, and the number of separate places."""
    found = words(texts)
    out = []
    for (k, t), at in candidates(index, found).items():
        want = index.shingles[t]
        reach = len(want) + SHINGLE
        best, count, beyond = (0.0, 0, 0), 0, int(found.first[k])
        for p in sorted(set(at)):
            if p < beyond:
                continue
            first, last = max(beyond, p - reach), min(int(found.first[k + 1]), p + reach + WINDOWS[0][0])
            spots = [q for q in range(first, last - SHINGLE + 1) if shingle_set(found, q, q + SHINGLE) <= want]
            have = len(shingle_set(found, first, last) & want) / len(want)
            if have >= CONTAINED:
                count += 1
                beyond = spots[0] + len(want)  # what is left of this place begins no new one
                if have > best[0]:
                    best = (have, spots[0], min(spots[-1], beyond) + SHINGLE)
        if count:
            out.append((k, index.names[t], best[0], best[1] - int(found.first[k]), best[2] - best[1], count))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, template, containment, first_word, n_words, places): a row for each template that a text holds.

    Whole texts are scanned; nothing is shuffled.  A text holds a template if, around one place, it has CONTAINED
    of the template's shingles of SHINGLE words (lower case, letters and digits).  templates: names (license, a slash,
    part) with their texts, as a dict or a table (template, text) of MOST_TEMPLATES rows at most; TEMPLATES if not
    given.  Null and empty texts hold none; a very long text is scanned whole; of equally good places the first is
    told; repeated rows give repeated results; null ids are kept; further columns, whatever their names, are ignored; an
    empty table gives an empty table."""
    ship(docs.sparkSession)
    if isinstance(templates, DataFrame):
        templates = {r["template"]: r["text"] for r in templates.select("template", "text").limit(MOST_TEMPLATES + 1).collect()}
    index = docs.sparkSession.sparkContext.broadcast(index_of(TEMPLATES if templates is None else templates))
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        for part in blocks(batches, text_col, 2 << 20):
            rows = sorted(scan_texts(index.value, raw(part, text_col)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types, 1)]
            yield pa.record_batch([part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *columns], names=["id", "template", "containment", "first_word", "n_words", "places"])

    found = docs.select(id_col, text_col).mapInArrow(kernel, f"id {kind}, template string, containment double, first_word long, n_words long, places long")
    return found.select(F.col("id").alias(id_col), F.split_part("template", F.lit("/"), F.lit(1)).alias("license"), "template", "containment", "first_word", "n_words", "places")
