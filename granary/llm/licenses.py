"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

Texts and templates are words. Runs of ``GRAM`` words are hashed, and of every ``WINDOW`` successive
hashes the least is kept (the last of equals), so any shared passage of GRAM + WINDOW - 1 words shares a
kept hash. Template hashes are an inverted index of (template, position). A document's hits vote for
(template, diagonal); around each voted diagonal the template is aligned with the document inside a band,
as a longest common subsequence of words. A match reports the covered share of the template and the
characters from its first to its last matched word. Of overlapping matches that with most words stays.

Defined results: null and empty texts and templates match nothing; a template of fewer words than GRAM + WINDOW - 1 has
too few for a window, so it is looked up at every word and matched only whole, and one of fewer than GRAM is compared at every word; null document ids stay null; repeated rows give repeated rows; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import tokens

GRAM, WINDOW = 3, 2
_words = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, license string, coverage double, matched int, begin int, end int"

# Notices as their licenses publish them.
TEMPLATES = [
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("MIT-line", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("all-rights-reserved", "All rights reserved."),
]


def grams(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM words."""
    n = len(ids) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = (out ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions kept: the least of each window, of equals the last."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(n) + WINDOW - 1 - windows.argmin(axis=1))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Matched (template, text) positions of a longest common subsequence within the band around text - template = diagonal."""
    m, width = len(template), 2 * band + 1
    best = np.zeros((m + 1, width + 1), np.int32)
    at = diagonal - band + np.arange(width)
    for i in range(m):
        j = at + i
        inside = (j >= 0) & (j < len(text))
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == template[i])
        # A cell's diagonal predecessor is the same column of the row before, the one above is a column to the right.
        up = np.append(best[i, 1:width], 0)
        best[i + 1, :width] = np.maximum.accumulate(np.maximum(best[i, :width] + same, up))
    out, i, c = [], m, int(best[m, :width].argmax())
    while i > 0 and best[i, c] > 0:
        if c > 0 and best[i, c - 1] == best[i, c]:
            c -= 1
            continue
        j = at[c] + i - 1
        if 0 <= j < len(text) and text[j] == template[i - 1] and best[i, c] == best[i - 1, c] + 1:
            out.append((i - 1, int(j)))
            i -= 1
        else:
            i, c = i - 1, min(c + 1, width)
    return out[::-1]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], coverage: float):
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.templates: list[tuple[str, np.ndarray]] = []
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        #: Templates that are one run of words shorter than a window, by its hash.
        self.short: dict[int, list[int]] = defaultdict(list)
        #: Templates shorter than a run, which are compared word for word.
        self.tiny: list[int] = []
        for name, text in templates:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _words.findall((text or "").lower())], np.int64)
            if not len(ids):
                continue
            t = len(self.templates)
            self.templates.append((name, ids))
            if len(ids) < GRAM:
                self.tiny.append(t)
                continue
            h = grams(ids)
            if len(ids) < GRAM + WINDOW - 1:
                self.short[int(h[0])].append(t)
                continue
            for p in winnow(h).tolist():
                self.index[int(h[p])].append((t, p))
        self.hashes = np.array(sorted(self.index), np.uint64)
        self.short_hashes = np.array(sorted(self.short), np.uint64)

    def find(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, begin, end) in the order of the text."""
        ids = np.fromiter(map(self.vocabulary.get, _words.findall(text.lower()), repeat(0)), np.int64)
        found, spans = [], None
        for t in self.tiny:
            name, template = self.templates[t]
            here = np.ones(max(len(ids) - len(template) + 1, 0), bool)
            for k, w in enumerate(template):
                here &= ids[k : k + len(here)] == w
            found += [(len(template), p, p + len(template) - 1, name, 1.0) for p in np.flatnonzero(here).tolist()]
        known = ids > 0
        whole = known[:-2] & known[1:-1] & known[2:] if len(ids) >= GRAM else known[:0]
        if not whole.any() and not found:
            return []
        h = grams(ids)
        # Hashes of runs with a word that no template has are in no window inside a shared passage.
        kept = winnow(h)
        kept = kept[whole[kept]]
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for p in kept[_among(h[kept], self.hashes)].tolist():
            for t, q in self.index[int(h[p])]:
                votes[t, p - q] += 1
        every = np.flatnonzero(whole)
        for p in every[_among(h[every], self.short_hashes)].tolist():
            for t in self.short[int(h[p])]:
                name, template = self.templates[t]
                last = p + len(template) - 1
                if np.array_equal(ids[p : last + 1], template):
                    found.append((len(template), p, last, name, 1.0))
        tried: dict[int, list[int]] = defaultdict(list)
        for (t, diagonal), _ in sorted(votes.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
            name, template = self.templates[t]
            band = max(2, len(template) // 8)
            if any(abs(diagonal - d) <= band // 2 for d in tried[t]):
                continue
            tried[t].append(diagonal)
            matched = align(template, ids, diagonal, band)
            length = matched[-1][1] - matched[0][1] + 1 if matched else 0
            if len(matched) >= self.coverage * len(template) and len(matched) >= self.coverage * length:
                found.append((len(matched), matched[0][1], matched[-1][1], name, len(matched) / len(template)))
        out, taken = [], []
        for n, first, last, name, share in sorted(found, key=lambda x: (-x[0], -x[4], x[1], x[3])):
            if all(last < a or first > b for a, b in taken):
                if spans is None:
                    low = text.lower()
                    spans = [m.span() for m in _words.finditer(low if len(low) == len(text) else text)]
                taken.append((first, last))
                out.append((name, share, n, spans[first][0], spans[last][1]))
        return sorted(out, key=lambda x: x[3])


def from_folder(spark: SparkSession, path: str, most: int = 20_000_000) -> list[tuple[str, str]]:
    """Templates of a folder of texts, such as whole licenses: (file name without its ending, text). The texts are broadcast, so their size is checked: over ``most`` characters are refused."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "").alias("name"), F.col("value").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > most:
        raise ValueError(f"templates of {size} characters are too many to broadcast")
    return sorted((r["name"], r["text"]) for r in rows.collect())


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every license notice in every document: doc_id, license, coverage, matched, begin, end."""
    spark = runtime.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast((templates, coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for batch, held in tokens.portions(batches, "text"):
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), held) for m in scanner.find(text)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "license", "coverage", "matched", "begin", "end"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
