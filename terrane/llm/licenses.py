"""License scanning: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Shingles are five words. For each template size, rounded up to a power of two, windows of that many shingles start at
every half window; a notice anywhere lies in one of them up to a quarter. A window that holds a whole notice then has a
Jaccard similarity of 0.5 or more with it, one with 0.8 of its shingles 0.35 or more; with BANDS bands of one row each the chance that
no band agrees is at most 0.65 ** 48 < 2e-9. Windows of one shingle have one value: equality. A retrieved
template is verified by the exact share of its shingles that the document has, anywhere: CONTAINED or more. So a notice with a
passage put into its middle is found as long as one window holds a third of it or more. Shingles are compared as 64-bit values;
two that differ agree by chance once in 2 ** 64 pairs.

TEMPLATES are short notices; `report` takes others, of any number and length, as a table. They go to every worker, TEMPLATE_WORDS
words at most. Nulls and texts without words: no licenses. Documents of fewer than five words have one shingle, all their
words. Repeated rows are scanned each; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import small_batches, whole
from terrane.llm.decontam import FOLD, words
from terrane.llm.transduce import portions

SHINGLE, CONTAINED, BANDS = 5, 0.8, 48
#: Words of all templates together; a table with more is refused.
TEMPLATE_WORDS = 2_000_000
#: Bytes of text that are scanned as one run; a longer text by itself.
PORTION = 1 << 22
ABSENT = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Notices as their licenses give them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code or binary form, for any purpose, commercial or non-commercial, and by any means.",
}

_ODD = [np.uint64(xxhash.xxh64_intdigest(f"m{i}") | 1) for i in range(SHINGLE)]
_MIX = [(np.uint64(xxhash.xxh64_intdigest(f"a{i}") | 1), np.uint64(xxhash.xxh64_intdigest(f"b{i}"))) for i in range(BANDS)]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of folded text, all words at once: a polynomial over the word's bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = raw != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, start)
    size = np.diff(np.append(first, len(kept)))
    powers = np.cumprod(np.full(int(size.max()), _BASE, dtype=np.uint64))
    position = np.arange(len(kept)) - np.repeat(first, size)
    h = np.add.reduceat((raw[kept].astype(np.uint64) + np.uint64(1)) * powers[position], first)
    return start, (h ^ (h >> np.uint64(31))) * _BASE


def _combined(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out += h[i : i + n] * _ODD[i]
    return out ^ (out >> np.uint64(29))


def shingles(ws: list[bytes]) -> np.ndarray:
    """A 64-bit value for each run of five words; for fewer words, one for all."""
    h = _word_hashes(b" ".join(ws))[1]
    return _combined(h, max(1, len(h) - SHINGLE + 1)) if len(h) else h


def _permuted(s: np.ndarray, k: int) -> np.ndarray:
    a, b = _MIX[k]
    x = s * a + b
    return x ^ (x >> np.uint64(32))


class Library:
    """Templates by size class, with a sorted table of band values for each."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.sets = {name: np.unique(shingles(words(text))) for name, text in templates.items()}
        self.classes: dict[int, list[str]] = {}
        for name, s in self.sets.items():
            if len(s):
                self.classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(name)
        self.bands = {}
        for size, names in self.classes.items():
            for k in range(1 if size == 1 else BANDS):
                values = np.array([self.sets[n].min() if size == 1 else _permuted(self.sets[n], k).min() for n in names], dtype=np.uint64)
                order = np.argsort(values)
                self.bands[size, k] = values[order], [names[i] for i in order]

    def candidates(self, s: np.ndarray, valid: np.ndarray) -> set[tuple[int, int, str]]:
        """(size, window start, template): a band of the window agrees with the template's. Shingles that aren't valid count
        as none."""
        out: set[tuple[int, int, str]] = set()

        def compare(low: np.ndarray, size: int, k: int, step: int) -> None:
            values, names = self.bands[size, k]
            at = np.minimum(np.searchsorted(values, low), len(values) - 1)
            for i in np.flatnonzero(values[at] == low):
                j = int(at[i])
                while j < len(values) and values[j] == low[i]:
                    out.add((size, int(i) * step, names[j]))
                    j += 1

        if 1 in self.classes:
            compare(np.where(valid, s, ABSENT), 1, 0, 1)
        sizes = sorted(c for c in self.classes if c > 1)
        for k in range(BANDS if sizes else 0):
            low, half = np.where(valid, _permuted(s, k), ABSENT), 1
            for size in sizes:
                while half < size // 2:  # minima of half windows from those of shorter ones
                    low = np.minimum(low[::2], np.append(low[1::2], ABSENT)[: len(low[::2])])
                    half *= 2
                compare(np.minimum(low, np.append(low[1:], ABSENT)), size, k, half)
        return out

    def scan_all(self, texts: list[str | None]) -> list[dict[str, float]]:
        """For each text the templates found, with their best containment. All texts go through as one run of words; a
        template is verified within each text that its window touches."""
        folded = [(t or "").encode().translate(FOLD) for t in texts]
        start, h = _word_hashes(b" ".join(folded))
        edges = np.zeros(len(folded) + 1, dtype=np.int64)
        np.cumsum([len(f) + 1 for f in folded], out=edges[1:])
        first = np.searchsorted(start, edges)
        out: list[dict[str, float]] = [{} for _ in texts]
        if not len(h):
            return out
        n = max(1, len(h) - SHINGLE + 1)
        s = _combined(h, n)
        doc = np.searchsorted(first, np.arange(n), side="right") - 1
        valid = np.arange(n) + SHINGLE <= first[doc + 1]

        def verify(d: int, name: str, around: np.ndarray) -> None:
            share = float(np.isin(self.sets[name], around).mean())
            if share >= CONTAINED:
                out[d][name] = max(share, out[d].get(name, 0.0))

        for size, at, name in self.candidates(s, valid):
            for d in range(int(doc[at]), int(doc[min(at + size, n) - 1]) + 1):
                low, high = int(first[d]), int(first[d + 1]) - SHINGLE + 1
                if low < high and name not in out[d]:
                    verify(d, name, s[low:high])
        for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE)).tolist():  # all of a short text is one shingle
            one = _combined(h[first[d] : first[d + 1]], 1)
            for name in self.sets:
                verify(d, name, one)
        return out

    def scan(self, text: str) -> dict[str, float]:
        return self.scan_all([text])[0]


@cache
def library() -> Library:
    return Library(TEMPLATES)


def templates_of(table: DataFrame) -> dict[str, str]:
    """name, text of a table of templates; rows without either are left out."""
    rows = table.where("name is not null and text is not null").select("name", "text")
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if size > TEMPLATE_WORDS:
        raise ValueError(f"{size} words of templates; {TEMPLATE_WORDS} at most")
    return {r["name"]: r["text"] for r in rows.collect()}  # TEMPLATE_WORDS words at most


def report(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted, comma-joined), containment (the least of those found; null without).
    templates: (name, text) in place of TEMPLATES."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = Library(templates_of(templates)) if templates is not None else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = own or library()
        for b in batches:
            found = [f for part in portions(b.column(1).to_pylist(), PORTION) for f in lib.scan_all(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array([min(f.values()) if f else None for f in found], pa.float64())], ["doc_id", "n_licenses", "licenses", "containment"])

    return docs.select("doc_id", whole(F.col("text")).alias("text")).mapInArrow(scan, f"doc_id {kind}, n_licenses long, licenses string, containment double")
