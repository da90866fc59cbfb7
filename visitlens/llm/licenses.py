"""License scan: winnowed fingerprints of templates find candidates, banded alignment reports what matches and where.

Templates are few and go to every task as an inverted index from fingerprint to places in templates. A document's words are
hashed once; only documents that share fingerprints with a template are aligned with it, in a band around the diagonal
that the shared fingerprints agree on.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

GRAM_WORDS = 3
WINDOW = 4
LEAST_COVERAGE = 0.8
BAND = 8
MOST_TEMPLATE_WORDS = 20_000
WORD = re.compile(r"[^\W_]+")

# Public license notices, by their SPDX names.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                  "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
                    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
                    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                    "other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
               "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
               "later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
               "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
               "later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def word_hashes(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in known), np.uint64, len(known))
    return own[ids] if len(ids) else own


def grams(hashes: np.ndarray, size: int = GRAM_WORDS) -> np.ndarray:
    """Hashes of the word n-grams in text order; a text of fewer words, but not none, is one n-gram."""
    n = min(size, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - n + 1 + i]
    return total ^ (total >> np.uint64(32))


def winnowed(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest value of every run of `window` values; equal text gives equal choices."""
    if len(values) <= window:
        return np.flatnonzero(values == values.min()) if len(values) else np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(runs.argmin(axis=1) + np.arange(len(runs)))


class TemplateIndex:
    """Hashed words of the templates, and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [word_hashes(WORD.findall(templates[name].lower())) for name in self.names]
        if sum(map(len, self.words)) > MOST_TEMPLATE_WORDS * max(1, len(self.names)):
            raise ValueError(f"templates of over {MOST_TEMPLATE_WORDS} words a piece do not fit into every task")
        self.places: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for number, own in enumerate(self.words):
            # Short templates have all their n-grams: one changed word may hit a single fingerprint, and the middle of
            # five words all n-grams of three.
            size = GRAM_WORDS if len(own) > 2 * GRAM_WORDS - 1 else GRAM_WORDS - 1
            size = min(size, len(own))
            values = grams(own, size)
            chosen = winnowed(values) if len(values) >= 2 * WINDOW else np.arange(len(values))
            for place in chosen.tolist():
                self.places[size][int(values[place])].append((number, place))
        self.known = {size: np.array(sorted(own), np.uint64) for size, own in self.places.items()}


def banded_alignment(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence of template `a` and text `b` within `band` of the diagonal j = i + shift.

    Returns the matched words and the first place and the place after the last in `b`, the shortest such span.
    """
    width = 2 * band + 1
    best = np.zeros(width + 2, np.int64)
    start = np.full(width + 2, -1, np.int64)
    end = np.full(width + 2, -1, np.int64)
    for i in range(len(a)):
        new, new_start, new_end = best.copy(), start.copy(), end.copy()
        for k in range(1, width + 1):
            j = i + shift + k - 1 - band
            # column k of row i - 1 is the diagonal step, k + 1 the step down, k - 1 of this row the step right
            value, s, e = best[k + 1], start[k + 1], end[k + 1]
            if new[k - 1] > value or (new[k - 1] == value and new_start[k - 1] > s):
                value, s, e = new[k - 1], new_start[k - 1], new_end[k - 1]
            if 0 <= j < len(b) and a[i] == b[j]:
                up, begin = best[k] + 1, start[k] if best[k] else j
                if up > value or (up == value and begin > s):
                    value, s, e = up, begin, j + 1
            new[k], new_start[k], new_end[k] = value, s, e
        new[0] = new[width + 1] = 0
        best, start, end = new, new_start, new_end
    k = int(np.lexsort((start, best))[-1])
    return int(best[k]), int(start[k]), int(end[k])


def separate_places(words: np.ndarray, hashes: np.ndarray, hits: list[tuple[int, int]], least: float, band: int) -> list[tuple[int, int, int]]:
    """(matched words, start, end) of the places where `least` of the template's `words` align around the `hits` (place, shift).

    A place found is taken out of the text, and a hit outside all places found is tried again on the words left around it.
    """
    spans: list[tuple[int, int, int]] = []
    failed = set()
    for place, shift in hits:
        while True:
            at = bisect.bisect_right(spans, place, key=lambda span: span[1])
            if at and place < spans[at - 1][2]:
                break
            low = spans[at - 1][2] if at else 0
            high = spans[at][1] if at < len(spans) else len(hashes)
            low, high = max(low, shift - band), min(high, shift + len(words) + band)
            if (shift, low, high) in failed:
                break
            own = hashes[low:high]
            # no alignment holds more words than stand in the window at all
            matched, start, end = banded_alignment(words, own, shift - low, band) if np.isin(words, own).sum() >= least * len(words) else (0, 0, 0)
            if not matched or matched < least * len(words):
                failed.add((shift, low, high))
                break
            bisect.insort(spans, (matched, low + start, low + end), key=lambda span: span[1])
    return spans


def match_licenses(text: str, index: TemplateIndex, least: float = LEAST_COVERAGE, band: int = BAND) -> list[tuple[str, float, int, int]]:
    """(name, coverage, start, end) of every template found, spans in code points, end exclusive, one per separate place."""
    found = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
    if not found:
        return []
    hashes = word_hashes([w.lower() for w, _, _ in found])
    hits = defaultdict(set)
    for size, known in index.known.items():
        values = grams(hashes, size)
        for place in np.flatnonzero(np.isin(values, known)).tolist():
            for number, own in index.places[size][int(values[place])]:
                hits[number].add((place, place - own))
    out = []
    for number in sorted(hits):
        out += [(index.names[number], matched / len(index.words[number]), found[start][1], found[end - 1][2])
                for matched, start, end in separate_places(index.words[number], hashes, sorted(hits[number]), least, band)]
    return sorted(out, key=lambda m: (m[2], m[3], m[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                  least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per document: the id, `n_matches` and `matches`, an array of (license, coverage, start, end).

    A template matches where `least` or more of its words align in order within a band; `coverage` is that share, the
    span runs over the aligned words in code points. Words are lower-cased runs of letters and digits. Null, empty and
    wordless texts match nothing; repeated rows give equal rows, an empty table an empty one. Texts are read whole.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)

    @F.pandas_udf("array<struct<license:string,coverage:double,start:long,end:long>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([
            [{"license": n, "coverage": c, "start": s, "end": e} for n, c, s, e in match_licenses(text or "", index, least)]
            for text in texts])

    matched = docs.select(docs[id_col], found(docs[text_col]).alias("matches"))
    return matched.select(id_col, F.size("matches").cast("long").alias("n_matches"), "matches")
