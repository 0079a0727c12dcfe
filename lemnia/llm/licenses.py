"""License scans: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcore import Words, blocks, buffers, char_positions, grams

#: Public license notices, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-short": "This work is licensed under the GNU Lesser General Public License.",
    "AGPL-short": "This work is licensed under the GNU Affero General Public License.",
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
GRAM, WINDOW, BAND = 3, 4, 8
#: Words up to which a template has single words in the index too.
SHORT = 24
LEAST_COVERAGE = 0.75

SCHEMA = "doc_id long, license string, coverage double, span_start long, span_end long, n_matched long"


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost least hash of each window; all of a shorter text's least."""
    if not len(g):
        return np.zeros(0, np.int64)
    w = min(window, len(g))
    view = np.lib.stride_tricks.sliding_window_view(g, w)
    return np.unique(np.arange(len(view)) + (w - 1 - np.argmin(view[:, ::-1], axis=1)))


class Index:
    """Inverted indexes, by gram length, from fingerprint to (template, position).

    Winnowing finds what shares WINDOW + GRAM - 1 words in a row.  A short
    template may share less of them though enough of its words are there.  As
    at most m - least * m of its m words are missing, one of any more than that is
    left, and so many of its longest words are fingerprints too.
    """

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        self.names = list(templates)
        self.words = []
        found: dict[int, list[tuple]] = {1: [], GRAM: []}
        for t, text in enumerate(templates.values()):
            buf, off = buffers(pa.array([text]))
            w = Words(buf, off, lower=True, alnum=True)
            m = len(w.hash)
            self.words.append(w.hash)
            g = grams(w.hash, GRAM)
            found[GRAM] += [(int(g[p]), t, int(p)) for p in winnow(g, WINDOW)]
            if m <= SHORT:
                g = grams(w.hash, 1)
                longest = sorted(range(m), key=lambda p: (w.start[p] - w.end[p], p))
                found[1] += [(int(g[p]), t, p) for p in longest[: m - math.ceil(least * m) + 1]]
        self.by_size = {k: sorted(x) for k, x in found.items() if x}
        self.hash = {k: np.array([h for h, _, _ in x], np.uint64) for k, x in self.by_size.items()}

    def hits(self, w: Words) -> list[tuple[int, int, int]]:
        """(word, template, position in the template) of all fingerprints found in the words."""
        out = []
        for k, hashes in self.hash.items():
            g = grams(w.hash, k)
            at = np.searchsorted(hashes, g)
            near = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == g)
            stop = np.searchsorted(hashes, g[near], "right")
            out += [(int(p), *self.by_size[k][i][1:]) for p, a, b in zip(near, at[near], stop, strict=True) for i in range(a, b)]
        return sorted(out)


def align(doc: np.ndarray, template: np.ndarray, shift: int, band: int = BAND):
    """Banded alignment of the template to doc positions near shift + i.

    Returns (matches, first, last + 1) of the best path; match 1, mismatch and gap cost a little.
    """
    width = 2 * band + 1
    offs = np.arange(-band, band + 1)
    score = np.zeros(width)
    hits = np.zeros(width, np.int64)
    first = np.full(width, -1, np.int64)
    last = np.full(width, -1, np.int64)
    for i, word in enumerate(template):
        pos = shift + i + offs
        ok = (pos >= 0) & (pos < len(doc))
        same = np.zeros(width, bool)
        same[ok] = doc[pos[ok]] == word
        s, h, f, z = score + np.where(same, 1.0, -0.6), hits + same, first.copy(), last.copy()
        f[same & (f < 0)] = pos[same & (f < 0)]
        z[same] = pos[same]
        up = np.append(score[1:], -1e9) - 0.4  # the template word is skipped
        take = up > s
        for new, old in ((h, hits), (f, first), (z, last)):
            new[take] = np.append(old[1:], 0)[take]
        s = np.maximum(s, up)
        for j in range(1, width):  # a document word is skipped
            if s[j - 1] - 0.4 > s[j]:
                s[j], h[j], f[j], z[j] = s[j - 1] - 0.4, h[j - 1], f[j - 1], z[j - 1]
        score, hits, first, last = s, h, f, z
    best = int(np.lexsort((-np.abs(offs), score))[-1])
    return int(hits[best]), int(first[best]), int(last[best]) + 1


def _scan(index: Index, least: float):
    # of a template's m words at most m - least * m are missing, so at most as many of its distinct ones
    vocabulary = [set(h.tolist()) for h in index.words]
    repeats = [len(h) - len(v) for h, v in zip(index.words, vocabulary, strict=True)]

    def run(batches):
        for batch in batches:
            for part, buf, off in blocks(batch):
                w = Words(buf, off, lower=True, alnum=True)
                hits = index.hits(w)
                if not hits:
                    continue
                row_of = w.row()
                rows, tried, found = [], set(), {}
                for p, t, q in hits:
                    row = int(row_of[p])
                    lo, hi = int(w.first[row]), int(w.first[row + 1])
                    shift = p - lo - q
                    # left out are only a diagonal tried before, and words of a span that was found with this diagonal in its band
                    if (row, t, shift) in tried or any(s <= p < e and abs(shift - d) <= BAND for s, e, d in found.get((row, t), ())):
                        continue
                    tried.add((row, t, shift))
                    doc, template = w.hash[lo:hi], index.words[t]
                    # no more words can match than occur in reach at all
                    if len(vocabulary[t].intersection(doc[max(0, shift - BAND) : max(0, shift + len(template) + BAND)].tolist())) < least * len(vocabulary[t]) - (1 - least) * repeats[t]:
                        continue
                    n, s, e = align(doc, template, shift)
                    if s >= 0 and n >= least * len(template):
                        rows.append((row, t, n, lo + s, lo + e))
                        found.setdefault((row, t), []).append((lo + s, lo + e, shift))
                if not rows:
                    continue
                chars = char_positions(buf)
                ids = part.column("id").to_pylist()
                out = {}
                # of overlapping templates the one with the most matched words stays, then the better covered
                rows.sort(key=lambda x: (x[0], -x[2], -x[2] / len(index.words[x[1]]), x[1], x[3]))
                kept: list[tuple[int, int, int]] = []
                for row, t, n, s, e in rows:
                    kept = [k for k in kept if k[0] == row]
                    if any(s < k[2] and k[1] < e for k in kept):
                        continue
                    kept.append((row, s, e))
                    a, b = (int(chars[x] - chars[off[row]]) for x in (w.start[s], w.end[e - 1]))
                    out[ids[row], row, index.names[t], a, b] = n, len(index.words[t])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in out], pa.int64()), pa.array([k[2] for k in out]),
                        pa.array([n / size for n, size in out.values()], pa.float64()), pa.array([k[3] for k in out], pa.int64()),
                        pa.array([k[4] for k in out], pa.int64()), pa.array([n for n, _ in out.values()], pa.int64()),
                    ],
                    ["doc_id", "license", "coverage", "span_start", "span_end", "n_matched"],
                )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per place that a fingerprint points to and where at least ``least`` of a template's words align.

    Any place whose words drift by at most BAND is found for a template of up to
    SHORT words; of a longer one, each that keeps WINDOW + GRAM - 1 words in a row.  Words are runs of letters and digits in lower case.  Where templates overlap,
    the one with the most matched words is reported.  Null, empty and clean
    texts give no row; repeated rows each give theirs; spans are code points.
    The index holds the templates only, so its size does not depend on the documents.
    """
    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(_scan(Index(templates or TEMPLATES, least), least), SCHEMA)
