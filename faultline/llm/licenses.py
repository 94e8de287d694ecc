"""License scans by patience alignment.

A template and a stretch of text are aligned on the words that stand exactly once in both: the longest increasing run of such
anchors is kept, equal neighbours of anchors join them, and each gap between anchors is aligned the same way. The share of the
template's words that find a partner is its coverage.

Stretches come from a bound that loses nothing: a template covered to the wanted share inside SPREAD times its length needs that
many of its words there, and only windows that have them are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, Runs, Texts, hashes_of, runs_of, texts_of

COVERAGE = 0.8
SPREAD = 2

# License notices as their publishers word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
    "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
    "License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
    "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "apache-line": "Released under the Apache License.",
    "apache-2.0-short": "Distributed under the Apache License 2.0.",
    "gpl-3.0-short": "Licensed under the GPL, version 3.",
    "apache-1.0-line": "Licensed under the Apache License, Version 1.0.",
    "apache-1.1-line": "Licensed under the Apache License, Version 1.1.",
    "bsd-line": "Released under the BSD License.",
    "isc-line": "Released under the ISC License.",
    "gpl-line": "Released under the GNU General Public License.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-line": "Released under the GNU Lesser General Public License.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc0-1.0-line": "Licensed under CC0 1.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "lgpl-2.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public "
    "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

# Tags that name a license by its short identifier, one template each.
SPDX = (
    "MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense",
)
TEMPLATES |= {f"{name.lower()}-tag": f"SPDX-License-Identifier: {name}" for name in SPDX}

# What tells a license from those with nearly the same words: each phrase must be aligned with words that stand side by side.
REQUIRED = {
    "apache-2.0-line": ("apache license", "2.0"), "apache-1.0-line": ("apache license", "1.0"), "apache-1.1-line": ("apache license", "1.1"),
    "apache-line": ("apache license",), "apache-2.0": ("apache license", "version 2.0"),
    "mit-line": ("mit license",), "bsd-line": ("bsd",), "isc-line": ("isc license",),
    "gpl-line": ("gnu general public license",), "gpl-2.0-line": ("gnu general public license", "version 2"),
    "gpl-3.0-line": ("gnu general public license", "version 3"), "gpl-notice": ("gnu general public license",),
    "lgpl-line": ("lesser general public license",), "lgpl-2.1-line": ("lesser general public license", "version 2.1"),
    "lgpl-3.0-line": ("lesser general public license", "version 3"), "lgpl-notice": ("lesser",), "lgpl-2.0-notice": ("library general public",),
    "agpl-3.0-line": ("affero general public license", "version 3"), "agpl-notice": ("affero",),
    "mpl-2.0-line": ("mozilla public license", "2.0"), "mpl-2.0": ("mozilla public license", "2.0"),
    "cc-by-4.0-line": ("cc by 4.0",), "cc-by-sa-4.0-line": ("cc by sa 4.0",), "cc-by-nd-4.0-line": ("cc by nd 4.0",),
    "cc-by-nc-4.0-line": ("cc by nc 4.0",), "cc-by-nc-sa-4.0-line": ("cc by nc sa 4.0",), "cc-by-nc-nd-4.0-line": ("cc by nc nd 4.0",),
    "cc0-1.0-line": ("cc0 1.0",), "cc-by-4.0": ("attribution 4.0",), "cc-by-sa-4.0": ("attribution sharealike 4.0",),
    "cc-by-nc-4.0": ("attribution noncommercial 4.0",),
}

REQUIRED |= {name: (TEMPLATES[name],) for name in TEMPLATES if name.endswith("-tag")}
REQUIRED |= {"apache-2.0-short": ("apache license 2.0",), "gpl-3.0-short": ("gpl version 3",)}

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[Runs, np.ndarray]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, and hashes of them in lower case."""
    lower = LOWER[data]
    runs = runs_of(_WORD[lower], offsets)
    return runs, hashes_of(lower, runs)


def template_hashes(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return [int(h) for h in _words(data, np.array([0, len(data)]))[1]]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, in which the second rises too."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1] = [j]
        at[k : k + 1] = [n]
    out = []
    n = at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: rising pairs (place in text, place in template) of equal words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
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
        once: dict[int, int] = {}
        for j in range(c, d):
            once[template[j]] = -1 if template[j] in once else j
        place: dict[int, int] = {}
        for i in range(a, b):
            place[text[i]] = -1 if text[i] in place else i
        anchors = _rising(sorted((i, once[w]) for w, i in place.items() if i >= 0 and once.get(w, -1) >= 0))
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if anchors and i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
        out += anchors
    return sorted(out)


def _place(words: list[int], phrase: list[int]) -> tuple[int, int]:
    """Where the phrase stands in the words for the first time."""
    for at in range(len(words) - len(phrase) + 1):
        if words[at : at + len(phrase)] == phrase:
            return at, at + len(phrase)
    raise ValueError("a required phrase does not stand in its template")


def _has(pairs: list[tuple[int, int]], phrases: list[tuple[int, int]]) -> bool:
    """Whether the words of each phrase are aligned, with words side by side."""
    partner = {j: i for i, j in pairs}
    return all(a in partner and all(partner.get(a + k) == partner[a] + k for k in range(b - a)) for a, b in phrases)


def _span(pairs: list[tuple[int, int]]) -> int:
    return pairs[-1][0] - pairs[0][0] + 1


class Templates:
    """Hashes of each template's words, where its required phrases stand, and for every known word which templates have it."""

    def __init__(self, templates: dict[str, str], required: dict[str, tuple[str, ...]]):
        self.names = list(templates)
        self.words = [template_hashes(t) for t in templates.values()]
        self.phrases = [[_place(w, template_hashes(p)) for p in required.get(n, ())] for n, w in zip(self.names, self.words, strict=True)]
        self.known = np.array(sorted({h for words in self.words for h in words}), dtype=np.uint64)
        self.has = np.zeros((len(self.known), len(self.names)), dtype=bool)
        for n, words in enumerate(self.words):
            self.has[np.searchsorted(self.known, np.array(words, dtype=np.uint64)), n] = True

    def _aligned(self, runs: Runs, hashes: np.ndarray, n: int, start: int) -> list[tuple[int, int]]:
        """Alignment of a template with the window that begins at word `start`."""
        stop = int(min(start + SPREAD * len(self.words[n]), np.searchsorted(runs.docs, runs.docs[start], side="right")))
        return align([int(h) for h in hashes[start:stop]], self.words[n])

    def search(self, texts: Texts, coverage: float) -> list[tuple[int, int, int, float, int, int]]:
        """Matches: (text, template, words matched, coverage, first byte, end byte); overlapping ones only the best."""
        runs, hashes = _words(texts.data, texts.offsets)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        spots = np.flatnonzero(self.known[at] == hashes)
        has = self.has[at[spots]]
        # Words of different texts never share a window.
        place = spots + runs.docs[spots] * (SPREAD * max(map(len, self.words)) + 1)
        found = []
        for n, words in enumerate(self.words):
            own = np.flatnonzero(has[:, n])
            need = int(np.ceil(coverage * len(words)))
            width = SPREAD * len(words)
            reach = np.searchsorted(place[own], place[own] + width) - np.arange(len(own))
            upto = -1
            for k in np.flatnonzero(reach >= need).tolist():
                start = int(spots[own[k]])
                if start <= upto:
                    continue
                pairs = self._aligned(runs, hashes, n, start)
                if len(pairs) < need or not _has(pairs, self.phrases[n]):
                    continue
                if (len(pairs), _span(pairs)) != (len(words), len(words)):
                    # A window may begin in another notice: of matches that share words the one with the most of them, then the shortest.
                    for later in spots[own[k + 1 : k + 1 + width]].tolist():
                        if later > start + pairs[-1][0]:
                            break
                        other = self._aligned(runs, hashes, n, later)
                        if len(other) < need or later + other[0][0] > start + pairs[-1][0]:
                            continue  # nothing, or a notice behind this one
                        if (len(other), -_span(other)) > (len(pairs), -_span(pairs)) and _has(other, self.phrases[n]):
                            start, pairs = later, other
                first, upto = start + pairs[0][0], start + pairs[-1][0]
                found.append((int(runs.docs[start]), n, len(pairs), len(pairs) / len(words), int(runs.starts[first]), int(runs.ends[upto])))
        best: list[tuple[int, int, int, float, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for match in sorted(found, key=lambda m: (-m[2], -m[3], m)):
            # What is taken of a text does not overlap, so only the neighbours can.
            spans = taken.setdefault(match[0], [])
            at = bisect_left(spans, (match[4], match[5]))
            if (at == 0 or spans[at - 1][1] <= match[4]) and (at == len(spans) or match[5] <= spans[at][0]):
                spans.insert(at, (match[4], match[5]))
                best.append(match)
        return sorted(best, key=lambda m: (m[0], m[4], m[1]))


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, required: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """License notices in each whole text of `docs(doc_id, text)`, one row out per row in.

    Returns doc_id, n_licenses, licenses (their names, sorted, comma-joined), coverage (the best, 0.0 without any) and matches:
    array of structs (license, coverage, start, end) by start, in code points, end exclusive. Words are compared without case and
    punctuation. A match has the phrases that `required` names for its license (REQUIRED for the known templates). Of overlapping matches the one with the most words counts. Null and empty texts have none; ids may be null
    or repeated; an empty table gives no rows; other columns are not read.
    """
    if required is None:
        required = REQUIRED if templates is None else {}
    known = Templates(TEMPLATES if templates is None else templates, required)
    schema = "doc_id long, matches array<struct<license: string, coverage: double, start: long, end: long>>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            rows: list[list[dict]] = [[] for _ in range(texts.count)]
            for doc, n, _, share, a, b in known.search(texts, coverage):
                begin = int(texts.offsets[doc])
                start = len(texts.data[begin:a].tobytes().decode(errors="replace"))
                size = len(texts.data[a:b].tobytes().decode(errors="replace"))
                rows[doc].append({"license": known.names[n], "coverage": share, "start": start, "end": start + size})
            ids = texts.batch.column(0).slice(texts.lo, texts.count)
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], names=["doc_id", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return rows.select(
        "doc_id", F.size("matches").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("matches.coverage")), F.lit(0.0)).alias("coverage"), "matches",
    )
