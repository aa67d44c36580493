"""License scanning by conditional compression.

Sentences that speak of licensing, together with the sentences around them that
use licence wording, are candidate blocks.  A block is compressed once by itself
and once with each template as a raw zstandard dictionary; the template that
saves most explains it best.  In that order the templates are aligned with
stretches of the block word by word: a licence is confirmed only if few words
differ and no number does.  The stretch that explains most words is taken first,
and the rest of the block is searched again, so that a block can hold several
notices.  Every SPDX expression is a stretch of its own.

Places are code points, end exclusive.  Defined cases: null or empty text has
no blocks; texts are scanned whole; equal blocks get equal findings; ties in
saving go to the template listed first; short references count only as whole
sentences or lines; repeated rows get equal findings; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm import textkit as tk

#: Public licence notices and the usual short references to licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
CUE = re.compile(r"licen[sc]e|sublicens|creative commons|\bcc0|\bcc[ -]by|permission (?:is hereby|to use)|redistribut|public domain|free software|spdx", re.I | re.A)
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?\)*"
SPDX = re.compile(rf"SPDX-License-Identifier:\s*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)")
#: Ends of sentences: line breaks, and white space after a full stop.
BREAK = re.compile(r"\n|(?<=[.!?;])[ \t]+")
WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: Templates of fewer words are short references: they have to be whole sentences or lines.
SHORT = 15

FOUND = "doc_id bigint, n_blocks int, licenses array<struct<license:string,start:int,end:int,saved:double,missing:array<string>,extra:array<string>>>"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Templates:
    """Compressors with each template as raw dictionary, and one without."""

    def __init__(self, templates=TEMPLATES, level: int = 12):
        self.names = [n for n, _ in templates]
        self.words = [words(t) for _, t in templates]
        self.counts = [Counter(own) for own in self.words]
        self.known = frozenset(w for own in self.words for w in own)
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.given = []
        for _, text in templates:
            raw = zstandard.ZstdCompressionDict(" ".join(text.lower().split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False))

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share of the bytes that the template saves, its place), best first."""
        data = " ".join(block.lower().split()).encode()
        alone = len(self.plain.compress(data))
        saved = [(1 - len(c.compress(data)) / alone, k) for k, c in enumerate(self.given)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def saved(self, part: str, k: int) -> float:
        """The share of the bytes of a part that one template saves."""
        data = " ".join(part.lower().split()).encode()
        return 1 - len(self.given[k].compress(data)) / len(self.plain.compress(data))


@lru_cache(maxsize=1)
def templates() -> Templates:
    return Templates()


def _edits(wanted: list[str], own: np.ndarray, anchored: bool) -> np.ndarray:
    """For each number of words of `own`: the fewest edits from `wanted` to words that end there, and that start at the first one if anchored."""
    step = np.arange(len(own) + 1)
    row = step.copy() if anchored else np.zeros_like(step)
    for i, w in enumerate(wanted):
        low = np.append(i + 1, np.minimum(row[:-1] + (own != w), row[1:] + 1))
        row = np.minimum.accumulate(low - step) + step
    return row


def _stretches(wanted: list[str], own: np.ndarray, heads: np.ndarray, tails: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Where words like the wanted ones stand, at most `most` edits away: [first, last) for each place with the fewest edits around, at ends of sentences if there is a choice."""
    edits = _edits(wanted, own, False)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (edits <= most).view(np.int8), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        last = min(range(max(a, 1), b), key=lambda j: (edits[j], not tails[j - 1], j), default=0)
        before = own[max(0, last - len(wanted) - most) : last][::-1]
        back = _edits(wanted[::-1], before, True)
        n = min(range(1, len(back)), key=lambda j: (back[j], not heads[last - j], j), default=0)
        if n:
            yield last - n, last


def _aligned(own: np.ndarray, text: str, places: list[tuple[int, int]], heads: np.ndarray, tails: np.ndarray, most_wrong: float, least_saved: float) -> list[tuple[int, int, tuple]]:
    """Confirmed stretches of words that do not overlap, those that explain most words first."""
    known, there = templates(), Counter(own.tolist())
    able = [k for k, counts in enumerate(known.counts) if sum((counts & there).values()) >= (1 - most_wrong) * len(known.words[k])]
    if not able:
        return []
    able = [k for _, k in known.ranked(text[places[0][0] : places[-1][1]]) if k in able]
    found = []
    for rank, k in enumerate(able):
        wanted = known.words[k]
        for first, last in _stretches(wanted, own, heads, tails, int(2 * most_wrong * len(wanted))):
            if len(wanted) < SHORT and not (heads[first] and tails[last - 1]):
                continue
            words_here, missing, extra = own[first:last].tolist(), [], []
            for kind, a, b, c, d in difflib.SequenceMatcher(None, wanted, words_here, autojunk=False).get_opcodes():
                if kind != "equal":
                    missing += wanted[a:b]
                    extra += words_here[c:d]
            wrong = max(len(missing), len(extra))
            if wrong > most_wrong * len(wanted) or any(c.isdigit() for w in missing + extra for c in w):
                continue
            saved = known.saved(text[places[first][0] : places[last - 1][1]], k)
            if saved >= least_saved:
                found.append((len(missing) - len(wanted), wrong, rank, first, last, (known.names[k], saved, tuple(missing), tuple(extra))))
    taken = np.zeros(len(own), bool)
    out = []
    for *_, first, last, got in sorted(found):
        if not taken[first:last].any():
            taken[first:last] = True
            out.append((first, last, got))
    return out


@lru_cache(maxsize=20_000)
def identify(block: str, most_wrong: float = 0.1, least_saved: float = 0.3) -> tuple[tuple[int, int, str, float, tuple[str, ...], tuple[str, ...]], ...]:
    """The confirmed licences of a block by place: start, end, name, share saved, and the words missing from and added to the template."""
    out, rest, at = [], [], 0
    for m in SPDX.finditer(block):
        out.append((*m.span(), " ".join(m[1].split()), 1.0, (), ()))
        rest.append((at, m.start()))
        at = m.end()
    rest.append((at, len(block)))
    cuts = [0, *(x for m in BREAK.finditer(block) for x in m.span()), len(block)]
    pieces = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b]
    lows, highs = np.array([a for a, _ in pieces], np.int64), np.array([b for _, b in pieces], np.int64)
    while rest:
        low, high = rest.pop()
        places = [m.span() for m in WORD.finditer(block, low, high)]
        if not places:
            continue
        own = np.array([block[a:b].lower() for a, b in places], object)
        piece = np.searchsorted(lows, [a for a, _ in places], "right") - 1
        new = np.append(True, np.diff(piece) > 0)
        heads, tails = new, np.append(new[1:], True)
        got = sorted(_aligned(own, block, places, heads, tails, most_wrong, least_saved), key=lambda x: x[:2])
        for first, last, what in got:
            start = max(low, int(lows[piece[first]])) if heads[first] else places[first][0]
            end = min(high, int(highs[piece[last - 1]])) if tails[last - 1] else places[last - 1][1]
            out.append((start, end, *what))
        if got:
            marks = [low, *(x for first, last, _ in got for x in (places[first][0], places[last - 1][1])), high]
            rest += zip(marks[::2], marks[1::2], strict=True)
    return tuple(sorted(out))


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks as [start, end): cue sentences, grown over neighbours most of whose words some template has."""
    cues = [m.start() for m in CUE.finditer(text)]
    if not cues:
        return []
    edges = [0, *(x for m in BREAK.finditer(text) for x in m.span()), len(text)]
    spans = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    known = templates().known
    cue, at = set(), 0
    for place in cues:
        while spans[at][1] <= place:
            at += 1
        cue.add(at)

    def fits(k: int) -> bool:
        own = words(text[slice(*spans[k])])
        return bool(own) and sum(w in known for w in own) >= (0.8 if len(own) > 3 else 1) * len(own)

    out: list[list[int]] = []
    for k in sorted(cue):
        if out and k <= out[-1][1]:
            continue
        low = high = k
        while low > (out[-1][1] + 1 if out else 0) and (low - 1 in cue or fits(low - 1)):
            low -= 1
        while high + 1 < len(spans) and (high + 1 in cue or fits(high + 1)):
            high += 1
        out.append([low, high])
    return [(spans[low][0], spans[high][1]) for low, high in out]


def find(text: str) -> tuple[int, list[dict]]:
    """How many candidate blocks there are, and all licences confirmed in them."""
    out, candidates = [], blocks(text)
    for start, end in candidates:
        for a, b, name, saved, missing, extra in identify(text[start:end]):
            out.append({"license": name, "start": start + a, "end": start + b, "saved": saved, "missing": list(missing), "extra": list(extra)})
    return len(candidates), out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of candidate blocks, and the confirmed licences with their places and wording differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])
        for batch in batches:
            for part in tk.slices(batch, "text"):
                found = [find(t) if t else (0, []) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(kind))], names=["doc_id", "n_blocks", "licenses"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND)
