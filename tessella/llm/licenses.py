"""License scans.

A text and the templates are sequences of words (lower-cased runs of letters and digits) and so of word pairs, the
shingles. A match of a template with S distinct shingles is a stretch of at most REACH * S shingles of the text that has
at least CONTAINMENT * S of them.

Templates fall into classes by S, each up to WIDTH times the least one. For a class, the text is cut into overlapping
windows of twice its reach, each starting one reach after the last, so that a match lies wholly within a window. The
minimum of a window's shingles under each of BANDS permutations is a band; an index of the templates' bands retrieves
those that share one with the window. A window of 2r shingles with a match has at least c S / (2r + S - c S) of the
union's shingles in common with its template, so it is retrieved with the probability that Scanner.retrieval() states:
0.997 or more for each of TEMPLATES at a containment c of 0.8, and 0.9995 or more for a whole one (c = 1).

The windows that retrieve a template are joined to ranges, and those are searched exactly, on the words themselves: from
left to right, at the first place where a match begins, the one of those that begin up to where it is complete with the
most shingles for its length (2 * distinct - length; then the first, then the shortest) is taken, and the search goes on
behind it. So all matches of a template are found, none twice, next to each other or not. Of overlapping matches of
templates that are alike, as those of two versions of a licence, the one with the greater containment stays.

Templates are a parameter, a table small enough to travel with the code.

Defined results: a null or empty text has no matches; a template of one word is matched as that word; a template without
words is never matched; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import arrow_map, unclashed
from .verify import mix64

BANDS, CONTAINMENT, REACH, WIDTH = 32, 0.8, 1.25, 1.4
#: Shingles of a block whose minima larger blocks are made of; bits of a hash that are looked at before it is looked up.
UNIT, LOW_BITS = 4, 18
#: Shingles of a text whose hashes are permuted at once, a multiple of UNIT.
BLOCK = 1 << 14
#: Bytes whose words are hashed at once.
SLICE = 1 << 20
#: Templates with this Jaccard similarity or more are alike.
ALIKE = 0.5

# The wording of common notices and short licences, by SPDX identifier.
_FSF = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_KEEP = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_CC = "This work is licensed under a Creative Commons {} {} International License."
_CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_TAGS = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib BSL-1.0 Unlicense WTFPL MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later Artistic-2.0 PostgreSQL Python-2.0 OFL-1.1"
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-line": "This project is licensed under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    **{f"CC-{kind}-4.0-line": f"Licensed under CC {kind} 4.0." for kind in _CC_KINDS if kind != "BY-NC"},
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    **{f"CC-{kind}-4.0": _CC.format(name, "4.0") for kind, name in _CC_KINDS.items() if kind != "BY-NC"},
    "CC-BY-NC-4.0-notice": _CC.format(_CC_KINDS["BY-NC"], "4.0"),
    "BSD-notice": _BSD,
    "BSD-2-Clause": f"{_BSD} 1. {_BSD_KEEP}",
    "BSD-3-Clause": f"{_BSD} 1. {_BSD_KEEP} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "MIT-grant": _MIT,
    "MIT-text": f"{_MIT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "GPL-3.0-or-later": _FSF.format("GNU General Public License", "3"),
    "GPL-2.0-or-later": _FSF.format("GNU General Public License", "2"),
    "LGPL-3.0-or-later": _FSF.format("GNU Lesser General Public License", "3"),
    "LGPL-2.1-or-later": _FSF.format("GNU Lesser General Public License", "2.1"),
    "AGPL-3.0-or-later": _FSF.format("GNU Affero General Public License", "3"),
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    **{f"{tag}-tag": f"SPDX-License-Identifier: {tag}" for tag in _TAGS.split()},
}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of the lower-cased text, made on slices of whole words."""
    text, at, out = text.lower().translate(_TABLE) + b" ", 0, [np.zeros(0, np.uint64)]
    while at < len(text):
        end = text.find(b" ", at + SLICE) + 1 or len(text)
        out.append(_slice_hashes(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out)


def _slice_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of bytes that end with a space."""
    letter = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # sum of byte * r^position over the word, with positions counted from the word's start
    length = ends - starts
    inside = np.flatnonzero(letter)
    place = inside - np.repeat(starts, length)
    powers = np.full(int(length.max()), np.uint64(0x9E3779B97F4A7C15))
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix64(np.add.reduceat(data[inside].astype(np.uint64) * powers[place], first) + length.astype(np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the word pairs."""
    return mix64(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:])


def permuted(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Values of the shingles under each permutation (seeds x shingles)."""
    x = (s[None, :] ^ seeds[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def pairs_of(words: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The shingles themselves: pairs of words."""
    return list(zip(words, words[1:], strict=False))


@dataclass(frozen=True)
class Template:
    """Name and distinct shingles; need: how many of them a match has, reach: its greatest length in shingles."""

    name: str
    pairs: frozenset
    need: int
    reach: int

    @classmethod
    def of(cls, name: str, text: str, containment: float) -> Template:
        pairs = frozenset(pairs_of(words_of(text.encode())))
        return cls(name, pairs, max(1, math.ceil(containment * len(pairs) - 1e-9)), math.floor(REACH * len(pairs)))

    def matches(self, found: list[tuple[bytes, bytes]], begin: int, end: int) -> Iterator[tuple[int, int, float]]:
        """(start, end, containment) of the matches, as defined above, among the shingles begin to end of a text."""
        hits = [i for i in range(begin, end) if found[i] in self.pairs]
        at = 0
        while at < len(hits):
            complete = self._complete(hits, at, found)
            if complete is None:
                at += 1
                continue
            best = None
            for first in range(at, bisect_left(hits, complete + 1)):
                seen = set()
                for j in range(first, len(hits)):
                    i = hits[j]
                    if i >= hits[first] + self.reach:
                        break
                    seen.add(found[i])
                    length = i + 1 - hits[first]
                    if len(seen) >= self.need and (best is None or 2 * len(seen) - length > best[0]):
                        best = 2 * len(seen) - length, hits[first], i + 1, len(seen)
            yield best[1], best[2], best[3] / len(self.pairs)
            at = bisect_left(hits, best[2])

    def _complete(self, hits: list[int], at: int, found: list[tuple[bytes, bytes]]) -> int | None:
        """Where a match that begins at hits[at] first has enough shingles."""
        seen = set()
        for j in range(at, len(hits)):
            i = hits[j]
            if i >= hits[at] + self.reach:
                return None
            seen.add(found[i])
            if len(seen) >= self.need:
                return i
        return None


@dataclass
class Scanner:
    """Templates in classes by size, each with an index of their bands."""

    templates: list[Template]
    seeds: np.ndarray
    #: reach, sorted band keys, templates of the keys, which low bits the keys have
    classes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    alike: set[tuple[int, int]] = field(default_factory=set)
    #: templates of one word: word, name
    singles: dict[bytes, str] = field(default_factory=dict)

    @classmethod
    def build(cls, templates: dict[str, str], bands: int = BANDS, containment: float = CONTAINMENT) -> Scanner:
        seeds = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        made = [Template.of(name, text, containment) for name, text in templates.items()]
        texts = {t.name: templates[t.name] for t in made}
        out = cls(sorted((t for t in made if t.pairs), key=lambda t: len(t.pairs)), seeds)
        out.singles = {words_of(x.encode())[0]: name for name, x in templates.items() if len(words_of(x.encode())) == 1}
        begin = 0
        while begin < len(out.templates):
            most = max(len(out.templates[begin].pairs) * WIDTH, len(out.templates[begin].pairs))
            end = next((i for i in range(begin, len(out.templates)) if len(out.templates[i].pairs) > most), len(out.templates))
            lows = np.array([permuted(shingles(word_hashes(texts[t.name].encode())), seeds).min(axis=1) for t in out.templates[begin:end]], np.uint64)
            keys, bits = lows.ravel(), np.zeros(1 << LOW_BITS, bool)
            bits[keys & np.uint64((1 << LOW_BITS) - 1)] = True
            order, reach = np.argsort(keys), out.templates[end - 1].reach
            out.classes.append((-(-reach // UNIT) * UNIT if reach >= 2 * UNIT else reach, keys[order], np.repeat(np.arange(begin, end), bands)[order], bits))
            begin = end
        sets = [t.pairs for t in out.templates]
        out.alike = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and len(sets[a] & sets[b]) >= ALIKE * len(sets[a] | sets[b])}
        return out

    def retrieval(self, containment: float) -> float:
        """The least probability, over the templates, that a window with a match of that containment retrieves its template."""
        reach = {t: r for r, _, members, _ in self.classes for t in members.tolist()}
        share = [containment * len(x.pairs) / (2 * reach[t] + (1 - containment) * len(x.pairs)) for t, x in enumerate(self.templates)]
        return 1 - (1 - min(share)) ** len(self.seeds)

    def candidates(self, s: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each retrieved template the ranges of shingles (joined windows) that may hold a match."""
        n = len(s)
        ranges: dict[int, list[tuple[int, int]]] = {}
        beyond = 2 * max((c[0] for c in self.classes), default=0)
        for at in range(0, n, BLOCK):
            # minima of a block of the text, and of what its last windows need of the next one
            p = permuted(s[at : at + BLOCK + beyond], self.seeds)
            units = np.minimum.reduceat(p, np.arange(0, p.shape[1], UNIT), axis=1)
            for one in self.classes:
                self._retrieve(one, p, units, at, n, ranges)
        return ranges

    def _retrieve(self, of: tuple[int, np.ndarray, np.ndarray, np.ndarray], p: np.ndarray, units: np.ndarray, at: int, n: int, ranges: dict[int, list[tuple[int, int]]]) -> None:
        """Adds the ranges of the windows of a class that begin in the block at ``at`` of n shingles."""
        reach, keys, members, bits = of
        # parts of one reach; a window is a part and the next one
        begin, end = -(-at // reach), -(-min(n, at + BLOCK) // reach)
        if begin < end:
            values, size, first = (units, reach // UNIT, (begin * reach - at) // UNIT) if reach >= 2 * UNIT else (p, reach, begin * reach - at)
            low = np.minimum.reduceat(values, np.arange(first, min(values.shape[1], first + (end - begin + 1) * size), size), axis=1)
            if low.shape[1] > end - begin:
                # the part after the last window's own may have gone beyond its end
                last = values[:, first + (end - begin) * size : first + (end - begin + 1) * size].min(axis=1)
                low = np.column_stack((low[:, : end - begin], last))
            if low.shape[1] > 1:
                low[:, :-1] = np.minimum(low[:, :-1], low[:, 1:])
            low = low[:, : end - begin]
            band, window = np.nonzero(bits[low & np.uint64((1 << LOW_BITS) - 1)])
            got = low[band, window]
            lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            hit = hi > lo
            retrieved = sorted({(w, t) for w, a, b in zip((window[hit] + begin).tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True) for t in members[a:b].tolist()})
            for w, t in retrieved:
                here = ranges.setdefault(t, [])
                # a reach more on either side, so that a range begins and ends as the whole text would
                first, last = max(0, (w - 1) * reach), min(n, (w + 3) * reach)
                if here and here[-1][1] >= first:
                    here[-1] = here[-1][0], max(last, here[-1][1])
                else:
                    here.append((first, last))

    def scan(self, text: bytes) -> list[tuple[str, int, int, float]]:
        """(template, first word, word after the last, containment) of the matches in a whole text, by place."""
        hashes = word_hashes(text)
        ranges = self.candidates(shingles(hashes)) if len(hashes) > 1 and self.classes else {}
        if not ranges and not self.singles:
            return []
        words = words_of(text)
        found = pairs_of(words)
        matches = self._best(sorted((start, end + 1, t, share) for t, rs in ranges.items() for a, b in rs for start, end, share in self.templates[t].matches(found, a, b)))
        out = [(self.templates[t].name, start, end, share) for start, end, t, share in matches]
        out += [(self.singles[w], i, i + 1, 1.0) for i, w in enumerate(words) if w in self.singles]
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))

    def _best(self, matches: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of (start, end, template, share) by start: without those that a better match of a template alike overlaps by half or more of the shorter one."""
        starts, longest = [m[0] for m in matches], max((m[1] - m[0] for m in matches), default=0)

        def beaten(start: int, end: int, t: int, share: float) -> bool:
            near = matches[bisect_left(starts, start - longest) : bisect_left(starts, end)]
            return any((t, o) in self.alike and better > share and 2 * (min(end, b) - max(start, a)) >= min(end - start, b - a) for a, b, o, better in near)

        return [m for m in matches if not beaten(*m)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs: doc_id, matches array<struct<license, start_word, end_word, containment>>."""
    scanner = Scanner.build(TEMPLATES if templates is None else templates, bands, containment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("license", "start_word", "end_word", "containment"), m, strict=True)) for m in scanner.scan(t or b"")] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "matches"])

    rows = unclashed(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, matches array<struct<license:string,start_word:long,end_word:long,containment:double>>")
