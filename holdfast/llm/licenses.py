"""Operator 6: license scans by rare words as fingerprints and banded alignment.

A find is an alignment that matches at least ``LEAST`` of a template's words, in order, inside a band around some shift between
template and document.  Such an alignment misses at most ``n - need`` of the ``n`` words, wherever they stand and whatever is put
between the others, so no run of two words is certain to survive (``k`` edits can break all runs) and fingerprints of several words,
winnowed or not, can miss finds.  Fingerprints are therefore single words: of every template the ``n - need + c`` places with the rarest
words, ``c`` growing with ``n``, go into an inverted index.  By pigeonhole every find matches at least ``c`` of them, all inside its
band; the shifts with at least ``c`` hits in their band are the candidates, and each of them is aligned.  So the index loses nothing.

Reported are the share of the template's words that the alignment matches, and the span of the document from the first to the last
of them.

Templates are a parameter and few; they travel with the tasks.  Documents are scanned row by row, whole, without a shuffle; long
ones in pieces of ``PIECE`` words that overlap by more than any find is long.  Null and empty texts have no match.  Repeated rows are
scanned each by itself.  Overlapping finds of one template are reported once, the one of best coverage; of different templates over
one span (more than half of it) the one that matches most words with fewest unmatched in template and document.  Words are ``[0-9a-z]`` and
everything beyond ASCII, after lower-casing A-Z.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect
from collections import Counter
from importlib import resources
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import common

BAND, PIECE = 8, 1 << 16
#: Share of a template's words that has to be matched.
LEAST = 0.8

#: Wording of common license notices and headers.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

_GNU = "it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version"
_PROGRAM = "This program is free software; you can redistribute it and/or modify "
_LIBRARY = "This library is free software; you can redistribute it and/or modify "
NOTICES |= {
    "AGPL-3.0-header": _PROGRAM + _GNU.format("Affero General Public License", "3"),
    "GPL-1.0-header": _PROGRAM + _GNU.format("General Public License", "1"),
    "GPL-2.0-header": _PROGRAM + _GNU.format("General Public License", "2"),
    "GPL-3.0-header": _PROGRAM + _GNU.format("General Public License", "3"),
    "LGPL-2.0-header": _LIBRARY + _GNU.format("Library General Public License", "2"),
    "LGPL-2.1-header": _LIBRARY + _GNU.format("Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _LIBRARY + _GNU.format("Lesser General Public License", "3"),
    "LGPL-header": _LIBRARY + _GNU.partition(";")[0].format("Lesser General Public License"),
    "AGPL-header": _PROGRAM + _GNU.partition(";")[0].format("Affero General Public License"),
    "CDDL-header": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You "
        "may not use this file except in compliance with the License"
    ),
    "EPL-1.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
        "accompanies this distribution"
    ),
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GFDL-header": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, "
        "Version 1.3 or any later version published by the Free Software Foundation"
    ),
    "MPL-1.1-header": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file "
        "except in compliance with the License"
    ),
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
}
#: Names as they stand in "Licensed under the ...".
_NAMED = {
    "0BSD": "Zero-Clause BSD License",
    "AGPL-3.0": "GNU Affero General Public License, Version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "Artistic-1.0": "Artistic License 1.0",
    "Artistic-2.0": "Artistic License 2.0",
    "BSD": "BSD License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "CC0-1.0": "CC0 1.0 Universal License",
    "CDDL-1.0": "Common Development and Distribution License, Version 1.0",
    "CDDL-1.1": "Common Development and Distribution License, Version 1.1",
    "EPL-1.0": "Eclipse Public License, Version 1.0",
    "EPL-2.0": "Eclipse Public License, Version 2.0",
    "EUPL-1.1": "European Union Public Licence, Version 1.1",
    "EUPL-1.2": "European Union Public Licence, Version 1.2",
    "GFDL-1.2": "GNU Free Documentation License, Version 1.2",
    "GFDL-1.3": "GNU Free Documentation License, Version 1.3",
    "GPL-1.0": "GNU General Public License, Version 1",
    "GPL-2.0": "GNU General Public License, Version 2",
    "ISC": "ISC License",
    "LGPL-2.0": "GNU Library General Public License, Version 2",
    "LGPL-2.1": "GNU Lesser General Public License, Version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, Version 3",
    "MIT": "MIT License",
    "MPL-1.1": "Mozilla Public License, Version 1.1",
    "MPL-2.0": "Mozilla Public License, Version 2.0",
    "OFL-1.1": "SIL Open Font License, Version 1.1",
    "Unlicense": "Unlicense License",
    "Zlib": "zlib License",
}
for _name, _text in _NAMED.items():
    # Names of one word stand in templates so short that no word may be missing, as all such notices have the other words in common.
    _lead = "Licensed under the" if len(_text.split()) > 2 else "under the"
    NOTICES.setdefault(_name if _name not in ("BSD", "MPL-2.0", "MIT") else f"{_name}-notice", f"{_lead} {_text}")
    if ", Version " in _text:
        NOTICES[f"{_name}-short"] = f"{_lead} {_text.replace(', Version ', ' v')}"
        NOTICES[f"{_name}-plain"] = f"{_lead} {_text.replace(', Version ', ' ')}"
for _short, _long in {
    "": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives",
}.items():
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        NOTICES[f"CC-BY{_short}-{_version}"] = f"Licensed under CC BY{_short} {_version}"
        NOTICES[f"CC-BY{_short}-{_version}-notice"] = f"licensed under a Creative Commons Attribution{_long} {_version} {_scope} License"


@functools.cache
def _templates() -> dict[str, str]:
    """Notices, headers and, named ``...-text``, the whole bodies beside this module; read on the driver only."""
    bodies = resources.files("holdfast.llm") / "license_texts"
    return NOTICES | {f.name.removesuffix(".txt") + "-text": f.read_text(encoding="utf-8") for f in bodies.iterdir() if f.name.endswith(".txt")}


def __getattr__(name: str) -> dict[str, str]:
    if name == "TEMPLATES":
        return _templates()
    raise AttributeError(name)


def needed(n: int, least: float) -> int:
    """Words that a find matches at least, of a template of ``n``."""
    return max(1, math.ceil(round(least * n, 9)))


class Index:
    """Words of the templates, and the places of their rarest ones by word."""

    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.names, self.least = sorted(templates), least
        self.words, self.sizes, self.bands, self.certain = [], [], [], []
        data = [templates[n].encode() for n in self.names]
        hashes = [common.ALNUM.hashes(d) for d in data]
        if not all(map(len, hashes)):
            raise ValueError("a template needs words")
        known = Counter(np.concatenate(hashes).tolist())
        places: list[tuple[int, int, int]] = []
        for t, (d, words) in enumerate(zip(data, hashes, strict=True)):
            starts, ends = common.ALNUM.spans(d)
            words, n = words.tolist(), len(words)
            certain = max(1, n // 8)
            rare = sorted(range(n), key=lambda q: (known[words[q]], starts[q] - ends[q], q))[: n - needed(n, least) + certain]
            places += [(words[q], t, q) for q in rare]
            self.words.append(words)
            self.sizes.append(Counter(words))
            self.bands.append(min(BAND, n // 2))
            self.certain.append(certain)
        places.sort()
        found, self.first = np.unique(np.array([h for h, _, _ in places], np.uint64), return_index=True)
        self.hashes, self.first = found, np.append(self.first, len(places))
        self.template = np.array([t for _, t, _ in places], np.int64)
        self.place = np.array([q for _, _, q in places], np.int64)
        self.longest = max(map(len, self.words))

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first shift, last shift) of all shifts with as many rare words in their band as a find has."""
        where = np.searchsorted(self.hashes, words)
        where[where == len(self.hashes)] = 0
        at = np.flatnonzero(self.hashes[where] == words)
        if not len(at):
            return []
        first = self.first[where[at]]
        n = self.first[where[at] + 1] - first
        # All places of the word at each of the document's places.
        entry = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        template, shift = self.template[entry], np.repeat(at, n) - self.place[entry]
        out = []
        for t in np.flatnonzero(np.bincount(template, minlength=len(self.names)) >= self.certain).tolist():
            d, c, band = np.sort(shift[template == t]), self.certain[t], self.bands[t]
            lo, hi = d[c - 1 :] - band, d[: len(d) - c + 1] + band
            close = lo <= hi
            lo, hi = lo[close], hi[close]
            if len(lo):
                gaps = np.flatnonzero(lo[1:] > hi[:-1] + 1)
                out += zip([t] * (len(gaps) + 1), lo[np.r_[0, gaps + 1]].tolist(), hi[np.r_[gaps, len(hi) - 1]].tolist(), strict=True)
        return out


def aligned(template: list[int], doc: list[int], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order inside the band around ``shift``, and the first and last document word matched.

    Among alignments with as many matches the shortest span is taken.
    """
    width, base, one = 2 * band + 1, shift - band, 1 << 32
    part = [None] * min(max(-base, 0), len(template) + width) + doc[max(base, 0) : max(base + len(template) + width, 0)]
    part += [None] * (len(template) + width - len(part))
    best, top = [0] * (width + 1), (0, 0, 0)  # matches and first + 1 in one number, by offset; the last one stands for none
    for i, word in enumerate(template):
        # Skip a template word (offset grows: same document word), or a document word (from the left).
        row = list(accumulate(best[1:], max))
        if word in part[i : i + width]:
            left = 0
            for o in range(width):
                here = max(best[o + 1], left)
                if part[i + o] == word:
                    value = best[o] + one if best[o] else one + i + base + o + 1
                    here = max(here, value)
                    first = value % one
                    top = max(top, (value // one, first - (i + base + o + 1), first))
                row[o] = left = here
        row.append(0)
        best = row
    m, span, first = top
    return m, first - 1, first - 1 - span


def _finds(index: Index, t: int, doc: list[int], lo: int, hi: int, need: int) -> set[tuple[int, int, int]]:
    """Alignments at all shifts from ``lo`` to ``hi`` that match at least ``need`` words."""
    template, size, band, out = index.words[t], index.sizes[t], index.bands[t], set()
    seen = Counter(w for w in doc[max(lo - band, 0) : max(hi + band + len(template), 0)] if w in size)
    if sum(min(n, size[w]) for w, n in seen.items()) < need:
        return out
    middle, most = (lo + hi) // 2, len(template) + 1
    # All finds overlap where the shifts differ by less than a find is long: then nothing beats one as good as the wide band's.
    if hi - lo + 2 * band < need:
        found = aligned(template, doc, middle, band)
        if found[0] == len(template):
            return {found}
        most = aligned(template, doc, middle, (hi - lo + 1) // 2 + band)[0]
        if most < need:
            return out
    for s in sorted(range(lo, hi + 1), key=lambda s: abs(s - middle)):
        found = aligned(template, doc, s, band)
        if found[0] >= need:
            out.add(found)
            if found[0] >= most:
                break
    return out


def _told_apart(finds: list[tuple[int, int, int, int]], index: Index, n_words: int) -> list[tuple[int, int, int, int]]:
    """The finds (first, last, matches, template) that explain their span best: most words matched, fewest unmatched on either side."""

    def rank(x: tuple[int, int, int, int]) -> tuple:
        first, last, m, t = x
        n, span = len(index.words[t]), last - first + 1
        return 3 * m - n - span, m / n, -span, -first, -t

    taken, kept = np.zeros(n_words, bool), []
    for x in sorted(finds, key=rank, reverse=True):
        place = slice(x[0], x[1] + 1)
        if 2 * np.count_nonzero(taken[place]) <= x[1] + 1 - x[0]:
            taken[place] = True
            kept.append(x)
    return kept


def scan(text: bytes, index: Index, least: float | None = None) -> list[dict]:
    """Matches of one text, in order of place; start and end count characters."""
    least = index.least if least is None else least
    if least < index.least:
        raise ValueError("the index is made for a larger share of words")
    words = common.ALNUM.hashes(text)
    found: dict[int, set[tuple[int, int, int]]] = {}
    for begin in range(0, len(words), PIECE):
        piece = words[begin : begin + PIECE + index.longest + 2 * BAND]
        candidates, doc = index.candidates(piece), None
        for t, lo, hi in candidates:
            doc = doc or piece.tolist()
            finds = _finds(index, t, doc, lo, hi, needed(len(index.words[t]), least))
            found.setdefault(t, set()).update((m, first + begin, last + begin) for m, first, last in finds)
    out = []
    for t, finds in found.items():
        taken: list[tuple[int, int, int]] = []
        for m, first, last in sorted(finds, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            at = bisect(taken, (first,))
            if (not at or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
                taken.insert(at, (first, last, m))
        out += [(first, last, m, t) for first, last, m in taken]
    if not out:
        return []
    out = _told_apart(out, index, len(words))
    starts, ends = common.ALNUM.spans(text)

    def chars(n: int) -> int:
        return len(text[:n].decode(errors="replace"))

    return [
        {"license": index.names[t], "coverage": m / len(index.words[t]), "first_word": a, "last_word": b, "start": chars(starts[a]), "end": chars(ends[b])}
        for a, b, m, t in sorted(out)
    ]


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()),
                             ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_MATCH_SQL = "array<struct<license: string, coverage: double, first_word: int, last_word: int, start: int, end: int>>"


def matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, n_matches and matches (license, coverage, words, characters) of every document."""
    spark = common.prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Index(templates or _templates(), least))

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        index = shared.value
        found = [scan(x, index) if x else [] for x in batch.column("data").to_pylist()]
        return [pa.array([len(f) for f in found], pa.int64()), pa.array(found, _MATCH)]

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_matches long, matches {_MATCH_SQL}"
    return rows.mapInArrow(common.by_batch(columns, ["n_matches", "matches"], ("data",)), schema)
