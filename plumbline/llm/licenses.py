"""Licence scan: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

Templates are a bounded dictionary (at most ``MAX_TEMPLATES``) that every task holds.  They are grouped by size: for up to
2B shingles, texts are cut into blocks of B shingles and every three neighbouring blocks form a window, so each passage
of a template's size lies in one window whole.  A verbatim template then has a Jaccard similarity of 1/3 or more with that
window, and one of which 80 % is there of 1/4 or more; bands of one row miss it with probability 0.75^48 = 1e-6 at most.
Windows that share a band with a template are verified on full sets.  Templates of up to four shingles can only occur
whole and are looked up as word sequences.  Where passages of several templates overlap, the fullest and longest one stays,
so a notice of the lesser licence is not taken for the general one.  Everything is one pass; nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytewords import ALNUM, Words, grams, text_slices, words_of
from plumbline.llm.registry import ship

_U = np.uint64
MAX_TEMPLATES = 10_000
BANDS = 48

# fixed values: notices as their licences word them
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mit": "Released under the MIT License",
    "mit-line": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
}
# fixed values: identifiers of the machine-readable line
SPDX = "0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
TEMPLATES |= {f"spdx:{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}

_FACTORS = np.random.RandomState(20240611).randint(0, 2**63, BANDS).astype(_U) * _U(2) + _U(1)


def _coordinate(x: np.ndarray, k: int) -> np.ndarray:
    """Coordinate k orders the (well mixed) hashes by their product with a random odd factor."""
    return x * _FACTORS[k]


class _Index:
    """Templates of up to four shingles as whole word sequences; the others as shingle sets by block size, and for each band by their minimum."""

    def __init__(self, templates: dict[str, str], shingle: int):
        self.sets: dict[str, np.ndarray] = {}
        self.short: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        self.classes: dict[int, list[str]] = defaultdict(list)
        self.words: dict[str, int] = {}
        whole: dict[int, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
        for name, text in sorted(templates.items()):
            data = np.frombuffer(text.encode(), np.uint8)
            hashes = words_of(data, np.array([0, len(data)]), ALNUM).hash
            self.words[name] = len(hashes)
            found = np.unique(grams(hashes, shingle))
            if len(found) > 4:
                self.sets[name] = found
                self.classes[1 << (int(len(found) - 1).bit_length() - 1)].append(name)
            elif len(hashes):
                whole[len(hashes)][int(grams(hashes, len(hashes))[0])].append(name)
        for n, named in whole.items():
            keys = np.array(sorted(named), _U)
            self.short[n] = keys, [named[int(k)] for k in keys]
        self.bands = {}
        for size, names in self.classes.items():
            for k in range(BANDS):
                low = np.array([_coordinate(self.sets[n], k).min() for n in names], _U)
                order = np.argsort(low, kind="stable")
                self.bands[size, k] = low[order], order


def _whole(index: _Index, words: Words) -> list[tuple[int, str, int, int, float]]:
    """Occurrences of the short templates."""
    out = []
    for n, (keys, names) in index.short.items():
        g = grams(words.hash, n)
        at = np.searchsorted(keys, g)
        at[at == len(keys)] = 0
        for i in np.flatnonzero((keys[at] == g) & (words.doc[: len(g)] == words.doc[n - 1 : n - 1 + len(g)])):
            d = int(words.doc[i])
            start = int(i - words.bounds[d])
            out += [(d, name, start, start + n, 1.0) for name in names[at[i]]]
    return out


def _windows(index: _Index, words: Words, shingle: int, percent: int) -> list[tuple[int, str, int, int, float]]:
    """Windows that share a band with a template and hold enough of its shingles."""
    g = grams(words.hash, shingle)
    inside = np.flatnonzero(words.doc[: len(g)] == words.doc[shingle - 1 : shingle - 1 + len(g)])
    g, doc = g[inside], words.doc[inside]
    if not len(g) or not index.classes:
        return []
    begin = np.searchsorted(doc, np.arange(len(words.bounds) - 1))  # first shingle of each document
    rank = np.arange(len(g)) - begin[doc]
    grids, before = [], np.arange(len(g))
    for size in sorted(index.classes):
        starts = before[rank[before] % size == 0]
        block_doc = doc[starts]
        # a window is a block and the two after it, as far as the document goes
        own = np.arange(len(starts))
        second, third = np.minimum(own + 1, len(starts) - 1), np.minimum(own + 2, len(starts) - 1)
        second = np.where(block_doc[second] == block_doc, second, own)
        third = np.where(block_doc[third] == block_doc, third, second)
        grids.append((size, starts, second, third, np.searchsorted(before, starts)))
        before = starts
    hits: set[tuple[int, int, int]] = set()  # grid, window, template of the class
    for k in range(BANDS):
        block = _coordinate(g, k)
        for i, (size, _, second, third, inner) in enumerate(grids):
            block = np.minimum.reduceat(block, inner)  # larger blocks from the minima of smaller ones
            low = np.minimum(np.minimum(block, block[second]), block[third])
            values, order = index.bands[size, k]
            at = np.searchsorted(values, low)
            at[at == len(values)] = 0
            for w in np.flatnonzero(values[at] == low):
                for j in order[np.searchsorted(values, low[w]) : np.searchsorted(values, low[w], "right")]:
                    hits.add((i, int(w), int(j)))
    out = []
    for i, w, j in hits:
        size, starts, _, third, _ = grids[i]
        name = index.classes[size][j]
        last = int(third[w])
        a, b = int(starts[w]), int(starts[last + 1]) if last + 1 < len(starts) else len(g)
        own = np.isin(g[a:b], index.sets[name])
        common = len(np.unique(g[a:b][own]))
        if 100 * common >= percent * len(index.sets[name]):
            at = np.flatnonzero(own) + a
            d = int(doc[a])
            word = inside[at] - words.bounds[d]
            out.append((d, name, int(word[0]), int(word[-1]) + shingle, common / len(index.sets[name])))
    return out


def scan_slice(index: _Index, data: np.ndarray, offsets: np.ndarray, shingle: int, percent: int) -> list[tuple[int, str, int, int, float]]:
    """(document, template, first word, end word, containment): of passages that overlap, the best template's."""
    words = words_of(data, offsets, ALNUM)
    found = defaultdict(list)
    for d, name, a, b, share in _whole(index, words) + _windows(index, words, shingle, percent):
        found[d, name].append((a, b, share))
    passages = defaultdict(list)
    for (d, name), spans in found.items():
        merged: list[list] = []
        for a, b, share in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], b), max(merged[-1][2], share)
            else:
                merged.append([a, b, share])
        passages[d] += [(-share, -index.words[name], name, a, b) for a, b, share in merged]
    out = []
    for d, spans in passages.items():
        kept: list[tuple[int, int]] = []
        for share, _, name, a, b in sorted(spans):  # fullest, then longest, then first by name
            if all(b <= x or y <= a for x, y in kept):
                kept.append((a, b))
                out.append((d, name, a, b, -share))
    return sorted(out)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Licence templates in documents.

    Returns ``id_col``, license, start_word, end_word (end exclusive, from the first to the last shared shingle) and
    containment (share of the template's distinct shingles in the best window), one row for each passage; passages of one
    template that overlap are one, and of those of several templates the one with the highest containment stays, then that of
    the longest template, then the first by name.  Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased.  Null, empty
    and clean texts give no rows; templates of fewer words than a shingle match as they are.  Rows that repeat an id, or have none,
    are scanned each.  Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    ship(docs.sparkSession)
    index = _Index(templates, shingle)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([base.schema["id"], T.StructField("license", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("containment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column("text")):
                rows = scan_slice(index, data, offsets, shingle, percent)
                if rows:
                    d, *rest = zip(*rows)
                    types = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([first + x for x in d])), *(pa.array(c, t) for c, t in zip(rest, types))], schema.names)

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)
