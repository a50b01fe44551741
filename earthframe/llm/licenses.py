"""License notices in texts: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

For each length of template, texts are read in overlapping windows of that many shingles, an eighth of it apart (each shingle
for short ones), so that some window covers seven eighths of any notice. A window and a template are their sets of five-word
shingles. Eight bands of one MinHash value retrieve a template of Jaccard similarity 0.6 with a chance above 0.999; unlike
words, shingles of a notice are rare elsewhere, so longer bands aren't needed. MinHash values of all windows come from
minima over powers of two. The retrieved template is verified by exact containment of its shingles in the window and half its
length to either side; a text shorter than the window is verified as a whole. Templates under five words are found where
their words stand in their order. So that versions and kin aren't taken for one another, half of the shingles with a number
must be there too, and half of those that tell a template from one of another license that holds most of it.

The templates are whole license texts (``license_texts``) and the notices by which texts name a license.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from importlib.resources import files
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthframe.llm import bytesets as bs
from earthframe.llm.rows import arrow_map

WORDS = 5
BANDS = 8
CONTAINMENT = 0.75
#: Words from which a template is a whole license, which numbers its sections.
NOTICE = 90

#: Identifiers of licenses and their usual notices, in words.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                   "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("all-rights-reserved", "All rights reserved."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this "
                "file except in compliance with the License"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
                "and transmit the Software"),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, Version 1.2"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("ODbL-1.0", "made available under the Open Database License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation "
                 "License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation "
                 "License, Version 1.2 or any later version published by the Free Software Foundation"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MIT", "is licensed under the MIT License"),
    ("ISC", "is licensed under the ISC License"),
    ("BSD-2-Clause", "licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "licensed under the Mozilla Public License, version 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC0-1.0", "licensed under CC0 1.0 Universal"),
)

#: Creative Commons licenses: identifier part, words of its name.
CREATIVE = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
#: Identifiers looked for behind SPDX-License-Identifier, besides those of the notices.
SPDX = ("0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BlueOak-1.0.0", "CDDL-1.0", "CECILL-2.1",
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+", "LGPL-2.1-only",
        "LGPL-2.1-or-later", "LGPL-2.1+", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+", "MIT-0", "MS-PL", "NCSA", "OFL-1.1",
        "OSL-3.0", "PostgreSQL", "Python-2.0", "UPL-1.0", "W3C", "Zlib")


def _templates() -> tuple[tuple[str, str], ...]:
    texts = sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8"))
                   for f in files("earthframe.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt"))
    creative = []
    for part, name in CREATIVE:
        for version, kind in (("4.0", "International"), ("3.0", "Unported")):
            creative.append((f"CC-{part}-{version}", f"licensed under a Creative Commons {name} {version} {kind} License"))
            if (part, version) != ("BY-NC", "4.0"):
                creative.append((f"CC-{part}-{version}", f"Licensed under CC {part} {version}"))
    named = [n for n, _ in (*NOTICES, *texts, *creative) if n != "all-rights-reserved"]
    return (*NOTICES, *creative, *texts, *((n, f"SPDX-License-Identifier: {n}") for n in dict.fromkeys([*named, *SPDX])))


TEMPLATES = _templates()

_rng = np.random.Generator(np.random.PCG64(60_606))
_TIMES = _rng.integers(0, 2**64, BANDS, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, BANDS, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased and one mark at their end left off, and the words per text."""
    start, stop, count = bs.words(data, offsets)
    stop = stop - (_MARKS[data[stop - 1]] & (stop - start > 1))
    return bs.span_hash(bs.prefix_hash(data, lower=True), start, stop), count


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words; a shorter sequence has none."""
    n = max(0, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        out += words[k:k + n] * _PLACE[k]
    return bs.mix(out)


class Template(NamedTuple):
    number: int
    license: str
    words: np.ndarray
    shingles: np.ndarray  # none of a template under five words
    minima: np.ndarray  # of each band
    least: int  # distinct shingles that can reach the containment
    telling: tuple[np.ndarray, ...]  # sets of shingles of which half must be there

    @property
    def size(self) -> int:
        return len(self.shingles)


def prepare(templates: Sequence[tuple[str, str]]) -> list[Template]:
    out = []
    for number, (name, text) in enumerate(templates):
        data = np.frombuffer(text.encode(), np.uint8)
        words = word_numbers(data, np.array([0, len(data)]))[0]
        if not len(words):
            continue
        runs = shingles(words)
        minima, least, telling = np.zeros(0, np.uint64), 0, ()
        if len(runs):
            minima = ((runs[:, None] ^ _XOR) * _TIMES).min(axis=0)
            often = np.cumsum(-np.sort(-np.unique(runs, return_counts=True)[1]))
            least = int(np.searchsorted(often, CONTAINMENT * len(runs) - 1e-9)) + 1
            if len(words) < NOTICE:
                numbers = np.array([any(c.isdigit() for c in w) for w in text.split()])
                numbered = np.lib.stride_tricks.sliding_window_view(numbers, WORDS).any(axis=1)
                telling = (runs[numbered],) if numbered.any() else ()
        out.append(Template(number, name, words, runs, minima, least, telling))
    holders: dict[int, list[Template]] = {}
    for template in out:
        for run in set(template.shingles.tolist()):
            holders.setdefault(run, []).append(template)
    return [t._replace(telling=(*t.telling, *_apart(t, holders))) for t in out]


def _apart(template: Template, holders: dict[int, list[Template]]) -> list[np.ndarray]:
    """Shingles that the template doesn't share with a template of another license that holds most of it."""
    shared = Counter(o.number for run in template.shingles.tolist() for o in holders[run] if o.license != template.license)
    kin = {n for n, times in shared.items() if CONTAINMENT * template.size <= times < template.size}
    return [np.array([run for run in template.shingles.tolist() if all(o.number != n for o in holders[run])], np.uint64)
            for n in sorted(kin)]


def retrieve(runs: np.ndarray, text: np.ndarray, templates: list[Template]) -> set[tuple[int, int]]:
    """(template, first shingle) of the windows that share a band with a template.

    ``text`` numbers the text of each word; windows over two texts are left out.
    """
    windows = {}
    for size in {t.size for t in templates if t.size}:
        start = np.arange(0, len(runs) - size + 1, max(1, size // 8))
        windows[size] = start[text[start] == text[start + size + WORDS - 2]]
    found: set[tuple[int, int]] = set()
    largest = max((size for size, start in windows.items() if len(start)), default=0)
    for band in range(BANDS if largest else 0):
        minima = [(runs ^ _XOR[band]) * _TIMES[band]]
        while 2 ** len(minima) <= largest:
            half = 2 ** (len(minima) - 1)
            minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
        for size, start in windows.items():
            if size == 1 and band or not len(start):
                continue  # the bands of a single shingle say the same
            level = size.bit_length() - 1
            least = np.minimum(minima[level][start], minima[level][start + size - 2 ** level])
            for number, template in enumerate(templates):
                if template.size == size:
                    found.update((number, int(i)) for i in start[least == template.minima[band]])
    return found


def in_order(words: np.ndarray, text: np.ndarray, template: Template) -> np.ndarray:
    """Places at which the words of a template stand one after the other in one text."""
    wanted = template.words
    at = np.flatnonzero(words[:len(words) - len(wanted) + 1] == wanted[0]) if len(words) >= len(wanted) else np.zeros(0, np.int64)
    for k in range(1, len(wanted)):
        at = at[words[at + k] == wanted[k]]
    return at[text[at] == text[at + len(wanted) - 1]]


def find(words: np.ndarray, count: np.ndarray, templates: list[Template]) -> list[tuple[int, int, str, float, int]]:
    """(text, template, license, containment, first word) of the best place of each template in each of several texts."""
    runs, ends = shingles(words), np.cumsum(count)
    starts = ends - count
    text = np.repeat(np.arange(len(count)), count)
    places = {(int(text[i]), number, i) for number, i in retrieve(runs, text, templates)}
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for number, template in enumerate(templates):
        if not template.size:
            for place in in_order(words, text, template).tolist():
                at = int(text[place])
                best[at, number] = min(best.get((at, number), (0.0, 0)), (-1.0, int(place - starts[at])))
            continue
        # Texts in which no whole window and its neighbour fit, but shingles enough.
        short = np.flatnonzero((count >= WORDS) & (count - WORDS + 1 >= template.least)
                               & (count < template.size + max(1, template.size // 8) + WORDS - 1))
        places.update((int(i), number, int(starts[i])) for i in short)
    for at, number, place in places:
        template = templates[number]
        last = ends[at] - WORDS + 1
        lo = max(starts[at], place - template.size // 2)
        hi = min(last, place + template.size + template.size // 2)
        share = float(np.isin(template.shingles, runs[lo:hi]).mean())
        if share >= CONTAINMENT and all(np.isin(own, runs[lo:hi]).mean() >= 0.5 for own in template.telling):
            first = int(lo + np.flatnonzero(np.isin(runs[lo:hi], template.shingles))[0] - starts[at])
            best[at, number] = min(best.get((at, number), (0.0, 0)), (-share, first))
    return [(at, templates[n].number, templates[n].license, -share, first) for (at, n), (share, first) in sorted(best.items())]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document and template found in it: doc_id, template, license, containment, first_word.

    Null and empty texts hold no notice; templates without words are never found. Of several places the one of the largest containment counts, then the first. Rows are read alone, so repeated rows and null
    ids give rows of their own. An empty table gives an empty result.
    """
    prepared = prepare(templates)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in bs.slices(batch):
            ids = rows.column("doc_id").to_pylist()
            found = [(ids[at], *rest) for at, *rest in find(*word_numbers(data, offsets), prepared)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                columns, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64()), strict=True)],
                ["doc_id", "template", "license", "containment", "first_word"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id bigint, template int, license string, containment double, first_word bigint")
