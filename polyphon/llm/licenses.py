"""License scan by patience alignment of texts with license templates.

Text and template are sequences of lower-case words. Where the words of a
template stand close together, that stretch of the text is aligned with it:
words that occur exactly once in both are anchors; the longest increasing
subsequence of their places is kept; between kept anchors, and before the first
and behind the last, the gaps are aligned in the same way, and equal words at
the borders of a gap are matched directly. Coverage is the share of template
words matched; a stretch with at least ``COVERAGE`` is a finding, if the words
that tell the license from others (``REQUIRED``) stand in it one behind the other.
A template is only looked for in texts that have all of those words. Very long
license texts are known by their openings and their usual notices.

Stretches are found with array operations over whole texts: a window of half as
many words again as the template has, of which enough are template words. After
a finding the search goes on behind it, so repeated notices all count. A text is
never aligned as a whole, so its length and its repeated words do not matter.

Edge cases: null and empty texts have no findings; null or repeated doc_ids keep
their rows; equal coverage is given by template order; overlapping findings of
several templates all count, except that a finding inside one with more matched
words is dropped; templates given by the caller have no required words unless
``required`` names them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyphon.llm.base import text_slices
from polyphon.llm.wordhash import byte_set, column_bytes, span_hashes, word_spans

COVERAGE = 0.8
SLACK = 1.5

#: Notices and texts of common public licenses, and the openings of the very long texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "mit": "Released under the MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "all-rights-reserved": "All rights reserved",
}

#: Word sequences that must stand in a finding, since they tell its license from others.
REQUIRED: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License, Version 2.0",),
    "apache-2.0-header": ("Apache License, Version 2.0",),
    "mit": ("MIT License",),
    "mit-text": ("to any person obtaining a copy of this software",),
    "gpl-3.0": ("GNU General Public License", "version 3"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0",),
    "all-rights-reserved": ("All", "rights", "reserved"),
}


def _add(name: str, text: str, *required: str) -> None:
    TEMPLATES[name], REQUIRED[name] = text, required


_DISCLAIMER = (
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_ENDORSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

_add("bsd-2-clause-text", _REDISTRIBUTION + _AS_IS + _DISCLAIMER, "Redistribution and use in source and binary forms")
_add("bsd-3-clause-text", _REDISTRIBUTION + _ENDORSE + _AS_IS + _DISCLAIMER, "Redistribution and use in source and binary forms", "to endorse or promote products")
_add("isc-text", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}", "permission notice appear in all copies")
_add("0bsd-text", f"{_ISC}. {_ISC_END}", "is hereby granted the software is provided")
_add(
    "mit-full-text",
    TEMPLATES["mit-text"] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE.",
    "to any person obtaining a copy of this software", "permission notice shall be included in all copies",
)
_add(
    "zlib-text",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions",
    "to alter it and redistribute it freely",
)
_add(
    "bsl-1.0-text",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "to any person or organization obtaining a copy",
)
_add(
    "unlicense-text",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "released into the public domain",
)
_add("apache-2.0-text", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.", "Apache License Version 2.0")
for _v in ("1.1", "2.0"):
    _add(f"mpl-{_v}-text", f"Mozilla Public License Version {_v} 1. Definitions", f"Mozilla Public License Version {_v}")
    _add(
        f"mpl-{_v}-header",
        f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {_v}. If a copy of the MPL was not distributed with this file, You can "
        f"obtain one at http://mozilla.org/MPL/{_v}/."
        if _v == "2.0"
        else f"The contents of this file are subject to the Mozilla Public License Version {_v} (the \"License\"); you may not use this file except in compliance with the License.",
        "Mozilla Public License", _v,
    )
_add(
    "epl-2.0-header",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "Eclipse Public License 2.0",
)
_add(
    "epl-1.0-header",
    "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies "
    "this distribution",
    "Eclipse Public License v1.0",
)
_add("cc0-1.0-text", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES", "CC0 1.0 Universal")

#: The GNU family: id, family name, version, what the full text says behind the version.
for _id, _gnu, _v, _date in (
    ("gpl-2.0", "General", "2", "June 1991"), ("gpl-3.0", "General", "3", "29 June 2007"), ("lgpl-2.0", "Library General", "2", "June 1991"),
    ("lgpl-2.1", "Lesser General", "2.1", "February 1999"), ("lgpl-3.0", "Lesser General", "3", "29 June 2007"), ("agpl-3.0", "Affero General", "3", "19 November 2007"),
):
    _name, _short = f"GNU {_gnu} Public License", _id.split("-")[0].upper()
    if _id not in TEMPLATES:
        _add(_id, f"This work is licensed under the {_name}, version {_v}", _name, f"version {_v}")
    _add(f"{_id}-notice", f"under the {_name}, version {_v}", _name, f"version {_v}")
    _add(f"{_id}-v-notice", f"under the {_name} v{_v}", f"{_name} v{_v}")
    _add(
        f"{_id}-header",
        f"is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation, either "
        f"version {_v} of the License, or (at your option) any later version. It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_name} for more details.",
        f"the {_name}", f"version {_v} of the License",
    )
    _add(
        f"{_id}-only-header",
        f"is free software; you can redistribute it and/or modify it under the terms of the {_name} version {_v} as published by the Free Software Foundation",
        f"the {_name} version {_v} as",
    )
    _add(
        f"{_id}-text",
        f"{_name} Version {_v}, {_date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this "
        "license document, but changing it is not allowed.",
        f"{_name} Version {_v} {_date}",
    )
    for _form in (f"{_short}v{_v}", f"{_short}-{_v}", f"{_short} v{_v}", f"{_short} version {_v}"):
        _add(f"{_id}-{_form.lower().replace(' ', '-')}", f"Licensed under the {_form}", _form)

#: Short names in one-line notices: id, forms of the name.
for _id, *_forms in (
    ("mit", "The MIT License (MIT)", "MIT License Copyright (c)"),
    ("bsd", "Released under the BSD License"),
    ("bsd-2-clause", "Released under the BSD 2-Clause License", "BSD 2-Clause License", "Simplified BSD License", "Released under the Simplified BSD License"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License", "BSD 3-Clause License", "New BSD License", "Modified BSD License", "Released under the New BSD License", "Released under the Modified BSD License"),
    ("bsd-4-clause", "Released under the BSD 4-Clause License", "BSD 4-Clause License"),
    ("isc", "Released under the ISC License", "The ISC License"),
    ("zlib", "Released under the zlib License"),
    ("apache-2.0", "Licensed under the Apache License 2.0", "Licensed under the Apache 2.0 License"),
    ("mpl-1.1", "Licensed under the Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "Licensed under the MPL 1.1"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Licensed under the MPL 2.0"),
    ("epl-1.0", "Licensed under the Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    ("epl-2.0", "Licensed under the Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    ("bsl-1.0", "Boost Software License, Version 1.0", "Boost Software License 1.0"),
    ("unlicense", "Released under the Unlicense", "Licensed under the Unlicense"),
    ("cc0-1.0", "CC0 1.0 Universal", "Licensed under CC0 1.0", "Creative Commons Zero 1.0"),
    ("public-domain", "released into the public domain", "is in the public domain", "dedicated to the public domain", "placed in the public domain"),
):
    for _k, _form in enumerate(_forms):
        # All words of a name but the verb phrase before it.
        _key = re.sub(r"^(?:(?:Released|Licensed) under (?:the )?|The (?=MIT|ISC))", "", _form)
        _add(_id if _id not in TEMPLATES else f"{_id}-notice-{_k + 1}", _form, _key)

for _by, _long in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _id = f"cc-{_by.lower()}-{_v}"
        if _id not in TEMPLATES:
            _add(_id, f"Licensed under CC {_by} {_v}", f"CC {_by} {_v}")
        _add(f"{_id}-notice", f"licensed under a Creative Commons {_long} {_v}", f"Creative Commons {_long} {_v}")

for _id in (
    "MIT", "MIT-0", "ISC", "Zlib", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-2.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0",
    "Unlicense", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0",
    *(f"CC-{b}-{v}" for b in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0")),
):
    _add(f"{_id.lower()}-spdx", f"SPDX-License-Identifier: {_id}", f"Identifier: {_id}")

WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

FOUND = "doc_id long, n_words long, found array<struct<license:string,start:long,end:long,matched:long,coverage:double>>"


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)}))


def increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            piles.append(i)
        else:
            tops[k], piles[k] = p, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        for (i, j), (p, q) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            if i + 1 < p and j + 1 < q:
                todo.append((i + 1, p, j + 1, q))
    return sorted(out)


def _stands_in(words: list[int], sequence: list[int]) -> bool:
    return any(words[i : i + len(sequence)] == sequence for i, w in enumerate(words) if w == sequence[0])


def _findings(words: np.ndarray, places: np.ndarray, known: dict[str, tuple[np.ndarray, list[list[int]]]]) -> list[tuple[str, int, int, int, float]]:
    """Findings in one text; ``places`` are those of words that occur in any template."""
    out = []
    for name, (template, required) in known.items():
        m = len(template)
        need, width = int(np.ceil(COVERAGE * m)), int(np.ceil(SLACK * m))
        own = places[np.isin(words[places], template)]
        at = 0
        target = template.tolist()
        while at + need <= len(own):
            # The next place from which enough template words stand in one window.
            tight = np.flatnonzero(own[at + need - 1 :] - own[at : len(own) - need + 1] < width)
            if not len(tight):
                break
            at += int(tight[0])
            first = int(own[at])
            matched = patience(words[first : first + width].tolist(), target)
            start, end = (first + matched[0][0], first + matched[-1][0] + 1) if matched else (first, first)
            if len(matched) >= need and all(_stands_in(words[start:end].tolist(), r) for r in required):
                out.append((name, start, end, len(matched), len(matched) / m))
                at = int(np.searchsorted(own, end))
            else:
                at += 1
    kept = [x for x in out if not any(y is not x and y[1] <= x[1] and x[2] <= y[2] and y[3] > x[3] for y in out)]
    return sorted(kept, key=lambda x: (x[1], x[2]))


def _hashes(text: str) -> np.ndarray:
    data, offsets = column_bytes(pa.array(template_words(text), pa.string()))
    return span_hashes(data, offsets[:-1], offsets[1:]) if len(offsets) > 1 else np.zeros(0, np.uint64)


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", required: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``found`` (license, word places, words matched, coverage)."""
    templates, required = (templates, required or {}) if templates else (TEMPLATES, REQUIRED)
    known = {}
    for name, text in templates.items():
        hashes = _hashes(text)
        if len(hashes):
            known[name] = (hashes, [r.tolist() for r in map(_hashes, required.get(name, ())) if len(r)])
    every = np.unique(np.concatenate([h for h, _ in known.values()]))
    keys = np.array(sorted({w for _, required in known.values() for r in required for w in r}), np.uint64)
    wanted = [(name, np.searchsorted(keys, sorted({w for r in required for w in r}))) for name, (_, required) in known.items()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])
        for batch in text_slices(batches, "text"):
            data, offsets = column_bytes(batch.column("text"))
            starts, ends, before = word_spans(data, offsets, WORD)
            hashes = span_hashes(data, starts, ends)
            hits = np.flatnonzero(every[np.minimum(np.searchsorted(every, hashes), len(every) - 1)] == hashes)
            bounds = np.searchsorted(hits, before)
            # Per text the templates whose required words all occur in it.
            has = np.zeros((batch.num_rows, len(keys)), bool)
            of = np.searchsorted(before, hits, side="right") - 1
            at = np.minimum(np.searchsorted(keys, hashes[hits]), max(len(keys) - 1, 0))
            key = keys[at] == hashes[hits] if len(keys) else np.zeros(len(hits), bool)
            has[of[key], at[key]] = True
            open_to: list[dict] = [{} for _ in range(batch.num_rows)]
            for name, columns in wanted:
                for i in np.flatnonzero(has[:, columns].all(axis=1)).tolist():
                    open_to[i][name] = known[name]
            found = [
                _findings(hashes[a:b], hits[x:y] - a, some) if y > x and some else []
                for a, b, x, y, some in zip(before[:-1].tolist(), before[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), open_to)
            ]
            rows = pa.array([[dict(zip(("license", "start", "end", "matched", "coverage"), m)) for m in f] for f in found], pa.list_(kind))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(before), pa.int64()), rows], names=["doc_id", "n_words", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(search, FOUND)
