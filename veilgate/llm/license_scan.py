"""License scans by patience alignment.

Where the words of a license notice gather in a text, a window of the notice's length is aligned with it:
words that occur once in both are anchors, the longest increasing run of anchors is kept, and the gaps between
them are aligned in the same way; a gap without anchors keeps its common start and end. The share of the
notice that is matched is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgate.llm.common import scan

#: Least share of a notice that has to be found.
LEAST_COVERAGE = 0.8

#: Words that tell one license of a family from another, besides numbers: in the place of each other, or inserted, they mean another one.
MARKS = frozenset("lesser library affero nd nc sa noncommercial noderivatives noderivs sharealike".split())
#: Words of a notice so short that none of its marks may be missing.
SHORT = 20


def _variants() -> tuple[tuple[str, str], ...]:
    """Notices that come in families: GNU, Creative Commons, BSD."""
    out = []
    for name, title, version in (
        ("GPL-2.0", "General", "2"),
        ("LGPL-2.0", "Library General", "2"),
        ("LGPL-2.1", "Lesser General", "2.1"),
        ("LGPL-3.0", "Lesser General", "3"),
        ("AGPL-3.0", "Affero General", "3"),
    ):
        if name != "GPL-2.0":
            out.append((name, f"This work is licensed under the GNU {title} Public License, version {version}."))
        out.append(
            (
                name,
                f"free software; you can redistribute it and/or modify it under the terms of the GNU {title} Public License as "
                f"published by the Free Software Foundation; either version {version} of the License, or (at your option) any later "
                "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} Public License for more details.",
            )
        )
    kinds = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
    for version, scope in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        for short, long in kinds.items():
            if version == "4.0" and short in ("", "-SA", "-NC"):
                continue  # among the notices
            if version != "4.0":
                long = long.replace("NoDerivatives", "NoDerivs")
            out.append((f"CC-BY{short}-{version}", f"Licensed under CC BY{short} {version}."))
            out.append((f"CC-BY{short}-{version}", f"This work is licensed under a Creative Commons Attribution{long} {version} {scope} License."))
    conditions = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    )
    neither = (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    )
    shown = (
        "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
        "This product includes software developed by the organization. "
    )
    out.append(("BSD-3-Clause", f"{conditions}3. {neither}"))
    out.append(("BSD-4-Clause", f"{conditions}{shown}4. {neither}"))
    return tuple(out)


# The public notices of common licenses.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
) + _variants()
#: Words too common to begin a search with.
COMMON = frozenset(
    "a above all an and any are as at be but by can for form free from if in is it its more no not of on one or other that the this "
    "to under use was will with without work you your 0 1 2 3 4 v".split()
)

_WORDS = re.compile(r"[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    least: int
    #: places of the words a search begins with, and how many of them a match cannot lack
    places: dict[str, tuple[int, ...]] = field(default_factory=dict)
    needed: int = 1


def make_templates(notices: Sequence[tuple[str, str]] = NOTICES, coverage: float = LEAST_COVERAGE) -> list[Template]:
    out = []
    for name, text in notices:
        words = tuple(words_of(text))
        if not words:
            continue
        least = max(1, -(-int(coverage * len(words) * 1000) // 1000))
        places: dict[str, tuple[int, ...]] = {}
        for n, word in enumerate(words):
            if word not in COMMON:
                places[word] = (*places.get(word, ()), n)
        if not places:  # a notice of common words only: any of them begins a search
            places = {w: tuple(n for n, x in enumerate(words) if x == w) for w in words}
        rare = sum(len(p) for p in places.values())
        out.append(Template(name, words, least, places, max(1, least - (len(words) - rare))))
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs rising in both places; ``pairs`` is sorted by the first."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(b)
            ends.append(k)
        else:
            tails[at], ends[at] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(text: Sequence[str], notice: Sequence[str]) -> list[tuple[int, int]]:
    """Matched (place in text, place in notice), rising in both."""
    out, waiting = [], [(0, len(text), 0, len(notice))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        of_text, of_notice = Counter(text[a:b]), Counter(notice[c:d])
        where = {w: n for n, w in enumerate(notice[c:d], c) if of_notice[w] == 1}
        anchors = increasing([(n, where[w]) for n, w in enumerate(text[a:b], a) if of_text[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        last_text, last_notice = a, c
        for x, y in [*anchors, (b, d)]:
            waiting.append((last_text, x, last_notice, y))
            last_text, last_notice = x + 1, y + 1
    return sorted(out)


def _marks(words: Sequence[str]) -> set[str]:
    return {w for w in words if w in MARKS or w.isdecimal()}


def same_license(text: Sequence[str], notice: Sequence[str], matched: list[tuple[int, int]]) -> bool:
    """Whether no mark of the notice is replaced by another one or joined by one, nor missing if it is short.

    In a long notice a number may be lost, and a word of MARKS in some of its places.
    """
    short = len(notice) <= SHORT
    if MARKS.intersection(notice) - {notice[d] for _, d in matched}:
        return False
    for (a, c), (b, d) in zip([(matched[0][0] - 1, -1), *matched], [*matched, (matched[-1][0] + 1, len(notice))], strict=True):
        there, wanted = _marks(text[a + 1 : b]), _marks(notice[c + 1 : d])
        if wanted and (short or there - wanted) or there & MARKS - wanted or short and there:
            return False
    return True


def find_notices(text: str | None, templates: Sequence[Template], keys: frozenset[str]) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, last word) of every notice in a whole text, in text order, without overlaps.

    Of overlapping finds that with most matched words less those it lacks stays, then the higher coverage, then the earlier notice.
    """
    words = words_of(text)
    if keys.isdisjoint(words):
        return []
    at: dict[str, list[int]] = {}
    for n, word in enumerate(words):
        if word in keys:
            at.setdefault(word, []).append(n)
    found = []
    for number, template in enumerate(templates):
        size = len(template.words)
        slack = max(2, size // 4)
        places = sorted((n, p) for w, ps in template.places.items() for n in at.get(w, ()) for p in ps)
        if len({p for _, p in places}) < template.needed:
            continue
        starts = sorted({n - p for n, p in places})
        spots = [n for n, _ in places]
        free = 0
        tried = -1 << 60
        for start in starts:
            # starts closer than a quarter of the slack see almost the same window
            if start < free - slack or start - tried < max(1, slack // 4):
                continue
            low, high = max(free, start - slack, 0), min(len(words), start + size + slack)
            if bisect_left(spots, high) - bisect_left(spots, low) < template.needed:
                continue
            tried = start
            matched = patience(words[low:high], template.words)
            if template.least <= len(matched) < size:  # the window may end within the notice
                first = low + matched[0][0]
                wide = max(free, first - slack), min(len(words), first + size + 2 * slack)
                again = patience(words[slice(*wide)], template.words)
                if len(again) > len(matched):
                    (low, high), matched = wide, again
            if len(matched) >= template.least and same_license(words[low:high], template.words, matched):
                first, last = low + matched[0][0], low + matched[-1][0]
                found.append((2 * len(matched) - size, len(matched) / size, -number, template.name, first, last))
                free, tried = last + 1, -1 << 60
    kept: list[tuple[str, float, int, int]] = []
    for _, coverage, _, name, first, last in sorted(found, key=lambda x: (-x[0], -x[1], -x[2], x[4])):
        if all(last < a or first > b for _, _, a, b in kept):
            kept.append((name, coverage, first, last))
    return sorted(kept, key=lambda x: x[2])


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: Sequence[tuple[str, str]] = NOTICES,
    coverage: float = LEAST_COVERAGE,
) -> DataFrame:
    """(``id_col``, licenses array<struct<license, coverage, first_word, last_word>>) per row of docs.

    Whole texts are read where they lie; the notices travel with the task and are a parameter, not data. A null
    or empty text has no licenses. Ids may be null or repeated, other columns are ignored.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = make_templates(notices, coverage)
        keys = frozenset(w for t in templates for w in t.places)
        for rows in batches:
            found = [
                [{"license": n, "coverage": c, "first_word": a, "last_word": b} for n, c, a, b in find_notices(t, templates, keys)]
                for t in rows.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, kind)], names=[id_col, "licenses"])

    keyed = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = (
        f"`{id_col}` {keyed.schema[0].dataType.simpleString()}, "
        "licenses array<struct<license: string, coverage: double, first_word: bigint, last_word: bigint>>"
    )
    return scan(keyed, each, schema)
