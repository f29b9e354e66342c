"""License scans by patience alignment."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8
SLACK = 1.5  # words of a stretch of text for each word of a long template
SHORT = 24  # words of a template that may have SHORT_GAP more words in it and must match to SHORT_COVERAGE
SHORT_COVERAGE = 0.7
SHORT_GAP = 6
NEGATIONS = frozenset("not never no nor isn aren wasn without".split())  # before a short notice

WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
VERSION = re.compile(r"(?<![\d.])v?(\d+)(?:\.0)+$")

# fixed values: public license notices, as their authors word them, with the words that decide which license it is
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} "
    "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
BSD_TWO = (
    BSD_START + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THREE = (
    BSD_TWO + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission."
)
GNU = (  # name, words of it, version, date of the full text
    ("GPL-2.0", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License", "2", "June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007"),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license 2"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
     "either express or implied.", "www.apache.org license-2"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
     "REPRODUCTION, AND DISTRIBUTION", "apache 2"),
    ("MIT", "Released under the MIT License", "mit license"),
    ("MIT", "Licensed under the MIT License", "mit license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "granted sublicense"),
    ("BSD", "Licensed under the BSD License", "bsd license"),
    ("BSD", BSD_START, "redistribution"),
    ("BSD-2-Clause", BSD_TWO, "retain reproduce"),
    ("BSD-3-Clause", BSD_THREE, "retain reproduce neither endorse"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0", "mozilla public 2"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions", "mozilla 2 definitions"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", "cc by 4"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", "cc by-sa 4"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "cc by-nc 4"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License", "commons attribution 4"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     "commons attribution-sharealike 4"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     "commons attribution-noncommercial 4"),
    ("CC0-1.0", "Released under CC0 1.0", "cc0 1"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
)
IDENTIFIERS = "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC MPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 Unlicense".split()


def templates() -> list[tuple[str, str, str]]:
    """License, words of a notice, and the words of it that decide."""
    out = list(NOTICES)
    tags = [(x, x) for x in IDENTIFIERS]
    for name, said, version, date in GNU:
        keys = f"{said.lower()} {version}"
        out.append((name, GNU_NOTICE.format(said, version), keys.replace(" license", "")))
        out.append((name, f"licensed under the {said}, version {version}", keys))
        out.append((name, f"{said} Version {version}, {date}", f"{keys} {date.lower()}"))
        tags += [(name, name + end) for end in ("", "-only", "-or-later")]
    return out + [(name, f"SPDX-License-Identifier: {tag}", f"spdx-license-identifier {tag.lower()}") for name, tag in tags]


def words(text: str) -> list[str]:
    """Words in lower case; ``v2.0`` and ``2.0`` are ``2``, as is the end of ``license-2.0``."""
    found = WORD.findall(text.lower())
    return [VERSION.sub(r"\1", w) if w[-1] == "0" else w for w in found]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places of equal words, rising in both.

    Words that both hold once anchor; the longest rising run of anchors stays; the stretches between
    anchors are aligned in the same way. Equal heads and tails are matched first.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once = {}
        for k in range(a0, a1):
            once[a[k]] = -1 if a[k] in once else k
        places: dict[str, int] = {}
        for k in range(b0, b1):
            places[b[k]] = -1 if b[k] in places else k
        anchors = sorted((k, places[w]) for w, k in once.items() if k >= 0 and places.get(w, -1) >= 0)
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(anchors):  # longest increasing subsequence
            at = bisect_left(tails, j)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1] = [j]
            ends[at : at + 1] = [n]
        run = []
        n = ends[-1] if ends else -1
        while n >= 0:
            run.append(anchors[n])
            n = back[n]
        run.reverse()
        for (i, j), (p, q) in zip([(a0 - 1, b0 - 1), *run], [*run, (a1, b1)]):
            if run:
                work.append((i + 1, p, j + 1, q))
        out += run
    return sorted(out)


def compiled() -> list[tuple[str, list[str], set[str], list[str], set[str], set[int]]]:
    """License, words of a template, its distinct words, these with the longest first, deciding words and their places."""
    out = []
    for name, notice, said in templates():
        template, keys = words(notice), set(words(said))
        distinct = set(template)
        places = {k for k, w in enumerate(template) if w in keys}
        out.append((name, template, distinct, sorted(distinct, key=lambda w: (-len(w), w)), keys, places))
    return out


def scan(text: str, least: float = COVERAGE) -> list[tuple[str, float, int]]:
    """``(license, coverage, first word)`` of the licenses of a whole text, the best match of each.

    A template can only be covered where enough of its words, the deciding ones among them, stand
    close together; those stretches are found by counting its distinct words, then aligned. Of
    matches that share words of the text, the one with most aligned words stays.
    """
    low = text.lower()
    likely = []
    for name, template, distinct, long_first, keys, deciding in COMPILED:
        short = len(template) <= SHORT
        bar = SHORT_COVERAGE if short else least
        room = len(template) + SHORT_GAP if short else int(len(template) * SLACK)
        missing = int((1 - bar) * len(template) + 1e-9)  # words of the template that may be absent
        if all(w in low for w in keys) and any(w in low for w in long_first[: missing + 1]):
            likely.append((name, template, distinct, keys, deciding, bar, room, missing))
    if not likely:
        return []
    mine = words(text)
    places: dict[str, list[int]] = {}
    needed = {w for entry in likely for w in entry[2]}
    for k, w in enumerate(mine):
        if w in needed:
            places.setdefault(w, []).append(k)
    found: list[tuple[int, float, int, int, str]] = []  # aligned words, coverage, first and last word, license
    for name, template, distinct, keys, deciding, bar, room, missing in likely:
        if not all(w in places for w in keys):
            continue
        spots = sorted(k for w in distinct for k in places.get(w, ()))
        held: Counter[str] = Counter()  # words of the window
        stop = 0
        for first in spots:
            while stop < len(spots) and spots[stop] - first < room:
                held[mine[spots[stop]]] += 1
                stop += 1
            if len(held) >= len(distinct) - missing and all(w in held for w in keys):
                pairs = align(mine[first : first + room], template)
                coverage = len(pairs) / len(template)
                if coverage >= bar and pairs[0][0] == 0 and deciding <= {j for _, j in pairs}:
                    denied = len(template) <= SHORT and not NEGATIONS.isdisjoint(mine[max(0, first - 2) : first])
                    found.append((0 if denied else len(pairs), coverage, first, first + pairs[-1][0], name))
            held[mine[first]] -= 1
            if not held[mine[first]]:
                del held[mine[first]]
    denied = sorted((x[2], x[3]) for x in found if not x[0])
    reach = list(accumulate((b for _, b in denied), max, initial=-1))  # words of denied notices do not count
    found = [x for x in found if x[0] and x[3] > reach[bisect_left(denied, (x[2], -1))]]
    taken: list[tuple[int, int]] = []  # spans, rising
    best: dict[str, tuple[float, int]] = {}
    for _, coverage, first, last, name in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])):
        at = bisect_left(taken, (first, last))
        if (at and taken[at - 1][1] >= first) or (at < len(taken) and taken[at][0] <= last):
            continue
        insort(taken, (first, last))
        if name not in best or (-coverage, first) < (-best[name][0], best[name][1]):
            best[name] = (coverage, first)
    return [(name, round(c, 4), first) for name, (c, first) in sorted(best.items())]


COMPILED = compiled()


def scan_licenses(docs: DataFrame, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, coverage, first_word)``: a row for each document and license in it.

    Templates of up to ``SHORT`` words may miss a few of them and have ``SHORT_GAP`` others between;
    longer ones must match in a share ``least`` of their words. The words that tell licenses and
    versions apart must always match; a short notice after a negation does not count. Full texts are
    known by their headings or first clauses. Whole texts are read. Null and empty texts give
    no rows; null ids pass through; repeated rows repeat; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, scalar in enumerate(batch.column(1)):
                if scalar.is_valid:
                    rows += [(k, *x) for x in scan(scalar.as_py(), least)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                ["doc_id", "license", "coverage", "first_word"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, license string, coverage double, first_word long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
