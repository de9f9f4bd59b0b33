"""License scans by patience alignment.

Words that a license has once are its anchors. Where a text has enough of a license's words
close together, the longest increasing subsequence of the anchors found there, in the order
of the license, is the backbone of the alignment; the gaps between its anchors, and what
stands before and behind, are aligned in the same way by the words that both sides have
once, and so on. Coverage is the share of the license's words that are aligned. A short
sentence must stand there whole, and a notice with the words that tell it from its neighbours
(a name, a version).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField

from logwarden.llm import arrow
from logwarden.llm.decontaminate import FOLD
from logwarden.llm.words import words_of

COVER = 0.75  # share of a license's words that an occurrence has at least
DENSE = 0.5  # share of an occurrence's words that belong to the license at least
SENTENCE = 20  # words below which a template must be found whole and without others between
NOTICE = 100  # words below which the words that its neighbours lack must be found as well

FOLDER = Path(__file__).parent / "licenses"  # whole texts, by name
# Identifiers of the public license list, and the notices that licenses recommend.
IDENTIFIERS = [
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent",
    "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "ECL-2.0", "EPL-1.0", "EPL-2.0",
    "EUPL-1.1", "EUPL-1.2", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0",
    "MS-PL", "MS-RL", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
]
GNU = [
    ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.0", "Library General", "2"), ("LGPL-2.1", "Lesser General", "2.1"),
    ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"),
]
COMMONS = [
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
                "which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means."),
    *((name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS),
    *((name, f"SPDX-License-Identifier: {name}-{which}") for name, _, _ in GNU for which in ("only", "or-later")),
    *((name, f"This work is licensed under the GNU {kind} Public License, version {version}.") for name, kind, version in GNU),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as "
             f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, kind, version in GNU),
    *((f"CC-{code}-{version}", text) for code, kind in COMMONS for version in ("3.0", "4.0") for text in (
        f"Licensed under CC {code} {version}.", f"SPDX-License-Identifier: CC-{code}-{version}",
        f"licensed under a Creative Commons {kind} {version}", f"licensed under the Creative Commons {kind} {version}")),
]


class License(NamedTuple):
    name: str
    words: list[int]  # numbers of its words
    has: np.ndarray  # how often it has each word of the vocabulary
    anchor: np.ndarray  # of a word that it has once the place, else -1
    need: int  # words of an occurrence
    span: int  # most words that an occurrence reaches over
    marks: list[set[int]]  # places of the words that a neighbour lacks; three quarters of each must be found
    tight: set[int]  # places behind which a neighbour has further words: the next word must follow at once


class Found(NamedTuple):
    name: str
    matched: int
    length: int  # of the license
    begin: int  # first and last aligned word
    end: int


def known_licenses() -> list[tuple[str, str]]:
    return [(path.stem, path.read_text("utf-8")) for path in sorted(FOLDER.glob("*.txt"))] + NOTICES


@lru_cache(maxsize=4)
def prepared(licenses: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, list[License]]:
    """The hashes of all words in order, whose places are the words' numbers, and the licenses."""
    words = words_of(arrow.texts(pa.array([text for _, text in licenses], pa.string())), FOLD)
    vocabulary, number = np.unique(words.hashes, return_inverse=True)
    out = []
    for (name, _), a, b in zip(licenses, words.rows[:-1].tolist(), words.rows[1:].tolist()):
        mine = number[a:b]
        has = np.bincount(mine, minlength=len(vocabulary))
        anchor = np.full(len(vocabulary), -1)
        anchor[mine] = np.arange(len(mine))
        anchor[has != 1] = -1
        short = len(mine) < SENTENCE
        if len(mine):
            out.append(License(
                name, mine.tolist(), has, anchor, len(mine) if short else int(np.ceil(COVER * len(mine))),
                len(mine) if short else int(len(mine) / DENSE), [], set(),
            ))
    notices = [one for one in out if SENTENCE <= len(one.words) < NOTICE]
    for one in notices:
        for other in notices:
            if one.name != other.name:
                found = aligned(other.words, one.words, 0, len(other.words), 0, len(one.words))
                lacks = set(range(len(one.words))) - {q for _, q in found}
                if len(found) < one.need:
                    continue
                if lacks:
                    one.marks.append(lacks)
                one.tight.update(q for (p, q), (r, s) in zip(found, found[1:]) if s == q + 1 and r > p + 1)
    return vocabulary, out


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, the one that ends first."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for k, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile < len(tops) and tops[pile] == value:
            continue
        before[k] = at[pile - 1] if pile else -1
        tops[pile:pile + 1], at[pile:pile + 1] = [value], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def aligned(text: list[int], own: list[int], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Pairs of places in ``text[a:b]`` and ``own[c:d]`` by patience: equal words at both ends,
    then words that both have once, then the same between those."""
    out, todo = [], [(a, b, c, d)]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == own[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == own[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(own[c:d]), Counter(text[a:b])
        place = {word: k for k, word in enumerate(own[c:d], c) if mine[word] == 1}
        both = [(k, place[word]) for k, word in enumerate(text[a:b], a) if theirs[word] == 1 and word in place]
        kept = [both[k] for k in rising([q for _, q in both])]
        if kept:
            out += kept
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)])]
    return sorted(out)


def backbone(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Anchors of one occurrence, (place in the text, place in the license). Where a license
    stands twice, the chain that ends first, from its last possible beginning; without
    anchors at its ends that lie too far off."""
    values = q.tolist()
    last = rising(values)[-1]
    chain = [last - k for k in rising([-v for v in values[last::-1]])][::-1]
    pairs = [(int(p[k]), values[k]) for k in chain]
    best, start, total, top = (0, 0), 0, 0.0, 0.0
    for k in range(1, len(pairs)):
        step = pairs[k][0] - pairs[k - 1][0]
        total += min(step, pairs[k][1] - pairs[k - 1][1]) - DENSE * step
        if total < 0:
            start, total = k, 0.0
        elif total > top:
            best, top = (start, k), total
    return pairs[best[0]:best[1] + 1]


def is_told_apart(license: License, found: list[tuple[int, int]]) -> bool:
    """Whether an alignment has what neighbours of the license lack, and nothing where they have more."""
    places = {q: p for p, q in found}
    return all(sum(q in places for q in lacks) >= COVER * len(lacks) for lacks in license.marks) and all(
        q in places and places.get(q + 1) == places[q] + 1 for q in license.tight
    )


def occurrences(text: np.ndarray, license: License) -> list[Found]:
    """Occurrences in a stretch of words, given as numbers, -1 for words of no license. What
    lies beside an occurrence is searched again; so are both sides of an alignment that falls
    short, cut at its beginning."""
    out, todo = [], [(0, len(text))]
    listed, own = text.tolist(), license.words
    while todo:
        a, b = todo.pop()
        part = text[a:b]
        if np.minimum(np.bincount(part[part >= 0], minlength=len(license.has)), license.has).sum() < license.need:
            continue
        place = np.where(part >= 0, license.anchor[part], -1)
        hits = np.flatnonzero(place >= 0)
        if not len(hits):
            continue
        pairs = backbone(hits + a, place[hits])
        (p, q), (r, s) = pairs[0], pairs[-1]
        found = aligned(listed, own, max(a, p - 2 * q), p, 0, q) + pairs
        for (e, f), (g, h) in zip(pairs, pairs[1:]):
            found += aligned(listed, own, e + 1, g, f + 1, h)
        found += aligned(listed, own, r + 1, min(b, r + 1 + 2 * (len(own) - s - 1)), s + 1, len(own))
        begin, end = min(found)[0], max(found)[0] + 1
        if len(found) >= license.need and end - begin <= license.span * len(found) / len(own) and is_told_apart(license, found):
            out.append(Found(license.name, len(found), len(own), begin, end))
            todo += [(a, begin), (end, b)]
        else:
            todo += [(a, p), (p + 1, b)]
    return out


def stretches(inside: np.ndarray, rows: np.ndarray, span: int, need: int) -> list[tuple[int, int]]:
    """Where an occurrence can lie: it has at least ``need`` of the license's words, the first
    of them at its beginning, within ``span`` words of one row. Stretches of more than
    twice that are cut into ones that overlap by that much."""
    count = np.r_[0, np.cumsum(inside)]
    begins = np.flatnonzero(inside)
    enough = count[np.minimum(begins + span, len(inside))] - count[begins] >= need
    begins = begins[enough]
    if not len(begins):
        return []
    ends = np.minimum(begins + span, rows[np.searchsorted(rows, begins, "right")])
    first = np.r_[True, begins[1:] >= ends[:-1]]
    out = []
    for a, b in zip(begins[first].tolist(), ends[np.r_[first[1:], True]].tolist()):
        while b - a > 2 * span:
            out.append((a, a + 2 * span))
            a += span
        out.append((a, b))
    return out


def best_of(found: list[Found]) -> list[Found]:
    """Of occurrences that overlap the one with most words and most of its license; in the
    order of the text. Of equals at one place with different names none counts."""
    begins: list[int] = []  # of the chosen, which do not overlap, in order
    chosen: list[Found] = []
    unsure: set[int] = set()
    for one in sorted(found, key=lambda f: (-f.matched**2 / f.length, f.begin, f.end, f.name)):
        k = bisect_left(begins, one.begin)
        at = next((j for j in (k - 1, k) if 0 <= j < len(chosen) and chosen[j].begin < one.end and one.begin < chosen[j].end), None)
        if at is None:
            begins.insert(k, one.begin)
            chosen.insert(k, one)
        elif one._replace(name=chosen[at].name) == chosen[at] and one.name != chosen[at].name:
            unsure.add(one.begin)
    return [one for one in chosen if one.begin not in unsure]


def scan_rows(column: pa.Array, licenses: tuple[tuple[str, str], ...]) -> list[pa.Array]:
    vocabulary, known = prepared(licenses)
    words = words_of(column, FOLD)
    number = np.minimum(np.searchsorted(vocabulary, words.hashes), max(len(vocabulary) - 1, 0))
    number = np.where(vocabulary[number] == words.hashes, number, -1) if len(vocabulary) else np.full(len(words.hashes), -1)
    found: list[list[Found]] = [[] for _ in range(len(column))]
    there = np.bincount(number[number >= 0], minlength=len(vocabulary))
    for license in known:
        if np.minimum(there, license.has).sum() < license.need:
            continue
        inside = np.r_[license.has > 0, False][number]
        for a, b in stretches(inside, words.rows, license.span, license.need):
            row = int(np.searchsorted(words.rows, a, "right")) - 1
            base = a - int(words.rows[row])
            found[row] += [f._replace(begin=f.begin + base, end=f.end + base) for f in occurrences(number[a:b], license)]
    best = [best_of(f) for f in found]
    ends = np.r_[0, np.cumsum([len(f) for f in best])]
    flat = [f for row in best for f in row]
    return [
        pa.array(np.diff(words.rows), pa.int64()),
        arrow.lists(ends, pa.array([f.name for f in flat], pa.string())),
        arrow.lists(ends, pa.array([f.matched / f.length for f in flat], pa.float64())),
        arrow.lists(ends, pa.array([f.begin for f in flat], pa.int32())),
        arrow.lists(ends, pa.array([f.end for f in flat], pa.int32())),
    ]


def license_scan(
    docs: DataFrame, licenses: list[tuple[str, str]] | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
) -> DataFrame:
    """``keep`` columns and, for every row, ``n_words``, the licenses found in the order of the
    text, their coverage, and where each begins and ends in words. ``licenses``: (name,
    text); several texts may have one name. Texts are scanned whole; null and empty ones have
    no words; repeated rows are scanned each."""
    known = tuple(known_licenses() if licenses is None else licenses)
    fields = [
        StructField("n_words", LongType()), StructField("licenses", ArrayType(StringType())), StructField("coverage", ArrayType(DoubleType())),
        StructField("begins", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())),
    ]
    return arrow.map_texts(docs, [F.col(c) for c in keep], F.col(text), fields, lambda column: scan_rows(column, known))
