"""License scans by patience alignment of texts with notice templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Part of a template's words that a passage must align with.
COVERAGE = 0.8
#: Words between two of a template's telling words that still belong to one passage, beside half the template's length.
GAP = 6

#: Notices of common licenses. Fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."],
}
#: Words that say nothing about a place in a text. Fixed values.
_COMMON = frozenset("a an the of to in and or is are be this that it you may not any by at for with use as can".split())

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str], a_at: int = 0, b_at: int = 0) -> list[tuple[int, int]]:
    """Patience alignment: pairs of positions of equal words, increasing in both.

    Words that are unique in both sides anchor; the longest increasing
    subsequence of their positions stays, and the gaps between anchors are
    aligned in the same way. Equal words at a gap's two ends need no anchor.
    """
    head: list[tuple[int, int]] = []
    while a and b and a[0] == b[0]:
        head.append((a_at, b_at))
        a, b, a_at, b_at = a[1:], b[1:], a_at + 1, b_at + 1
    tail: list[tuple[int, int]] = []
    while a and b and a[-1] == b[-1]:
        tail.append((a_at + len(a) - 1, b_at + len(b) - 1))
        a, b = a[:-1], b[:-1]
    if a and b:
        many, other = Counter(a), Counter(b)
        place = {w: i for i, w in enumerate(b) if other[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a) if many[w] == 1 and w in place]
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        if anchors:
            x = y = 0
            for i, j in [*anchors, (len(a), len(b))]:
                head += align(a[x:i], b[y:j], a_at + x, b_at + y)
                if i < len(a):
                    head.append((a_at + i, b_at + j))
                x, y = i + 1, j + 1
    return head + tail[::-1]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], coverage: float) -> None:
        self.coverage = coverage
        self.known = [(name, words(text)) for name, texts in templates.items() for text in texts]
        self.telling = [set(t) - _COMMON for _, t in self.known]
        self.where: dict[str, list[int]] = {}
        for k, told in enumerate(self.telling):
            for w in told:
                self.where.setdefault(w, []).append(k)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first word, last word, coverage) of each passage that aligns, the best where passages overlap."""
        own = words(text)
        at: dict[int, list[int]] = {}
        for i, w in enumerate(own):
            for k in self.where.get(w, ()):
                at.setdefault(k, []).append(i)
        found = []
        for k, places in at.items():
            name, template = self.known[k]
            reach, begin = GAP + len(template) // 2, 0
            for i in range(1, len(places) + 1):
                if i < len(places) and places[i] - places[i - 1] <= reach:
                    continue
                cluster, begin = places[begin:i], i
                if len({own[p] for p in cluster}) < len(self.telling[k]) - int((1 - self.coverage) * len(template) + 1e-9):  # more are missing than may be
                    continue
                low, high = max(0, cluster[0] - reach), min(len(own), cluster[-1] + reach + 1)
                found += [(name, *hit) for hit in self.passages(own, low, high, template, cluster)]
        best: list[tuple[str, int, int, float]] = []
        begins: list[int] = []  # those of best, in order, as best is
        for hit in sorted(found, key=lambda h: (-h[4], -h[3], h[2] - h[1], h[1], h[0])):  # most words aligned first, of equals the tightest
            at = bisect_left(begins, hit[1])
            if (at == 0 or best[at - 1][2] < hit[1]) and (at == len(best) or hit[2] < best[at][1]):
                best.insert(at, hit[:4])
                begins.insert(at, hit[1])
        return best

    def passages(self, own: list[str], low: int, high: int, template: list[str], cluster: list[int]) -> Iterator[tuple[int, int, float, int]]:
        """Passages of own[low:high] that align; repeats of a template leave it without anchors, so pieces are tried too: of its length, and from where its telling words start again to the next such place."""
        size = len(template)
        if high - low <= 3 * size + 2 * GAP:
            pieces = [(low, high)]
        else:
            step = max(1, size // 2)
            pieces = [(p, min(high, p + 2 * size)) for p in range(low, high, step)]
        many, own_many, starts = Counter(template), Counter(), []
        for at in cluster:
            own_many[own[at]] += 1
            if own_many[own[at]] > many[own[at]]:  # one more than a copy has: the next copy
                starts.append(max(low, at - template.index(own[at])))
                own_many = Counter(own[starts[-1] : at + 1])
        if starts:
            pieces += list(zip([low, *starts], [*starts, high]))
        seen = set()
        for p, q in pieces:
            pairs = align(own[p:q], template, p)
            if len(pairs) >= self.coverage * size and (pairs[0][0], pairs[-1][0]) not in seen and pairs[-1][0] - pairs[0][0] < 2 * size + GAP:
                seen.add((pairs[0][0], pairs[-1][0]))
                yield pairs[0][0], pairs[-1][0], len(pairs) / size, len(pairs)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, license (of the passage with the largest coverage; null without one), coverage, licenses (names in order), passages.

    A passage is a run of words of which at least `coverage` of a template's
    words align in patience order. Texts are scanned whole, in one pass that
    looks for templates' telling words; only places with enough of them are
    aligned. No rows are moved.

    Null and empty texts have no passages. Null doc_ids and repeated rows are
    rows like any other. Of equal coverages the earlier passage counts. An
    empty table gives no rows. Columns other than doc_id and text aren't
    looked at.
    """
    scanner = Scanner(templates or TEMPLATES, coverage)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for text in part["text"]:
                hits = scanner.scan(text)
                top = max(hits, key=lambda h: h[3], default=None)
                out.append((top and top[0], top[3] if top else 0.0, sorted({h[0] for h in hits}), [{"license": n, "first": a, "last": b, "coverage": c} for n, a, b, c in hits]))
            made = pd.DataFrame(out, columns=["license", "coverage", "licenses", "passages"])
            made.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield made

    schema = "doc_id long, license string, coverage double, licenses array<string>, passages array<struct<license:string,first:int,last:int,coverage:double>>"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
