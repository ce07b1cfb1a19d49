"""Licence statements in documents by patience alignment with templates.

A region of a text is a candidate for a template where a stretch of
``STRETCH`` times the template's length holds enough of the template's words.
Text and template are then aligned: words that occur once in both are anchors,
the longest increasing run of anchors is kept, and the gaps between them are
aligned the same way.  Coverage is the share of template words that were
aligned; where it reaches ``COVERAGE`` the region is reported.

Words are compared in lower case without marks at their ends.  Nulls, empties,
ties: a null or empty text or template matches nothing; a template that occurs
several times is reported each time; templates that cover the same region are
all reported; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, unchunked, words_of

STRETCH = 1.5
COVERAGE = 0.8
_EDGE = b".,;:!?\"'()[]{}<>*#/-"
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")

# Wording of public licence statements and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
    "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def word_key(word: bytes) -> bytes:
    return word.strip(_EDGE) or word


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run, by piles."""
    tops, places, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(places[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[k], places[k] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(template[c:d], c) if right[w] == 1}
        pairs = [(i, at[w]) for i, w in enumerate(text[a:b], a) if left[w] == 1 and w in at]
        anchors = [pairs[k] for k in increasing([j for _, j in pairs])]
        for (i, j), (p, q) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if anchors:
                todo.append((i + 1, p, j + 1, q))
        out += anchors
    return sorted(out)


def upper_bounds(text: list, template: list, reach: int) -> list[int]:
    """For each place, how many of the template's words (repeats included) the ``reach`` words from there on hold."""
    want, have, n, out = Counter(template), Counter(), 0, []
    for i in range(len(text) + reach):
        if i >= reach:
            out.append(n)
            w = text[i - reach]
            n -= 0 < have[w] <= want[w]
            have[w] -= 1
        if i < len(text):
            w = text[i]
            have[w] += 1
            n += have[w] <= want[w]
    return out


def regions(text: list, template: list) -> list[tuple[int, int, int]]:
    """(first, last, aligned) of the template's places in a stretch of words, from left to right.

    Every place is tried as the start.  The leftmost region that reaches the
    coverage is reported, unless a later start aligns more words with the same
    text: then the first is cut off before it, or dropped if too little is left.
    """
    need, reach, known = COVERAGE * len(template), int(STRETCH * len(template)) + 1, set(template)
    most = upper_bounds(text, template, reach)

    def at(lo: int, hi: int) -> tuple[int, int, int] | None:
        found = patience(text[lo:hi], template)
        return (lo + found[0][0], lo + found[-1][0], len(found)) if len(found) >= need else None

    out, best, lo = [], None, 0
    while lo < len(text):
        if best and lo > best[1]:
            out.append(best)
            best = None
        if text[lo] in known and most[lo] >= need and (best is None or most[lo] > best[2]):
            new = at(lo, lo + reach)
            if new and (best is None or new[2] > best[2]):
                if best and new[0] > best[0]:
                    left = at(best[0], new[0])
                    out += [left] if left else []
                best = new
                lo = max(lo, best[0] - 1)  # next, with the whole template in view
                if best[2] == len(template) == best[1] - best[0] + 1:  # nothing can be better
                    lo = best[1]
        lo += 1
    return out + ([best] if best else [])


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, start, end (code points, end exclusive), coverage, n_words for every region."""
    templates = TEMPLATES if templates is None else templates
    keys = {n: [word_key(w) for w in t.lower().encode().split()] for n, t in templates.items()}
    keys = {n: k for n, k in keys.items() if k}
    vocabulary = {w: i for i, w in enumerate(sorted({w for k in keys.values() for w in k}))}
    member = {n: np.isin(np.arange(len(vocabulary) + 1), [vocabulary[w] for w in k]) for n, k in keys.items()}

    def found_in(part: pa.Array, base: int):
        codes, words, offsets = words_of(part)
        none = len(vocabulary)
        ids = np.array([vocabulary.get(word_key(w), none) for w in words], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        for name, key in keys.items():
            hit = np.concatenate(([0], np.cumsum(member[name][ids])))
            reach, need = int(STRETCH * len(key)) + 1, int(np.ceil(COVERAGE * len(key)))
            n = len(ids)
            end = np.minimum(np.arange(n) + reach, n)
            start = np.flatnonzero(hit[end] - hit[:-1] >= need) if n else []
            if not len(start):
                continue
            cut = np.flatnonzero(np.diff(start) > 1)
            target = [vocabulary[w] for w in key]
            for lo, hi in zip(start[np.concatenate(([0], cut + 1))], np.append(start[cut], start[-1])):
                hi = int(end[hi])
                row = int(np.searchsorted(offsets, lo, side="right")) - 1
                last = int(np.searchsorted(offsets, hi - 1, side="right")) - 1
                for r in range(row, last + 1):  # a run may pass from one text to the next
                    a, b = max(int(lo), int(offsets[r])), min(hi, int(offsets[r + 1]))
                    for first, final, n_words in regions(ids[a:b].tolist(), target) if b > a else []:
                        yield base + r, name, a + first - int(offsets[r]), a + final - int(offsets[r]), n_words, len(key)

    def run(batches):
        for batch in batches:
            texts, doc = texts_of(batch), unchunked(batch.column(0))
            rows, place = [], {}
            for lo, hi in slices(texts):
                rows += found_in(texts.slice(lo, hi - lo), lo)
            if not rows:
                continue
            for r in {r[0] for r in rows}:
                place[r] = [m.span() for m in _WORD.finditer(texts[r].as_py())]
            row, name, first, final, n, m = zip(*sorted(rows))
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(row)), pa.array(name, pa.string()), pa.array([place[r][i][0] for r, i in zip(row, first)], pa.int64()),
                 pa.array([place[r][i][1] for r, i in zip(row, final)], pa.int64()), pa.array([x / y for x, y in zip(n, m)], pa.float64()),
                 pa.array(n, pa.int64())], names=["doc_id", "license", "start", "end", "coverage", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, start long, end long, coverage double, n_words long")
