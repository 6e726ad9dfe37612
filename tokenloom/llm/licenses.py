"""License scans by patience alignment.

Texts and templates are compared as words in lower case without punctuation at their ends.  In
every window of twice a template's length that can hold enough of its words, the words unique to both
sides anchor the alignment, the longest increasing run of them is taken, and the gaps are aligned the same
way; equal words at both ends of a gap are matched first.  Coverage is the share of the template's words that is matched.

Windows start at every word a template has.  The place with the most matched words counts first (of equal ones
the shortest, then the one whose window starts first); then the next best in what is left before and after it,
with windows that end where a found place starts.

Skipped without alignment are only windows and texts that lack so many of a template's words
that the coverage asked for cannot be reached.

Defined results: null and empty texts have no licence; of licences with equal coverage the longer
template, then the first by name, is the best; rows may repeat; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect, bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COVERAGE = 0.8

# Public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction"
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "reserved": "All rights reserved.",
}

_ENDS = ".,;:!?()[]{}<>\"'`*#"
_FOUND = "license string, coverage double, matched int, first_word int, last_word int"


def normal_words(text: str) -> list[str]:
    return [w for w in (raw.strip(_ENDS) for raw in text.lower().split()) if w]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (sorted by the first) that increases in the second too."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[at], piles[at] = y, k
    run, k = [], piles[-1] if piles else -1
    while k >= 0:
        run.append(pairs[k])
        k = back[k]
    return run[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b``, in order."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
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
        unique = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = _increasing(unique)
        if not anchors:
            continue
        ends = [*anchors, (a1, b1)]
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], ends, strict=True):
            gaps.append((i + 1, k, j + 1, m))
        out += anchors
    return sorted(out)


def _windows(vocab: Counter, width: int, need: int, words: list[str]) -> list[tuple[int, int]]:
    """``(start, words it may match)`` of the windows that can hold enough."""
    hits = [i for i, w in enumerate(words) if w in vocab]
    inside: Counter = Counter()
    out, have, upto = [], 0, 0
    for k, start in enumerate(hits):
        if k:
            gone = words[hits[k - 1]]
            inside[gone] -= 1
            have -= inside[gone] < vocab[gone]
        while upto < len(hits) and hits[upto] < start + width:
            come = words[hits[upto]]
            have += inside[come] < vocab[come]
            inside[come] += 1
            upto += 1
        if have >= need:
            out.append((start, have))
    return out


def _places(template: list[str], vocab: Counter, need: int, words: list[str]) -> list[tuple[int, int, int]]:
    """``(first, last, matched)`` of the places that hold the template, the best of those that overlap."""
    width = 2 * len(template)
    stops = {}
    # Best first: what a window may match stands in until it is aligned.
    queue: list[tuple] = []
    for start, have in _windows(vocab, width, need, words):
        stops[start] = start + width
        queue.append((-have, have - 1, start, start + width, None))
    starts = list(stops)
    heapify(queue)
    taken: list[tuple[int, int, int]] = []
    while queue:
        _, _, start, stop, place = heappop(queue)
        if stops[start] != stop:
            continue
        if place is None:
            pairs = align(template, words[start:stop])
            if len(pairs) >= need:
                first, last = start + pairs[0][1], start + pairs[-1][1]
                heappush(queue, (-len(pairs), last - first, start, stop, (first, last, len(pairs))))
            continue
        taken.append(place)
        first, last, _ = place
        for k in range(bisect(starts, first - width), bisect(starts, last)):
            near = starts[k]
            if near >= first:
                stops[near] = near
            elif stops[near] > first:
                stops[near] = first
                have = sum((Counter(words[near:first]) & vocab).values()) if first - near >= need else 0
                if have >= need:
                    heappush(queue, (-have, have - 1, near, first, None))
    taken.sort()
    return taken


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float) -> None:
        self.templates = []
        for name, text in sorted(templates.items()):
            words = normal_words(text)
            need = -(-int(round(min_coverage * 1000)) * len(words) // 1000)
            # Long words first: they are the ones most texts lack.
            self.templates.append((name, words, Counter(words), need, sorted(set(words), key=len, reverse=True)))

    def found(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """``(license, coverage, matched, first, last)`` of each place that holds a template."""
        lowered = text.lower()
        words: list[str] | None = None
        out = []
        for name, template, vocab, need, spelled in self.templates:
            may_lack = len(template) - need
            for w in spelled:
                if w not in lowered:
                    may_lack -= vocab[w]
                    if may_lack < 0:
                        break
            if may_lack < 0:
                continue
            if words is None:
                words = normal_words(text)
            for first, last, n in _places(template, vocab, need, words):
                out.append((name, n / len(template), n, first, last))
        return out


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """``(id, licenses)``: per row of ``docs`` an array of all places found."""
    scanner = Scanner(templates or TEMPLATES, min_coverage)

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':') for c in _FOUND.split(', '))}>>")
    def scan(texts: pd.Series) -> pd.Series:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pd.Series(
            [
                [dict(zip(names, f, strict=True)) for f in scanner.found(t)] if t else []
                for t in texts
            ],
            dtype=object,
        )

    return docs.select(F.col(id_col), scan(F.col(text_col)).alias("licenses"))


def best_license(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """``(id, license, coverage, matched, first_word, last_word, n_found)``; nulls without any."""
    found = scan_licenses(docs, id_col, text_col, templates, min_coverage)
    # Most coverage, then most words, then the name that sorts first.
    ranked = F.sort_array(
        F.transform(
            "licenses",
            lambda x: F.struct(
                (-x["coverage"]).alias("c"), (-x["matched"]).alias("m"), x["license"].alias("l"),
                x["first_word"].alias("f"), x["last_word"].alias("t"),
            ),
        )
    )
    best = F.get(ranked, 0)
    return found.select(id_col, F.size("licenses").alias("n_found"), best.alias("b")).select(
        id_col,
        F.col("b.l").alias("license"),
        (-F.col("b.c")).alias("coverage"),
        (-F.col("b.m")).alias("matched"),
        F.col("b.f").alias("first_word"),
        F.col("b.t").alias("last_word"),
        "n_found",
    )
