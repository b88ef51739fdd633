"""License scans by winnowed fingerprints and banded alignment (operator 7).

Words of templates and texts are compared without case and punctuation. Of the hashes of all
runs of ``GRAM`` words, winnowing keeps the smallest in each window of ``WINDOW``; a run of
``GRAM + WINDOW - 1`` shared words leaves a common fingerprint. The templates' fingerprints are
an inverted index of bounded size that goes to every task. Fingerprints of a text that the index
knows say where a template may begin; there the text is aligned with the template in a narrow
band, and what is covered to ``COVERAGE`` is reported with its span.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from punctuality.llm.texts import WordHashes, map_rows

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 6, 0.8
SCHEMA = "doc_id long, license string, coverage double, matched_words int, start_word long, end_word long, start_byte long, end_byte long"
#: Public notices that name or grant a license: fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC0-1.0": ("The person who associated a work with this deed has dedicated the work to the public domain",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: ASCII letters in lower case; other ASCII signs are gaps between words.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^\x20]+")


def plain(text: str | None) -> bytes:
    """Text as bytes of the same length, with the separators of words as spaces."""
    return (text or "").encode("utf-8", "replace").translate(_PLAIN)


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash (the last of equal ones) of each window."""
    if not len(grams):
        return np.empty(0, np.int64)
    if len(grams) < window:
        return np.array([len(grams) - 1 - int(grams[::-1].argmin())])
    seen = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    at = np.arange(len(seen)) + window - 1 - seen.argmin(axis=1)
    return at[np.r_[True, at[1:] != at[:-1]]]


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray  # sorted fingerprints
    where: list[list[tuple[int, int]]]  # per key: template, position


def index(hashes: WordHashes, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Index:
    names, words, found = [], [], {}
    for name, texts in templates.items():
        for text in texts:
            own = hashes.of_plain(plain(text))
            grams = hashes.windows(own, min(GRAM, len(own)))
            for at in winnow(grams).tolist():
                found.setdefault(int(grams[at]), []).append((len(names), at))
            names.append(name)
            words.append(own)
    keys = np.array(sorted(found), np.uint64)
    return Index(names, words, keys, [found[int(k)] for k in keys])


def align(template: np.ndarray, text: np.ndarray, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, start, end) of the best alignment of ``template`` within ``text``.

    ``text`` begins ``band`` words before the place where the template is expected; only cells
    within ``band`` of that diagonal are filled. Of equal scores the shortest span wins.
    """
    width = 2 * band + 1
    # Cell d of row i stands for text position i + d; values: (matches, -skips, start).
    row = [(0, 0, d) for d in range(width)]
    best = (0, 0, 0, 0)
    for i, word in enumerate(template.tolist()):
        new: list[tuple[int, int, int]] = []
        for d in range(width):
            j = i + d
            matches, skips, start = row[d]
            take = (matches + 1, skips, start if matches else j) if j < len(text) and int(text[j]) == word else (matches, skips - 1, start)
            if d + 1 < width:
                m, s, b = row[d + 1]
                take = max(take, (m, s - 1, b))
            if d:
                m, s, b = new[d - 1]
                take = max(take, (m, s - 1, b))
            new.append(take)
            if take[0] > best[0]:
                best = (take[0], take[1], take[2], j + 1)
        row = new
    return best[0], best[2], best[3]


def scan(raw: bytes, hashes: WordHashes, known: Index, coverage: float = COVERAGE) -> list[tuple]:
    """(license, coverage, matched, start word, end word) of the templates in a text."""
    own = hashes.of_plain(raw)
    if len(own) < GRAM:
        return []
    grams = hashes.windows(own, GRAM)
    at = winnow(grams)
    prints = grams[at]
    slot = np.minimum(np.searchsorted(known.keys, prints), len(known.keys) - 1)
    hit = known.keys[slot] == prints
    places = sorted({(t, int(p) - q) for p, s in zip(at[hit], slot[hit], strict=True) for t, q in known.where[s]})
    found, last = [], (-1, 0)
    # Room on the left: a notice at the head of a text may have lost words. 0 is no word's hash there.
    room = BAND + max(map(len, known.words), default=0)
    padded = np.r_[np.zeros(room, np.uint64), own]
    for t, begin in places:
        if last[0] == t and begin - last[1] <= BAND // 2:
            continue  # the band of the place before covers it
        last = (t, begin)
        template = known.words[t]
        low = begin - BAND
        matched, start, end = align(template, padded[low + room : begin + len(template) + BAND + 1 + room])
        if matched >= coverage * len(template):
            found.append((matched, known.names[t], matched / len(template), low + start, low + end))
    # Longest first; a place belongs to one template.
    taken, out = [], []
    for matched, name, share, start, end in sorted(found, key=lambda x: (-x[0], -x[2], x[1], x[3])):
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            out.append((name, share, matched, start, end))
    return sorted(out, key=lambda x: x[3])


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per license notice found in a text, with matched coverage and its span.

    Words are counted from 0 after case and punctuation are taken out, bytes in the UTF-8 text;
    ends are exclusive. Texts without a notice, null and empty ones give no row; repeated rows
    give theirs each. Extra columns are ignored.
    """

    def start():
        hashes = WordHashes()
        known = index(hashes, templates)

        def each(doc_id, text):
            raw = plain(text)
            found = scan(raw, hashes, known, coverage)
            if not found:
                return
            spans = [m.span() for m in _WORD.finditer(raw)]
            for name, share, matched, first, last in found:
                yield doc_id, name, share, matched, first, last, spans[first][0], spans[last - 1][1]

        return each

    return map_rows(docs.select("doc_id", "text"), start, SCHEMA)
