"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words, shingles of GRAM words are hashed, and winnowing keeps the smallest
hash of every WINDOW in a row. An inverted index of these names the templates that a text shares
a fingerprint with, and where. The diagonals of such places are chained over stretches of a template's
length; a chain, and then a diagonal, is looked at only if enough of the template's words stand there
in order, which no band can better. From each such place in turn, unless a span that was found holds it,
the template and the text's words are aligned within a band of BAND words, or of the share that may be
missing; what is found splits the text, and both sides are looked at alone, so a notice that follows itself is found each time. A
report has the template's matched words, its coverage and the span in the text.

Templates are a parameter. Those given here are the whole texts in license_texts/, and the notices
and headers by which files and pages name a license (texts of the Creative Commons licenses but CC0
are not among them: their notices are).

The index is as large as the templates given, which are a parameter. It is broadcast in parts of
at most about INDEX_ENTRIES entries; further parts are further looks at the same text in one pass.

Defined results. Words are as in A-Z-lower-cased text, runs of letters, digits and bytes beyond
ASCII. A null or empty text has no report. Templates without words report nothing; one of fewer
than GRAM words is a single shingle of all its words. Reports of one template do not overlap; of
reports of several templates that do, all are given, and best marks those of most matched words,
then greatest coverage, then first name. Of equally good spans the first to end counts, from its last possible start. Rows are kept apart even if doc_id repeats or is null. Long texts are read
whole: winnowing works on any length, and only candidate places are aligned. Other columns pass
through; a column called reports is replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesarr as B
from .common import bounded_batches, table

GRAM, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.8
#: Least share of a span's words that the template matches.
DENSITY = 0.6
#: Index entries up to which the index is broadcast (20 bytes each).
INDEX_ENTRIES = 1_000_000

#: Notices and headers by which texts name their license, in their usual public wording.
NOTICES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
    "either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
    "either version 2.1 of the License, or (at your option) any later version.",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@cache
def default_templates() -> dict[str, str]:
    """Whole license texts, by the names of their files, and notices."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in resources.files("veritab.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    return texts | NOTICES


REPORT = "array<struct<template string, matched int, words int, coverage double, first_word int, last_word int, start long, end long, best boolean>>"


def shingles(words: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of every gram words in a row (all of them, if fewer)."""
    gram = min(gram, len(words))
    if gram == 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - gram + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            out = out * np.uint64(0x100000001B3) + words[k : len(words) - gram + 1 + k]
    return B.mix(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last one of ties) of each window in a row."""
    n = len(hashes)
    if n <= window:
        return np.flatnonzero(hashes == hashes.min())[-1:] if n else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], 1))


def _longest(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int]:
    """The length of the longest common subsequence near the diagonal text = template + shift, and the first place in text where one ends."""
    n, width = len(template), 2 * band + 1
    place = np.arange(shift - band, shift + n + band)
    inside = (place >= 0) & (place < len(text))
    ahead = np.zeros(len(place), np.uint64)
    ahead[inside] = text[place[inside]]
    best = np.zeros(width + 1, np.int32)  # cell d: text up to place row + shift + d - band; beyond the band nothing
    for i, word in enumerate(template):
        # Of the row before, cell d + 1 is the same place and cell d the one before it.
        same = (ahead[i : i + width] == word) & inside[i : i + width]
        best[:width] = np.maximum.accumulate(np.maximum(best[1:], best[:width] + same))
    d = int(np.argmax(best[:width]))
    return int(best[d]), n - 1 + shift + d - band


def aligned(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Most words of template that text matches in order, near the diagonal text = template + shift; first and last place in text.

    A longest common subsequence within the band: of all, those that end first, and of these one that starts last.
    """
    template, text = template.astype(np.uint64), text.astype(np.uint64)
    most, last = _longest(template, text, shift, band)
    if not most:
        return 0, -1, -1
    _, back = _longest(template[::-1], text[: last + 1][::-1], last - len(template) + 1 - shift, band)
    return most, last - back, last


def _places(template: np.ndarray) -> dict[int, int]:
    """For each word of the template its places, as the bits of a whole number."""
    out: dict[int, int] = {}
    for k, word in enumerate(template.tolist()):
        out[word] = out.get(word, 0) | 1 << k
    return out


def _in_order(places: dict[int, int], n: int, part: np.ndarray) -> int:
    """The longest common subsequence of the template (its places, n words) and part, wherever it lies: no band has more.

    A row of the table at a time, in the bits of a whole number: a zero bit is a place at which the length grows.
    """
    full = (1 << n) - 1
    row = full
    for word in part.tolist():
        same = row & places.get(word, 0)
        if same:
            row = (row + same | row - same) & full
    return n - row.bit_count()


def _chains(shifts: list[int], n: int) -> dict[int, tuple[int, int]]:
    """The chain of each diagonal: the first and the last of those that lie within n words; they are judged at once."""
    out, chain = {}, []
    for d in [*sorted(set(shifts)), None]:
        if chain and (d is None or d - chain[0] > n):
            out |= dict.fromkeys(chain, (chain[0], chain[-1]))
            chain = []
        chain.append(d)
    return out


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names, self.words = [], []
        keys, of, at = [], [], []
        for name, text in sorted(templates.items()):
            data = np.frombuffer((text or "").encode(), np.uint8)
            words = B.word_hashes(data, np.array([0, len(data)]))[2]
            if not len(words):
                continue
            hashes = shingles(words, gram)
            places = winnow(hashes, window)
            keys.append(hashes[places])
            at.append(places)
            of.append(np.full(len(places), len(self.names)))
            self.names.append(name)
            self.words.append(words)
        self.short = sorted({min(gram, len(w)) for w in self.words})
        self.keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        self.of, self.at = np.concatenate([np.zeros(0, np.int64), *of]), np.concatenate([np.zeros(0, np.int64), *at])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.of, self.at = self.keys[order], self.of[order], self.at[order]

    def seeds(self, words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template that shares a fingerprint, the places (in the text, in the template), in order.

        Every shingle of the text is looked up, so that a template's fingerprint is found even
        where the text around it would make winnowing choose another.
        """
        out = defaultdict(list)
        for gram in self.short:
            if len(words) < gram or not len(self.keys):
                continue
            hashes = shingles(words, gram)
            low, high = np.searchsorted(self.keys, hashes), np.searchsorted(self.keys, hashes, side="right")
            for place in np.flatnonzero(high > low).tolist():
                for k in range(low[place], high[place]):
                    out[int(self.of[k])].append((place, int(self.at[k])))
        return {t: sorted(own) for t, own in out.items()}


def spans(template: np.ndarray, words: np.ndarray, seeds: list[tuple[int, int]], band: int, coverage: float) -> list[tuple[int, int, int]]:
    """(matched words, first, last) of the places where the template stands, found from seeds that are in order; they do not overlap."""
    n, found, stretches = len(template), [], [(0, len(words) - 1, 0, len(seeds))]
    places = _places(template)
    starts = [place for place, _ in seeds]
    while stretches:
        low, high, s, e = stretches.pop()
        chains, tried, hopeless = _chains([place - at for place, at in seeds[s:e]], n), set(), {}
        for place, at in seeds[s:e]:
            shift = place - at
            if shift in tried:
                continue
            tried.add(shift)
            near, far = chains[shift]
            if near not in hopeless:
                hopeless[near] = _in_order(places, n, words[max(low, near - band) : min(high, far + n - 1 + band) + 1]) < coverage * n
            if hopeless[near]:
                continue
            first, last = max(low, shift - band), min(high, shift + n - 1 + band)
            part = words[first : last + 1]
            if _in_order(places, n, part) < coverage * n:
                continue
            most, a, b = aligned(template, part, shift - first, band)
            if most >= coverage * n and most >= DENSITY * (b - a + 1):
                a, b = a + first, b + first
                found.append((most, a, b))
                stretches += [(low, a - 1, s, bisect.bisect_left(starts, a)), (b + 1, high, bisect.bisect_right(starts, b), e)]
                break
    return sorted(found, key=lambda m: m[1])


def _marked(found: list[dict]) -> list[dict]:
    """Reports with best: whether no better one that is best overlaps them."""
    starts: list[int] = []
    ends: list[int] = []
    for r in sorted(found, key=lambda r: (-r["matched"], -r["coverage"], r["template"], r["first_word"])):
        k = bisect.bisect_right(starts, r["last_word"])
        r["best"] = k == 0 or ends[k - 1] < r["first_word"]
        if r["best"]:
            starts.insert(k, r["first_word"])
            ends.insert(k, r["last_word"])
    return found


def reports(index: Index, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, band: int, coverage: float) -> list[dict]:
    found = []
    for t, seeds in sorted(index.seeds(words).items()):
        n = len(index.words[t])
        wide = max(band, int(np.ceil((1 - coverage) * n)))  # as far as words that are missing may shift it
        found += [
            {"template": index.names[t], "matched": m, "words": n, "coverage": m / n, "first_word": a, "last_word": b, "start": int(starts[a]), "end": int(starts[b] + lengths[b]), "best": False}
            for m, a, b in spans(index.words[t], words, seeds, wide, coverage)
        ]
    return found


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """docs without its text, with reports: template, matched and all words, coverage, first and last word, span in bytes."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("text", "reports")]
    out, parts = docs.select(*[F.col(f"`{c}`") for c in [*kept, "text"]]), [[]]
    for name, text in sorted((default_templates() if templates is None else templates).items()):
        if sum(len(t or "") for _, t in parts[-1]) > 4 * INDEX_ENTRIES:  # four letters a word or more
            parts.append([])
        parts[-1].append((name, text))
    for k, part in enumerate(parts):
        out = _scanned(out, dict(part), kept, k == len(parts) - 1, band, coverage)
    return out


def _scanned(docs: DataFrame, templates: dict[str, str], kept: list[str], last: bool, band: int, coverage: float) -> DataFrame:
    """docs with the reports of some templates after those it has; the text goes with the last ones."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    had, carried = "reports" in docs.columns, kept if last else [*kept, "text"]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField("reports", T._parse_datatype_string(REPORT))])
    kind = pa.list_(pa.struct([("template", pa.string()), ("matched", pa.int32()), ("words", pa.int32()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("best", pa.bool_())]))

    def run(batches):
        index = shared.value
        for b in batches:
            buf, offsets = B.buffers(b.column("text"))
            out = b.column("reports").to_pylist() if had else [[] for _ in range(b.num_rows)]
            for i, j in B.groups_of_texts(offsets, B.STEP):
                cuts = offsets[i : j + 1] - offsets[i]
                starts, lengths, hashes = B.word_hashes(buf[offsets[i] : offsets[j]], cuts)
                bounds = B.per_text(starts, cuts)
                for k in range(j - i):
                    s, e = bounds[k], bounds[k + 1]
                    out[i + k] += reports(index, hashes[s:e], starts[s:e] - cuts[k], lengths[s:e], band, coverage)
            if last:
                out = [_marked(own) for own in out]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], pa.array(out, kind)], names=[*carried, "reports"])

    return docs.mapInArrow(run, schema)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode_outer("reports").alias("n", "r"))
    return found.where("r IS NOT NULL").select("doc_id", F.col("n").cast("int").alias("n"), *[F.col(f"r.{c}").alias(c) for c in ("template", "matched", "words", "coverage", "first_word", "last_word", "start", "end", "best")])
