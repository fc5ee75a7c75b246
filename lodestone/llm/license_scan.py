"""License scans: Dice coefficient of word bigrams between normalised text and license templates.

Text is folded to lower-case letters and digits. A segment is a run of words whose
first and last bigrams belong to a template; its score is 2 |A and B| / (|A| + |B|)
over distinct bigrams. Since a score of t needs between |B| t / (2 - t) and
|B| (2 - t) / t bigrams, templates of which a text holds fewer bigrams are dropped
and segments never grow past the upper bound, nor past SPAN times the template's words.

Templates are one-line notices and the whole texts in the folder licenses, which are the
licenses' own public texts. They are read on the driver and travel with the tasks.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table
from .hashing import mix, word_hashes

THRESHOLD = 0.8
#: Words of a segment at most, as a multiple of its template's.
SPAN = 8
#: SPDX id -> notices that declare it; whole texts join them from files.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This file is licensed to you under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License version 3 or later."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License version 2 or later."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the three clause BSD license."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the two clause BSD license."],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def bigrams(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Hashes of the word pairs of each normalised text in order; fewer than two words have none."""
    for words in word_hashes([(t or b"").translate(_FOLD) for t in texts], fold=False):
        yield mix(words[:-1] * np.uint64(3) + words[1:])


@cache
def whole_texts() -> dict[str, str]:
    """SPDX id -> the license's text."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


class Templates:
    """Bigram sets of templates in order of their ids, and which of them holds a bigram."""

    def __init__(self, named: list[tuple[str, np.ndarray]], threshold: float):
        named = [(name, grams) for name, grams in named if len(grams)]
        self.names, self.threshold = [name for name, _ in named], threshold
        self.sets = [np.unique(g) for _, g in named]
        self.sizes = np.array([len(x) for x in self.sets])
        self.spans = [SPAN * len(g) for _, g in named]
        self.least = self.sizes * threshold / (2 - threshold) - 1e-9
        self.most = self.sizes * (2 - threshold) / threshold + 1e-9
        every = np.concatenate(self.sets) if named else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(named)), self.sizes) if named else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.every, self.first = np.unique(every[order], return_index=True)
        self.until = np.append(self.first[1:], len(every))

    def likely(self, grams: np.ndarray) -> list[int]:
        """The templates of which a text holds enough distinct bigrams."""
        if not len(self.every) or not len(grams):
            return []
        held = np.unique(grams)
        low = np.minimum(np.searchsorted(self.every, held), len(self.every) - 1)
        low = low[self.every[low] == held]
        counts = np.zeros(len(self.names), np.int64)
        for a, b in zip(self.first[low].tolist(), self.until[low].tolist(), strict=True):
            counts[self.owner[a:b]] += 1
        return np.flatnonzero((counts >= self.least) & (counts > 0)).tolist()


def segments(grams: np.ndarray, templates: Templates) -> list[tuple[float, str, int, int]]:
    """(score, id, first, last bigram) of the segments at or above the threshold, of which none overlap, best first.

    Of overlapping segments of all templates the best counts, ties to the first id, then the leftmost and shortest.
    Each start keeps its best end; where a better segment takes that end, the start is tried again up to it.
    """
    chosen = templates.likely(grams)
    if not chosen:
        return []
    n, order = len(grams), np.argsort(grams, kind="stable")
    before = np.full(n, -1)  # where the same bigram stood last
    same = grams[order[1:]] == grams[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    wanted = {t: np.isin(grams, templates.sets[t]) for t in chosen}

    def best(t: int, s: int, limit: int) -> tuple[float, str, int, int, int] | None:
        end = min(limit, s + templates.spans[t])
        new = before[s:end] < s
        size = np.cumsum(new)
        good = new & wanted[t][s:end]
        both = np.cumsum(good)
        at = np.flatnonzero(good & (size <= templates.most[t]))
        score = 2 * both[at] / (size[at] + templates.sizes[t])
        if not len(at) or (top := float(score.max())) < templates.threshold or top <= 0:
            return None
        return -top, templates.names[t], s, s + int(at[score.argmax()]), t

    heap = [x for t in chosen for s in np.flatnonzero(wanted[t]).tolist() if (x := best(t, s, n))]
    heapq.heapify(heap)
    kept, firsts, lasts = [], [], []
    while heap:
        score, name, s, e, t = heapq.heappop(heap)
        at = bisect_left(firsts, s)
        if (at and lasts[at - 1] >= s) or (at < len(firsts) and firsts[at] == s):
            continue
        if at < len(firsts) and firsts[at] <= e:
            if x := best(t, s, firsts[at]):
                heapq.heappush(heap, x)
            continue
        firsts.insert(at, s)
        lasts.insert(at, e)
        kept.append((-score, name, s, e))
    return kept


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licenses, license, dice, start_word and end_word (exclusive) for every row of docs.

    licenses lists the ids found, sorted and comma-joined, where of overlapping segments of all templates the best counts; license, dice and the
    words (of the normalised text) are those of the best, ties to the first id.
    Null, empty or clean texts have '' and 0. Equal rows give equal rows.
    """
    texts = templates or {name: [*TEMPLATES.get(name, []), *([whole_texts()[name]] if name in whole_texts() else [])] for name in {*TEMPLATES, *whole_texts()}}
    known = [(name, t.encode()) for name, all_ in sorted(texts.items()) for t in all_]
    sets = Templates([(name, g) for (name, _), g in zip(known, bigrams([t for _, t in known]), strict=True)], threshold)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grams in bigrams(batch.column("_text").to_pylist()):
                kept = segments(grams, sets)
                score, best, s, e = kept[0] if kept else (0.0, "", 0, -2)
                rows.append((",".join(sorted({name for _, name, _, _ in kept})), best, score, s, e + 2))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "licenses", "license", "dice", "start_word", "end_word"])

    kept = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, licenses string, license string, dice double, start_word long, end_word long")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses of every whole document."""
    return scan(read_table(spark, sf_dir, "documents"))
