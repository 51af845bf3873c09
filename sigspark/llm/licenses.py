"""License scan: an exact containment join of text blocks with license templates."""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import as_bytes, record

# Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of the public license texts.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Share of a template's distinct words that a block must contain.
THRESHOLD = 0.8

# A-Z to a-z; every ASCII character that is no letter or digit ends a word; other bytes belong to words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(pa.struct([
        ("line", pa.int64()), ("template", pa.string()), ("containment", pa.float64())]))),
])


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def template_sets(templates: dict[str, list[str]] | None = None) -> list[tuple[str, frozenset]]:
    return [(label, frozenset(folded_words(t.encode()))) for label, ts in (templates or TEMPLATES).items() for t in ts]


def needed(size: int, threshold: float) -> int:
    """The smallest overlap with a template of so many words that reaches the threshold."""
    k = max(1, int(size * threshold))
    while k > 1 and (k - 1) / size >= threshold:
        k -= 1
    while k / size < threshold:
        k += 1
    return k


class TemplateIndex:
    """Templates with their words in the global order, rarest first, and lists of those words that may open a match."""

    def __init__(self, sets: list[tuple[str, frozenset]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        vocabulary = sorted(set().union(*(s for _, s in sets)), key=lambda w: (frequency.get(w, 0), w)) if sets else []
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in sets]
        self.words = [sorted(self.rank[w] for w in s) for _, s in sets]
        self.least = [needed(len(s), threshold) for _, s in sets]
        self.opening = defaultdict(list)
        for t, (ws, k) in enumerate(zip(self.words, self.least)):
            for place, r in enumerate(ws[: len(ws) - k + 1]):
                self.opening[r].append((t, place))
        self.openers = {w for w, r in self.rank.items() if r in self.opening}

    def matches(self, block: set) -> list[tuple[int, float]]:
        """Templates that the block contains to the threshold, with their containment."""
        if self.openers.isdisjoint(block):
            return []
        own = sorted(self.rank[w] for w in block if w in self.rank)
        found, seen = [], set()
        for i, r in enumerate(own):
            for t, place in self.opening.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)
                ws, k = self.words[t], self.least[t]
                if len(own) < k:  # length
                    continue
                # Position: this is the first common word, so both sides can only add what comes behind.
                if 1 + min(len(own) - i - 1, len(ws) - place - 1) < k:
                    continue
                common = 0
                for x in own[i:]:
                    j = bisect_left(ws, x, place)
                    common += j < len(ws) and ws[j] == x
                if common >= k:
                    found.append((t, common / len(ws)))
        return found


def word_frequencies(docs: DataFrame, sets) -> dict[bytes, int]:
    """In how many documents each word of the templates stands; one number for each word of the fixed templates."""
    vocabulary = frozenset().union(*(s for _, s in sets))
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for batch in batches:
            for text in as_bytes(batch, "text"):
                n.update(vocabulary.intersection(folded_words(text)))
        yield record(schema, list(n), list(n.values()))

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def _places(words: list[bytes]) -> list[tuple[int, str]]:
    """Starts of the phrases."""
    out = []
    for phrase, label in PHRASES.items():
        ws = phrase.encode().split()
        at = -1
        for _ in range(words.count(ws[0])):
            at = words.index(ws[0], at + 1)
            if words[at : at + len(ws)] == ws:
                out.append((at, label))
    return out


def _windows(words: list[bytes], wanted: set, length: int, least: int) -> list[tuple[int, int, int]]:
    """(first word, last word, distinct words of the template) of windows that hold enough; the best of those that overlap.

    A window has at most ``length`` words and starts anywhere in the text.
    """
    spots = [i for i, w in enumerate(words) if w in wanted]
    held, left, out = Counter(), 0, []
    for i in spots:
        held[words[i]] += 1
        while i - spots[left] >= length or held[words[spots[left]]] > 1:  # a later copy of the first word stands for it
            w = words[spots[left]]
            held[w] -= 1
            if not held[w]:
                del held[w]
            left += 1
        if len(held) >= least:
            hit = (spots[left], i, len(held))
            if not out or hit[0] > out[-1][1]:
                out.append(hit)
            elif hit[2] > out[-1][2]:
                out[-1] = hit
    return out


def find_blocks(text: bytes, words: list[bytes], index: TemplateIndex, lengths: list[int]) -> list[tuple[int, int, float]]:
    """(line, template, containment) of lines, word windows and paragraphs that hold a template, by line.

    A window is as long as the template and may cross lines, so wrapping loses
    nothing. A window counts where no line holds as much, a paragraph where neither does.
    """
    # What a block holds, the whole text holds too.
    possible = index.matches(set(words))
    if not possible:
        return []
    lines = [folded_words(line) for line in text.split(b"\n")]
    hits = [(n, n, t, c) for n, ws in enumerate(lines) for t, c in index.matches(set(ws))]
    ends = list(accumulate(map(len, lines)))
    vocabulary = {r: w for w, r in index.rank.items()}

    def add(first: int, last: int, t: int, c: float) -> None:
        if not any(u == t and a <= last and first <= b and c <= d for a, b, u, d in hits):
            hits.append((first, last, t, c))

    for t, _ in possible:
        wanted = {vocabulary[r] for r in index.words[t]}
        for first, last, n in _windows(words, wanted, lengths[t], index.least[t]):
            add(bisect_right(ends, first), bisect_right(ends, last), t, n / len(wanted))
    n = 0
    for filled, group in groupby(lines, bool):
        size = sum(1 for _ in group)
        if filled and size > 1:
            for t, c in index.matches(set().union(*lines[n : n + size])):
                add(n, n + size - 1, t, c)
        n += size
    return [(first, t, c) for first, _, t, c in sorted(hits, key=lambda h: h[0])]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Phrases and template blocks of every whole text.

    Needs ``doc_id`` and ``text``. A block is a line, a paragraph, or a window
    of as many words as the template has, anywhere in the text; ``blocks`` lists
    number of the first line, label and containment of every block that holds a
    template to the threshold, ``score`` is the best containment, 1 where a phrase stands and 0
    without any finding. Null and empty texts have no words and no findings.
    Repeated rows are scanned each; an empty table gives no rows.
    """
    sets = template_sets(templates)
    index = TemplateIndex(sets, word_frequencies(docs, sets), threshold)
    lengths = [len(folded_words(t.encode())) for ts in (templates or TEMPLATES).values() for t in ts]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[] for _ in SCHEMA]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text")):
                words = folded_words(text)
                places = _places(words) if b"license" in words else []
                blocks = find_blocks(text, words, index, lengths)
                base = {label for _, label in places}
                every = base | {index.labels[t] for _, t, _ in blocks}
                starts = [at for at, _ in places]
                row = (
                    doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(every)), 1.0 if base else max((c for *_, c in blocks), default=0.0),
                    [{"line": n, "template": index.labels[t], "containment": c} for n, t, c in blocks],
                )
                for c, x in zip(cols, row):
                    c.append(x)
            yield record(SCHEMA, *cols)

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<line: long, template: string, containment: double>>"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
