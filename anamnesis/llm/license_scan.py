"""License scans as an exact containment join of text blocks with templates.

A block is a line of a text, or with ``over_lines`` also any run of words over line
ends as long as a template; a template is a short notice; both are sets of words.
A word weighs by its rarity: the logarithm of one and how many documents there are
for each that holds it. A block matches if it holds at least ``CONTAINED`` of a
template's weight, so that a notice without the license's name does not. The words
of the templates are ordered by weight, heaviest first. With r of a template's t
required, one of the first words that weigh more than t - r together must be in the
block (prefix); the block's words of the templates' vocabulary must weigh at least r
(length); and from the first common word on, both must have r left (position). What
passes is weighed exactly. Of a block's matches, one whose words are all among those
of a better one (more of its template, or more words) gives no label: a notice that
names a variant is that variant's. Phrases whose words stand consecutively are the
base.

A wrapped notice may stand behind comment marks and over blank lines: line ends
count as blanks there. A run is as long as its template with its repetitions, and
slides over the text as one count a template, of which only the words of the
template's vocabulary are touched.

Defined cases: null or empty text has no words and no labels; texts and lines of any
length are read whole; of words that weigh alike the first in their own order comes
first; a corpus of no documents gives every word one weight; repeated rows each give
their row; an empty table gives none; no other columns are read, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import map_texts, small_batches, table

CONTAINED = 0.8
#: Weights are whole numbers of this fraction, so that their sums are exact.
GRAIN = 10_000
# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Notices as they are customarily worded, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it under the terms of the gnu lesser general public license", "lgpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("dedicated to the public domain under cc0 1 0 universal", "cc0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)

_WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 or b == 10 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: str) -> bytes:
    """The text's bytes with everything but words and line ends blank."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS)


def word_weights(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """The rarity of each word of the templates in the whole corpus.

    Each task sends at most one row a word; what reaches the driver is bounded by the
    templates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(vocabulary.intersection(words_of(text).split()))
        counts[b""] = rows
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in counts], "n": list(counts.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    small_batches(docs)
    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = {r.word.encode(): r.n for r in rows}
    total = seen.get(b"", 0)
    return {w: round(GRAIN * math.log(1 + total / (1 + seen.get(w, 0)))) or 1 for w in vocabulary}


Match = dict[int, tuple[float, frozenset[int]]]


class TemplateJoin:
    """The templates in global word order with their prefix index."""

    def __init__(self, templates: tuple[tuple[str, str], ...], weight: dict[bytes, int], contained: float = CONTAINED) -> None:
        vocabulary = sorted({w for t, _ in templates for w in t.encode().split()}, key=lambda w: (-weight.get(w, 1), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.weight = [weight.get(w, 1) for w in vocabulary]
        self.sets, self.labels, self.required, self.whole, self.lengths = [], [], [], [], []
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (text, label) in enumerate(templates):
            ranks = sorted({self.rank[w] for w in text.encode().split()})
            whole = left = sum(self.weight[r] for r in ranks)
            required = math.ceil(round(contained * whole, 6))
            for r in ranks:
                if left < required:
                    break
                self.index[r].append((k, left))
                left -= self.weight[r]
            self.sets.append(frozenset(ranks))
            self.labels.append(label)
            self.required.append(required)
            self.whole.append(whole)
            self.lengths.append(math.ceil(round(len(text.split()) / contained, 9)))
        self.rare = frozenset(vocabulary[r] for r in self.index)
        self.least = min(self.required, default=0)

    def match(self, words: list[bytes]) -> Match:
        """Containment and common words of each template that a block holds enough of."""
        rank = self.rank
        block = sorted({rank[w] for w in words if w in rank})
        left = sum(self.weight[r] for r in block)
        if left < self.least:
            return {}
        found, seen, whole = {}, set(), frozenset(block)
        for r in block:
            for k, rest in self.index.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)
                if min(rest, left) < self.required[k]:
                    continue
                common = whole & self.sets[k]
                if (held := sum(self.weight[x] for x in common)) >= self.required[k]:
                    found[k] = held / self.whole[k], common
            left -= self.weight[r]
        return found

    def match_over_lines(self, words: list[bytes]) -> Match:
        """The most of each template that a run of its length holds.

        A run that matches holds one of the template's prefix words, so runs are
        weighed only in the stretches around those.
        """
        rank = self.rank
        placed = [(at, rank[w]) for at, w in enumerate(words) if w in rank]
        if sum(self.weight[r] for r in {r for _, r in placed}) < self.least:
            return {}
        near: dict[int, list[int]] = defaultdict(list)
        for at, r in placed:
            for k, _ in self.index.get(r, ()):
                near[k].append(at)
        found: Match = {}
        places = [at for at, _ in placed]
        for k, rare in near.items():
            own, length, most, best, n = self.sets[k], self.lengths[k], 0, frozenset(), 0
            while n < len(rare):
                start, end = rare[n] - length + 1, rare[n] + length
                while n < len(rare) and rare[n] - length < end:
                    end = rare[n] + length
                    n += 1
                stretch = [(at, r) for at, r in placed[bisect_left(places, start) : bisect_left(places, end)] if r in own]
                counts: Counter[int] = Counter()
                first = held = 0
                for at, r in stretch:
                    held += 0 if counts[r] else self.weight[r]
                    counts[r] += 1
                    while stretch[first][0] <= at - length:
                        old = stretch[first][1]
                        counts[old] -= 1
                        held -= 0 if counts[old] else self.weight[old]
                        first += 1
                    if held > most:
                        most, best = held, frozenset(x for x, c in counts.items() if c)
            if most >= self.required[k]:
                found[k] = most / self.whole[k], best
        return found

    def best(self, found: Match) -> dict[str, float]:
        """Labels, with their containment, of the matches that no better one covers."""
        out: dict[str, float] = {}
        for k, (share, common) in found.items():
            covered = any(common <= other and (more, len(other)) > (share, len(common)) for j, (more, other) in found.items() if j != k)
            if not covered:
                out[self.labels[k]] = max(share, out.get(self.labels[k], 0.0))
        return out


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) wherever a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    found.append((at, label))
        except ValueError:
            continue
    return found


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: float = CONTAINED, over_lines: bool = False) -> DataFrame:
    """A row for each document with its base phrases and the labels of its blocks."""
    vocabulary = frozenset(w for t, _ in templates for w in t.encode().split())
    join = TemplateJoin(templates, word_weights(docs, vocabulary), contained)
    phrases = [(p.encode().split(), label) for p, label in PHRASES]
    firsts = frozenset(p[0] for p, _ in phrases)

    def start() -> Callable[[str], tuple]:
        def row(text: str) -> tuple:
            plain = words_of(text)
            words = plain.split()
            places = [] if firsts.isdisjoint(words) else phrase_places(words, phrases)
            base = {label for _, label in places}
            labels, score = set(base), 1.0 if base else 0.0
            if not join.rare.isdisjoint(words):
                for line in plain.split(b"\n"):
                    block = line.split()
                    if not join.rare.isdisjoint(block):
                        for label, share in join.best(join.match(block)).items():
                            labels.add(label)
                            score = max(score, share)
                if over_lines and b"\n" in plain:
                    for label, share in join.best(join.match_over_lines(words)).items():
                        labels.add(label)
                        score = max(score, share)
            starts = [at for at, _ in places]
            return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

        return row

    return map_texts(docs, start, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), over_lines=True)
