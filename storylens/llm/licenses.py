"""License scans with a positional rare-token index.

Index: the rarest words of each licence template with their positions, by
inverse document frequency over all documents. A template has so many of its
positions in the index that any stretch with enough agreeing words agrees in
``VOTES`` of them at least, whatever else the document holds. A document's
words look up their postings, and each (template, relative position) that
several of them agree on is a place to look at. There the document's words are
compared with the template's from the agreed start, and a template counts only
if one of its mandatory key phrases stands in that stretch and enough of its
words agree.

Whole licence texts (files of a folder, ``FOLDER`` unless told) are indexed in
blocks of ``BLOCK`` words, each with its own rarest words, so a text with words
added or left out still agrees block by block. A licence counts if its title,
its mandatory key phrase, stands in the document and ``WHOLE`` of its blocks are
found; its label is the file's name with ``-text``. Without the folder there are
no such labels.

Base labels: places where a phrase's words stand consecutively. The phrases
are looked up by their rarest word in the same per-document postings.

Null and empty texts have no words, labels or places; repeated rows each get
their own result; columns are kept, but ``licenses`` is replaced. Of equal idf the smaller word is
indexed first. With an empty table no word has a frequency.
"""

from __future__ import annotations

import math
import os
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylens.llm.common import prepare, texts
from storylens.llm.words import alnum_words

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Licence notices as published: label, text, key phrases of which one must
# stand in the matched stretch.
TEMPLATES = (
    ("gpl-notice",
     "This work is licensed under the GNU General Public License, version 3.",
     ("gnu general public license",)),
    ("gpl-3.0",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
     "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
     ("gnu general public license", "free software foundation")),
    ("lgpl",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation.",
     ("gnu lesser general public license",)),
    ("apache-notice",
     "Licensed under the Apache License, Version 2.0.",
     ("apache license version 2 0",)),
    ("apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
     ("compliance with the license",)),
    ("mit-notice",
     "Released under the MIT License.",
     ("mit license",)),
    ("mit-text",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
     ("permission is hereby granted free of charge",)),
    ("cc-by-notice",
     "This work is licensed under a Creative Commons Attribution 4.0 International License.",
     ("creative commons attribution",)),
    ("cc-by-nc",
     "Licensed under CC BY-NC 4.0.",
     ("cc by nc",)),
    ("cc-by-sa",
     "Licensed under CC BY-SA 4.0.",
     ("cc by sa",)),
    ("bsd",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met.",
     ("redistribution and use in source and binary forms",)),
    ("mpl-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
     ("mozilla public license",)),
)
# Indexed words that must agree on a start (all, if a template has fewer).
# Every place of such a word in the document votes.
VOTES = 2
# Share of a template's words that must agree from that start.
AGREE = 0.6


# Whole licence texts: their folder, words of a block, of a title, and the share
# of blocks that must be found.
FOLDER = "/usr/share/common-licenses"
BLOCK = 64
TITLE = 4
WHOLE = 0.9


def whole_texts(folder: str = FOLDER) -> tuple[tuple[str, str], ...]:
    """Label and text of each licence file of a folder of the driver; of files
    with equal texts the one of the longest name."""
    by_text: dict[str, str] = {}
    if os.path.isdir(folder):
        for name in sorted(os.listdir(folder), key=lambda n: (len(n), n)):
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                by_text[f.read()] = name
    return tuple(sorted((f"{name.lower()}-text", t) for t, name in by_text.items()))


def blocks_of(words: list[bytes]) -> list[list[bytes]]:
    """Blocks of ``BLOCK`` words; the last has what is left besides."""
    many = max(1, len(words) // BLOCK)
    return [words[i * BLOCK:(i + 1) * BLOCK if i < many - 1 else len(words)] for i in range(many)]


def phrase(text: str) -> tuple[bytes, ...]:
    return tuple(alnum_words(text))


class Index:
    """Template words with their (template, position) postings. With ``rank``,
    of each template only its first positions by rank: as many as may disagree,
    and ``VOTES`` more."""

    def __init__(self, templates=TEMPLATES, base=BASE, rank: dict[bytes, tuple] | None = None, whole=()):
        self.templates = [(label, alnum_words(t), [phrase(k) for k in keys]) for label, t, keys in templates]
        self.base = [(phrase(p), label) for p, label in base]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, words, _) in enumerate(self.templates):
            for at, w in indexed(words, rank):
                self.postings[w].append((i, at))
        self.whole = []
        for label, t in whole:
            words = alnum_words(t)
            if len(words) >= TITLE:
                blocks = [(b, indexed(b, rank)) for b in blocks_of(words)]
                self.whole.append((label, tuple(words[:TITLE]), blocks))
        self.vocabulary = frozenset(self.postings) | {w for p, _ in self.base for w in p} | {
            w for _, _, blocks in self.whole for b, _ in blocks for w in b}
        self.searched = frozenset(self.postings) | {w for p, _ in self.base for w in p}
        self.distinct = [len(set(words)) for _, words, _ in self.templates]

    def scan(self, words: list[bytes]) -> tuple:
        """``(places, base labels, matches)``; places: starts of base phrases;
        matches: label, share of agreeing words, start and end."""
        present = self.searched.intersection(words)
        where: dict[bytes, list[int]] = {w: [] for w in present}
        if present:
            for at, w in enumerate(words):
                if w in where:
                    where[w].append(at)
        places, labels = [], set()
        for p, label in self.base:
            if all(w in where for w in p):
                k = min(range(len(p)), key=lambda j: len(where[p[j]]))
                found = [at - k for at in where[p[k]] if at >= k and tuple(words[at - k:at - k + len(p)]) == p]
                places += found
                labels |= {label} if found else set()
        votes: Counter = Counter()
        for w in present & self.postings.keys():
            for i, at in self.postings[w]:
                votes.update({(i, doc_at - at) for doc_at in where[w]})
        best: dict[int, tuple] = {}
        for (i, start), n in votes.items():
            if n < min(VOTES, self.distinct[i]):
                continue
            _, template, keys = self.templates[i]
            lo, hi = max(start, 0), min(start + len(template), len(words))
            stretch = words[lo:hi]
            same = sum(a == b for a, b in zip(stretch, template[lo - start:], strict=False))
            share = same / len(template)
            if share >= AGREE and any(stands(k, stretch) for k in keys):
                best[i] = max(best.get(i, (0.0, 0, 0)), (share, -lo, hi))
        found = [(self.templates[i][0], s, -lo, hi) for i, (s, lo, hi) in best.items()]
        return places, labels, found + self.scan_whole(words)

    def scan_whole(self, words: list[bytes]) -> list[tuple]:
        """Matches of whole licence texts: label, share of blocks found, start
        and end of the stretch that holds them."""
        out, present = [], None
        for label, title, blocks in self.whole:
            if present is None:
                present = set(words)
            if not present.issuperset(title) or not stands(title, words):
                continue
            where = defaultdict(list)
            for at, w in enumerate(words):
                where[w].append(at)
            starts = []
            for block, places in blocks:
                votes = Counter(doc_at - at for at, w in places for doc_at in where.get(w, ()))
                good = [start for start, n in votes.items() if n >= VOTES and agreement(words, block, start) >= AGREE]
                if good:
                    starts.append((min(good), len(block)))
            if len(starts) >= WHOLE * len(blocks):
                out.append((label, len(starts) / len(blocks), max(0, min(s for s, _ in starts)),
                            min(len(words), max(s + n for s, n in starts))))
        return out


def indexed(words: list[bytes], rank: dict[bytes, tuple] | None) -> list[tuple[int, bytes]]:
    """Positions that are indexed: the first by rank, as many as may disagree and
    ``VOTES`` more; all without ``rank``."""
    places = list(enumerate(words))
    if rank is None:
        return places
    may_differ = sum((n + 1) / len(words) >= AGREE for n in range(len(words))) - 1
    return sorted(places, key=lambda x: rank[x[1]])[:may_differ + VOTES]


def agreement(words: list[bytes], template: list[bytes], start: int) -> float:
    """Share of a template's words that agree with the document's from a start."""
    lo, hi = max(start, 0), min(start + len(template), len(words))
    return sum(a == b for a, b in zip(words[lo:hi], template[lo - start:], strict=False)) / len(template)


def stands(p: tuple[bytes, ...], words: list[bytes]) -> bool:
    return any(words[i] == p[0] and tuple(words[i:i + len(p)]) == p for i in range(len(words) - len(p) + 1))


def word_frequencies(docs: DataFrame, templates=TEMPLATES, base=BASE, whole=()) -> tuple[dict[bytes, int], int]:
    """Documents that hold each licence word, and all documents: counted over
    the whole table; as many rows as the templates have words."""
    vocabulary = Index(templates, base, whole=whole).vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(vocabulary.intersection(alnum_words(t)))
                seen[None] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k and k.decode() for k in keys], pa.string()),
                                          pa.array([seen[k] for k in keys], pa.int64())], ["word", "n"])

    rows = texts(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    got = {w and w.encode(): n for w, n in rows}
    return {w: n for w, n in got.items() if w is not None}, got.get(None, 0)


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, whole=None) -> DataFrame:
    """``docs`` with a struct ``licenses``: ``n_words, n_base, first_word,
    last_word, base_labels`` and ``labels`` (sorted arrays), ``score`` (best
    share of agreeing template words; 1 if a base phrase stands alone; else
    0), ``matches`` (label, share, start, end in words). ``whole``: labels and
    texts of whole licences, those of ``FOLDER`` unless told."""
    prepare(docs.sparkSession)
    whole = whole_texts() if whole is None else whole
    df, n_docs = word_frequencies(docs, templates, base, whole)
    vocabulary = Index(templates, base, whole=whole).vocabulary
    rank = {w: (-math.log((n_docs + 1) / (df.get(w, 0) + 1)), w) for w in vocabulary}

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
                  "labels array<string>, score double, "
                  "matches array<struct<label string, share double, start long, end long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(templates, base, rank, whole)
        for s in batches:
            rows = []
            for t in s:
                words = alnum_words(t)
                places, labels, found = index.scan(words)
                score = max([f[1] for f in found] + [1.0] * bool(places), default=0.0)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None),
                             sorted(labels), sorted(labels | {f[0] for f in found}), score,
                             [dict(zip(("label", "share", "start", "end"), f, strict=True)) for f in sorted(found)]))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                                              "score", "matches"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn("licenses", run.asNondeterministic()(F.col("text")))
