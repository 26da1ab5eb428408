"""Licence notices by a positional index of each template's rarest words.

A template lies over a file where at least LEAST_SHARE of its words are in place. So of its rarest words, one
more than may be missing, one at least is in place: only these are in the index, each with its positions
in its templates. A file looks up its licence words from the highest inverse document frequency down; what
it finds are relative positions, file against template, and only where one stands is the template laid
over the file. Mandatory phrases are verified last. No template that could match goes untried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .runtime import arrow_session, blocks, text_buffers

#: Phrases that are reported wherever their words stand consecutively, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices in use, with a label and the phrases without which a match does not count.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("hereby granted", "free of charge", "without restriction")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide", ("extent possible under law", "public domain")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("reserved", "All rights reserved", ("all rights reserved",)),
)
#: Words too common in any text for a file to be read on their account; they still count towards a template's match.
FUNCTION_WORDS = "a all an and any are as at be by can for has in into is it may not of on or that the this to use with you 0 2 3 4".split()
#: Words by which a place may differ from its template's, and the share of a template that must be in place.
SLACK, LEAST_SHARE = 2, 0.6


def words_of(texts: list[str]) -> list[np.ndarray]:
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    data = tc.LOWER[data]
    starts, ends, first = tc.word_spans(data, offsets, tc.ALNUM)
    hashes = tc.span_hash(data, starts, ends)
    return [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def least_hits(n: int) -> int:
    """Words of a template of n that must be in place."""
    return next(h for h in range(1, n + 1) if h / n >= LEAST_SHARE)


@dataclass
class Index:
    """Words of templates and phrases (sorted hashes), the postings of each template's rarest words, and the corpus's document counts."""

    vocabulary: np.ndarray
    filter: np.ndarray
    labels: list[str]
    templates: list[list[int]]
    mandatory: list[list[list[int]]]
    base: list[tuple[str, list[int]]]
    quiet: np.ndarray  # by word: files with no others are not read
    idf: np.ndarray
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by word: template and position

    def __post_init__(self) -> None:
        """Post each template's rarest words, as many that a match cannot miss them all."""
        self.postings = defaultdict(list)
        for t, words in enumerate(self.templates):
            rarest = sorted(range(len(words)), key=lambda q: (-self.idf[words[q]], words[q], q))
            for q in rarest[: len(words) - least_hits(len(words)) + 1]:
                self.postings[words[q]].append((t, q))

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of licence words among the hashes, and which they are."""
        near = np.flatnonzero(self.filter[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[near]
        return near[same], at[same]


def template_index(templates=TEMPLATES, base: dict[str, str] = BASE) -> Index:
    texts = [t for _, t, _ in templates]
    phrases = [p for _, _, ps in templates for p in ps]
    every = words_of([*texts, *phrases, *base, " ".join(FUNCTION_WORDS)])
    vocabulary = np.unique(np.concatenate(every))
    mask = np.zeros(1 << 16, bool)
    mask[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    number = [np.searchsorted(vocabulary, w).tolist() for w in every]
    quiet = np.zeros(len(vocabulary), bool)
    quiet[number[-1]] = True
    own, rest = number[: len(texts)], iter(number[len(texts) :])
    mandatory = [[next(rest) for _ in ps] for _, _, ps in templates]
    fixed = [(label, next(rest)) for label in base.values()]
    return Index(vocabulary, mask, [label for label, _, _ in templates], own, mandatory, fixed, quiet, np.zeros(len(vocabulary)))


def with_frequencies(index: Index, docs: DataFrame) -> Index:
    """Count in how many of all documents each licence word is; the counts are as many as the words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(len(index.vocabulary), np.int64), 0
        for part in blocks(batches):
            hashes, first = block_words(part)
            at, word = index.numbers(hashes)
            doc = np.searchsorted(first, at, "right")
            seen += np.bincount(np.unique(doc * len(seen) + word) % len(seen), minlength=len(seen))
            total += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(seen))), pa.array(np.concatenate([[total], seen]))], ["word", "n"])

    rows = {r[0]: r[1] for r in docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect()}
    total = rows.get(-1, 0)
    n = np.array([rows.get(i, 0) for i in range(len(index.vocabulary))])
    return replace(index, idf=np.log((total + 1) / (n + 1)))


def block_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(part.column("text"))
    data = tc.LOWER[data]
    starts, ends, first = tc.word_spans(data, offsets, tc.ALNUM)
    return tc.span_hash(data, starts, ends), first


def positions(place: dict[int, int]) -> dict[int, list[int]]:
    """Positions of each word, in order."""
    where: dict[int, list[int]] = {}
    for p, w in sorted(place.items()):
        where.setdefault(w, []).append(p)
    return where


def phrase_places(where: dict[int, list[int]], place: dict[int, int], phrase: list[int]) -> list[int]:
    """Where the phrase's words stand consecutively, found by the one that the file has least often."""
    k, w = min(enumerate(phrase), key=lambda x: len(where.get(x[1], ())))
    return [p - k for p in where.get(w, ()) if all(place.get(p - k + i) == v for i, v in enumerate(phrase))]


def relative_positions(where: dict[int, list[int]], index: Index) -> dict[int, tuple[int, int]]:
    """By template: the least and the greatest start in the file that one of its rarest words speaks for. Words are looked up from the highest IDF down."""
    spans: dict[int, tuple[int, int]] = {}
    for w in sorted(where, key=lambda w: (-index.idf[w], w)):
        for t, q in index.postings.get(w, ()):
            first, last = where[w][0] - q - SLACK, where[w][-1] - q + SLACK
            lo, hi = spans.get(t, (first, last))
            spans[t] = min(lo, first), max(hi, last)
    return spans


def laid_over(words: list[int], where: dict[int, np.ndarray], first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start from first to last: the template's words in place, give or take SLACK, and exactly in place."""
    near, exact = np.zeros(last - first + 1, np.int32), np.zeros(last - first + 1, np.int32)
    for q, w in enumerate(words):
        stands = where.get(w)
        if stands is None:
            continue
        at = stands[np.searchsorted(stands, first + q - SLACK) : np.searchsorted(stands, last + q + SLACK, "right")] - q - first
        inside = at[(at >= 0) & (at <= last - first)]
        exact[inside] += 1
        step = np.zeros(last - first + 2, np.int32)
        np.add.at(step, np.maximum(at - SLACK, 0), 1)
        np.add.at(step, np.minimum(at + SLACK, last - first) + 1, -1)
        near += np.cumsum(step[:-1]) > 0
    return near, exact


def template_matches(where: dict[int, list[int]], place: dict[int, int], index: Index) -> dict[str, tuple[float, int, int]]:
    """By label: the best share of a template in place, and the words (from, to) it lies over.

    ``place`` has the file's licence words by position, ``where`` their positions. Only templates
    whose mandatory phrases all stand inside count. Of places with the same share, that with the
    most words exactly in place is given, then the first.
    """
    best: dict[str, tuple] = {}
    arrays = {w: np.array(ps) for w, ps in where.items()}
    for t, (first, last) in sorted(relative_positions(where, index).items()):
        words, mandatory = index.templates[t], index.mandatory[t]
        n = len(words)
        near, exact = laid_over(words, arrays, first, last)
        starts = np.flatnonzero(near >= least_hits(n))
        phrases = [phrase_places(where, place, phrase) for phrase in mandatory] if len(starts) else []
        if not len(starts) or not all(phrases):
            continue
        for at in starts[np.lexsort((starts, -exact[starts], -near[starts]))].tolist():
            d = at + first
            found = near[at] / n, int(exact[at]), -t, -d
            if found <= best.get(index.labels[t], (0,)):
                break
            lo, hi = d - SLACK, d + n + SLACK
            if all((i := bisect_left(ps, lo)) < len(ps) and ps[i] + len(phrase) <= hi for ps, phrase in zip(phrases, mandatory, strict=True)):
                best[index.labels[t]] = found
                break
    return {label: (float(share), max(-d, 0), len(index.templates[-t]) - d) for label, (share, _, t, d) in best.items()}


ROWS = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places array<struct<label:string,share:double,first:bigint,stop:bigint>>"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row a document: its words, base phrases, labels, score and where each template lies.

    n_base counts all places of base phrases, first_word and last_word are their least and greatest
    start; labels are the base phrases' and the matched templates'; score is the greatest share of a
    matched template's words in place, 1 where a base phrase stands. Null and empty texts have no
    words and no labels; repeated rows are each scanned; an empty table gives an empty result; columns
    besides doc_id and text are not read.
    """
    spark = arrow_session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(with_frequencies(template_index(templates, base), docs))
    kind = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("first", pa.int64()), ("stop", pa.int64())]))
    names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in blocks(batches):
            hashes, first = block_words(part)
            at, word = index.numbers(hashes)
            doc = np.searchsorted(first, at, "right") - 1
            rows: list[tuple] = [(0, None, None, "", "", 0.0, [])] * part.num_rows
            bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
            for d in np.unique(doc[~index.quiet[word]]).tolist():
                a, b = bounds[d], bounds[d + 1]
                place = dict(zip((at[a:b] - first[d]).tolist(), word[a:b].tolist(), strict=True))
                where = positions(place)
                found = [(label, p) for label, phrase in index.base for p in phrase_places(where, place, phrase)]
                more = template_matches(where, place, index)
                own = {label for label, _ in found}
                score = 1.0 if own else max([0.0, *(m[0] for m in more.values())])
                starts = [p for _, p in found]
                rows[d] = (len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(more))), score, [{"label": k, "share": s, "first": lo, "stop": hi} for k, (s, lo, hi) in sorted(more.items())])
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), *columns], ["doc_id", "n_words", *names])

    return docs.mapInArrow(scan, ROWS)
