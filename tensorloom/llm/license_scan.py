"""License scans by an exact set-similarity join with license templates.

A text block is a run of as many words as a template has (the whole text, if it has
fewer). It meets the template when it holds at least ``threshold`` of the template's distinct
words. Every such block is found:

* *prefix filter*: the template's words are ordered by how often all documents have
  them, rarest first; a block that meets it holds one of the first
  ``size - needed + 1``;
* *length filter*: a text with fewer words than needed holds no block;
* *positional filter*: a block whose rarest hit stands at rank r can hold at most ``size - r``
  of the words, and at most as many as it has places with any word of the template;
* a text that has fewer than the needed words of the template in all holds no block;
* what is left is compared exactly, by the number of distinct words of every block, which is counted
  from where each word stood before: a template has as many words as it likes.

A phrase is a template whose words must all stand in order (threshold 1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import slices
from ._words import NON_ALNUM, Words
from .license_texts import CLAUSES

# Base phrases, and opening words of common license notices.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False


#: Short notices differ by a word (BY-NC, BY-SA), so they have to be nearly whole.
TEMPLATES = (*(Template(label, text, 1.0, True) for label, text in PHRASES), *(Template(label, text, 0.8 if len(text) > 60 else 0.9) for label, text in NOTICES))
#: Beside them, the clauses of whole licenses: a body counts without its title or opening words.
ALL_TEMPLATES = (*TEMPLATES, *(Template(label, text) for label, text in CLAUSES))


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text], pa.large_string()), NON_ALNUM).hashes()


def distinct_words(at: np.ndarray, width: int) -> np.ndarray:
    """How many distinct words of a template (at: their numbers, or -1) each run of width places holds."""
    places = np.flatnonzero(at >= 0)
    order = np.argsort(at[places], kind="stable")
    a, b = order[:-1], order[1:]
    again = at[places[a]] == at[places[b]]
    before = np.full(len(places), -1)
    before[b[again]] = places[a[again]]
    # A place counts in the runs that hold it and start after the place where its word stood before.
    first = np.maximum(np.maximum(before, places - width) + 1, 0)
    change = np.bincount(first, minlength=len(at) + 1) - np.bincount(places + 1, minlength=len(at) + 1)
    return np.cumsum(change)[: len(at) - width + 1]


class Plan:
    """Templates made ready: words, their order by frequency, and what each filter needs."""

    def __init__(self, templates: tuple[Template, ...], counts: dict[int, int] | None = None):
        sequences = [_hashes(t.text) for t in templates]
        if any(len(s) == 0 for s in sequences):
            raise ValueError("a template has no words")
        self.vocabulary = np.unique(np.concatenate(sequences))
        self.templates = templates
        frequency = np.array([(counts or {}).get(int(h), 0) for h in self.vocabulary.view(np.int64)])
        #: Rank of each word of the vocabulary in the global order, rarest first.
        rank = np.empty(len(self.vocabulary), np.int64)
        rank[np.lexsort((self.vocabulary, frequency))] = np.arange(len(self.vocabulary))
        self.parts = []
        for template, sequence in zip(templates, sequences, strict=True):
            ids = np.searchsorted(self.vocabulary, sequence)
            own = np.unique(ids)
            own = own[np.argsort(rank[own])]
            needed = max(1, int(np.ceil(template.threshold * len(own) - 1e-9)))
            place = np.full(len(self.vocabulary) + 1, -1, np.int32)
            place[own] = np.arange(len(own))
            self.parts.append((template, ids, place, len(own), needed))
        self.needed = np.array([needed for *_, needed in self.parts])
        #: A row for each word of the vocabulary: the templates that have it.
        self.having = np.ascontiguousarray(np.stack([place[:-1] >= 0 for _, _, place, _, _ in self.parts], axis=1))

    def find(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Blocks of one text (vocabulary number of each word, or -1): template, start, end, containment."""
        out = []
        held = self.having[np.unique(ids[ids >= 0])].sum(axis=0)
        for number in np.flatnonzero(held >= self.needed).tolist():
            template, sequence, place, size, needed = self.parts[number]
            width = len(sequence)
            if len(ids) < (width if template.phrase else needed):
                continue
            at = place[ids]
            hits = np.flatnonzero((at >= 0) & (at < size - needed + 1))
            if not len(hits):
                continue
            width = min(width, len(ids))
            if template.phrase:
                starts = np.unique((hits[:, None] - np.arange(width)).ravel())
                starts = starts[(starts >= 0) & (starts + width <= len(ids))]
                found = starts[(ids[starts[:, None] + np.arange(width)] == sequence).all(axis=1)]
                out.extend((number, int(s), int(s) + width, 1.0) for s in found)
                continue
            overlap = distinct_words(at, width)
            good = np.flatnonzero(overlap >= needed)
            out.extend((number, s, s + width, n / size) for s, n in zip(good.tolist(), overlap[good].tolist(), strict=True))
        return out


def _count(vocabulary: np.ndarray):
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in slices(batches, "text"):
            h = Words(batch.column("text"), NON_ALNUM).hashes()
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        found = np.flatnonzero(total)
        yield pa.record_batch({"word": pa.array(vocabulary[found].view(np.int64)), "n": pa.array(total[found])})

    return run


_MATCHES = "array<struct<template:int,start_word:bigint,end_word:bigint,containment:double>>"
_MATCH_TYPE = pa.list_(pa.struct([("template", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))


def _scan(plan: Plan):
    names = ("template", "start_word", "end_word", "containment")

    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), NON_ALNUM)
            h = words.hashes()
            at = np.minimum(np.searchsorted(plan.vocabulary, h), len(plan.vocabulary) - 1)
            ids = np.where(plan.vocabulary[at] == h, at, -1)
            rarest = np.zeros(len(plan.vocabulary) + 1, bool)
            for _, _, place, size, needed in plan.parts:
                rarest |= (place >= 0) & (place < size - needed + 1)
            hit = np.concatenate(([0], np.cumsum(rarest[ids])))
            rows = [[dict(zip(names, m, strict=True)) for m in plan.find(ids[a:b])] if hit[b] > hit[a] else [] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(rows, _MATCH_TYPE)], names=["doc_id", "n_words", "matches"])

    return run


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = ALL_TEMPLATES) -> DataFrame:
    """Every text block that meets a template.

    docs: doc_id (integer) and text; other columns are left out. ASCII letters are lower-cased; words are
    runs of letters, digits and non-ASCII characters. Returns per document: doc_id, n_words and
    matches (template: its place in templates; start_word, end_word; containment), by
    template and place. Null and empty texts have no words and no matches.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = Plan(templates).vocabulary
    # As many rows as the templates have distinct words.
    rows = docs.select("text").mapInArrow(_count(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    plan = Plan(templates, {r["word"]: r["n"] for r in rows})
    return docs.mapInArrow(_scan(plan), f"doc_id long, n_words long, matches {_MATCHES}")
