"""License scans with a positional index of rare licence words.

The templates are short public notices.  Document frequencies of their words
are counted over all documents; of each template the ``rare`` words with the
highest inverse frequency are indexed with their positions.  A file looks up
all its words that the index has, each with a posting votes for the place where
the template would begin, and a place with enough of the template's rare weight
is compared with the whole template; a label is given when the template's
mandatory phrases stand there.

Base labels come from fixed phrases at whatever place their words stand
consecutively.

Words: A-Z lower-cased, then runs of other bytes than
``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

Nulls and texts without words have no label, no place and score 0.  Without
documents every template word has the same weight.  Repeated rows each get
their own row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, raw
from .decontam import words_of

#: Phrases and base labels of the contract.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, mandatory phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl-notice", "under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify and or distribute"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]


class Index:
    def __init__(self, templates, frequency: dict[bytes, int], total: int, rare: int, least: float):
        self.least = least
        self.labels = [t[0] for t in templates]
        texts = [t[1].encode().split() for t in templates]
        self.base = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]
        words = sorted({w for t in texts for w in t} | {w for p, _ in self.base for w in p} | {w for t in templates for p in t[2] for w in p.encode().split()})
        self.ids = {w: i + 1 for i, w in enumerate(words)}
        self.idf = np.array([0.0, *(math.log((total + 2) / (frequency.get(w, 0) + 1)) for w in words)])
        self.texts = [np.array([self.ids[w] for w in t]) for t in texts]
        self.must = [[np.array([self.ids[w] for w in p.encode().split()]) for p in t[2]] for t in templates]
        self.base_ids = [(np.array([self.ids[w] for w in p]), label) for p, label in self.base]
        rows, self.rare_weight = [], []
        for t, ids in enumerate(self.texts):
            places: dict[int, int] = {}
            for at, w in enumerate(ids):
                places.setdefault(int(w), at)
            top = sorted(places, key=lambda w: (-self.idf[w], places[w]))[:rare]
            self.rare_weight.append(sum(self.idf[w] for w in top))
            rows += [(w, t, places[w]) for w in top]
        rows.sort()
        self.post = np.array(rows)
        self.start = np.searchsorted(self.post[:, 0], np.arange(len(words) + 2))

    def scan(self, text: bytes):
        """n_words, n_base, first, last, base labels, all labels, score."""
        words = words_of(text)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        at = np.flatnonzero(ids)
        n, firsts, base = len(words), [], set()
        if not len(at):
            return n, 0, None, None, "", "", 0.0
        for phrase, label in self.base_ids:
            here = at[ids[at] == phrase[0]]
            here = here[here + len(phrase) <= n]
            for k in range(1, len(phrase)):
                here = here[ids[here + k] == phrase[k]]
            if len(here):
                base.add(label)
                firsts.append(here)
        labels, score = set(base), 0.0
        for t, place, share in self.places(ids, at):
            lo, hi = max(0, place - 2), place + len(self.texts[t]) + 2
            if all(holds(ids[lo:hi], p) for p in self.must[t]):
                labels.add(self.labels[t])
                score = max(score, share)
        places = np.concatenate(firsts) if firsts else np.array([], int)
        if base:
            score = max(score, 0.5)
        return (
            n, len(places), int(places.min()) if len(places) else None, int(places.max()) if len(places) else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), float(min(1.0, score)),
        )

    def places(self, ids: np.ndarray, at: np.ndarray):
        """(template, place, matched share) where enough rare words agree."""
        counts = self.start[ids[at] + 1] - self.start[ids[at]]
        if not counts.sum():
            return
        word = np.repeat(np.arange(len(at)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        post = self.post[self.start[ids[at[word]]] + offset]
        places = at[word] - post[:, 2]
        width = len(ids) + 64
        keys, which = np.unique(post[:, 1] * (2 * width) + places + width, return_inverse=True)
        weight = np.bincount(which, self.idf[post[:, 0]])
        for key, w in zip(keys, weight, strict=True):
            t, place = int(key) // (2 * width), int(key) % (2 * width) - width
            if w < self.least * self.rare_weight[t]:
                continue
            lo, hi = max(0, place), min(len(ids), place + len(self.texts[t]))
            same = ids[lo:hi] == self.texts[t][lo - place : hi - place]
            idf = self.idf[self.texts[t]]
            share = float(idf[lo - place : hi - place][same].sum() / idf.sum()) if idf.sum() else float(same.mean())
            if share >= self.least:
                yield t, place, share


def holds(ids: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return False
    ok = np.ones(n, bool)
    for k, w in enumerate(phrase):
        ok &= ids[k : k + n] == w
    return bool(ok.any())


def template_words(templates) -> set[bytes]:
    return {w for t in templates for w in t[1].encode().split()}


def frequencies(docs: DataFrame, text_col: str, templates) -> dict[bytes, int]:
    """Documents that have each template word: one row a word and task, so at
    most as many as the templates have words after the sum."""
    wanted = template_words(templates)

    def kernel():
        def run(texts):
            counts: dict[bytes, int] = {}
            for text in raw(texts):
                for w in wanted.intersection(words_of(text)):
                    counts[w] = counts.get(w, 0) + 1
            out = [[{"word": w.decode(), "n": c} for w, c in counts.items()]] + [[]] * (len(texts) - 1)
            return (out,)

        return run

    counted = append(docs, [text_col], "counts array<struct<word:string,n:long>>", kernel, [])
    rows = counted.select(F.explode("counts").alias("c")).groupBy("c.word").agg(F.sum("c.n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


def scan(
    docs: DataFrame,
    text_col: str = "text",
    templates=TEMPLATES,
    rare: int = 6,
    least: float = 0.6,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    total = docs.count()
    index = Index(templates, frequencies(docs, text_col, templates), total, rare, least)

    def kernel():
        def run(texts):
            return [list(c) for c in zip(*map(index.scan, raw(texts)), strict=True)] if len(texts) else [[]] * 7

        return run

    return append(
        docs,
        [text_col],
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
        kernel,
        keep,
    )
