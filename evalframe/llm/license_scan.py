"""Licence scans by a positional index of the rarest template words.

A template is a notice, a clause or a name of a licence: a sequence of words, the label it stands
for, key phrases that must stand in the place found, and the share of its words that must stand at
their relative places. The index is made in two passes over the documents:

1. In how many documents each template word stands is counted over all of them; that orders the
   words by their inverse document frequency.
2. Of a template of n words of which m must agree, the n - m + 2 rarest positions are looked up in
   a text. Wherever m words agree at one relative position, at least two of those do (one, where
   m is 1), so postings that meet at one relative position give every place there is: no text,
   place or template is left out, and what the counts are changes the work, not the result. A
   place that they give is compared word by word, and its key phrases are verified.

Words: A-Z lower-cased, runs of digits, ASCII letters and non-ASCII characters.
Edge cases: null and empty texts have no words and no places; a template may begin before a text or
end after it if enough of it stands inside; repeated rows are scanned each; an empty table gives an
empty one; a column named like a result column is replaced by it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.batches import ALNUM, map_texts


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    #: Word sequences that must stand within the place.
    phrases: tuple[str, ...] = ()
    #: Share of the words that must stand at their relative places.
    coverage: float = 1.0
    #: Whether it is one of the phrases every scan reports.
    base: bool = False

    @property
    def words(self) -> list[bytes]:
        return split(self.text.encode())

    @property
    def need(self) -> int:
        return max(1, math.ceil(self.coverage * len(self.words) - 1e-9))


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


#: Phrases and what they stand for.
BASE = (
    Template("mit license", "mit", "mit license", ("mit license",), base=True),
    Template("apache license", "apache", "apache license", ("apache license",), base=True),
    Template("general public license", "gpl", "general public license", ("general public license",), base=True),
)
#: Names of licences as notices give them.
NAMES = tuple(
    Template(f"name: {text}", label, text, (text,))
    for label, text in (
        ("agpl", "affero general public license"), ("apache-2.0", "apache license version 2 0"), ("apache-2.0", "apache 2 0"),
        ("boost-1.0", "boost software license"), ("bsd", "bsd license"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
        ("cc-by", "cc by 4 0"), ("cc-by", "creative commons attribution 4 0"), ("cc-by-nc", "cc by nc"), ("cc-by-nc", "attribution noncommercial"),
        ("cc-by-nc-nd", "cc by nc nd"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nd", "cc by nd"), ("cc-by-sa", "cc by sa"),
        ("cc-by-sa", "attribution sharealike"), ("cc0", "cc0 1 0"), ("epl", "eclipse public license"), ("gpl-2.0", "general public license version 2"),
        ("gpl-2.0", "gpl 2 0"), ("gpl-2.0", "gplv2"), ("gpl-3.0", "general public license version 3"), ("gpl-3.0", "gpl 3 0"), ("gpl-3.0", "gplv3"),
        ("isc", "isc license"), ("lgpl", "lesser general public license"), ("mit", "license identifier mit"), ("mpl-2.0", "mozilla public license version 2 0"),
        ("mpl-2.0", "mpl 2 0"), ("zlib", "zlib license"),
    )
)
#: Clauses of licence texts; a fifth of the words may differ.
CLAUSES = (
    Template("agpl notice", "agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             ("gnu affero general public license", "free software foundation"), 0.8),
    Template("apache notice", "apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
             ("apache license version 2 0", "in compliance with the license"), 0.8),
    Template("boost grant", "boost-1.0", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
             ("person or organization", "covered by this license"), 0.8),
    Template("bsd conditions", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
             ("source and binary forms",), 0.8),
    Template("bsd endorsement", "bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission",
             ("endorse or promote products",), 0.8),
    Template("gpl notice", "gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
             ("gnu general public license", "free software foundation"), 0.8),
    Template("isc grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
             ("with or without fee",), 0.8),
    Template("lgpl notice", "lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             ("gnu lesser general public license", "free software foundation"), 0.8),
    Template("mit grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
             ("hereby granted free of charge", "associated documentation files"), 0.8),
    Template("mpl notice", "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",), 0.8),
    Template("public domain", "unlicense", "This is free and unencumbered software released into the public domain.", ("released into the public domain",), 0.8),
    Template("wtfpl permission", "wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
             ("changing it is allowed",), 0.8),
    Template("zlib liability", "zlib", "In no event will the authors be held liable for any damages arising from the use of this software.", ("held liable for any damages",), 0.8),
)
TEMPLATES = BASE + NAMES + CLAUSES
RESULTS = ("n_words", "places")


class Index:
    """Postings of the templates' rarest positions; rarer tells words' order, the rarest first."""

    def __init__(self, templates: tuple[Template, ...], rarer: dict[bytes, int]) -> None:
        self.templates = templates
        self.vocab: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.phrases: list[list[np.ndarray]] = []
        number = lambda ws: np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64)
        for t in templates:
            self.words.append(number(t.words))
            self.phrases.append([number(split(p.encode())) for p in t.phrases])
        self.meet = [min(2, t.need) for t in templates]
        self.postings: list[list[tuple[int, int]]] = [[] for _ in self.vocab]
        for k, t in enumerate(templates):
            rare = sorted(range(len(t.words)), key=lambda q: (rarer[t.words[q]], q))
            for q in rare[: len(t.words) - t.need + self.meet[k]]:
                self.postings[self.words[k][q]].append((k, q))
        self.looked_up = np.array([bool(p) for p in self.postings] + [False])

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words) of every place, by start and template."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(self.looked_up[ids])
        if not len(at):
            return []
        met: Counter = Counter()
        for p, w in zip(at.tolist(), ids[at].tolist()):
            for k, q in self.postings[w]:
                met[k, p - q] += 1
        out = []
        for (k, start), n in met.items():
            if n < self.meet[k]:
                continue
            first, whole = max(start, 0), self.words[k]
            part = ids[first : start + len(whole)]
            same = int(np.count_nonzero(part == whole[first - start : first - start + len(part)]))
            if same >= self.templates[k].need and all(_within(part, p) for p in self.phrases[k]):
                out.append((k, start, same / len(whole)))
        return sorted(out, key=lambda x: (x[1], x[0]))


def _within(part: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(part) - len(phrase) + 1
    return n > 0 and bool(np.all([part[i : i + n] == w for i, w in enumerate(phrase)], axis=0).any())


def word_counts(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> DataFrame:
    """word, n_docs: in how many texts each template word stands; words in none are left out."""
    names = sorted({w for t in templates for w in t.words})

    def count(batches):
        vocab, seen = {w: i for i, w in enumerate(names)}, np.zeros(len(names), np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                found = set(map(vocab.get, split(t)))
                found.discard(None)
                seen[list(found)] += 1
        kept = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([names[i].decode() for i in kept], pa.string()), pa.array(seen[kept])], names=["word", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n_docs"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns plus n_words and places (template, label, base, start, words, coverage; by start).

    templates is a parameter of the call, not a table: its words, some hundreds, are what tasks hold and
    what the counts of the first pass return.
    """
    templates = tuple(t for t in templates if t.words)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    seen = {r.word.encode(): r.n_docs for r in word_counts(docs, templates, text).collect()}
    rarer = {w: seen.get(w, 0) for t in templates for w in t.words}

    def factory():
        index = Index(templates, rarer)
        label, base = [t.label for t in templates], [t.base for t in templates]
        kind = pa.list_(pa.struct([
            ("template", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32()), ("coverage", pa.float64()),
        ]))

        def fn(texts):
            n, found = [], []
            for t in texts:
                words = split(t)
                n.append(len(words))
                found.append([
                    {"template": templates[k].name, "label": label[k], "base": base[k], "start": s, "words": len(index.words[k]), "coverage": c}
                    for k, s, c in index.places(words)
                ])
            return [pa.array(n, pa.int64()), pa.array(found, kind)]

        return fn

    fields = "n_words bigint, places array<struct<template:string,label:string,base:boolean,start:bigint,words:int,coverage:double>>"
    return map_texts(docs, factory, fields, keep, text)
