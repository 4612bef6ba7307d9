"""License scans as an exact set-similarity join of text blocks with license templates.

A template is a phrase, whose words must stand one after another, or a notice: any run of words a quarter longer than the notice (its block) that holds at least
``threshold`` of its distinct words is found, with the best share as its score.

1. Words of whole documents are looked up among the templates' words; a document is cut into chunks of ``core`` words and as many more as the longest block, so that every
   block lies whole in the chunk where it starts. A chunk keeps the templates' words it holds, and where.
2. Words are ordered by the number of chunks that hold them, over all documents, rarest first. A template's prefix is so many of its rarest words that a chunk
   without any of them can't reach the threshold. Chunks meet templates by equal prefix words; the length filter drops chunks with too few template words at all,
   the positional filter those where too few words follow the first common one in either's order.
3. What is left is verified exactly: blocks are slid over the words' places, phrases are compared word by word.

All templates together are a parameter of bounded size (``MOST_TEMPLATES``), so the index of prefixes is broadcast. A word that every document holds makes one row a
chunk, and is no prefix word where there are rarer ones.

Defined cases: null and empty texts have no words and no labels: zeros, nulls and ''. Rows with the same doc_id and text are each returned with the same result; null
doc_ids are ids like others; an empty table gives an empty result; other columns are not read. Very long texts are cut like others; one text must fit in a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, keyed, range_hashes, slices, stash, tidy, unstash

MOST_TEMPLATES, MOST_WORDS = 10_000, 400
#: Words of a chunk that are its own, at least.
CORE = 64
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return [w.decode() for w in words_of(self.text)[0]]

    @property
    def need(self) -> int:
        """Distinct words that a block must hold."""
        n = len(set(self.words))
        return n if self.phrase else max(1, math.ceil(n * self.threshold - 1e-9))

    @property
    def span(self) -> int:
        """Words of its block."""
        return len(self.words) if self.phrase else len(self.words) + len(self.words) // 4


#: Phrases that are labels by themselves.
BASE = (
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
)
# fixed values: notices that licenses ask for or are known by
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("mit", "Released under the MIT License", 1.0),
    Template("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", 1.0),
    Template("gpl-2", "licensed under the GNU General Public License, version 2", 1.0),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", 1.0),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", 1.0),
    Template("cc-by-nc", "Licensed under CC BY-NC", 1.0),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)


def words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of a text, and their hashes."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends = _edges(data)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)], range_hashes(data, starts, ends)


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(_IN_WORD[data].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    """All words of templates; a word's number is its place."""
    if len(templates) > MOST_TEMPLATES or any(not 0 < len(t.words) <= MOST_WORDS for t in templates):
        raise ValueError(f"up to {MOST_TEMPLATES} templates of 1 to {MOST_WORDS} words")
    return sorted({w for t in templates for w in t.words})


def _chunks(vocabulary: list[str], core: int, over: int):
    """(doc_id, k, h, text) -> rows of chunks with their template words; the first of each document is always there and has its number of words."""
    known = np.array([words_of(w)[1][0] for w in vocabulary], np.uint64)
    order = np.argsort(known)
    known, sizes = known[order], np.array([len(w.encode()) for w in vocabulary])[order]

    @tidy
    def run(batches):
        for whole in batches:
            for b in slices(whole, column=3):
                raw = [t.encode() for t in b.column(3).to_pylist()]
                data = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
                starts, ends = _edges(data)
                first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
                n = np.diff(first)
                h = range_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero((known[at] == h) & (sizes[at] == ends - starts))
                doc = np.searchsorted(first, hit, "right") - 1
                place, word = hit - first[doc], order[at[hit]]
                chunk = place // core
                again = (place % core < over) & (chunk > 0)
                # a first chunk of no words stands for each document
                docs = np.concatenate([np.arange(len(raw)), doc, doc[again]])
                chunks = np.concatenate([np.zeros(len(raw), np.int64), chunk, chunk[again] - 1])
                places, words = np.concatenate([np.full(len(raw), -1), place, place[again]]), np.concatenate([np.zeros(len(raw), np.int64), word, word[again]])
                by = np.lexsort((places, chunks, docs))
                docs, chunks, places, words = docs[by], chunks[by], places[by], words[by]
                heads = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (chunks[1:] != chunks[:-1])])) if len(docs) else np.zeros(0, int)
                real = places >= 0
                offsets = np.concatenate([[0], np.cumsum(real)])[np.append(heads, len(docs))]
                of = pa.array(docs[heads])
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[real], kind)) for x, kind in ((words, pa.int32()), (places, pa.int64()))]
                count = pa.array(n[docs[heads]], pa.int64(), mask=chunks[heads] != 0)
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(of) for i in range(3)], count, pa.array(chunks[heads], pa.int64()), *lists], names=["doc_id", "k", "h", "n_words", "chunk", "words", "places"])

    return run


def _verify(templates: tuple[Template, ...], vocabulary: list[str], core: int):
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches):
        made = [([number[w] for w in t.words], set(number[w] for w in t.words)) for t in templates]
        for b in batches:
            out = []
            for k, h, chunk, which, words, places in zip(*[b.column(i).to_pylist() for i in range(6)]):
                t, (spelt, distinct) = templates[which], made[which]
                if t.phrase:
                    at = dict(zip(places, words))
                    found = [p for p in places if p // core == chunk and all(at.get(p + i) == w for i, w in enumerate(spelt))]
                    if found:
                        out.append((k, h, t.label, True, 1.0, len(found), min(found), max(found)))
                    continue
                have: dict[int, int] = {}
                best = left = 0
                pairs = [(p, w) for p, w in zip(places, words) if w in distinct]
                for p, w in pairs:
                    have[w] = have.get(w, 0) + 1
                    while pairs[left][0] <= p - t.span:
                        gone = pairs[left][1]
                        have[gone] -= 1
                        if not have[gone]:
                            del have[gone]
                        left += 1
                    best = max(best, len(have))
                if best >= t.need:
                    out.append((k, h, t.label, False, best / len(distinct), 0, None, None))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["k", "h", "label", "phrase", "score", "places", "first", "last"])

    return run


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """A row for each row of docs(doc_id, text), written: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; phrases are the base."""
    spark, names = docs.sparkSession, vocabulary(templates)
    span = max(t.span for t in templates)
    core = max(CORE, span)
    chunks = stash(keyed(docs).mapInArrow(_chunks(names, core, span - 1), "doc_id long, k long, h long, n_words long, chunk long, words array<int>, places array<long>"), "chunks")
    # a row for each word of the templates
    counted = {r["w"]: r["n"] for r in chunks.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = sorted(range(len(names)), key=lambda i: (counted.get(i, 0), names[i]))
    rank = {i: r for r, i in enumerate(ranked)}
    index = []
    for which, t in enumerate(templates):
        own = sorted({rank[names.index(w)] for w in t.words})
        index += [(r, which, i, len(own), t.need) for i, r in enumerate(own[: len(own) - t.need + 1])]
    prefixes = spark.createDataFrame(index, "r int, which int, i int, size int, need int")
    numbers = F.expr("array(" + ", ".join(str(rank[i]) for i in range(len(names))) + ")")
    starts = F.expr("array(" + ", ".join(map(str, sorted({r for r, *_ in index}))) + ")")
    ranks = F.array_sort(F.array_distinct(F.transform("words", lambda w: F.get(numbers, w))))
    rows = chunks.where("size(words) > 0").select("k", "h", "chunk", "words", "places", ranks.alias("ranks")).where(F.size("ranks") >= min(t.need for t in templates)).where(F.arrays_overlap("ranks", starts))
    rows = rows.select("k", "h", "chunk", "words", "places", F.size("ranks").alias("held"), F.posexplode("ranks").alias("j", "r"))
    met = rows.join(F.broadcast(prefixes), "r").where("held >= need")
    # repeated rows give the same chunk and count once
    met = met.groupBy("k", "h", "chunk", "which").agg(F.min(F.struct("i", "j")).alias("at"), *[F.first(c).alias(c) for c in ("held", "size", "need", "words", "places")])
    near = met.where("1 + least(size - 1 - at.i, held - 1 - at.j) >= need").select("k", "h", "chunk", "which", "words", "places")
    found = near.mapInArrow(_verify(templates, names, core), "k long, h long, label string, phrase boolean, score double, places long, first long, last long")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  templates bound the set
    of = found.groupBy("k", "h").agg(F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"), joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("score").alias("score"))
    out = chunks.where("n_words is not null").select("doc_id", "k", "h", "n_words").join(of.hint("merge"), ["k", "h"], "left")
    blank = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    done = stash(out.select("doc_id", "n_words", *[F.coalesce(c, blank[c]).alias(c) if c in blank else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")]), "licenses")
    unstash(chunks)
    return done


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs)
