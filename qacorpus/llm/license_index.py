"""License scans by a positional index of rare template words (operator 11)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Phrases whose every place counts, with their labels. Fixed values of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Beginnings and notices of public licences: label, text, mandatory phrases. Fixed texts.
TEMPLATES = [
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version", ["affero general public license", "version 3"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["redistribution and use in source and binary forms", "must retain the above copyright notice"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["endorse or promote products", "specific prior written permission"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt", ["boost software license"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 2 of the License or at your option any later version", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["with or without fee", "permission notice appear in all copies"]),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation either version 2.1 of the License or at your option any later version", ["lesser general public license", "version 2 1"]),
    ("mit-notice", "Released under the MIT License", ["under the mit license"]),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "without restriction"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one", ["mozilla public license v 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications", ["in no event will the authors be held liable", "including commercial applications"]),
]

SPANS = "doc_id long, n_words long, spans array<struct<label:string,base:boolean,first:long,last:long,score:double>>"
_SPAN = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str) -> list[bytes]:
    """The words of a text: A-Z in lower case; digits, a-z and all beyond ASCII make words."""
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def _ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-case bytes begin and end."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def _codes(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 8 bytes of each word, its last 8 where it has more, and its length: all of a word of up to 16 bytes."""
    n = end - begin
    at = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))
    head = at[begin] & _LOW[np.minimum(n, 8)]
    return head, np.where(n > 8, at[np.maximum(end - 8, 0)], np.uint64(0)), n


class Index:
    """Positional postings of all words of phrases and templates; a word's number is its place in `words`.

    Words of over 16 bytes have no postings: a template or phrase with one is refused.
    """

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, list[str]]] = TEMPLATES):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.templates = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in templates]
        every = [w for p, _ in self.phrases for w in p] + [w for _, t, keys in self.templates for x in (t, *keys) for w in x]
        if any(len(w) > 16 for w in every) or any(not p for p, _ in self.phrases) or any(not t or not keys for _, t, keys in self.templates):
            raise ValueError("phrases, templates and their mandatory phrases need words, of at most 16 bytes")
        self.words = sorted(set(every))
        number = {w: k for k, w in enumerate(self.words)}
        self.phrases = [(np.array([number[w] for w in p]), label) for p, label in self.phrases]
        self.templates = [(label, np.array([number[w] for w in t]), [np.array([number[w] for w in k]) for k in keys]) for label, t, keys in self.templates]
        #: For each template its distinct words, each with all its positions: the postings.
        self.postings = [{int(w): np.flatnonzero(t == w) for w in np.unique(t)} for _, t, _ in self.templates]
        self.member = np.zeros((len(self.templates), len(self.words)), np.float32)
        for row, p in zip(self.member, self.postings):
            row[list(p)] = 1
        self.sizes = self.member.sum(1)
        data = b" ".join(self.words)
        self.head, self.tail, self.length = _codes(data, *_ends(data))
        key = self._mixed(self.head, self.tail, self.length)
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.key >> np.uint64(48)] = True

    @staticmethod
    def _mixed(head: np.ndarray, tail: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (head * _MIX[0]) ^ (tail * _MIX[1] + n.astype(np.uint64) * _MIX[0])

    def numbers(self, text: bytes, block: int = 1 << 20) -> np.ndarray:
        """The number of each word of a text, -1 for words the index lacks; a block at a time, each up to a word's end."""
        out, at = [], 0
        while at < len(text):
            to = at + block
            while to < len(text) and _IN_WORD[text[to] | 32 if 65 <= text[to] <= 90 else text[to]]:
                to += 1
            data = text[at:to].lower()
            begin, end = _ends(data)
            head, tail, n = _codes(data, begin, end)
            key = self._mixed(head, tail, n)
            found = np.full(len(begin), -1, np.int16)
            some = np.flatnonzero(self.maybe[key >> np.uint64(48)] & (n <= 16))
            place = self.order[np.minimum(np.searchsorted(self.key, key[some]), len(self.key) - 1)]
            same = (self.head[place] == head[some]) & (self.tail[place] == tail[some]) & (self.length[place] == n[some])
            found[some[same]] = place[same]
            out.append(found)
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.int16)

    def places(self, numbers: np.ndarray, wanted: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Where a phrase stands: the postings of its rarest word, kept where all its other words stand beside it."""
        rare = int(np.argmax(idf[wanted]))
        at = np.flatnonzero(numbers == wanted[rare]) - rare
        at = at[(at >= 0) & (at + len(wanted) <= len(numbers))]
        for k in np.argsort(-idf[wanted], kind="stable"):
            at = at[numbers[at + k] == wanted[k]]
        return at

    def scan(self, numbers: np.ndarray, idf: np.ndarray, rare: int = 8, share: float = 0.75, slack: int = 8) -> list[tuple[str, bool, int, int, float]]:
        """(label, base, first word, last word, score) of every place of phrases and templates in a file, by its words.

        Of the words of a template, of which the file must have half, the `rare` with the highest idf in the file are
        looked up. A place is where at least `share` of as many as the template has to look up agree on its beginning
        within `slack` words (for names and line marks put in), and every mandatory phrase stands within it, or `slack`
        words about it. Its score is the agreeing share. Of places within one another's slack the first with the highest
        score counts.
        """
        have = np.zeros(len(self.words), np.float32)
        have[numbers[numbers >= 0]] = 1
        out = [(label, True, a, a + len(p) - 1, 1.0) for p, label in self.phrases if have[p].all() for a in self.places(numbers, p, idf).tolist()]
        shared = self.member @ have
        for t in np.flatnonzero(shared >= np.maximum(share * np.minimum(rare, self.sizes), self.sizes / 2)):
            label, template, keys = self.templates[t]
            must = [self.places(numbers, k, idf) for k in keys]
            if not all(len(m) for m in must):
                continue
            mine = sorted((w for w in self.postings[t] if have[w]), key=lambda w: (-idf[w], w))[:rare]
            votes, voters = [], []
            for v, w in enumerate(mine):
                offsets = (np.flatnonzero(numbers == w)[:, None] - self.postings[t][w][None, :]).ravel()
                votes.append(offsets)
                voters.append(np.full(len(offsets), v))
            vote, voter = np.concatenate(votes), np.concatenate(voters)
            most = min(rare, len(self.postings[t]))
            found: dict[int, float] = {}
            for shift in (0, slack // 2):  # two rasters: agreeing votes share a cell of one of them
                cell = (vote + shift) // slack
                order = np.lexsort((vote, cell))
                cells, first, size = np.unique(cell[order], return_index=True, return_counts=True)
                agree = np.unique(np.unique(cell * rare + voter) // rare, return_counts=True)[1]
                good = agree >= share * most
                for begin, n in zip(vote[order][(first + size // 2)[good]].tolist(), agree[good].tolist()):
                    found[begin] = max(found.get(begin, 0.0), n / most)
            last = None
            for begin in sorted(found):
                low, high = begin - slack, begin + len(template) + slack
                if all(np.searchsorted(m, high - len(k) + 1) > np.searchsorted(m, low) for m, k in zip(must, keys)):
                    span = (label, False, max(begin, 0), min(begin + len(template), len(numbers)) - 1, found[begin])
                    if last is not None and begin - last <= slack and out[-1][0] == label:
                        if span[4] > out[-1][4]:
                            out[-1] = span
                    else:
                        out.append(span)
                    last = begin
        return out


def word_idf(docs: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """The number of documents and the idf of each word of the index over all of them. What the driver sees is one sum
    per word of the index; each task sums before."""

    def of(batches):
        total, seen = 0, np.zeros(len(index.words), np.int64)
        for batch in slices(batches):
            for text in utf8(batch.column("text")):
                numbers = index.numbers(text)
                seen[np.unique(numbers[numbers >= 0])] += 1
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(seen)), pa.int32()), pa.array(np.append(total, seen), pa.int64())], names=["word", "n"])

    sums = dict(docs.select("text").mapInArrow(of, "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    n, df = sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(len(index.words))], float)
    return n, np.log((1 + n) / (1 + df))


def spans(docs: DataFrame, index: Index | None = None, rare: int = 8, share: float = 0.75, slack: int = 8) -> DataFrame:
    """(doc_id, n_words, spans) of every row of docs (doc_id, text): where base phrases and licence templates stand, by
    word (from 0), with label and score, ordered by first word.

    Words are runs of digits, letters a-z (A-Z in lower case) and anything beyond ASCII; bytes count, so broken UTF-8 is
    no error. A null or empty text has no words and an empty list. Repeated rows have a row each; equal spans of two
    templates with one label count once; other columns are left out. Idf is counted over all rows of docs. The result
    doesn't depend on it for base phrases, whose places are exact.
    """
    index = index or Index()
    _, idf = word_idf(docs, index)

    def of(batches):
        for batch in slices(batches):
            counts, ends, rows = [], [0], []
            for text in utf8(batch.column("text")):
                numbers = index.numbers(text)
                counts.append(len(numbers))
                if (numbers >= 0).any():
                    rows += sorted(set(index.scan(numbers, idf, rare, share, slack)), key=lambda r: (r[2], r[3], r[0], r[1]))
                ends.append(len(rows))
            columns = [pa.array([r[k] for r in rows], _SPAN.field(k).type) for k in range(5)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPAN)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), listed], names=["doc_id", "n_words", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, SPANS)


def labelled(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """spans() by document: n_base places of base phrases, first and last word where one begins (null without any),
    base_labels, labels, and score: the best of its templates, at least 0.5 with a base phrase, else 0."""
    base = F.filter("spans", lambda s: s["base"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    best = F.array_max(F.transform("spans", lambda s: F.when(s["base"], 0.5).otherwise(s["score"])))
    first = F.transform(base, lambda s: s["first"])
    return spans(docs, index).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        names(base).alias("base_labels"), names("spans").alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )
