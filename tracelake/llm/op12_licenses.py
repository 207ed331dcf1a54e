"""License scan: an exact set-similarity join of license templates with all stretches of text.

A template is a short text, taken as the set of its words; a block of text is any stretch of consecutive words as long
as the template (plus some slack). A block meets a template if it contains at least a given share of the template's
words. One pass counts all words of templates over all texts; they are then ordered from rare to frequent. The join is
by filters that lose nothing:

* prefix: of m words, c of which must occur, a matching block has one of the m - c + 1 rarest; only blocks around an
  occurrence of such a word are looked at;
* length: a text in which fewer than c words of the template occur has no matching block;
* position: if an occurrence is the rarest word of its block, the others come behind it in the order; an occurrence with
  too few of those within reach is given up.

What passes is counted exactly. Phrases are templates that a block must contain whole, word by word and in order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table

SHARE = 0.8
SLACK = 0.25


class Template(NamedTuple):
    label: str
    text: str
    share: float = SHARE


# Fixed phrases and their labels, as the contract states them.
PHRASES = (Template("gpl", "gnu general public license", 1), Template("apache", "apache license", 1), Template("cc-by", "cc by", 1), Template("mit", "mit license", 1))

# Fixed wording of well-known license notices. Short names must be there whole.
NOTICES = (
    Template("agpl", "gnu affero general public license", 1),
    Template("lgpl", "gnu lesser general public license", 1),
    Template("mpl", "mozilla public license", 1),
    Template("bsd", "bsd license", 1),
    Template("cc-by-nc", "cc by nc", 1),
    Template("cc-by-nd", "cc by nd", 1),
    Template("cc-by-sa", "cc by sa", 1),
    Template("cc0", "cc0 public domain dedication", 1),
    Template("cc-by", "this work is licensed under a creative commons attribution international license"),
    Template("gpl", "this work is licensed under the gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: a-z, digits and all bytes of non-ASCII characters make words, A-Z is lower-cased, everything else separates.
_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


@dataclass(frozen=True)
class Block:
    """Words start to end (exclusive), and the share of the template's words in them."""

    template: int
    start: int
    end: int
    share: float


class Join:
    """Templates in the global order: the join's small side."""

    def __init__(self, templates: Iterable[Template], counts: dict[bytes, int], slack: float = SLACK):
        self.templates = list(templates)
        self.words = [words_of(t.text.encode()) for t in self.templates]
        order = sorted({w for own in self.words for w in own}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.sets = [sorted({self.rank[w] for w in own}) for own in self.words]
        self.least = [max(1, ceil(round(t.share * len(s), 9))) for t, s in zip(self.templates, self.sets)]
        self.length = [len(w) if t.share >= 1 else ceil(len(w) * (1 + slack)) for t, w in zip(self.templates, self.words)]
        self.place = [{r: i for i, r in enumerate(s)} for s in self.sets]
        self.ordered = [tuple(self.rank[w] for w in own) if t.share >= 1 else None for t, own in zip(self.templates, self.words)]
        self.by_prefix: dict[int, list[int]] = {}
        for k, (s, c) in enumerate(zip(self.sets, self.least)):
            for r in s[: len(s) - c + 1]:
                self.by_prefix.setdefault(r, []).append(k)

    def blocks(self, words: list[bytes]) -> Iterator[Block]:
        """All matching blocks of a text; of overlapping ones of a template the first with the largest share."""
        rank = self.rank
        places = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
        for k in sorted({k for _, r in places for k in self.by_prefix.get(r, ())}):
            own = [(i, self.place[k][r]) for i, r in places if r in self.place[k]]
            yield from self._phrase(k, words, own) if self.ordered[k] else self._notice(k, len(words), own)

    def _phrase(self, k: int, words: list[bytes], own: list[tuple[int, int]]) -> Iterator[Block]:
        """Places of the whole phrase, looked for where its rarest word stands (the prefix of a template needed whole)."""
        phrase, m = self.words[k], len(self.words[k])
        before = [i for i, w in enumerate(phrase) if self.place[k][self.rank[w]] == 0]
        for start in sorted({i - b for i, p in own if p == 0 for b in before}):
            if start >= 0 and words[start : start + m] == phrase:
                yield Block(k, start, start + m, 1.0)

    def _notice(self, k: int, n: int, own: list[tuple[int, int]]) -> Iterator[Block]:
        m, c, length = len(self.sets[k]), self.least[k], self.length[k]
        if len(own) < c:  # length
            return
        at = [i for i, _ in own]
        reach = lambda i: own[bisect_left(at, i - length + 1) : bisect_left(at, i + length)]
        rare = [i for i, p in own if p <= m - c and len({q for _, q in reach(i) if q >= p}) >= c]  # prefix, position
        found: list[tuple[int, int]] = []  # start and number of words, by start
        a = b = 0
        for start, stop in _near(rare, length, n):
            while a < len(own) and own[a][0] < start:
                a += 1
            b = max(a, b)
            inside = Counter(p for _, p in own[a:b])
            for i in range(start, stop):
                while a < len(own) and own[a][0] < i:
                    inside[own[a][1]] -= 1
                    if not inside[own[a][1]]:
                        del inside[own[a][1]]
                    a += 1
                while b < len(own) and own[b][0] < i + length:
                    inside[own[b][1]] += 1
                    b += 1
                if len(inside) >= c:
                    found.append((i, len(inside)))
        for run in _overlapping(found, length):
            i, most = max(run, key=lambda x: (x[1], -x[0]))
            yield Block(k, i, min(n, i + length), most / m)


def _near(rare: list[int], length: int, n: int) -> Iterator[tuple[int, int]]:
    """Starts of the blocks that hold one of the given places, as disjoint ranges; a text shorter than a block is one block."""
    last = max(1, n - length + 1)
    lo = hi = 0
    for i in rare:
        start, stop = max(0, min(i - length + 1, last - 1)), min(i + 1, last)
        if start > hi:
            if hi > lo:
                yield lo, hi
            lo, hi = start, stop
        else:
            hi = max(hi, stop)
    if hi > lo:
        yield lo, hi


def _overlapping(found: list[tuple[int, int]], length: int) -> Iterator[list[tuple[int, int]]]:
    """Cut a list by start where a block begins behind the end of the one before."""
    run = 0
    tagged = []
    for (i, c), before in zip(found, [None, *found]):
        run += before is not None and i >= before[0] + length
        tagged.append((run, (i, c)))
    for _, g in groupby(tagged, key=lambda x: x[0]):
        yield [x for _, x in g]


def word_counts(docs: DataFrame, templates: Iterable[Template]) -> dict[bytes, int]:
    """How often each word of the templates occurs in all texts. As many numbers come to the driver as templates have words."""
    vocabulary = {w for t in templates for w in words_of(t.text.encode())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(w for w in words_of(text.as_py() or b"") if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


FOUND = "doc_id long, n_words long, base array<struct<label string, start long>>, blocks array<struct<label string, start long, end long, share double>>"


def scan(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base (places of the phrases, by start) and blocks (stretches that meet a notice).

    Words count from 0. Null texts are empty; empty texts have no words and no finds. Rows with the same id are scanned
    each on its own, and columns other than doc_id and text are not read. A text may be of any length; all of it is
    scanned.
    """
    templates = (*phrases, *notices)
    join = Join(templates, word_counts(docs, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: dict[str, list] = {"n_words": [], "base": [], "blocks": []}
                for text in batch.column("text"):
                    words = words_of(text.as_py() or b"")
                    found = list(join.blocks(words))
                    rows["n_words"].append(len(words))
                    rows["base"].append(sorted(({"label": templates[b.template].label, "start": b.start} for b in found if b.template < len(phrases)), key=lambda x: (x["start"], x["label"])))
                    rows["blocks"].append([{"label": templates[b.template].label, "start": b.start, "end": b.end, "share": b.share} for b in found if b.template >= len(phrases)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows["n_words"], pa.int64()), pa.array(rows["base"], _BASE), pa.array(rows["blocks"], _BLOCKS)], ["doc_id", "n_words", "base", "blocks"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FOUND)


_BASE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    start = F.col("base.start")
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.share"), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), labels(F.col("base.label")).alias("base_labels"), labels(F.concat("base.label", "blocks.label")).alias("labels"), score.alias("score"))


_ROWS = ", ".join(f"({k}, '{t.label}', {k < len(PHRASES)}, {t.share >= 1}, string_split('{t.text}', ' '), {max(1, ceil(round(t.share * len(set(t.text.split())), 9)))}, {ceil(len(t.text.split()) * (1 + SLACK))})" for k, t in enumerate((*PHRASES, *NOTICES)))

# A block holds most of a template's words if it begins at one of them, so only such blocks are counted.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT * FROM (VALUES {_ROWS}) v(k, label, base, whole, ws, least, len)),
p AS (SELECT doc_id, i, w[i + 1] AS word FROM d, unnest(range(len(w))) u(i)),
h AS (SELECT p.doc_id, i, label, base FROM p JOIN t ON whole AND word = ws[1] JOIN d ON d.doc_id = p.doc_id WHERE w[i + 1 : i + len(ws)] = ws),
o AS (SELECT doc_id, k, i, word, len, least, len(list_distinct(ws)) AS m, label FROM p JOIN (SELECT *, unnest(list_distinct(ws)) AS own FROM t WHERE NOT whole) ON word = own),
e AS (SELECT doc_id, k FROM o GROUP BY doc_id, k, least HAVING count(DISTINCT word) >= least),
b AS (SELECT a.doc_id, a.label, count(DISTINCT z.word) / any_value(a.m)::DOUBLE AS share FROM o a SEMI JOIN e ON a.doc_id = e.doc_id AND a.k = e.k JOIN o z ON z.doc_id = a.doc_id AND z.k = a.k AND z.i >= a.i AND z.i < a.i + a.len
  GROUP BY a.doc_id, a.k, a.label, a.i HAVING count(DISTINCT z.word) >= any_value(a.least)),
f AS (SELECT doc_id, i, label, base, 1.0::DOUBLE AS share FROM h UNION ALL SELECT doc_id, NULL, label, false, share FROM b),
g AS (SELECT doc_id, count(*) FILTER (base) AS n, min(i) FILTER (base) AS lo, max(i) FILTER (base) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS own, string_agg(DISTINCT label, ',' ORDER BY label) AS every, max(share) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(own, '') AS base_labels, coalesce(every, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
