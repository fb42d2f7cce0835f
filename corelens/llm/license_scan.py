"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a run of up to WIDTH times as many words as the template has, wherever lines break: a notice wrapped in a comment's lines is one block.
Template T matches block B if |T and B| >= threshold * |T| over their word sets. Words are ordered
by how many lines of the whole corpus hold them, rarest first. With o = ceil(threshold * |T|), a match shares one of the
first |T| - o + 1 words of T (prefix filter), needs o words of the join's vocabulary in B (length filter), and from a first
common word at position i of B and j of T at most 1 + min(|B| - i - 1, |T| - j - 1) words can follow (positional filter).
A text whose own word set doesn't match T has no block that does, so these filters first run on whole texts; the blocks of a text that passes are verified exactly,
runs by a window that slides over the template's words. The result is that of the full join.

Templates are parameters of the job, so their index is of bounded size and goes to every task; documents are read twice,
once to count words of the templates' vocabulary and once to match, and only the counts are shuffled.

Defined cases: a null text is empty and has no words; an empty table gives an empty table; repeated rows give repeated,
equal rows; further columns are ignored; a template without words never matches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.session import bounded_batches

CONTAINMENT = 0.8
#: Words of a run for each word of the template.
WIDTH = 1.25

#: Phrases and labels of the base scan.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license notices.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"],
}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: Lower-cases A-Z and turns every other ASCII character but digits, letters and line feeds into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 10 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def fold(text: bytes) -> bytes:
    return text.translate(_FOLD)


class ContainmentIndex:
    """Prefix index of templates under one global order of words."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[bytes, int], threshold: float = CONTAINMENT):
        words_of = [(label, fold(t.encode()).split()) for label, texts in sorted(templates.items()) for t in texts]
        self.sets = [(label, frozenset(words)) for label, words in words_of if words]
        self.width = [int(WIDTH * len(words)) for _, words in words_of if words]
        self.vocabulary = vocabulary(templates)
        self.rank = {w: k for k, w in enumerate(sorted(self.vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.needed = [max(1, math.ceil(threshold * len(words) - 1e-9)) for _, words in self.sets]
        self.least = min(self.needed, default=0)
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.sets):
            for j, word in enumerate(sorted(words, key=self.rank.__getitem__)[: len(words) - self.needed[k] + 1]):
                self.prefix.setdefault(word, []).append((k, j))

    def candidates(self, found: frozenset[bytes]) -> list[tuple[int, int]]:
        """(template's number, common words) of every template that a block with these words of the vocabulary contains."""
        if not self.sets or len(found) < self.least:
            return []
        block = sorted(found, key=self.rank.__getitem__)
        tried: set[int] = set()
        out = []
        for i, word in enumerate(block):
            for k, j in self.prefix.get(word, ()):
                _, words = self.sets[k]
                if k in tried or len(block) < self.needed[k]:
                    continue
                tried.add(k)  # i, j is the first common word
                if 1 + min(len(block) - i - 1, len(words) - j - 1) >= self.needed[k] and (common := len(words & found)) >= self.needed[k]:
                    out.append((k, common))
        return out

    def matches(self, found: frozenset[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that a block with these words of the vocabulary contains."""
        return [(self.sets[k][0], common / len(self.sets[k][1])) for k, common in self.candidates(found)]

    def runs(self, k: int, words: list[bytes]) -> int:
        """The most different words of template k in a run of the words of a text."""
        own, width = self.sets[k][1], self.width[k]
        held: Counter[bytes] = Counter()
        places = [(i, w) for i, w in enumerate(words) if w in own]
        best = first = 0
        for i, w in places:
            held[w] += 1
            while i - places[first][0] >= width:
                gone = places[first][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                first += 1
            best = max(best, len(held))
        return best

    def blocks(self, folded: bytes, words: list[bytes], present: frozenset[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of the matches of a text's blocks."""
        tried = self.candidates(present & self.vocabulary)
        if not tried:
            return []
        out = [x for line in folded.split(b"\n") for x in self.matches(self.vocabulary.intersection(line.split()))]
        for k, _ in tried:
            if (common := self.runs(k, words)) >= self.needed[k]:
                out.append((self.sets[k][0], common / len(self.sets[k][1])))
        return out


def vocabulary(templates: dict[str, list[str]]) -> frozenset[bytes]:
    return frozenset(w for texts in templates.values() for t in texts for w in fold(t.encode()).split())


def word_frequencies(texts: DataFrame, words: frozenset[bytes]) -> dict[bytes, int]:
    """In how many blocks of the corpus each of the given words stands; tasks pre-aggregate, so a task yields at most len(words) rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in fold(text or b"").split(b"\n"):
                    if found := words.intersection(line.split()):
                        counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = texts.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every start of the phrase in words."""
    out, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                out.append(at)
    except ValueError:
        return out


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases and matched templates of each text; score: 1 with a base label, else the largest containment of a match, else 0."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    own = vocabulary(templates)
    index = ContainmentIndex(templates, word_frequencies(narrow.select("text"), own), threshold)
    phrases = [(phrase.encode().split(), label) for phrase, label in BASE_PHRASES.items()]
    watched = own | {w for phrase, _ in phrases for w in phrase}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text or b"")
                words = folded.split()
                present = frozenset(watched.intersection(words))
                places: list[int] = []
                base, labels, score = set(), set(), 0.0
                for phrase, label in phrases:
                    if present.issuperset(phrase) and (at := phrase_places(words, phrase)):
                        places += at
                        base.add(label)
                for label, containment in index.blocks(folded, words, present):
                    labels.add(label)
                    score = max(score, containment)
                rows.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score))
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]
    return narrow.mapInArrow(scanned, SCHEMA)


def oracle() -> str:
    """The same scan as SQL: every template against every line and every run of its width."""
    quoted = lambda words: ", ".join(f"({k}, '{label}', '{w}')" for k, label, ws in words for w in sorted(ws))
    templates = [(k, label, fold(t.encode()).decode().split()) for k, (label, t) in enumerate((label, t) for label, ts in TEMPLATES.items() for t in ts)]
    widths = ", ".join(f"({k}, {int(WIDTH * len(ws))})" for k, _, ws in templates)
    phrases = [(k, label, phrase.split()) for k, (phrase, label) in enumerate(BASE_PHRASES.items())]
    starts = " UNION ALL ".join(
        f"SELECT w0.r, '{label}' AS label, w0.i FROM u AS w0" + "".join(f" JOIN u AS w{j} ON w{j}.r = w0.r AND w{j}.i = w0.i + {j} AND w{j}.word = '{w}'" for j, w in enumerate(ws) if j) + f" WHERE w0.word = '{ws[0]}'"
        for _, label, ws in phrases
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
p AS ({starts}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM p GROUP BY r),
t(k, label, word) AS (VALUES {quoted([(k, label, set(ws)) for k, label, ws in templates])}),
size AS (SELECT k, label, count(*) AS n FROM t GROUP BY k, label),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS j FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
lw AS (SELECT DISTINCT r, j, unnest(regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM l),
tw AS (SELECT u.r, u.i, k, u.word FROM u JOIN t USING (word)),
whole AS (SELECT r, k FROM tw JOIN size USING (k) GROUP BY r, k, n HAVING 5 * count(DISTINCT word) >= 4 * n),
own AS (SELECT tw.*, width FROM tw JOIN whole USING (r, k) JOIN (VALUES {widths}) AS x(k, width) USING (k)),
run AS (SELECT a.r, a.i, a.k, count(DISTINCT b.word) AS c FROM own AS a JOIN own AS b ON b.r = a.r AND b.k = a.k AND b.i >= a.i AND b.i < a.i + a.width GROUP BY a.r, a.i, a.k),
block AS (SELECT r, k, count(*) AS c FROM lw JOIN t USING (word) GROUP BY r, j, k UNION ALL SELECT r, k, c FROM run),
hit AS (SELECT r, label, c / n::DOUBLE AS share FROM block JOIN size USING (k) WHERE 5 * c >= 4 * n),
best AS (SELECT r, max(share) AS share FROM hit GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM p) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CASE WHEN bl.labels IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d JOIN w USING (r) LEFT JOIN base USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN best USING (r)
"""
