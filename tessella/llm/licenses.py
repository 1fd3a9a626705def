"""License scan with a positional index of rare words.

Templates are licence statements. Each has one mandatory key phrase; of the phrase's
words, the two with the highest inverse document frequency over all documents (ties: the
earlier word) stand for the template. The index has, for each word, postings (template,
position in it) of the templates for which it is the rarest. A file's licence words are
looked up there, so the work follows the file's rare words, not the number of templates;
each posting gives an alignment (the word's place less the template's position), at which
the template's second rare word must stand too, and then the whole key phrase, word for
word. The template's remaining words only add to the score: the share of its words that
match at the alignment.

Scale: two scans (word statistics of the index vocabulary, then the look-up), no
shuffle of texts; what is collected is one count for each word of the templates.

Defined cases: null and empty texts have no words, no places, no labels (empty
strings) and score 0; repeated rows give repeated results; overlapping places count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import ALNUM, chunks, hash_of, hash_words, ranges, record, split_words, texts


class Template(NamedTuple):
    label: str
    words: str
    key: str
    base: bool = False


#: Fixed phrases of the base scan, and statements that the method adds.
BASE = [
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
]
EXTRA = [
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "released under cc0 1 0 universal", "cc0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    Template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    Template("cc", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    Template("gfdl", "under the terms of the gnu free documentation license", "gnu free documentation license"),
    Template("epl", "available under the terms of the eclipse public license", "eclipse public license"),
    Template("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("zlib", "this software is provided as is without any express or implied warranty", "provided as is without any express or implied warranty"),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("artistic", "under the terms of the artistic license", "artistic license"),
    Template("ofl", "this font software is licensed under the sil open font license", "open font license"),
    Template("odbl", "made available under the open database license", "open database license"),
    Template("eupl", "licensed under the european union public license", "european union public license"),
    Template("public-domain", "dedicated to the public domain", "dedicated to the public domain"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
TEMPLATES = BASE + EXTRA
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words.split()})


class _Lookup:
    """Numbers of the vocabulary's words, 0 for all others."""

    def __init__(self, vocab: list[str]):
        h = np.array([hash_of(w) for w in vocab], np.uint64)
        order = np.argsort(h)
        self.hashes, self.number = h[order], order.astype(np.int32) + 1

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], 0)


def count_documents(batches: Iterator[pa.RecordBatch], vocab: list[str]) -> Iterator[pa.RecordBatch]:
    lookup, df, n = _Lookup(vocab), np.zeros(len(vocab) + 1, np.int64), 0
    for batch in chunks(batches):
        words = split_words(batch.column(0), ALNUM, lower=True)
        number = lookup(hash_words(words))
        seen = np.flatnonzero(number)
        pairs = np.unique(words.doc_of()[seen] * (len(vocab) + 1) + number[seen])
        df += np.bincount(pairs % (len(vocab) + 1), minlength=len(vocab) + 1)
        n += batch.num_rows
    df[0] = n
    yield record(number=np.arange(len(df)), df=df)


def inverse_document_frequency(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) of each word of the templates."""
    vocab = vocabulary(templates)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda it: count_documents(it, vocab), "number long, df long")
    df = {r.number: r.df for r in counts.groupBy("number").agg(F.sum("df").alias("df")).collect()}
    return {w: math.log((1 + df.get(0, 0)) / (1 + df.get(i + 1, 0))) for i, w in enumerate(vocab)}


class Index(NamedTuple):
    """``first[w]:first[w + 1]`` are the postings of word number w; the other arrays have a row for each template."""

    vocab: list[str]
    templates: list[Template]
    first: np.ndarray
    template: np.ndarray
    second: np.ndarray  # (word, position) of the second rare word
    rare: np.ndarray  # position of the rarest
    words: np.ndarray  # numbers of all words, padded with -1
    size: np.ndarray
    key: np.ndarray  # (position, length) of the key phrase


def build_index(templates: list[Template], idf: dict[str, float]) -> Index:
    vocab = vocabulary(templates)
    number = {w: i + 1 for i, w in enumerate(vocab)}
    split = [(t.words.split(), t.key.split()) for t in templates]
    table = np.full((len(templates), max((len(w) for w, _ in split), default=1)), -1, np.int64)
    rarest, rare, second, spans = [], [], [], []
    for i, (words, key) in enumerate(split):
        at = next(j for j in range(len(words)) if words[j : j + len(key)] == key)
        order = sorted(range(len(key)), key=lambda j, key=key: (-idf.get(key[j], 0.0), j))
        table[i, : len(words)] = [number[w] for w in words]
        rarest.append(number[key[order[0]]])
        rare.append(at + order[0])
        second.append((number[key[order[min(1, len(key) - 1)]]], at + order[min(1, len(key) - 1)]))
        spans.append((at, len(key)))
    template = np.argsort(rarest, kind="stable")
    first = np.searchsorted(np.sort(rarest), np.arange(len(vocab) + 2))
    return Index(vocab, templates, first, template, np.array(second, np.int64).reshape(-1, 2), np.array(rare, np.int64), table, np.array([len(w) for w, _ in split], np.int64), np.array(spans, np.int64).reshape(-1, 2))


def alignments(number: np.ndarray, n: int, doc: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(template, place of its first word) wherever a template's key phrase stands within one text; ``number`` has a 0 more than the ``n`` words."""
    known = np.flatnonzero(number)
    count = (index.first[1:] - index.first[:-1])[number[known]]
    t = index.template[ranges(index.first[number[known]], count)]
    at = np.repeat(known, count) - index.rare[t]

    def keep(t: np.ndarray, at: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return t[use], at[use]

    start = at + index.key[t, 0]
    t, at = keep(t, at, (start >= 0) & (start + index.key[t, 1] <= n))
    t, at = keep(t, at, number[at + index.second[t, 1]] == index.second[t, 0])
    for j in range(int(index.key[t, 1].max(initial=0))):
        place = index.key[t, 0] + j
        inside = j < index.key[t, 1]
        t, at = keep(t, at, ~inside | (number[np.where(inside, at + place, n)] == index.words[t, np.where(inside, place, 0)]))
    start = at + index.key[t, 0]
    return keep(t, at, doc[start] == doc[start + index.key[t, 1] - 1])


def scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    lookup = _Lookup(index.vocab)
    base = np.array([t.base for t in index.templates], np.bool_)
    for batch in chunks(batches, "text"):
        words = split_words(batch.column(1), ALNUM, lower=True)
        n, n_docs, doc = len(words), batch.num_rows, words.doc_of()
        number = np.concatenate([lookup(hash_words(words)), [0]])
        t, at = alignments(number, n, doc, index)
        place = at + index.key[t, 0]
        of = doc[place]
        match = np.zeros(len(t))
        for j in range(int(index.size[t].max(initial=0))):
            spot = at + j
            inside = (j < index.size[t]) & (spot >= words.first[of]) & (spot < words.first[of + 1])
            match += inside & (number[np.where(inside, spot, n)] == index.words[t, j])
        score = np.zeros(n_docs)
        np.maximum.at(score, of, match / index.size[t])
        labels: list[list[set[str]]] = [[set() for _ in range(n_docs)] for _ in range(2)]
        for i, k in set(zip(of.tolist(), t.tolist(), strict=True)):
            labels[1][i].add(index.templates[k].label)
            if index.templates[k].base:
                labels[0][i].add(index.templates[k].label)
        own, spot = of[base[t]], place[base[t]]
        spot = spot - words.first[own]
        first, last = np.full(n_docs, np.iinfo(np.int64).max), np.full(n_docs, -1, np.int64)
        np.minimum.at(first, own, spot)
        np.maximum.at(last, own, spot)
        cells = [[sorted(x) for x in part] for part in labels]
        yield record(
            doc_id=batch.column(0), n_words=words.counts.astype(np.int64), n_base=np.bincount(own, minlength=n_docs).astype(np.int64),
            first_word=pa.array(first, mask=last < 0), last_word=pa.array(last, mask=last < 0),
            base_labels=pa.array(cells[0], pa.list_(pa.string())), labels=pa.array(cells[1], pa.list_(pa.string())), score=score,
        )


def scan_licenses(docs: DataFrame, *, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every document; labels are sorted arrays."""
    source = texts(docs, id_col, text_col)
    index = build_index(templates, inverse_document_frequency(source, templates))
    return source.mapInArrow(lambda it: scan(it, index), SCHEMA)
