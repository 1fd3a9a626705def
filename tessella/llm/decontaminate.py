"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

Every window of ``width`` consecutive words of a benchmark text is a pattern (a
shorter text is one pattern). For all patterns of one length ``m`` a shift table,
addressed by the hash of a block of two words, says how far the search may jump
before any pattern can end; where it says 0, the same block hash selects a bucket of
patterns that end in that block, and a direct comparison of bytes confirms an
occurrence.

Scale: documents are scanned once and never shuffled. Benchmark texts are cut into pieces
of at most ``PIECE`` words, which overlap by a window less one word; each distinct piece
counts once, with the ids of its items, at most ``IDS`` of them in one entry. Entries are
broadcast in blocks of about ``block_words`` words and ids, so that neither a huge text nor
one that many items repeat makes a large block, and tables have room for their patterns.
A benchmark beyond one block is searched block after block: each reads the texts again and
writes, without them, the stretches of words that it hits (the first block a row for every
document, the others only for those hit); they meet by id and hash of the text at the end.

Defined cases: a null text has no words; a null, empty or wordless benchmark text
is no pattern; an item without an id still marks words but is never listed; repeated
document rows give repeated result rows, repeated items count once; an empty benchmark
leaves all clean.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import ALNUM, chunks, hash_words, lists, record, split_words, texts
from tessella.tables import cut

#: Words of one piece of a benchmark text, and item ids of one entry.
PIECE, IDS = 2_000, 10_000
SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>"
#: What one of several blocks hits: stretches as first word and the word after the last, one after another.
_HITS = "doc_id long, text_key long, n_words long, spans array<int>, items array<long>"


class WuManber:
    """Patterns of exactly ``m`` words, as byte strings of space-joined words; ``search`` gives the places where they occur."""

    def __init__(self, m: int, patterns: list[tuple[bytes, np.ndarray]]):
        """patterns: the joined words and the words' hashes. The table has sixteen places for each word of theirs, 2^26 at most."""
        self.m, self.block = m, min(2, m)
        words = len(np.unique(np.concatenate([h for _, h in patterns]))) + len(patterns)
        self.bits = min(max(10, (16 * words - 1).bit_length()), 26)
        self.shift = np.full(1 << self.bits, min(m - self.block + 1, 255), np.uint8)
        self.buckets: dict[int, dict[bytes, int]] = defaultdict(dict)
        for k, (joined, hashes) in enumerate(patterns):
            at = self._blocks(hashes)
            # entry i is the block that ends at word i + block - 1: a pattern that holds it may end so many words later
            np.minimum.at(self.shift, at, np.minimum(len(at) - 1 - np.arange(len(at)), 255).astype(np.uint8))
            self.buckets[int(at[-1])].setdefault(joined, k)

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        mixed = h if self.block == 1 else h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words, h: np.ndarray) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence within the words of one text or of several; ``words`` gives bytes."""
        if len(h) < self.m:
            return []
        at = self._blocks(h)
        jumps, ends, i, n = self.shift[at].tobytes(), [], self.m - self.block, len(at)
        while i < n:
            jump = jumps[i]
            if jump:
                i += jump
            else:
                ends.append(i)
                i += 1
        found = []
        for i in ends:
            if bucket := self.buckets.get(int(at[i])):
                start = i + self.block - self.m
                k = bucket.get(b" ".join([words.bytes_of(x) for x in range(start, start + self.m)]))
                if k is not None:
                    found.append((start, k))
        return found


def patterns_of(pieces: list[str], width: int) -> list[tuple[WuManber, list[list[int]]]]:
    """One searcher for each pattern length, with the numbers of the pieces that have each of its patterns."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, list]]] = defaultdict(dict)
    for number, text in enumerate(pieces):
        words = split_words(pa.array([text], pa.string()), ALNUM, lower=True)
        h = hash_words(words)
        if n := len(words):
            m, all_words = min(n, width), [words.bytes_of(k) for k in range(n)]
            for k in range(n - m + 1):
                of = by_length[m].setdefault(b" ".join(all_words[k : k + m]), (h[k : k + m], []))[1]
                if not of or of[-1] != number:
                    of.append(number)
    return [(WuManber(m, [(p, h) for p, (h, _) in found.items()]), [of for _, of in found.values()]) for m, found in sorted(by_length.items())]


def cut_pieces(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    """(item_id, piece, n_words) of each piece of each text: its words, folded and joined by spaces."""
    for batch in chunks(batches):
        words = split_words(batch.column(1), ALNUM, lower=True)
        items, pieces, sizes = [], [], []
        for item, a, b in zip(batch.column(0).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            while a < b:
                end = min(a + size, b)
                items.append(item)
                pieces.append(b" ".join([words.bytes_of(k) for k in range(a, end)]).decode())
                sizes.append(end - a)
                a = b if end == b else end - width + 1
        yield record(item_id=pa.array(items, pa.int64()), piece=pa.array(pieces, pa.string()), n_words=pa.array(sizes, pa.int64()))


def entries_of(benchmark: DataFrame, width: int, piece: int = PIECE, ids: int = IDS) -> DataFrame:
    """``piece, part, n_words, items``: each distinct piece with its items' ids, in parts of about ``ids``."""
    pieces = cut(benchmark.mapInArrow(lambda it: cut_pieces(it, width, max(piece, width)), "item_id long, piece string, n_words long").distinct(), "pieces")
    many = pieces.groupBy("piece").agg(F.ceil(F.count("*") / ids).alias("parts")).where("parts > 1")
    parted = pieces.join(many, "piece", "left").withColumn("part", F.pmod(F.xxhash64("item_id"), F.coalesce("parts", F.lit(1))))
    return parted.groupBy("piece", "part").agg(F.max("n_words").alias("n_words"), F.collect_set("item_id").alias("items"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that cover the same places, in ascending order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    new = np.flatnonzero(np.append(True, start[1:] >= np.maximum.accumulate(end)[:-1]))
    return start[new], np.maximum.reduceat(end, new)


def scan(batches: Iterator[pa.RecordBatch], searchers, ids: list[list[int]], only: bool) -> Iterator[pa.RecordBatch]:
    """Documents with what a block's patterns hit: the number of words hit if it is the only block, else the stretches of them."""
    for batch in chunks(batches):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        words = split_words(column["text"], ALNUM, lower=True)
        h, doc, n_docs = hash_words(words), words.doc_of(), batch.num_rows
        starts, ends, hits = [np.empty(0, np.int64)], [np.empty(0, np.int64)], set()
        for searcher, pieces in searchers:
            found = np.array(searcher.search(words, h), np.int64).reshape(-1, 2)
            found = found[doc[found[:, 0]] == doc[found[:, 0] + searcher.m - 1]] if len(found) else found
            starts.append(found[:, 0])
            ends.append(found[:, 0] + searcher.m)
            hits.update((d, number) for d, k in set(zip(doc[found[:, 0]].tolist(), found[:, 1].tolist(), strict=True)) for number in pieces[k])
        pairs = sorted({(d, x) for d, number in hits for x in ids[number]})
        item_lists = lists(np.array([x for _, x in pairs], np.int64), np.bincount(np.array([i for i, _ in pairs], np.int64), minlength=n_docs))
        start, end = merged(np.concatenate(starts), np.concatenate(ends))
        of, n_words = doc[start], words.counts.astype(np.int64)
        if only:
            n_hit = np.bincount(of, end - start, n_docs).astype(np.int64)
            yield record(doc_id=column["doc_id"], n_words=n_words, n_hit=n_hit, items=item_lists)
        else:
            spans = np.stack([start, end], 1) - words.first[of][:, None]  # counted from the text's first word
            yield record(doc_id=column["doc_id"], text_key=column["text_key"], n_words=n_words, spans=lists(spans.astype(np.int32).ravel(), 2 * np.bincount(of, minlength=n_docs)), items=item_lists)


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words hit, from the stretches that all blocks have found."""
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        n_words = column["n_words"].to_numpy()
        spans = column["spans"].flatten().to_numpy().astype(np.int64).reshape(-1, 2)
        of = np.repeat(np.arange(batch.num_rows), column["spans"].value_lengths().to_numpy() // 2)
        base = np.cumsum(n_words) - n_words
        start, end = merged(spans[:, 0] + base[of], spans[:, 1] + base[of])
        n_hit = np.bincount(np.searchsorted(np.cumsum(n_words), start, "right"), end - start, batch.num_rows).astype(np.int64)
        yield record(doc_id=column["doc_id"], n_words=n_words, n_hit=n_hit, items=column["items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, block_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, items``: words covered by benchmark windows, and the sorted ids of the items they come from."""
    spark = docs.sparkSession
    entries = cut(entries_of(texts(benchmark, item_col, item_text_col).where("text is not null"), width), "entries")
    size = entries.agg(F.sum(F.col("n_words") + F.size("items"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_words))
    source = texts(docs, id_col, text_col)
    keyed = source.withColumn("text_key", F.xxhash64("text"))
    found = []
    for k in range(n_blocks):
        block = entries.where(F.pmod(F.xxhash64("piece", "part"), F.lit(n_blocks)) == k).select("piece", "items").collect()
        shared = spark.sparkContext.broadcast((patterns_of([r["piece"] for r in block], width), [r["items"] for r in block]))
        if n_blocks == 1:
            return source.mapInArrow(lambda it: scan(it, *shared.value, True), SCHEMA)
        hits = keyed.mapInArrow(lambda it, b=shared: scan(it, *b.value, False), _HITS)
        found.append(cut(hits if k == 0 else hits.where("size(spans) > 0").drop("n_words").distinct(), "hits"))
        shared.unpersist()
    every, *others = found
    later = reduce(DataFrame.unionByName, others).groupBy(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key"))
    later = later.agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
    both = every.join(later, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("text_key").eqNullSafe(F.col("__text_key")), "left")
    joined = {c: F.concat(c, F.coalesce(f"__{c}", F.array().cast(every.schema[c].dataType))) for c in ("spans", "items")}
    return both.select("doc_id", "n_words", joined["spans"].alias("spans"), F.array_sort(F.array_distinct(joined["items"])).alias("items")).mapInArrow(united, SCHEMA)
