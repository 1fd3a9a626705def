"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

A document's tokens (an end token counted) are cut into pieces of at most
``capacity``; a full piece is a bin of its own, the rest is packed. Within a shard,
pieces are placed longest first. Open bins are kept ordered by their residual room, with
two sets of bitmaps: which bins hold each source, and which hold each duplicate cluster.
A piece's search starts at the successor of its length, the tightest bin that can hold it,
and goes on to the next larger residual until a bin has neither its source's bit nor its
duplicate cluster's; if there is none, it opens a bin. So no sequence repeats a source
or holds two copies of one text.

A duplicate cluster is a set of documents with equal words, letter case aside.

Scale: a scan counts tokens; then only five numbers a document move, spread by a hash of
its id and its row into shards of about ``shard_docs`` rows, which are packed
independently: a shard is one group, and the search in it is bounded by its size,
whatever the number and sizes of sources and clusters, and however often an id or a text
repeats (bitmaps take at most the square of a shard's pieces in bits, 8 MB for 8,192).
Shards are dealt to as many tasks as there are shards, since their rows are so few bytes
that joining small tasks would put hundreds of shards in one. The loss is at most the few
half-empty bins of each shard.

Defined cases: null and empty texts are their end token alone; a null source
conflicts with none; wordless texts are no duplicates; ties go to the smaller id and
the older bin; rows repeated under one id, and rows without an id, are packed as separate
copies, spread over the shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import SOLID, chunks, hash_words, mix, odd_constants, record, signed, split_words
from tessella.llm.token_file import encoder, vocabulary_path
from tessella.tables import cut

#: An open bin is one number: its residual, then 32 bits for its own number.
_BIN = 0xFFFFFFFF
OUT = "shard int, bin int, doc_id long, piece int, n_tokens long, bin_start long"


def measure(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, n_tokens, cluster): the number of tokens with the end token, and a hash of the text's words (0: none)."""
    encode = encoder(vocabulary_path(vocabulary))
    for batch in chunks(batches):
        column = batch.column(1)
        _, n = encode.encode(column)
        words = split_words(column, SOLID, lower=True)
        h, counts = hash_words(words), words.counts
        cluster, full = np.zeros(len(counts), np.uint64), counts > 0
        if full.any():
            place = np.arange(len(h)) - np.repeat(words.first[:-1], counts)
            by = odd_constants(max(1024, 1 << int(counts.max()).bit_length()), 91)
            cluster[full] = mix(np.add.reduceat(h * by[place], words.first[:-1][full])) | np.uint64(1)
        yield record(doc_id=batch.column(0), source=batch.column(2), n_tokens=n + 1, cluster=signed(cluster))


def compatible(order: np.ndarray, lowest: int, holders: list[np.ndarray]) -> int:
    """The place in ``order`` of the first open bin from ``lowest`` on that no bitmap of ``holders`` has; -1 if there is none."""
    i, step = int(np.searchsorted(order, lowest)), 64
    if i == len(order):
        return -1
    if not any(held[(order[i] & _BIN) >> 3] >> (order[i] & 7) & 1 for held in holders):
        return i
    clash = np.unpackbits(np.bitwise_or.reduce(holders), bitorder="little")
    while i < len(order):
        of = clash[order[i : i + step] & _BIN]
        k = int(of.argmin())
        if not of[k]:
            return i + k
        i, step = i + step, 8 * step
    return -1


def best_fit(n_tokens: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each piece, in the order given; source or cluster -1 is none.

    Open bins are kept in one list ordered by (residual, bin). A source, and a cluster, that
    several pieces have keeps a bitmap of the bins that hold it, so that a search looks its two
    bits up for one bin, then for 64, 512, ... bins at once: whatever conflicts there are, it takes
    a few array operations on the open bins.
    """
    n_pieces = len(n_tokens)
    several = [{k for k, n in Counter(kinds).items() if n > 1 and k >= 0} for kinds in (sources, clusters)]
    held: tuple[dict[int, np.ndarray], ...] = ({}, {})
    order, n_open, bins, placed = np.empty(n_pieces, np.int64), 0, 0, []
    for n, *kinds in zip(n_tokens, sources, clusters, strict=True):
        holders = [of[k] for of, k in zip(held, kinds, strict=True) if k in of]
        i = compatible(order[:n_open], n << 32, holders)
        if i < 0:
            left, b, i = capacity, bins, n_open
            bins, n_open = bins + 1, n_open + 1
        else:
            left, b = int(order[i]) >> 32, int(order[i]) & _BIN
        for of, k, shared in zip(held, kinds, several, strict=True):
            if k in shared:
                of.setdefault(k, np.zeros(-(-n_pieces // 8), np.uint8))[b >> 3] |= 1 << (b & 7)
        placed.append((b, capacity - left))
        if left > n:
            key = left - n << 32 | b
            j = int(np.searchsorted(order[:i], key))
            order[j + 1 : i + 1] = order[j:i]
            order[j] = key
        else:
            order[i : n_open - 1] = order[i + 1 : n_open]
            n_open -= 1
    return placed


def pack_shard(key: tuple, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Every piece of a shard's documents with its bin and its place there."""
    rows = rows.sort_values(["n_tokens", "doc_id", "cluster", "row"], ascending=[False, True, True, True], na_position="first", kind="stable")
    full = (rows["n_tokens"] // capacity).to_numpy()
    rest = (rows["n_tokens"] % capacity).to_numpy()
    again = Counter(rows["cluster"].tolist())
    bit = {c: i for i, c in enumerate(c for c, n in again.items() if n > 1 and c)}
    kinds = {s: i for i, s in enumerate(rows["source"].dropna().unique())}
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    sources = [kinds.get(s, -1) for s in rows["source"].iloc[order].tolist()]
    clusters = [bit.get(c, -1) for c in rows["cluster"].iloc[order].tolist()]
    placed = np.array(best_fit(rest[order].tolist(), sources, clusters, capacity), np.int64).reshape(-1, 2)
    bins = int(placed[:, 0].max()) + 1 if len(placed) else 0
    own = np.repeat(np.arange(len(rows)), full)
    ids = rows["doc_id"].astype("Int64")
    pieces = pd.DataFrame({"bin": placed[:, 0], "doc_id": ids.iloc[order].array, "piece": full[order], "n_tokens": rest[order], "bin_start": placed[:, 1]})
    whole = pd.DataFrame({"bin": bins + np.arange(len(own)), "doc_id": ids.iloc[own].array, "piece": np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full), "n_tokens": capacity, "bin_start": 0})
    out = pd.concat([pieces, whole], ignore_index=True)
    out.insert(0, "shard", key[0])
    return out


def pack(docs: DataFrame, *, capacity: int = 4096, shard_docs: int = 8192, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``shard, bin, doc_id, piece, n_tokens, bin_start``: where each piece of each document goes."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[source_col].cast("string").alias("source"))
    sized = source.mapInArrow(lambda it: measure(it, vocabulary), "doc_id long, source string, n_tokens long, cluster long")
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")  # written once, so that a row keeps its number if a task runs again
    shards = max(1, math.ceil(sized.count() / shard_docs))
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return sharded.groupBy("shard").applyInPandas(lambda key, rows: pack_shard(key, rows, capacity), OUT)
