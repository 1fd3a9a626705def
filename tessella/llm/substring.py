"""Substring deduplication by seed and extend.

Anchors: of the ``length - gram + 1`` word grams in every window of ``length``
words, the one with the smallest hash (the rightmost of equals) is selected
(winnowing), so two documents that share a window share its anchor at the same
place in it. Occurrences of an anchor meet in one join on the anchor's hash. Each
carries a hash of all words of the windows that selected it, its block: where a
document with a smaller id has an equal block, the match covers all of it at once (the
inside of a long repeat). Where blocks of one anchor differ between documents (the ends
of repeats), the words around the occurrences meet under their anchor and are extended
both ways, word by word to the first mismatch, against the anchor's first occurrence, and
what is not covered then against the first one left, and so on; matches of at least
``length`` words are kept. Matches of one document that overlap unite to maximal
repeats, and these are removed.

Scale: a task compares what it holds before it shuffles, so that an anchor reaches the
shuffle about once a task, however common it is; what is left is spread by its hash,
sorted by Spark (which spills) and streamed. No step lists pairs of documents: after
``ROUNDS`` first occurrences, and for anchors of more than ``CROWD`` occurrences, windows
are compared by a 128-bit hash instead, which is spread and pre-compared like the
anchors. Texts are shuffled by ``doc_id`` twice: to meet the ends of repeats, and their
removed words.

Defined cases: a null text has no words; rows without an id are returned whole and
take no part; rows repeated under one id are one document; of different texts under one
id, what is removed from one place goes in all of them; texts shorter than ``length``
words are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import SOLID, by_key, chunks, gram_hashes, hash_words, mix, odd_constants, ranges, record, runs, signed, split_words, texts
from tessella.tables import cut

#: Occurrences, or windows, that a task compares with each other before the shuffle.
BUFFER = 1_500_000
#: First occurrences of one anchor against which the others are extended, and occurrences from which on an anchor's windows are spread instead.
ROUNDS, CROWD = 24, 10_000
ANNOUNCED, PROBE, REPEAT, EDGE = 0, 1, 2, 3
_SPOT = "doc_id long, at long, edge boolean, anchor long"
_MET = "key long, w2 long, doc_id long, at long, known boolean, around binary"
_B = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_B_INVERSE = np.uint64(pow(int(_B), -1, 2**64))


def occurrences(words, h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, extension, text, first window, windows) of each selected anchor of each text."""
    per = length - gram + 1
    g = gram_hashes(h, gram, 5)
    n = len(g) - per + 1
    doc = words.doc_of()
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    best, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, per):
        better = g[j : j + n] <= best
        np.copyto(best, g[j : j + n], where=better)
        at[better] = j
    start = np.flatnonzero(doc[:n] == doc[length - 1 : length - 1 + n])  # windows within one text
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    place, of = start + at[start], doc[start]
    new = np.ones(len(start), np.bool_)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    a, place, of = start[first], place[first], of[first]
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h), _B), out=sums[1:])
    end = a + count + length - 1
    extension = (sums[end] - sums[a]) * _powers(len(h), _B_INVERSE)[a]
    extension = mix(extension + ((place - a) * 64 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return g[place], extension, of, a - words.first[of], count


def compare(anchor: np.ndarray, extension: np.ndarray, doc: np.ndarray, at: np.ndarray, announced: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted occurrences, which of them repeat a smaller document's, and whether their anchor's extensions differ between documents."""
    order = np.lexsort((doc, extension, anchor))
    anchor, extension, doc, at = anchor[order], extension[order], doc[order], at[order]
    new = runs(anchor, extension)
    lowest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    repeat = doc > lowest
    new_anchor = runs(anchor)
    first = np.flatnonzero(new_anchor)
    group = np.cumsum(new_anchor) - 1
    several = (np.minimum.reduceat(lowest, first) < np.maximum.reduceat(lowest, first)) if len(first) else np.empty(0, np.bool_)
    several |= np.isin(anchor[first], announced)
    return anchor, extension, doc, at, repeat, several[group], first


def seed(batches: Iterator[pa.RecordBatch], length: int, gram: int, buffer: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        if not held:
            return
        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        anchor, extension, doc, at, repeat, several, first = compare(*joined, np.empty(0, np.uint64))
        kind = np.where(repeat, REPEAT, np.where(several, EDGE, PROBE)).astype(np.int32)
        said = first[several[first]]  # one row stands for all that a task has seen of an anchor with several extensions
        spread = mix(doc.astype(np.uint64) + at.astype(np.uint64))
        key, extension = np.where(kind == PROBE, anchor, spread), np.where(kind == EDGE, anchor, extension)
        for a in range(0, len(key), 500_000):
            s = slice(a, a + 500_000)
            yield record(key=signed(key[s]), extension=signed(extension[s]), doc_id=doc[s], at=at[s], kind=kind[s])
        none = np.zeros(len(said), np.int64)
        yield record(key=signed(anchor[said]), extension=none, doc_id=none, at=none, kind=np.full(len(said), ANNOUNCED, np.int32))

    for batch in chunks(batches):
        ids = batch.column(0)
        batch = batch.filter(ids.is_valid()) if ids.null_count else batch
        words = split_words(batch.column(1), SOLID)
        anchor, extension, of, first, count = occurrences(words, hash_words(words), length, gram)
        held.append((anchor, extension, batch.column(0).to_numpy()[of], first << 8 | count))
        if sum(len(x[0]) for x in held) >= buffer:
            yield from flush()
    yield from flush()


def extend(rows: list[np.ndarray]) -> pa.RecordBatch:
    """Repeats and ends of repeats, of all rows that concern some anchors."""
    key, extension, doc, at, kind = rows
    probe, known = kind == PROBE, kind >= REPEAT
    announced = np.unique(key[kind == ANNOUNCED])
    of, _, own, place, repeat, several, _ = compare(key[probe], extension[probe], doc[probe], at[probe], announced)
    use = repeat | several
    return record(
        doc_id=np.concatenate([doc[known], own[use]]), at=np.concatenate([at[known], place[use]]),
        edge=np.concatenate([kind[known] == EDGE, ~repeat[use]]), anchor=np.concatenate([extension[known], of[use]]),
    )


def later(w1: np.ndarray, w2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted windows, and which of them a smaller document has too."""
    order = np.lexsort((at, doc, w2, w1))
    w1, w2, doc, at = w1[order], w2[order], doc[order], at[order]
    new = runs(w1, w2)
    return w1, w2, doc, at, doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def around(batches: Iterator[pa.RecordBatch], length: int, gram: int, buffer: int) -> Iterator[pa.RecordBatch]:
    """Of texts with the ends of repeats in them, the words around each anchor, under the anchor; of crowded anchors the windows, ``at`` as of one window.

    Windows are compared within the task first, as anchors are: of a window that many
    documents have, one goes to the shuffle under its hash, the others are known.
    """
    held: list[tuple[np.ndarray, ...]] = []
    per = length - gram + 1

    def flush():
        if held:
            w1, w2, doc, at, known = later(*[np.concatenate(x) for x in zip(*held, strict=True)])
            held.clear()
            key = np.where(known, mix(doc.astype(np.uint64) + at.astype(np.uint64)), w1)
            for a in range(0, len(key), 500_000):
                s = slice(a, a + 500_000)
                yield record(key=signed(key[s]), w2=signed(w2[s]), doc_id=doc[s], at=at[s], known=known[s], around=pa.nulls(len(key[s]), pa.binary()))

    for batch in chunks(batches):
        words = split_words(batch.column(1), SOLID)
        h, spots = hash_words(words), batch.column(2)
        of = np.repeat(np.arange(batch.num_rows), np.diff(spots.offsets.to_numpy()))
        at, anchor, crowded = (spots.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "anchor", "crowded"))
        ids = batch.column(0).to_numpy()

        few = np.flatnonzero(~crowded)
        first, count = (at[few] >> 8) + words.first[of[few]], at[few] & 255
        g, place = signed(gram_hashes(h, gram, 5)), first.copy()
        for j in range(per):  # the rightmost gram of the first window that is the anchor
            place = np.where(g[first + j] == anchor[few], first + j, place)
        spot = place[:, None] + np.arange(1 - per, length)
        inside = (spot >= first[:, None]) & (spot < (first + count + length - 1)[:, None])
        table = np.where(inside, h[np.where(inside, spot, 0)], np.uint64(0)) if len(few) else np.empty((0, per - 1 + length), np.uint64)
        for a in range(0, len(few), 50_000):
            s = slice(a, a + 50_000)
            cells = pa.Array.from_buffers(pa.binary(), len(table[s]), [None, pa.py_buffer((np.arange(len(table[s]) + 1) * table.shape[1] * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(table[s]))])
            yield record(key=anchor[few][s], w2=(place - first)[s], doc_id=ids[of[few]][s], at=at[few][s], known=np.zeros(len(table[s]), np.bool_), around=cells)

        many = np.flatnonzero(crowded)
        start = ranges((at[many] >> 8) + words.first[of[many]], at[many] & 255)
        own = np.repeat(of[many], at[many] & 255)
        held.append((gram_hashes(h, length, 13)[start], gram_hashes(h, length, 14)[start], ids[own], (start - words.first[own]) << 8 | 1))
        if sum(len(x[0]) for x in held) >= buffer:
            yield from flush()
    yield from flush()


def matches(key: np.ndarray, off: np.ndarray, doc: np.ndarray, at: np.ndarray, table: np.ndarray, length: int, gram: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, at) of the matches of occurrences with documents that have a smaller id; ``off``: words of the first window before the anchor, ``table``: words around it."""
    order = np.lexsort((at, doc, key))
    key, off, doc, at, table = key[order], off[order], doc[order], at[order], table[order]
    per, group = length - gram + 1, np.cumsum(runs(key)) - 1
    place, count, row = (at >> 8) + off, at & 255, np.arange(len(key))
    before = np.arange(per)  # words of a window before the anchor
    need = (before > (off - count)[:, None]) & (before <= off[:, None])
    led, docs, found = np.zeros(len(key), np.bool_), [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(of: np.ndarray, low: np.ndarray, high: np.ndarray):
        docs.append(doc[of])
        found.append((place[of] - high) << 8 | (high - low + 1))

    for _ in range(rounds):
        open_ = np.flatnonzero(need.any(1) & ~led)
        if not len(open_):
            break
        leaders = open_[runs(group[open_])]  # the first occurrence of each anchor that is not all covered
        led[leaders] = True
        lead = np.full(group[-1] + 1, -1)
        lead[group[leaders]] = leaders
        of = open_[doc[open_] > doc[lead[group[open_]]]]
        same = table[of] == table[lead[group[of]]]
        left = np.logical_and.accumulate(same[:, per - 2 :: -1] if per > 1 else same[:, :0], axis=1).sum(1)
        right = np.logical_and.accumulate(same[:, per - 1 + gram :], axis=1).sum(1)
        low, high = np.maximum(off[of] - count[of] + 1, per - 1 - right), np.minimum(off[of], left)
        covered = need[of] & (before >= low[:, None]) & (before <= high[:, None]) & same[:, per - 1 : per - 1 + gram].all(1)[:, None]
        new = covered.any(1)
        add(of[new], low[new], high[new])
        need[of] &= ~covered
    rest, ahead = np.nonzero(need & ~led[:, None])  # windows that no leader has: compared by hash
    if len(rest):
        words = table[rest[:, None], (per - 1 - ahead)[:, None] + np.arange(length)]
        w1, w2 = (mix((words * odd_constants(length, seed)).sum(1)) for seed in (13, 14))
        _, _, _, which, again = later(w1 + group[rest].astype(np.uint64), w2, doc[rest], np.arange(len(rest)))
        which = which[again]
        add(rest[which], ahead[which], ahead[which])
    return np.concatenate(docs), np.concatenate(found)


def settle(rows: list[np.ndarray], length: int, gram: int, rounds: int) -> pa.RecordBatch:
    """(doc_id, at) of the matches, and of the windows that a smaller document has too, of all rows under some keys."""
    key, w2, doc, at, known, words = rows
    some = np.array([x is not None for x in words], np.bool_)
    open_ = ~known & ~some
    _, _, own, place, repeat = later(key[open_], w2[open_], doc[open_], at[open_])
    table = np.frombuffer(b"".join(words[some].tolist()), np.uint64).reshape(-1, 2 * length - gram)
    of, spot = matches(key[some], w2[some], doc[some], at[some], table, length, gram, rounds) if some.any() else (np.empty(0, np.int64),) * 2
    return record(doc_id=np.concatenate([doc[known], own[repeat], of]), at=np.concatenate([at[known], place[repeat], spot]))


def finish(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        spots = batch.column(2).to_pylist()
        kept, n_words, n_removed = [], [], []
        for text, spot in zip(raw, spots, strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if spot:
                spot = np.array(spot, np.int64)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, spot >> 8, 1)
                np.add.at(change, (spot >> 8) + (spot & 255) + length - 1, -1)
                stay = np.cumsum(change[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield record(doc_id=batch.column(0), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), kept=pa.array(kept, pa.binary()).cast(pa.string()))


def drop_repeats(docs: DataFrame, *, length: int = 13, gram: int = 5, buffer: int = BUFFER, rounds: int = ROUNDS, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of windows that a document with a smaller id has too."""
    source = texts(docs, id_col, text_col)
    seeds = source.mapInArrow(lambda it: seed(it, length, gram, buffer), "key long, extension long, doc_id long, at long, kind int")
    spots = cut(seeds.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: by_key(it, extend), _SPOT), "spots")

    edges = spots.where("edge").select("doc_id", "at", "anchor")
    crowded = cut(edges.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor", F.lit(True).alias("crowded")), "crowded")
    ends = edges.join(crowded, "anchor", "left").groupBy("doc_id").agg(F.collect_set(F.struct("at", "anchor", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("spots"))
    met = source.join(ends, "doc_id").select("doc_id", "text", "spots").mapInArrow(lambda it: around(it, length, gram, buffer), _MET)
    repeats = met.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: by_key(it, lambda x: settle(x, length, gram, rounds)), "doc_id long, at long")

    removed = spots.where("not edge").select("doc_id", "at").unionByName(repeats).groupBy("doc_id").agg(F.collect_set("at").alias("spots"))
    return source.join(removed, "doc_id", "left").select("doc_id", "text", "spots").mapInArrow(lambda it: finish(it, length), "doc_id long, n_words long, n_removed long, kept string")
