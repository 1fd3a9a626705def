"""Line deduplication with a log-template tree.

Every line is parsed down a tree of fixed depth: by its number of tokens, then by its
leading tokens, each of which may be a variable field, to a leaf of the lines that may be
one template. Tokens with a digit are variable fields, ``<*>``, from the start. In a leaf,
lines merge by the share of equal positions: a line of n tokens has ``min(n, SEGMENTS)``
(12) segments, which are single tokens up to twelve, and a template of it leaves
``fields(segments)`` of them open, wherever they are: two fifths of them, at most three.
A line goes if

* the line itself recurs in ``min_docs`` (2) documents, whatever its length where it has no
  variable field;
* or a template that leaves segments open is that of lines in ``FIELD_DOCS`` (3) documents;
* or so is the line with all its capitalised words but the first generalised (names, places,
  titles), however many they are.

A template with variable fields needs ``min_constants`` constant tokens that make up half
of it. What recurs decides, not how often a name does, so the rule is the same at every size
of corpus. The document with the smallest id keeps its line (``keep_first``, so that no
content leaves the corpus altogether; without it, the line goes everywhere).

Scale: the choices of segments are not made for every line. A line's segments are cut into
one part more than a template leaves open, so lines that merge share a whole part (token
count, place and tokens). First, each line sends the hash of itself, of its generalised names
and of its (two to four) parts. Only lines with a part that another, different line has go to
the leaves: one row for each distinct line, however often it is copied, with the three
smallest of its documents (which say all that a template needs of them). There each makes its
templates (at most 220; a part that no other line has is open in all of them), which meet
by a last shuffle.

At each step, a task compares what it holds before it shuffles: of a template or part that
recurs within the task, only one row goes on under its hash, all others are decided. So the
commonest line reaches the shuffle about once a task, and the rest is spread by hash, sorted
by Spark (which spills) and streamed. Texts are shuffled once, to meet the numbers of their
dropped lines.

Defined cases: null and empty texts have no lines; blank lines are kept and belong to
no template; rows without an id come back unchanged and are not counted; rows
repeated under one id are one document; of different texts under one id, a line number
that goes in one goes in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.llm._common import SOLID, by_key, chunks, hash_of, hash_words, mix, odd_constants, raw_bytes, record, runs, signed, split_words, texts
from tessella.tables import cut

WILD = np.uint64(hash_of("<*>"))
_B = odd_constants(1, 61)[0]
_B_INVERSE = np.uint64(pow(int(_B), -1, 2**64))
#: Segments of a line, and how many of them a template leaves open at most.
SEGMENTS, OPEN = 12, 3
#: Documents in which a template with a word for a variable field recurs.
FIELD_DOCS = 3
#: Templates that a task compares with each other before the shuffle.
BUFFER = 1_500_000
#: What a row says: decided already; the hash of a line, of its generalised names, of a part; the same, known to recur; a line that has a shared part.
GONE, SAME, FIELD, PART, KNOWN, SHARED = 0, 1, 2, 3, 3, 7
_N = odd_constants(1, 62)[0]
#: What tells places of segments and parts apart.
_AT = odd_constants(SEGMENTS + OPEN + 1, 64)
#: What stands for each segment that a template leaves open.
_OPEN = odd_constants(SEGMENTS, 63)


def fields(segments):
    """How many of a line's segments its templates leave open, of a number or an array."""
    return np.minimum(OPEN, 2 * segments // 5)


_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """``base`` to the power of 0, 1, ...; kept, as long as the longest chunk needs."""
    if len(_tables.get(int(base), ())) < max(n, 1):
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _tables[int(base)] = np.multiply.accumulate(out)
    return _tables[int(base)][:n]


def _sums(x: np.ndarray, kind: type = np.int64) -> np.ndarray:
    out = np.zeros(len(x) + 1, kind)
    np.cumsum(x, dtype=kind, out=out[1:])
    return out


class Lines:
    """The lines with tokens of some texts: ``doc`` (its row), ``line`` (its number), ``n`` tokens, ``constants`` among them, and ``key``, a hash of the line."""

    def __init__(self, column: pa.Array):
        self.words = words = split_words(column, SOLID)
        h = hash_words(words)
        digits, breaks = np.flatnonzero((words.data >= 0x30) & (words.data <= 0x39)), np.flatnonzero(words.data == 0x0A)
        h[np.searchsorted(words.start, digits, "right") - 1] = WILD
        doc, line = words.doc_of(), np.searchsorted(breaks, words.start)
        self.hash, self.first = h, np.flatnonzero(runs(doc, line)) if len(h) else np.empty(0, np.int64)
        self.end = np.append(self.first[1:], len(h)).astype(np.int64)[: len(self.first)]
        self.n = self.end - self.first
        self.doc = doc[self.first]
        self.line = line[self.first] - np.searchsorted(breaks, raw_bytes(column)[1][self.doc])
        self.power, self.inverse = _powers(len(h), _B), _powers(len(h) + 1, _B_INVERSE)
        self._own, self._constant = _sums(h * self.power, np.uint64), _sums(h != WILD)
        self.whole, self.constants = self._own[self.end] - self._own[self.first], self.constants_of(self.first, self.end)
        self.key = mix(self.whole * self.inverse[self.first] + self.n.astype(np.uint64) * _N)

    def content(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the tokens from ``a`` up to ``b``, wherever they stand."""
        return (self._own[b] - self._own[a]) * self.inverse[a]

    def constants_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._constant[b] - self._constant[a]

    def bounds(self, of: np.ndarray, part: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last token of segments ``part // parts`` of lines; ``parts`` may differ by line."""
        n, first = self.n[of], self.first[of]
        return first + part * n // parts, first + (part + 1) * n // parts

    def mergeable(self, min_constants: int) -> np.ndarray:
        """Lines that have segments to leave open, and constants enough besides."""
        return np.flatnonzero((self.n > OPEN) & enough(self.constants, self.n, min_constants))


def enough(constants: np.ndarray, n: np.ndarray, min_constants: int) -> np.ndarray:
    return (constants >= min_constants) & (2 * constants >= n)


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Lines]]:
    for batch in chunks(batches):
        ids = batch.column(0)
        batch = batch.filter(ids.is_valid()) if ids.null_count else batch
        found = Lines(batch.column(1))
        if len(found.n):
            yield batch.column(0).to_numpy()[found.doc], found


def templates(batches: Iterator[pa.RecordBatch], min_constants: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, document, line, kind) of every line, its names generalised, and its parts (the line's key and the part's number in place of document and line), a chunk at a time."""
    for ids, of in _with_ids(batches):
        rows = []

        def add(key: np.ndarray, owner: np.ndarray, line: np.ndarray, kind: int, rows=rows):
            rows.append((mix(key + np.uint64(kind)), owner, line, np.full(len(key), kind, np.int8)))

        use = enough(of.constants, of.n, min_constants) | (of.constants == of.n)
        add(of.key[use], ids[use], of.line[use], SAME)
        words, h = of.words, of.hash
        capital = (words.data[words.start] >= 0x41) & (words.data[words.start] <= 0x5A) & (h != WILD)
        capital[of.first] = False
        names, shed = _sums(capital), _sums(np.where(capital, (h - WILD) * of.power, np.uint64(0)), np.uint64)
        names, shed = names[of.end] - names[of.first], shed[of.end] - shed[of.first]
        use = (names > 0) & enough(of.constants - names, of.n, min_constants)
        add(((of.whole - shed) * of.inverse[of.first] + of.n.astype(np.uint64) * _N)[use], ids[use], of.line[use], FIELD)
        some = of.mergeable(min_constants)
        segments = np.minimum(of.n[some], SEGMENTS)
        for k in range(OPEN + 1):
            has = np.flatnonzero(k <= fields(segments))
            i, s = some[has], segments[has]
            a, b = (of.first[i] + (j * s // (fields(s) + 1)) * of.n[i] // s for j in (k, k + 1))
            add(of.content(a, b) + of.n[i].astype(np.uint64) * _N + _AT[SEGMENTS + k], signed(of.key[i]), np.full(len(i), k), PART)
        yield tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def decide(key: np.ndarray, doc: np.ndarray, line: np.ndarray, kind: np.ndarray, min_docs: int, keep_first: bool) -> tuple[np.ndarray, ...]:
    """Distinct rows sorted by (key, doc): their columns, whether their template recurs among them, whether their line goes, whether they are of the template's first document."""
    order = np.lexsort((line, doc, key))
    key, doc, line, kind = key[order], doc[order], line[order], kind[order]
    at = np.flatnonzero(runs(key))
    known = np.maximum.reduceat(kind, at) > KNOWN if len(at) else np.empty(0, np.bool_)
    size = np.diff(np.append(at, len(key)))
    known, once = np.repeat(known, size), runs(key, doc, line)
    key, doc, line, kind, known = key[once], doc[once], line[once], kind[once], known[once]
    new = runs(key)
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    docs = np.add.reduceat(runs(key, doc).astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    base = np.where(kind > KNOWN, kind - KNOWN, kind)
    need = np.array([0, min_docs, FIELD_DOCS, 2])[base]
    recurs = known | (docs[group] >= need)
    is_first = doc == doc[at][group]
    return key, doc, line, base, recurs, recurs & (~is_first | (base == PART) if keep_first else np.ones(len(key), np.bool_)), is_first


def seed(batches: Iterator[pa.RecordBatch], min_docs: int, min_constants: int, keep_first: bool, buffer: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, line, kind): what a task has decided, and what it must compare with other tasks."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        if not held:
            return
        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        key, doc, line, kind, recurs, gone, is_first = decide(*joined, min_docs, keep_first)
        open_ = ~recurs | is_first
        rows = [(key[open_], doc[open_], line[open_], np.where(recurs, kind + KNOWN, kind)[open_])]
        for how, which in ((GONE, gone & (kind != PART)), (SHARED, gone & (kind == PART))):
            done = np.unique(np.stack([doc[which], line[which]], 1), axis=0) if which.any() else np.empty((0, 2), np.int64)
            rows.append((mix(done[:, 0].astype(np.uint64) + done[:, 1].astype(np.uint64)), done[:, 0], done[:, 1], np.full(len(done), how)))
        rows = [np.concatenate(x) for x in zip(*rows, strict=True)]
        for a in range(0, len(rows[0]), 500_000):
            k, d, n, how = (x[a : a + 500_000] for x in rows)
            yield record(key=signed(k), doc_id=d, line=n, kind=how.astype(np.int32))

    for found in templates(batches, min_constants):
        held.append(found)
        if sum(len(x[0]) for x in held) >= buffer:
            yield from flush()
    yield from flush()


def settle(rows: list[np.ndarray], min_docs: int, keep_first: bool) -> pa.RecordBatch:
    """Of all rows under some keys: (doc_id, line) of the lines that go; the keys of lines with a shared part, as ``doc_id``, and the part."""
    key, doc, line, kind = rows
    done = (kind == GONE) | (kind == SHARED)
    _, own, at, base, _, goes, _ = decide(key[~done], doc[~done], line[~done], kind[~done], min_docs, keep_first)
    shared = np.concatenate([kind[done] == SHARED, base[goes] == PART])
    return record(doc_id=np.concatenate([doc[done], own[goes]]), line=np.concatenate([line[done], at[goes]]), shared=shared)


# ---------------------------------------------------------------- leaves


def _smallest(key: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (key, doc, line), each once, and the rank of their document under their key, from 0; those of the first document and one of the second and third."""
    order = np.lexsort((line, doc, key))
    key, doc, line = key[order], doc[order], line[order]
    new_doc, new_key = runs(key, doc), runs(key)
    count = np.cumsum(new_doc)
    rank = count - np.repeat(count[new_key], np.diff(np.append(np.flatnonzero(new_key), len(key))))
    keep = runs(key, doc, line) & ((rank == 0) | ((rank < FIELD_DOCS) & new_doc))
    return order[keep], rank[keep]


def to_leaves(batches: Iterator[pa.RecordBatch], min_constants: int, buffer: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, line, n, segments, constants) of the lines that may merge: hashes of their segments, and how many constants each has."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        if held:
            key, doc, line, n, hashes, constants = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keep, _ = _smallest(key, doc, line)
            for a in range(0, len(keep), 50_000):
                i = keep[a : a + 50_000]
                packed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(w), len(i), [None, pa.py_buffer(np.ascontiguousarray(x[i]).tobytes())]).cast(pa.binary()) for w, x in ((8 * SEGMENTS, hashes), (4 * SEGMENTS, constants))]
                yield record(key=key[i], doc_id=doc[i], line=line[i], n=n[i], segments=packed[0], constants=packed[1])

    for ids, of in _with_ids(batches):
        some = of.mergeable(min_constants)
        parts = np.minimum(of.n[some], SEGMENTS)
        hashes, constants = np.zeros((len(some), SEGMENTS), np.uint64), np.zeros((len(some), SEGMENTS), np.int32)
        for k in range(SEGMENTS):
            has = np.flatnonzero(k < parts)
            a, b = of.bounds(some[has], k, parts[has])
            hashes[has, k] = mix(of.content(a, b) + _AT[k])
            constants[has, k] = of.constants_of(a, b)
        held.append((signed(of.key[some]), ids[some], of.line[some], of.n[some], hashes, constants))
        if SEGMENTS * sum(len(x[0]) for x in held) >= buffer:
            yield from flush()
    yield from flush()


def merge(key: np.ndarray, doc: np.ndarray, line: np.ndarray, second: np.ndarray, third: np.ndarray, known: np.ndarray, keep_first: bool) -> tuple[np.ndarray, ...]:
    """The order of rows by (key, doc); in it, whether their template is of lines in FIELD_DOCS documents, whether their line goes, whether they are of its first document."""
    order = np.lexsort((line, doc, key))
    key, doc = key[order], doc[order]
    new = runs(key)
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    docs = np.concatenate([doc, second[order], third[order]])
    of = np.concatenate([group] * 3)
    by = np.lexsort((docs, of))
    count = np.bincount(of[by][runs(of[by], docs[by])], minlength=len(at))
    known = np.logical_or.reduceat(known[order], at) if len(at) else np.empty(0, np.bool_)
    recurs = ((count >= FIELD_DOCS) | known)[group]
    is_first = doc == doc[at][group]
    return order, recurs, recurs & ~is_first if keep_first else recurs, is_first


def in_leaves(rows: list[np.ndarray]) -> pa.RecordBatch:
    """(doc_id, line, n, second, third, shared, segments, constants): the distinct lines under some keys that have shared parts, where their first document has them."""
    key, doc, line, n, hashes, constants = rows
    marked = n == 0
    new = runs(key)
    shared = np.bitwise_or.reduceat(np.where(marked, line, 0), np.flatnonzero(new))[np.cumsum(new) - 1] if len(key) else line
    here = ~marked & (shared > 0)
    key, doc, line, n, shared, hashes, constants = (x[here] for x in (key, doc, line, n, shared, hashes, constants))
    keep, rank = _smallest(key, doc, line)
    own, new = keep[rank == 0], runs(key[keep])
    number = np.cumsum(new) - 1
    docs = np.repeat(doc[keep][new][:, None], FIELD_DOCS, 1)
    docs[number, rank] = doc[keep]
    docs = docs[number[rank == 0]]
    return record(doc_id=doc[own], line=line[own], n=n[own], second=docs[:, 1], third=docs[:, 2], shared=shared[own], segments=pa.array(hashes[own], pa.binary()), constants=pa.array(constants[own], pa.binary()))


def leaves(batches: Iterator[pa.RecordBatch], min_constants: int, keep_first: bool, size: int = 3000) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, line, second, third, kind): the templates of lines; what recurs among those of ``size`` lines is decided."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            doc, line, n, second, third, shared, hashes, constants = (c.to_numpy(zero_copy_only=False) for c in batch.slice(start, size).columns)
            hashes = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, SEGMENTS)
            constants = np.frombuffer(b"".join(constants), np.int32).reshape(-1, SEGMENTS)
            found = []
            segments = np.minimum(n, SEGMENTS)
            for s in np.unique(segments).tolist():
                these = np.flatnonzero(segments == s)
                total, rest = hashes[these].sum(1, dtype=np.uint64) + n[these].astype(np.uint64) * _N, constants[these].sum(1)
                parts = int(fields(s)) + 1
                part_of = [max(k for k in range(parts) if k * s // parts <= i) for i in range(s)]
                for chosen in combinations(range(s), parts - 1):
                    c, closed = list(chosen), sum(1 << k for k in range(parts) if k not in {part_of[i] for i in chosen})
                    use = np.flatnonzero((closed & ~shared[these] == 0) & enough(rest - constants[these][:, c].sum(1), n[these], min_constants))
                    i = these[use]
                    template = total[use] + _OPEN[c].sum(dtype=np.uint64) - hashes[i][:, c].sum(1, dtype=np.uint64)
                    found.append((mix(template), i))
            key, i = (np.concatenate(x) for x in zip(*found, strict=True))
            order, recurs, goes, is_first = merge(key, doc[i], line[i], second[i], third[i], np.zeros(len(i), np.bool_), keep_first)
            key, i = key[order], i[order]
            on, gone = ~recurs | is_first, np.unique(i[goes])
            at = np.concatenate([i[on], gone])
            spread = mix(doc[gone].astype(np.uint64) + line[gone].astype(np.uint64))
            kind = np.concatenate([np.where(recurs, FIELD + KNOWN, FIELD)[on], np.full(len(gone), GONE)]).astype(np.int32)
            yield record(key=signed(np.concatenate([key[on], spread])), doc_id=doc[at], line=line[at], second=second[at], third=third[at], kind=kind)


def settle_leaves(rows: list[np.ndarray], keep_first: bool) -> pa.RecordBatch:
    """(doc_id, line) of the lines that go, of all templates under some keys."""
    key, doc, line, second, third, kind = rows
    gone = kind == GONE
    key, own, at, second, third, kind = (x[~gone] for x in (key, doc, line, second, third, kind))
    order, _, goes, _ = merge(key, own, at, second, third, kind > KNOWN, keep_first)
    return record(doc_id=np.concatenate([doc[gone], own[order][goes]]), line=np.concatenate([line[gone], at[order][goes]]))


# ---------------------------------------------------------------- the operator


def rebuild(batches: Iterator[pa.RecordBatch], text: str, gone: str) -> Iterator[pa.RecordBatch]:
    """The input with the kept text, the number of lines and the number of dropped lines in place of ``gone``."""
    for batch in batches:
        names = batch.schema.names
        kept, n_lines, n_dropped = [], [], []
        for t, drop in zip(batch.column(names.index(text)).to_pylist(), batch.column(names.index(gone)).to_pylist(), strict=True):
            lines = t.split("\n") if t else []
            n_lines.append(len(lines))
            if drop:
                drop = set(drop)
                lines = [x for k, x in enumerate(lines) if k not in drop]
                t = "\n".join(lines)
            kept.append(t)
            n_dropped.append(n_lines[-1] - len(lines))
        columns = {c: batch.column(i) for i, c in enumerate(names) if c != gone} | {text: pa.array(kept, pa.string())}
        yield record(**columns, __n_lines=pa.array(n_lines, pa.int64()), __n_dropped=pa.array(n_dropped, pa.int64()))


def repeated_lines(docs: DataFrame, *, min_docs: int = 2, min_constants: int = 3, keep_first: bool = True, buffer: int = BUFFER) -> DataFrame:
    """``(doc_id, lines)``: numbers, from 0, of the lines to drop; ``docs``: (doc_id, text)."""
    rows = docs.mapInArrow(lambda it: seed(it, min_docs, min_constants, keep_first, buffer), "key long, doc_id long, line long, kind int")
    first = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: by_key(it, lambda x: settle(x, min_docs, keep_first)), "doc_id long, line long, shared boolean")
    first = cut(first, "recurring")
    empty = F.lit(b"")
    marks = first.where("shared").select(F.col("doc_id").alias("key"), F.expr("shiftleft(1L, int(line))").alias("part")).groupBy("key").agg(F.bit_or("part").alias("line"))
    marks = marks.select("key", F.lit(0).cast("long").alias("doc_id"), "line", F.lit(0).cast("long").alias("n"), empty.alias("segments"), empty.alias("constants"))
    found = docs.mapInArrow(lambda it: to_leaves(it, min_constants, buffer), "key long, doc_id long, line long, n long, segments binary, constants binary")
    parsed = found.unionByName(marks).repartition("key").sortWithinPartitions("key")
    merged = parsed.mapInArrow(lambda it: leaves(by_key(it, in_leaves), min_constants, keep_first), "key long, doc_id long, line long, second long, third long, kind int")
    second = merged.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: by_key(it, lambda x: settle_leaves(x, keep_first)), "doc_id long, line long")
    gone = first.where("not shared").select("doc_id", "line").unionByName(second)
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """``docs`` with the kept lines as its text, and ``__n_lines`` and ``__n_dropped`` as further columns; ``rules`` of :func:`repeated_lines`."""
    gone = repeated_lines(texts(docs, id_col, text_col), **rules).select(F.col("doc_id").alias("__gone_id"), F.col("lines").alias("__gone"))
    joined = docs.join(gone, docs[id_col].cast("long") == gone["__gone_id"], "left").select(*[docs[c] for c in docs.columns], "__gone")
    schema = StructType([*docs.schema.fields, StructField("__n_lines", LongType()), StructField("__n_dropped", LongType())])
    return joined.mapInArrow(lambda it: (b.select(schema.names) for b in rebuild(it, text_col, "__gone")), schema)
