"""Shared helpers of the training-data operators.

* :func:`texts` narrows any input table to the two columns an operator reads, so
  further columns, whatever their names, cannot clash with an operator's own.
* :func:`split_words` and :func:`hash_words` turn an Arrow text column into word
  boundaries and 64-bit word hashes with NumPy, whole texts at a time.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass handles; a longer single text is one pass of its own.
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- tables


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id BIGINT, text STRING)`` of any table; no other column is read."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


# ---------------------------------------------------------------- words


def byte_class(word: bytes | range | list[int]) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    table[list(word)] = True
    return table


#: Words are runs of these UTF-8 bytes. ALNUM: ASCII letters and digits and everything beyond ASCII. SOLID: all but ASCII white space.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
SOLID = byte_class([c for c in range(256) if c != 0x20 and not 0x09 <= c <= 0x0D])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_SEED = int(_RNG.integers(0, 2**63))
_place = np.empty(0, np.uint64)


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers; a longer list starts with the shorter one."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, np.uint64) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _place
    if len(_place) < n:
        _place = odd_constants(max(4096, 1 << (n - 1).bit_length()), _SEED)
    return _place


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass(frozen=True)
class Words:
    """Words of some texts: ``data[start:end]`` are a word's bytes; ``first[i]:first[i+1]`` are the words of text ``i``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, kind: np.ndarray, lower: bool = False) -> Words:
    """Words of each text, found byte-wise; ``lower`` folds A-Z only."""
    data, offsets = raw_bytes(column)
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    edges = offsets[1:-1][offsets[1:-1] < n]
    before = np.zeros(n, np.bool_)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(n, np.bool_)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = words.end - words.start
    at = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    inner = np.arange(int(size.sum())) - np.repeat(at, size)
    value = _BYTE[words.data[inner + np.repeat(words.start, size)]]
    value *= _places(int(size.max()))[inner]
    return mix(np.add.reduceat(value, at))


def hash_of(word: str | bytes) -> int:
    """:func:`hash_words` of one word."""
    word = word.encode() if isinstance(word, str) else word
    return int(hash_words(Words(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), np.array([0, 1])))[0])


def gram_hashes(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of every ``k`` consecutive entries of ``h`` (fewer entries: none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    by = odd_constants(k, seed)
    out = h[:n] * by[0]
    for j in range(1, k):
        out += h[j : j + n] * by[j]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0]+1, ...`` for each run of ``sizes``, one after another."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs in any key from the row before."""
    new = np.ones(len(keys[0]), np.bool_)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


# ---------------------------------------------------------------- batches


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches that hold about ``size`` bytes of text each, or one text; every row comes once."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        long = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(long + 16) - long - 16) // size
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Give freed memory back to the system: an idle Python worker otherwise keeps its largest task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent where the C library is not glibc
        if trim:
            trim(0)


def by_key(batches: Iterator[pa.RecordBatch], done: Callable[[list[np.ndarray]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``done`` of the columns of rows sorted by their first column; equal keys come together."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        held = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
        cut_at = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
        if cut_at:
            yield done([x[:cut_at] for x in held])
            held = [x[cut_at:] for x in held]
    if held:
        yield done(held)
    held = []
    release()


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from flat values and the number of them in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def sha_of_joined(column: str):
    """SHA-256 of the distinct ids of an array column, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(column, lambda x: x.cast("string"))), ","), 256)


def learnable(column: str = "doc_id"):
    """False for the fifth of the documents (by ``crc32`` of the id's text) whose labels are held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) != 0
