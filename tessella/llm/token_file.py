"""Token ids of a corpus in a compact binary file, and back.

Texts are encoded with a public tokenizer; an end id closes each document. Ids are
replaced by their rank of frequency over the whole corpus (ties: the smaller id), so
that the commonest ids take one byte: a rank is stored in its least number of bytes,
1 to 4, and the numbers of bytes, two bits each and four to a control byte, in a
stream of their own. Decoding looks up, for each control byte in a table of 256
rows, where the bytes of its four ranks lie, and gathers all of them with NumPy.

The file is a folder with two Parquet tables, which Spark writes and commits, so
that a lost executor leaves nothing half-written: ``blocks`` (shard, block, tokens
before it in the shard and in it, document ids, tokens of each document, control bytes, data
bytes), in ascending ``doc_id`` order, and ``ranks`` (rank, id).

Scale: texts are encoded once, the ids written as 16- or 32-bit integers; they are
shuffled once, in coded form, by range of ``doc_id``. What is collected to the
driver and broadcast is one number for each id of the vocabulary, and in reading one
number for each shard. Blocks hold about ``block_tokens`` tokens or one document.

Defined cases: a null text is empty; an empty text is its end id alone; an empty
corpus is an empty file; rows without an id come first; rows repeated under one id
are written one after another, in the order of their ids' bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import SOLID, Words, byte_class, chunks, hash_words, ranges, record, split_words, texts
from tessella.tables import cut, new_path

BLOCKS = "shard int, block int, before long, tokens long, doc_ids binary, missing binary, sizes binary, control binary, data binary"


# ---------------------------------------------------------------- text to ids


#: Bytes of plain words: letters (with the lead byte of Latin-1 letters) and punctuation that is never part of a contraction or a special token.
_LETTER = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3])
_MARK = byte_class([ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"])


def pieces(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Parts of the texts whose ids, one after another, are the texts' ids; and which parts are whole words, not plain.

    Plain words, of ASCII and Latin-1 letters and punctuation, fall into runs of either,
    in lower case; any other word is left as it is.
    """
    words = split_words(column, SOLID)
    data, n = words.data, len(words.data)
    if not len(words):
        return words, np.empty(0, np.bool_)
    latin = np.zeros(n, np.bool_)  # second bytes of Latin-1 letters
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter = _LETTER[data] | latin
    bad = np.concatenate([[0], np.cumsum(~(letter | _MARK[data]), dtype=np.int32)])
    plain = bad[words.end] == bad[words.start]
    inside = np.zeros(n + 1, np.int8)
    inside[words.start[plain]] += 1
    inside[words.end[plain]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(np.bool_)
    capital = inside & ((data >= 0x41) & (data <= 0x5A) | latin & (data <= 0x9E))
    low = data + (capital * np.uint8(0x20)).astype(np.uint8)
    first = np.zeros(n, np.bool_)
    first[1:] = (letter[1:] != letter[:-1]) & inside[1:] & inside[:-1]
    first[words.start] = True
    start = np.flatnonzero(first)
    word = np.searchsorted(words.start, start, "right") - 1
    end = np.minimum(np.append(start[1:], n), words.end[word])
    at = np.searchsorted(start, np.append(words.start, n)[words.first])
    return Words(low, start, end, at), ~plain[word]


class WordEncoder:
    """Encodes texts by parts (:func:`pieces`) with a memory of the parts seen.

    Only for tokenizers that drop white space, never join across it, and split words
    into runs of letters and of punctuation. New parts are encoded by the library, many
    plain ones at once: each is one pre-token, which ends with an end-of-word id. The
    memory is sorted arrays of 64-bit hashes, at most about ``LIMIT`` of them.
    """

    LIMIT = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.n_ids = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.n_ids, np.bool_)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids, self.used = np.empty(1 << 20, np.int32), 0

    def _encode(self, items: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)] if items else []

    def _ids_of(self, plain: list[str], other: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after another, and how many each has."""
        ids, sizes = [], []
        for a in range(0, len(plain), 512):
            group = plain[a : a + 512]
            found = np.array(self._encode([" ".join(group)])[0], np.int32)
            stop = np.flatnonzero(self.ends[found]) + 1
            if len(stop) != len(group):  # not what this tokenizer promises: one by one
                each = self._encode(group)
                found, stop = np.array([i for e in each for i in e], np.int32), np.cumsum([len(e) for e in each])
            ids.append(found)
            sizes.append(np.diff(stop, prepend=0))
        each = self._encode(other)
        ids.append(np.array([i for e in each for i in e], np.int32))
        sizes.append(np.array([len(e) for e in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes).astype(np.int32)

    def learn(self, hashes: np.ndarray, texts_: list[str], whole: np.ndarray) -> None:
        order = np.argsort(whole, kind="stable")
        split = int((~whole).sum())
        listed = [texts_[i] for i in order.tolist()]
        ids, size = self._ids_of(listed[:split], listed[split:])
        start = self.used + np.cumsum(size, dtype=np.int64) - size
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        merged = np.concatenate([self.hashes, hashes[order]])
        by = np.argsort(merged, kind="stable")
        self.hashes, self.start, self.size = merged[by], np.concatenate([self.start, start])[by], np.concatenate([self.size, size])[by]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each."""
        parts, whole = pieces(column)
        if not len(parts):
            return np.empty(0, np.int32), np.zeros(len(parts.first) - 1, np.int64)
        distinct, example, which = np.unique(hash_words(parts) ^ whole, return_index=True, return_inverse=True)
        if len(self.hashes) > self.LIMIT:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            self.learn(distinct[new], [parts.bytes_of(k).decode() for k in example[new].tolist()], whole[example[new]])
            at = np.searchsorted(self.hashes, distinct)
        size = self.size[at][which].astype(np.int64)
        out = self.ids[ranges(self.start[at][which], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return out, np.diff(ends[parts.first])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(batches: Iterator[pa.RecordBatch], name: str, end: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids): 16-bit ids where the vocabulary allows, with the end id."""
    encode = encoder(vocabulary_path(name))
    kind = np.uint16 if max(encode.n_ids, end + 1) <= 1 << 16 else np.uint32
    for batch in chunks(batches):
        ids, n = encode.encode(batch.column(1))
        stop = np.cumsum(n)
        ids = np.insert(ids, stop, end).astype(kind)
        offsets = np.concatenate([[0], stop + np.arange(1, len(n) + 1)]) * kind().itemsize
        cells = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
        yield record(doc_id=batch.column(0), ids=cells)


def lengths(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The input's other columns with ``n_tokens`` (an end id counted) in place of the text."""
    encode = encoder(vocabulary_path(name))
    for batch in chunks(batches):
        _, n = encode.encode(batch.column(batch.schema.get_field_index("text")))
        yield record(**{c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"}, n_tokens=n + 1)


# ---------------------------------------------------------------- ranks to bytes


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2^32."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    padded[: len(ranks)] = size - 1
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: For each control byte: where its four ranks start, and the bytes of all four.
_STARTS, _TOTAL = np.cumsum(_SIZES, 1) - _SIZES, _SIZES.sum(1)
_MASK = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    group = np.frombuffer(control, np.uint8)
    total = _TOTAL[group]
    start = ((np.cumsum(total) - total)[:, None] + _STARTS[group]).ravel()[:n]
    size = _SIZES[group].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    value = np.zeros(n, np.uint32)
    for j in range(4):
        value |= raw[np.minimum(start + j, len(raw) - 1)].astype(np.uint32) << np.uint32(8 * j)
    return value & _MASK[size - 1]


def write_blocks(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray, width: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    shard, block, before = TaskContext.get().partitionId(), 0, 0
    held_ids, held = [], []

    def done():
        nonlocal block, before
        size = np.array([len(x) // width for x in held], np.int64)
        ranks = rank_of[np.frombuffer(b"".join(held), f"<u{width}")]
        control, data = pack(ranks)
        missing = np.array([x is None for x in held_ids], np.bool_)
        row = record(
            shard=pa.array([shard], pa.int32()), block=pa.array([block], pa.int32()), before=[before], tokens=[int(size.sum())],
            doc_ids=[np.array([x or 0 for x in held_ids], "<i8").tobytes()], missing=[np.packbits(missing).tobytes()], sizes=[size.astype("<i8").tobytes()], control=[control], data=[data],
        )
        block, before = block + 1, before + int(size.sum())
        held_ids.clear()
        held.clear()
        return row

    n = 0
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held_ids.append(doc_id)
            held.append(ids)
            n += len(ids) // width
            if n >= block_tokens:
                yield done()
                n = 0
    if held:
        yield done()


def read_blocks(batches: Iterator[pa.RecordBatch], id_of: np.ndarray, offset: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            size = np.frombuffer(row["sizes"], "<i8")
            ids = id_of[unpack(row["control"], row["data"], int(size.sum()))].astype("<u4")
            stop = np.cumsum(size)
            cells = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], stop * 4]).astype(np.int32)), pa.py_buffer(ids)])
            missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(size)).astype(np.bool_)
            yield record(
                doc_id=pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=missing),
                start=offset[row["shard"]] + row["before"] + stop - size, n_tokens=size, ids=cells,
            )


# ---------------------------------------------------------------- the operator


def write_tokens(docs: DataFrame, path: str | None = None, *, vocabulary: str = "word_bpe_49k.json", end: int = 1, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text and write the file; returns its path (by default in the shared folder)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    encoded = cut(texts(docs, id_col, text_col).mapInArrow(lambda it: tokenize(it, vocabulary, end), "doc_id long, ids binary"), "ids")
    n_ids = max(encoder(vocabulary_path(vocabulary)).n_ids, end + 1)
    width = 2 if n_ids <= 1 << 16 else 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}"), minlength=n_ids)
        yield record(id=np.flatnonzero(total), n=total[total > 0])

    counted = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = sorted((-r.n, r.id) for r in counted.collect())  # at most one row for each id of the vocabulary
    rank_of = np.zeros(n_ids, np.uint32)
    rank_of[[i for _, i in by_rank]] = np.arange(len(by_rank))
    spark.createDataFrame([(r, i) for r, (_, i) in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(lambda it: write_blocks(it, shared.value, width, block_tokens), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a written file; ``ids``: little-endian unsigned 32-bit integers."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # at most one row for each id of the vocabulary
    id_of = np.zeros(max(1, len(ranks)), np.uint32)
    id_of[[r["rank"] for r in ranks]] = [r["id"] for r in ranks]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    offset, before = {}, 0  # one number for each shard, of which there are as many as tasks that wrote
    for r in blocks.groupBy("shard").agg(F.sum("tokens").alias("n")).orderBy("shard").collect():
        offset[r.shard], before = before, before + r.n
    return blocks.mapInArrow(lambda it: read_blocks(it, id_of, offset), "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(x) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
        yield record(**{c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "ids"}, ids_crc32=pa.array(crc, pa.int64()))
