"""Near-duplicate classes by SimHash, with meet-in-the-middle ball hashing.

A document's shingles are its runs of ``k`` words, repeats included; each is hashed by
XXH64, and a bit of the 64-bit fingerprint is set if more than half of the hashes have it.
Fingerprints that differ in at most ``radius`` (even) bits are linked. Every distinct
fingerprint emits all variants within half the radius of it (2,081 for two bits), so two
linked ones share the variants halfway between them; and all that share one are within
half the radius of it, hence linked with one another. A variant's fingerprints are at most
as many as its own ball holds, whatever the corpus, and a link from the smallest of them
to each other one stands for all of their pairs.

The variants are what there is to shuffle, and nearly all of them meet nothing, so they
are shuffled in two steps. In the first, a block of ``block`` fingerprints sends the hashes
of its variants, sorted and coded as the bits in which they differ (about 2 bytes a
variant), and nothing of their owners; where a hash came twice, the blocks that sent it are
told. In the second, each block emits the variants of these hashes again, with their
fingerprints; whole variants are shuffled and compared, so that hashes which are equal by
chance cost work, never results. The hash has as many bits as keep such meetings to one in
2,048 variants.

Scale: texts are read once and never shuffled; a fingerprint costs about 5 KB of shuffle
(a row for each variant would be 50 KB); a task holds the variants of one block, or one part
of the hashes, which has those of about ``part`` fingerprints. Documents with equal
fingerprints are one from the start. Components are found by star-joins on tables in the
shared folder.

Defined cases: texts of fewer than ``k`` words are one shingle; null, empty and wordless
texts have fingerprint zero, which is linked like any other; rows without an id come back
with their fingerprint, link nothing and have no component; rows repeated under one id are
one node each time, and different texts under one id link through each other's
fingerprints only; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import chunks, mix, record, release, signed, texts
from tessella.llm.minhash import components
from tessella.tables import cut

K, RADIUS, SEED = 4, 4, 42
BLOCK, PART = 4096, 2048

# ---------------------------------------------------------------- fingerprints

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, k: int = K) -> int:
    """The SimHash of a text in UTF-8; ``bytes.split`` takes words between ASCII white space."""
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: max(len(words) - k + 1, 1)].tolist(), end[min(k, len(words)) - 1 :].tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, len(start), 1 << 16):
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(start[a : a + (1 << 16)], end[a : a + (1 << 16)], strict=True)], np.uint64)
        set_bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * set_bits > len(start)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = np.array([fingerprint(t or b"", k) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        yield record(doc_id=batch.column(0), print=signed(found))


# ---------------------------------------------------------------- balls


def ball(half: int) -> np.ndarray:
    """What to flip for each variant within ``half`` bits."""
    return np.array([sum(1 << b for b in flipped) for n in range(half + 1) for flipped in combinations(range(64), n)], np.uint64)


class Hashes:
    """The hash of a variant: ``bits`` leading bits of its mix, of which the first ``part`` say where it goes, and the last bytes are stored as they are."""

    def __init__(self, n: int, half: int, block: int = BLOCK, part: int = PART):
        variants = len(ball(half))
        self.part = max(0, math.ceil(math.log2(max(n, 1) / part)))
        wanted = math.ceil(math.log2(max(n, 1) * variants)) + 11  # equal by chance: one variant in 2,048 at most, at any size
        bits = {low: max(self.part, wanted - 8 * low) for low in range(1, 8)}
        self.low = min(bits, key=lambda low: 8 * low + 2 ** bits[low] / (block * variants))  # bits for a variant: low bytes, and a share of the places
        top = bits[self.low]
        self.bits = top + 8 * self.low
        self.slots = 1 << (top - self.part)

    def of(self, prints: np.ndarray, flips: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Variants and their hashes, some fingerprints at a time."""
        for a in range(0, len(prints), 256):
            variants = (prints[a : a + 256, None] ^ flips).ravel()
            yield variants, mix(variants) >> np.uint64(64 - self.bits)

    def encode(self, keys: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
        """For each part: its number, the top bits of its sorted keys as the places of ones, and their low bytes."""
        shift, own = np.uint64(8 * self.low), np.uint64(self.bits - self.part)
        bounds = np.searchsorted(keys, np.arange(1, 1 << self.part, dtype=np.uint64) << own).tolist()
        numbers, tops, lows = [], [], []
        for number, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(keys)], strict=True)):
            if b > a:
                slot = ((keys[a:b] >> shift) & np.uint64(self.slots - 1)).astype(np.int64)
                ones = np.zeros(self.slots + b - a, np.bool_)
                ones[slot + np.arange(b - a)] = True
                numbers.append(number)
                tops.append(np.packbits(ones).tobytes())
                lows.append(np.ascontiguousarray(keys[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.low]).tobytes())
        return numbers, tops, lows

    def decode(self, part: int, top: bytes, low: bytes) -> np.ndarray:
        n = len(low) // self.low
        slot = np.flatnonzero(np.unpackbits(np.frombuffer(top, np.uint8))) - np.arange(n)
        keys = np.zeros((n, 8), np.uint8)
        keys[:, : self.low] = np.frombuffer(low, np.uint8).reshape(n, self.low)
        first = np.uint64(part) << np.uint64(self.bits - self.part)
        return keys.view("<u8").ravel() | first | slot.astype(np.uint64) << np.uint64(8 * self.low)


def send(batches: Iterator[pa.RecordBatch], hashes: Hashes, half: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, print), sorted by block: the coded hashes of each block's variants, a row for each part."""
    flips = ball(half)

    def coded(block: int, prints: np.ndarray) -> pa.RecordBatch:
        keys = np.empty(len(prints) * len(flips), np.uint64)
        at = 0
        for _, found in hashes.of(prints, flips):
            keys[at : at + len(found)] = found
            at += len(found)
        keys.sort()
        numbers, tops, lows = hashes.encode(keys)
        return record(part=pa.array(numbers, pa.int64()), block=pa.array([block] * len(numbers), pa.int64()), top=pa.array(tops, pa.binary()), low=pa.array(lows, pa.binary()))

    held_block, held = None, []
    for batch in batches:
        block, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                if held and block[a] != held_block:
                    yield coded(held_block, np.concatenate(held))
                    held = []
                held_block = int(block[a])
                held.append(prints[a:b])
    if held:
        yield coded(held_block, np.concatenate(held))
    held = []
    release()


def meet(rows: pa.Table, hashes: Hashes) -> pa.Table:
    """Of one part's coded hashes those that came more than once, for each block that sent them."""
    part = rows.column("part")[0].as_py()
    blocks = rows.column("block").to_pylist()
    keys = [hashes.decode(part, t, w) for t, w in zip(rows.column("top").to_pylist(), rows.column("low").to_pylist(), strict=True)]
    every = np.concatenate(keys)
    every.sort()
    twice = every[1:][every[1:] == every[:-1]]
    del every
    out = []
    for own in keys:
        at = np.searchsorted(twice, own)
        at[at == len(twice)] = 0
        out.append(np.unique(own[twice[at] == own]).tobytes() if len(twice) else b"")
    told = [i for i, x in enumerate(out) if x]
    return pa.table({"block": pa.array([blocks[i] for i in told], pa.int64()), "keys": pa.array([out[i] for i in told], pa.binary())})


def emit(own: pa.Table, told: pa.Table, hashes: Hashes, half: int) -> pa.Table:
    """The variants of a block's fingerprints whose hash came more than once, whole."""
    prints, docs = own.column("print").to_numpy().view(np.uint64), own.column("doc").to_numpy()
    keys = np.sort(np.frombuffer(b"".join(told.column("keys").to_pylist()), np.uint64))
    flips, sieve = ball(half), np.zeros(1 << 22, np.bool_)
    found: list[list[np.ndarray]] = [[], [], []]
    if len(keys):
        sieve[keys & np.uint64(len(sieve) - 1)] = True
        at = 0
        for variants, h in hashes.of(prints, flips):
            likely = np.flatnonzero(sieve[h & np.uint64(len(sieve) - 1)])
            near = np.minimum(np.searchsorted(keys, h[likely]), len(keys) - 1)
            likely = likely[keys[near] == h[likely]]
            row = at + likely // len(flips)
            for column, values in zip(found, (signed(variants[likely]), docs[row], signed(prints[row])), strict=True):
                column.append(values)
            at += len(h) // len(flips)
    columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
    return pa.table(dict(zip(("variant", "doc", "print"), (pa.array(x, pa.int64()) for x in columns), strict=True)))


# ---------------------------------------------------------------- the operator


def near_prints(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Links ``(a, b)`` that connect all rows of ``classes (doc, print)``, distinct prints, that differ in at most ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius must be even: only then are all fingerprints of a variant linked")
    half, n = radius // 2, classes.count()
    hashes, blocks = Hashes(n, half, block, part), max(1, math.ceil(n / block))
    placed = classes.withColumn("block", F.pmod(F.xxhash64("print"), F.lit(blocks)))
    dealt = placed.select("block", "print").repartition(blocks, "block").sortWithinPartitions("block")
    sent = dealt.mapInArrow(lambda it: send(it, hashes, half), "part long, block long, top binary, low binary")
    told = sent.groupBy("part").applyInArrow(lambda rows: meet(rows, hashes), "block long, keys binary")
    again = placed.groupBy("block").cogroup(told.groupBy("block"))
    met = again.applyInArrow(lambda own, keys: emit(own, keys, hashes, half), "variant long, doc long, print long")
    smallest = F.min(F.struct("doc", "print")).over(Window.partitionBy("variant"))
    pairs = met.withColumn("low", smallest).where("doc <> low.doc").select(F.col("low.doc").alias("a"), F.col("low.print").alias("x"), F.col("doc").alias("b"), F.col("print").alias("y"))
    return pairs.distinct().where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius).select("a", "b")


def near_copies(docs: DataFrame, *, k: int = K, radius: int = RADIUS, block: int = BLOCK, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest document that links of at most ``radius`` differing bits reach."""
    prints = cut(texts(docs, id_col, text_col).mapInArrow(lambda it: fingerprints(it, k), "doc_id long, print long"), "prints")
    classes = cut(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc")), "classes")
    # different texts under one id, of which each is the smallest of its class, are one node
    links = cut(near_prints(classes, radius, block, part), "links")
    found = components(links)
    placed = classes.join(found, "doc", "left").select("print", F.coalesce("component", "doc").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    return prints.join(placed, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component)
