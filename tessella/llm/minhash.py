"""Near-duplicate detection with HyperMinHash signatures.

A document's set is its distinct five-word shingles, each hashed once. The hash's first
bits choose one of ``registers`` buckets; a bucket keeps the smallest of the remaining
bits, compressed to its number of leading zeros and the ``mantissa`` bits after them. An
empty bucket, of which a short text has many, takes over another bucket's register: the
first filled one in an order that is fixed for each bucket, so that registers of two sets
still agree as often as the sets do. Registers are banded; documents with an equal band
are candidates. For a candidate pair the share of equal registers, less the share
expected from chance collisions of compressed registers at these set sizes, estimates the
Jaccard similarity; pairs whose estimate is within six standard deviations of the
threshold (or above) are confirmed on their full sets.

No step lists all pairs of a bucket. Equal sets are one class from the start. Round
one links each class of a bucket to the bucket's smallest, confirms these links and
takes connected components. Only buckets that then still hold several components
need more: in round two their classes meet with their full sets. A bucket of more than
``block`` classes that is nearly all one component is dealt into that component's blocks,
each of which meets the others, of which there are at most two blocks. Classes of other
large buckets meet by rare shingles instead: two sets of similarity 0.75 share one
of the rarest quarter of the shingles of either, so each class is sent to those of this
quarter that another class has too. Texts with a passage in common, which fill a bucket,
do not meet by that passage; what is sent grows with the classes, not with their pairs,
and no link is lost by it. What is still larger than a block is compared in pairs of
blocks, so that a task is bounded whatever the bucket's size. Pairs across components
(of a band's bucket, in the first common band only) are estimated and confirmed there
and then, and only links that unite two components leave the task, at most one for each
class and block. A pair inside one component cannot change the result.

With 32 bands of 4 registers, a pair at the threshold of 0.75 shares no band with
probability (1 - 0.75^4)^32 = 5e-6.

Scale: a shingle costs one hash; signatures are 2 bytes a register; band rows are two
longs; texts move for confirmation only: those of the pairs' second documents to their first
ones, which are in as many parts as they have pairs for, each with its own copy of the
text, so that the smallest document of a large bucket is not one task's. Components are found by alternating large-star and
small-star joins on tables in the shared folder, in a number of rounds logarithmic in
their diameter.

Defined cases: null, empty and wordless texts have 0 shingles and are linked with
nothing; a text of one to four words is one shingle; rows without an id come back
with component null and are kept; rows repeated under one id are one document; different
texts under one id count their own shingles each, and one of them stands for the id in
its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import SOLID, chunks, gram_hashes, hash_words, mix, ranges, record, release, runs, signed, split_words, texts
from tessella.tables import cut

REGISTERS, BAND, MANTISSA = 128, 4, 10


# ---------------------------------------------------------------- sets and signatures


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text in ascending order, and where each text's start."""
    words = split_words(column, SOLID, lower=True)
    h, n = hash_words(words), len(words.first) - 1
    g, doc, count = gram_hashes(h, k, 50), words.doc_of(), words.counts
    inside = np.flatnonzero(doc[: len(g)] == doc[k - 1 : k - 1 + len(g)])
    short = np.flatnonzero((count > 0) & (count < k))  # the whole text is one shingle
    of, value = doc[inside], g[inside]
    if len(short):
        whole = [gram_hashes(h[words.first[i] : words.first[i + 1]], int(count[i]), 50 + int(count[i]))[0] for i in short]
        of, value = np.concatenate([of, short]), np.concatenate([value, np.array(whole, np.uint64)])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), np.bool_)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(of[new], np.arange(n + 1))


def leading_zeros(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(x), np.uint64), x.copy()
    for bits in (32, 16, 8, 4, 2, 1):
        low = x < (np.uint64(1) << np.uint64(64 - bits))
        out[low] += np.uint64(bits)
        x[low] <<= np.uint64(bits)
    return out


def compress(smallest: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Leading zeros, then the bits after the first one, of each hash; 16 bits in all."""
    zeros = leading_zeros(smallest)
    rest = (smallest << zeros) << np.uint64(1)
    return ((zeros << np.uint64(mantissa)) | (rest >> np.uint64(64 - mantissa))).astype(np.uint16)


def _probes(registers: int) -> np.ndarray:
    """For each bucket, the order in which it looks for a filled one when it is empty."""
    return np.random.Generator(np.random.PCG64(128)).permuted(np.tile(np.arange(registers), (registers, 1)), axis=1)


_PROBES = {REGISTERS: _probes(REGISTERS)}


def signatures(values: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of registers (a power of two) for each text that has shingles; ``values`` ascend within a text."""
    count = np.diff(first)
    count = count[count > 0]
    bits = np.uint64(registers.bit_length() - 1)
    cell = np.repeat(np.arange(len(count)) * registers, count) + (values >> (np.uint64(64) - bits)).astype(np.int64)
    smallest = runs(cell)  # values ascend, so a bucket's first is its smallest
    out, filled = np.zeros(len(count) * registers, np.uint16), np.zeros(len(count) * registers, np.bool_)
    out[cell[smallest]] = compress(values[smallest] << bits)
    filled[cell[smallest]] = True
    probes = _PROBES[registers] if registers in _PROBES else _probes(registers)
    empty, step = np.flatnonzero(~filled), 0
    while len(empty):
        own = empty % registers
        at = empty - own + probes[own, step]
        found = filled[at]
        out[empty[found]] = out[at[found]]
        empty, step = empty[~found], step + 1
    return out.reshape(-1, registers)


def sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        values, first = shingles(batch.column(1), k)
        n = np.diff(first)
        full = n > 0
        sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
        if full.any():
            for s, v in zip(sums, (values, mix(values + np.uint64(1))), strict=True):
                s[full] = np.add.reduceat(v, first[:-1][full])
        rows = iter(signatures(values, first))
        cells = [next(rows).tobytes() if x else b"" for x in full.tolist()]
        yield record(doc_id=batch.column(0), n=n.astype(np.int64), s1=signed(sums[0]), s2=signed(sums[1]), registers=pa.array(cells, pa.binary()))


# ---------------------------------------------------------------- candidates


#: The last byte of a bucket's key is its band; the byte before it is 0, or _RARE where classes meet by a shingle.
_FREE, _RARE = ~np.uint64(0xFFFF), 0xFF


def bands(batches: Iterator[pa.RecordBatch], band: int = BAND) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        table = registers_of(batch.column(1))
        table = np.ascontiguousarray(table[:, : table.shape[1] // band * band]).reshape(len(table), -1, band).astype(np.uint64)
        key = np.zeros(table.shape[:2], np.uint64)
        for j in range(band):
            key = mix(key + table[:, :, j] + np.uint64(1))
        number = np.arange(key.shape[1], dtype=np.uint64)
        key = mix(key + number * np.uint64(0x9E3779B97F4A7C15)) & _FREE | number
        yield record(key=signed(key.ravel()), doc=np.repeat(batch.column(0).to_numpy(), key.shape[1]))


def spell(batches: Iterator[pa.RecordBatch], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(doc, n, shingle) of each shingle of rows (doc, n, shingles)."""
    for batch in batches:
        doc, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        group = (np.cumsum(n) - n) // size
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            shingle = np.frombuffer(b"".join(batch.column(2).slice(a, b - a).to_pylist()), np.int64)
            yield record(doc=np.repeat(doc[a:b], n[a:b]), n=np.repeat(n[a:b], n[a:b]), shingle=shingle)


def registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def chance(a: np.ndarray, b: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """Expected share of registers that are equal by chance for disjoint sets of ``a`` and ``b`` elements.

    A filled bucket of a set of n elements holds the smallest of about n / registers uniform values.
    """
    rate, out = [np.asarray(n, np.float64) / registers for n in (a, b)], np.zeros(len(a))

    def above(n: np.ndarray, x: float) -> np.ndarray:
        return (np.exp(-n * x) - np.exp(-n)) / -np.expm1(-n)

    for zeros in range(40):
        cell = [above(n, 2.0 ** -(zeros + 1)) - above(n, 2.0**-zeros) for n in rate]
        out += cell[0] * cell[1]
    return out / 2**mantissa


def estimate(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of pairs of signatures of sets of ``a`` and ``b`` elements."""
    by_chance = chance(a, b, x.shape[1])
    return np.maximum(0.0, ((x == y).mean(1) - by_chance) / (1 - by_chance))


def floor_of(threshold: float, registers: int = REGISTERS) -> float:
    return threshold - 6 * float(np.sqrt(threshold * (1 - threshold) / registers))


def likely(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sizes and registers, those that may reach the threshold."""
    for batch in batches:
        if batch.num_rows:
            a, b, x, y = batch.column("na").to_numpy(), batch.column("nb").to_numpy(), registers_of(batch.column("ra")), registers_of(batch.column("rb"))
            fit = (np.minimum(a, b) >= threshold * np.maximum(a, b)) & (estimate(x, y, a, b) >= floor_of(threshold))
            yield record(a=batch.column("a").to_numpy()[fit], b=batch.column("b").to_numpy()[fit])


def set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc, n, registers, shingles) of each text."""
    for batch in chunks(batches):
        values, first = shingles(batch.column(1), k)
        cells = [values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
        registers = [row.tobytes() for row in signatures(values, first)]
        yield record(doc=batch.column(0), n=np.diff(first).astype(np.int64), registers=pa.array(registers, pa.binary()), shingles=pa.array(cells, pa.binary()))


def across(batches: Iterator[pa.RecordBatch], percent: int, band: int = BAND) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, x, y): links that unite components within each group; of two blocks, across them."""
    names = ("key", "x", "y", "part", "doc", "component", "n")
    held: dict = {}

    def group_links(c: dict, registers: np.ndarray, sets: list[bytes]):
        parent: dict[tuple, int] = {}  # components as they unite within one group
        group = np.cumsum(runs(c["key"], c["x"], c["y"]))
        order = np.lexsort((c["component"], group))
        c, group, registers = {x: c[x][order] for x in names}, group[order], registers[order]

        def root(g: int, x: int) -> int:
            while (above := parent.get((g, x), x)) != x:
                x = above
            return x

        def ends(new: np.ndarray) -> np.ndarray:
            return np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]

        after = ends(runs(group, c["component"]))  # each row meets the rows of the components after its own
        count = ends(runs(group)) - after
        chunk, found = np.cumsum(count) // 500_000, []
        bounds = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(group)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            p, q = np.repeat(np.arange(lo, hi), count[lo:hi]), ranges(after[lo:hi], count[lo:hi])
            use = (c["x"][p] == c["y"][p]) | (c["part"][p] != c["part"][q])
            use &= 100 * np.minimum(c["n"][p], c["n"][q]) >= percent * np.maximum(c["n"][p], c["n"][q])
            p, q = p[use], q[use]
            if not len(p):
                continue
            same = registers[p] == registers[q]
            by_chance = chance(c["n"][p], c["n"][q], same.shape[1])
            fit = (same.mean(1) - by_chance) / (1 - by_chance) >= floor_of(percent / 100)
            common = same[:, : same.shape[1] // band * band].reshape(len(p), -1, band).all(2)
            fit &= (c["key"][p] >> 8 & 0xFF == _RARE) | (common.argmax(1) == (c["key"][p] & 0xFF))  # a pair is looked at in its first common band
            for a, b in zip(p[fit].tolist(), q[fit].tolist(), strict=True):
                ra, rb = root(group[a], c["component"][a]), root(group[a], c["component"][b])
                if ra != rb:
                    both = len(np.intersect1d(np.frombuffer(sets[order[a]], np.uint64), np.frombuffer(sets[order[b]], np.uint64), assume_unique=True))
                    if 100 * both >= percent * (c["n"][a] + c["n"][b] - both):
                        parent[group[a], max(ra, rb)] = min(ra, rb)
                        found.append((c["doc"][a], c["doc"][b]))
        links = np.array(found, np.int64).reshape(-1, 2)
        return record(a=links.min(1), b=links.max(1)) if len(links) else record(a=np.empty(0, np.int64), b=np.empty(0, np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: batch.column(c).to_numpy() for c in names} | {"registers": registers_of(batch.column("registers")), "shingles": batch.column("shingles").to_pylist()}
        if held:
            new = {c: held[c] + new[c] if isinstance(new[c], list) else np.concatenate([held[c], new[c]]) for c in new}
        last = (new["key"] == new["key"][-1]) & (new["x"] == new["x"][-1]) & (new["y"] == new["y"][-1])
        at = int(np.argmax(last))
        if at:
            yield group_links({c: new[c][:at] for c in names}, new["registers"][:at], new["shingles"][:at])
        held = {c: new[c][at:] for c in new}
    if held:
        yield group_links(held, held["registers"], held["shingles"])
    held.clear()
    release()


# ---------------------------------------------------------------- confirmation


#: Pairs of one document that are confirmed together.
GROUP = 512


def confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, text) sorted by (a, part, b), of which those without b come first and hold a's own text: the pairs whose full sets have ``100 * intersection >= percent * union``."""
    own, sets = None, {}  # of the document a and part at hand; repeated rows of a have one set, different texts one each
    for batch in chunks(batches):
        values, first = shingles(batch.column(3), k)
        linked = ([], [])
        for i, (a, part, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            mine = values[first[i] : first[i + 1]]
            if own != (a, part):
                own, sets = (a, part), {}
            if b is None:
                sets[mine.tobytes()] = mine
                continue
            for other in sets.values():
                both = len(np.intersect1d(mine, other, assume_unique=True)) if len(mine) and len(other) else 0
                if both and 100 * both >= percent * (len(mine) + len(other) - both):
                    linked[0].append(a)
                    linked[1].append(b)
                    break
        yield record(a=pa.array(linked[0], pa.int64()), b=pa.array(linked[1], pa.int64()))


def dealt_pairs(pairs: DataFrame, source: DataFrame, group: int = GROUP) -> DataFrame:
    """``a, part, b, text``: the text of b of each pair, and of a once for each of its parts of about ``group`` pairs, however many it has."""
    hubs = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / group).cast("int").alias("parts")), "hubs")
    members = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = members.join(source.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "part", "b", "text")
    own = hubs.join(source.select(F.col("doc_id").alias("a"), "text"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    return own.unionByName(members)


def confirmed(pairs: DataFrame, source: DataFrame, k: int, percent: int, group: int = GROUP) -> DataFrame:
    """The pairs that are links; ``pairs`` is a written table, so that Spark knows its size when it plans the joins."""
    dealt = dealt_pairs(pairs, source, group).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return dealt.mapInArrow(lambda it: confirm(it, k, percent), "a long, b long").distinct()


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """``(doc, component)`` of every linked document: the smallest document reachable by ``links (a, b)``.

    Large-star joins every larger neighbour of a node to the node's smallest
    neighbour, small-star every smaller one; at the fixpoint each component is a star.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))
        state = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")


# ---------------------------------------------------------------- the operator


def _mixed(rows: DataFrame) -> DataFrame:
    """``rows (key, doc, component)`` of buckets that hold several components, with the bucket's ``size``."""
    sizes = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    return rows.join(cut(sizes.select("key", "size"), "buckets"), "key").select("key", "doc", "component", "size")


def _around_one(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of which all but two blocks are one component, as groups in which that component's blocks meet the others; and the rows of other buckets."""
    each = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    kinds = each.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total")).where(F.col("total") - F.col("top.n") <= 2 * block)
    kinds = cut(kinds.select("key", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / block).cast("int").alias("parts")), "kinds")
    placed = rows.join(kinds, "key").withColumn("part", F.when(F.col("component") == F.col("main"), 1 + F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).otherwise(0))
    met = placed.withColumn("other", F.explode(F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts"))).otherwise(F.array(F.lit(0)))))
    return met.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "doc", "component"), rows.join(kinds.select("key"), "key", "left_anti")


def meeting(placed: DataFrame, source: DataFrame, *, k: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``key, x, y, part, doc, component``: where classes of buckets that hold several components meet; and the sets of these classes.

    ``placed``: (key, doc, component). Groups (key, x, y) hold at most about three blocks.
    """
    buckets = cut(_mixed(placed), "mixed")
    few, large = buckets.where(F.col("size") <= block), buckets.where(F.col("size") > block)
    around, rest = _around_one(large, block)
    many = cut(rest.select("doc", "component").distinct(), "many")
    wanted = cut(buckets.select("doc").distinct(), "wanted")
    sets = source.join(wanted, source["doc_id"] == wanted["doc"]).select("doc_id", "text").dropDuplicates(["doc_id"])
    sets = cut(sets.mapInArrow(lambda it: set_rows(it, k), "doc long, n long, registers binary, shingles binary"), "sets")

    each = sets.join(many.select("doc"), "doc", "left_semi").select("doc", "n", "shingles").mapInArrow(spell, "doc long, n long, shingle long")
    common = cut(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "common")
    own = each.join(common, "shingle").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    # n - size(own) shingles, which no other class has, come first in the order of rarity
    prefix = F.greatest(F.lit(0), F.size("own") - F.expr(f"cast((n * {percent} + 99) div 100 AS INT)") + 1)
    met = own.select("doc", F.explode(F.slice("own", F.lit(1), prefix)).alias("x"))
    key = F.col("x.shingle").bitwiseAND(F.lit(-65536)).bitwiseOR(F.lit(_RARE << 8))
    rare = cut(_mixed(cut(met.select(key.alias("key"), "doc").distinct().join(many, "doc"), "rare")), "mixed")
    rare_around, rare_rest = _around_one(rare.where(F.col("size") > block), block)

    parts = F.ceil(F.col("size") / block).cast("int")  # one of the buckets of at most a block, and of rare shingles' all that is left
    blocks = few.unionByName(rare.where(F.col("size") <= block)).unionByName(rare_rest).withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = blocks.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "doc", "component")
    return cut(blocks.unionByName(around).unionByName(rare_around), "meeting"), sets


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 75, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the smallest document that links of similarity ``percent``/100 or more reach."""
    source, threshold = texts(docs, id_col, text_col), percent / 100
    signed_docs = cut(source.mapInArrow(lambda it: sign(it, k), "doc_id long, n long, s1 long, s2 long, registers binary"), "signatures")
    known = signed_docs.where("doc_id is not null and n > 0")
    classes = cut(known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "registers").dropDuplicates(["doc_id"])
    reps = cut(reps, "representatives")
    rows = reps.select("doc_id", "registers").mapInArrow(bands, "key long, doc long")

    # round one: each class of a bucket with the bucket's smallest
    buckets = rows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("size")).where("low < high")
    stars = rows.join(buckets.select("key", "low"), "key").where("doc <> low").select(F.col("low").alias("a"), F.col("doc").alias("b")).distinct()
    side = {s: reps.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("registers").alias(f"r{s}")) for s in "ab"}
    pairs = stars.join(side["b"], "b").join(side["a"], "a").mapInArrow(lambda it: likely(it, threshold), "a long, b long")
    links = cut(confirmed(cut(pairs, "pairs"), source, k, percent), "links")
    found = cut(components(links), "components")

    # round two: what is left in one bucket, but in different components
    placed = rows.join(found, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    spread, sets = meeting(placed, source, k=k, percent=percent, block=block)
    met = spread.join(sets, "doc").select("key", "x", "y", "part", "doc", "component", "n", "registers", "shingles")
    crossing = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "doc")
    more = cut(crossing.mapInArrow(lambda it: across(it, percent), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        found = cut(components(links.unionByName(more)), "components")

    member = signed_docs.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(classes, [F.col("n_shingles") == classes["n"], signed_docs["s1"] == classes["s1"], signed_docs["s2"] == classes["s2"]], "left")
    member = member.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    result = member.join(found, member["rep"] == found["doc"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
