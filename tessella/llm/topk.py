"""Exact top-k by inner product with a KD-tree in every shard.

Candidates are spread over shards by a hash of their row (equal vectors and ids spread
too). A shard's tree is built once, by median splits on its widest dimension, and each
node keeps the tight bounding box of its rows. A query visits nodes best-first: a node's
bound is the largest inner product that any point of its box could have, and nodes whose
bound is below the k-th score known so far are never opened. The k-th score is propagated:
the task that builds a tree answers the queries among its own rows, and the k-th score
found there is where a query's search of all other shards starts.

Components are quantised to ``floor(scale * x)``; scores are exact integers (products
are summed in float64 where that is exact, below 2^53, and else in Python's integers).

Scale: candidates are shuffled once, to build; trees are written to the shared folder,
one row a shard, and read from there. In the search each shard is one task, which holds
one tree of ``shard_rows`` rows while the queries stream past it. A query reaches every
shard, as an exact search whose boxes may not prune must; with it go k rows back.

Defined cases: vectors that are null, empty, hold null or non-finite components, or differ
in length from a query, take no part (with that query); so do rows without an id;
rows repeated under one id are queries and candidates each, ranked together under their
id, and none is a candidate of its own id; fewer than k candidates give fewer rows; equal
scores rank by smaller id; components and scores beyond 64 bits count as the largest, or
smallest, 64-bit integer; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import record, release, runs
from tessella.tables import cut

#: The floor of a query without a k-th score; floors stay integers, since a double may round up past the score.
_NONE = -(2**63)
_LARGEST = 2**63 - 1
TREE, FOUND, FLOOR = 0, 1, 2
_BUILT = "kind int, shard long, tree binary, query_id long, row long, vec_id long, score long"


class KdTree:
    """Rows of integers as float64 in leaf order; nodes as arrays: child numbers (-1: leaf), row range and bounding box."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = 128):
        self.order = np.lexsort((ids,))
        self.left, self.right, self.start, self.end, low, high = [], [], [], [], [], []
        todo = [(0, len(ids), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            own = len(self.start)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = own
            rows = vectors[self.order[a:b]]
            low.append(rows.min(0))
            high.append(rows.max(0))
            self.left.append(-1)
            self.right.append(-1)
            self.start.append(a)
            self.end.append(b)
            width = high[-1] - low[-1]
            if b - a > leaf and width.max() > 0:
                middle = (b - a) // 2
                part = np.argsort(rows[:, int(width.argmax())], kind="stable")
                self.order[a:b] = self.order[a:b][part]
                todo += [(a, a + middle, own, False), (a + middle, b, own, True)]
        self.vectors, self.ids = vectors[self.order], ids[self.order]
        self.low, self.high = np.array(low), np.array(high)
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def answer(self, queries: np.ndarray, own: list[int], floors: list[int], k: int) -> Iterator[list[tuple[int, int]]]:
        """The k best (score, -id) for each query."""
        high, low, vectors = self.high, self.low, self.vectors
        if not self.largest * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2**52:
            queries, high, low, vectors = (np.frompyfunc(int, 1, 1)(x) for x in (queries, high, low, vectors))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T  # the largest inner product with a point of each node's box
        for query, bound, mine, floor in zip(queries, bounds, own, floors, strict=True):
            yield self.search(vectors, query, mine, bound, k, floor)

    def search(self, vectors: np.ndarray, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, -id), best first; ``floor``: a score that k rows are known to reach."""
        exact = vectors.dtype == object
        best: list[tuple[float, int]] = []  # a heap of (score, -id), the worst first
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            most = min(max(-most, _NONE), _LARGEST) if exact else -most  # scores are cut off at both ends, and so are bounds
            if most < floor or (len(best) == k and most < best[0][0]):
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-bound[child], child))
                continue
            s = slice(self.start[node], self.end[node])
            scores, ids = vectors[s] @ query, self.ids[s]
            if exact:
                scores = np.array([min(max(x, _NONE), _LARGEST) for x in scores], object)
            limit = max(floor, best[0][0]) if len(best) == k else floor
            use = np.flatnonzero((scores >= limit) & (ids != own))
            if len(use) > k:
                use = np.array(sorted(use.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]) if exact else use[np.lexsort((ids[use], -scores[use]))[:k]]
            for i in use.tolist():
                item = (scores[i], -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(best, reverse=True)


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A matrix of a column of lists of one length."""
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by shard, cut where the shard changes."""
    for batch in batches:
        at = [*np.flatnonzero(runs(batch.column("shard").to_numpy())).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            yield batch.slice(a, b - a)


def _found(kind: int, shard: int, rows: list[tuple[int, int, int | None, int]]) -> pa.RecordBatch:
    query_id, row, vec_id, score = zip(*rows, strict=True)
    n = len(rows)
    return record(
        kind=pa.array([kind] * n, pa.int32()), shard=pa.array([shard] * n, pa.int64()), tree=pa.nulls(n, pa.binary()), query_id=pa.array(query_id, pa.int64()),
        row=pa.array(row, pa.int64()), vec_id=pa.array(vec_id, pa.int64()), score=pa.array(score, pa.int64()),
    )


def build(batches: Iterator[pa.RecordBatch], k: int, every: int) -> Iterator[pa.RecordBatch]:
    """Each shard's tree, what its own queries find in it, and where their search of other shards starts."""
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        shard = held[0].column("shard")[0].as_py()
        ids, row = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("vec_id", "row"))
        vectors = np.concatenate([_rows(b, "v") for b in held])
        held.clear()
        tree = KdTree(vectors, ids)
        yield record(
            kind=pa.array([TREE], pa.int32()), shard=pa.array([shard], pa.int64()), tree=pa.array([pickle.dumps(tree)], pa.binary()),
            query_id=pa.nulls(1, pa.int64()), row=pa.nulls(1, pa.int64()), vec_id=pa.nulls(1, pa.int64()), score=pa.nulls(1, pa.int64()),
        )
        asked = np.flatnonzero(ids % every == 0)
        found, floors = [], []
        own, rows = ids[asked].tolist(), row[asked].tolist()
        for i, r, best in zip(own, rows, tree.answer(vectors[asked], own, [_NONE] * len(own), k), strict=True):
            found += [(i, r, -x, int(s)) for s, x in best]
            if len(best) == k:
                floors.append((i, r, None, int(best[-1][0])))
        if found:
            yield _found(FOUND, shard, found)
        if floors:
            yield _found(FLOOR, shard, floors)

    for batch in _shards(batches):
        if held and held[0].column("shard")[0] != batch.column("shard")[0]:
            yield from done()
        held.append(batch)
    if held:
        yield from done()
    release()


def look_up(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What the queries of rows sorted by (shard, kind) find: of each shard the tree comes first."""
    tree, of_shard = None, None
    for batch in _shards(batches):
        if batch.column("kind")[0].as_py() == TREE:
            tree, of_shard = pickle.loads(batch.column("tree")[0].as_py()), batch.column("shard")[0].as_py()
            batch = batch.slice(1)
        if batch.num_rows and batch.column("shard")[0].as_py() != of_shard:
            continue  # no row has come to this shard
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            own = part.column("vec_id").to_pylist()
            best = tree.answer(_rows(part, "v"), own, part.column("floor").to_pylist(), k)
            rows = [(i, -x, int(s)) for i, of in zip(own, best, strict=True) for s, x in of]
            if rows:
                yield record(**{c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), zip(*rows, strict=True), strict=True)})
    tree = None
    release()


def vectors_of(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)``: quantised vectors of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each row whose id is divisible by ``every``."""
    rows = cut(vectors_of(vectors, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, math.ceil(rows.count() / shard_rows))  # of each length of vectors
    first = F.size("v").cast("long") * shards
    placed = rows.withColumn("shard", first + F.pmod(F.xxhash64("row"), F.lit(shards)))
    tasks = 2 * shards
    built = placed.select("shard", "vec_id", "row", "v").repartition(tasks, "shard").sortWithinPartitions("shard")
    built = cut(built.mapInArrow(lambda it: build(it, k, every), _BUILT), "trees")

    floors = built.where(F.col("kind") == FLOOR).select("row", F.col("score").alias("floor"))
    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0).join(floors, "row", "left")
    others = F.filter(F.sequence(first, first + (shards - 1)), lambda x: x != F.col("shard"))
    asked = asked.select(F.explode(others).alias("shard"), F.lit(FOUND).alias("kind"), "vec_id", F.coalesce("floor", F.lit(_NONE)).alias("floor"), "v")
    trees = built.where(F.col("kind") == TREE).select("shard", "kind", "tree")
    met = trees.unionByName(asked, allowMissingColumns=True).repartition(tasks, "shard").sortWithinPartitions("shard", "kind")
    elsewhere = met.mapInArrow(lambda it: look_up(it, k), "query_id long, vec_id long, score long")

    found = built.where(F.col("kind") == FOUND).select("query_id", "vec_id", "score").unionByName(elsewhere)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
