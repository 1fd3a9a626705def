"""Exact hard negatives: anchors are clustered, and each cluster shares one list of candidates.

Anchors are assigned to the nearest of ``clusters`` directions, which spherical k-means
finds on at most ``sample`` of them. Of a candidate at the angle t from a cluster's
direction, no member of the cluster, all of which are within the angle r of it, can have a
larger inner product than |member| |candidate| cos(max(0, t - r)). In every shard of the
candidates the candidates are sorted by |candidate| cos(...) once for each cluster and
written. Every member then walks that list, block by block, until its bound for the next
row is below all that it still looks for: only then is its result certified, and it leaves.

The lists are walked twice. First for an anchor's ``positives`` best rows of its own label;
the floor is the last of them found so far. Then, with the best of all shards known, for
the ``negatives`` best rows of other labels in each positive's window of scores; the floor
is the lower end of the window or the last of them found so far, of the positive for
which it is lowest.

Components are quantised to ``floor(scale * x)``; scores are exact integers (products are
summed in float64 where that is exact, below 2^53, and else in Python's integers, without
bounds). Bounds are widened by more than their rounding errors.

Scale: candidates are shuffled once, to build the lists, which take 12 bytes a candidate and
cluster beside the vectors. In a walk each shard is one task, which holds one shard of
``shard_rows`` rows while the anchors stream past it; an anchor reaches every shard, as an
exact search must, and its few rows go back. What the driver sees is the sample and one
angle a cluster.

Defined cases: rows whose id, label or vector is null, whose vector is empty or holds null or
non-finite components take no part; vectors of different lengths do not meet; a row repeated
under one id is one row, and of different rows under one id the smallest by (label, vector)
stands for it; no row is a partner of its own id; fewer than so many positives or negatives
give fewer rows, and an anchor without either none; equal scores rank by smaller id;
components and scores beyond 64 bits count as the largest, or smallest, 64-bit integer;
vectors of zeros score 0 with all; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import record, release, runs
from tessella.llm.topk import _rows, _shards
from tessella.tables import cut

_LEAST, _LARGEST = -(2**63), 2**63 - 1
LISTS, ANCHOR = 0, 1
#: Rows of a list that the members of a cluster look at in one step, and members that walk together.
STEP, MEMBERS = 256, 256
_SLACK = 1e-6

# ---------------------------------------------------------------- clusters


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a vector of zeros has no direction, and stays."""
    length = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(length > 0, length, 1)[:, None], length


def fit(vectors: list[list[float]], clusters: int, rounds: int = 10) -> dict[int, np.ndarray]:
    """Directions of clusters for each length of vectors in a sample, by spherical k-means from evenly spaced rows."""
    found = {}
    for d in sorted({len(v) for v in vectors}):
        unit, _ = units(np.array([v for v in vectors if len(v) == d], np.float64))
        centres = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)]
        for _ in range(rounds):
            nearest = (unit @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, unit)
            moved, length = units(sums)
            centres = np.where(length[:, None] > 0, moved, centres)
        found[d] = centres
    return found


def angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def assign(batches: Iterator[pa.RecordBatch], model: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, v) with their cluster and the angle to it; a length that the sample lacks is one cluster without a direction."""
    for batch in batches:
        vectors = batch.column(2).to_pylist()
        size = np.fromiter(map(len, vectors), np.int64, len(vectors))
        cluster, angle = np.zeros(len(size), np.int64), np.full(len(size), np.pi)
        for d in np.unique(size).tolist():
            if d in model:
                at = np.flatnonzero(size == d)
                t = angles(units(np.array([vectors[i] for i in at.tolist()]))[0], model[d])
                cluster[at], angle[at] = t.argmin(1), t.min(1)
        yield record(vec_id=batch.column(0), label=batch.column(1), v=batch.column(2), cluster=cluster, angle=angle)


# ---------------------------------------------------------------- lists


@dataclass
class Shard:
    """A shard's candidates; for each cluster the order of its list, and in that order what bounds inner products with members of length 1."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    order: list[np.ndarray]
    bound: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, centres: np.ndarray | None, radii: dict[int, float]) -> Shard:
        unit, length = units(vectors)
        order, bound = [], []
        for c in range(1 if centres is None else len(centres)):
            t = np.zeros(len(ids)) if centres is None else angles(unit, centres[c : c + 1])[:, 0]
            most = length * np.cos(np.maximum(0, t - radii.get(c, math.pi) - _SLACK)) + length * 1e-9
            order.append(np.argsort(-most, kind="stable").astype(np.int32))
            bound.append(most[order[-1]])
        return cls(ids, labels, vectors, order, bound)

    def walk(self, cluster: int, search: Search) -> None:
        """Show the members of a cluster this shard's list, block by block, until each is certified."""
        order, bound = self.order[cluster], self.bound[cluster]
        safe = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(search.vectors).max(initial=0)) * self.vectors.shape[1] < 2**52
        length = np.linalg.norm(search.vectors, axis=1) * (1 + 1e-9)
        active = np.arange(len(search.vectors))
        for a in range(0, len(order), STEP):
            if safe:
                active = active[length[active] * bound[a] + _SLACK >= search.floor[active]]
            if not len(active):
                return
            at = order[a : a + STEP]
            if safe:
                scores = (search.vectors[active] @ self.vectors[at].T).astype(np.int64)
            else:
                whole = np.frompyfunc(int, 1, 1)
                products = whole(search.vectors[active]) @ whole(self.vectors[at]).T
                scores = np.array([[min(max(x, _LEAST), _LARGEST) for x in row] for row in products], np.int64)
            search.look(active, scores, self.ids[at], self.labels[at])


class Search:
    """What the members of one cluster look for: ``floor`` is the score below which nothing can change a member's result."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.floor = np.full(len(ids), -np.inf)


def _best(kept: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of those kept and new ones; ties to the smaller id."""
    if len(ids) > k:
        use = np.lexsort((ids, np.bitwise_not(scores)))[:k]  # ~x falls as x rises, without overflow
        scores, ids = scores[use], ids[use]
    return sorted([*kept, *zip(scores.tolist(), ids.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]


class Positives(Search):
    """The ``k`` best rows of a member's own label."""

    def __init__(self, ids, labels, vectors, k: int):
        super().__init__(ids, labels, vectors)
        self.k, self.found = k, [[] for _ in ids]

    def look(self, active: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        use = (labels == self.labels[active][:, None]) & (ids != self.ids[active][:, None]) & (scores >= self.floor[active][:, None])
        for i in np.flatnonzero(use.any(1)).tolist():
            own, member = use[i], int(active[i])
            self.found[member] = _best(self.found[member], scores[i, own], ids[own], self.k)
            if len(self.found[member]) == self.k:
                self.floor[member] = self.found[member][-1][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for anchor, found in zip(self.ids.tolist(), self.found, strict=True):
            yield from ((anchor, i, s) for s, i in found)


class Negatives(Search):
    """The ``k`` best rows of other labels with scores from ``low`` to ``high`` percent of each positive's."""

    def __init__(self, ids, labels, vectors, positives: list[list[dict]], k: int, low: int, high: int):
        super().__init__(ids, labels, vectors)
        self.k = k
        # of each positive: its id and score, the ends of its window, and what is found in it
        self.windows = [[[p["id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100, []] for p in own if p["score"] >= 0] for own in positives]
        for member, own in enumerate(self.windows):
            self._lower(member, own)
        self.top = np.array([max((w[3] for w in own), default=_LEAST) for own in self.windows], object).astype(np.int64)

    def _lower(self, member: int, windows: list[list]) -> None:
        self.floor[member] = min((w[4][-1][0] if len(w[4]) == self.k else w[2] for w in windows if w[2] <= w[3]), default=np.inf)

    def look(self, active: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        use = (labels != self.labels[active][:, None]) & (ids != self.ids[active][:, None]) & (scores >= self.floor[active][:, None]) & (scores <= self.top[active][:, None])
        for i in np.flatnonzero(use.any(1)).tolist():
            own, member = use[i], int(active[i])
            near, names = scores[i, own], ids[own]
            for window in self.windows[member]:
                least = window[4][-1][0] if len(window[4]) == self.k else window[2]
                fit = (near >= least) & (near <= window[3])
                if fit.any():
                    window[4] = _best(window[4], near[fit], names[fit], self.k)
            self._lower(member, self.windows[member])

    def rows(self) -> Iterator[tuple[int, int, int, int, int]]:
        for anchor, own in zip(self.ids.tolist(), self.windows, strict=True):
            yield from ((anchor, positive, score, i, s) for positive, score, _, _, found in own for s, i in found)


def build(batches: Iterator[pa.RecordBatch], model: dict[int, np.ndarray], radii: dict[tuple[int, int], float]) -> Iterator[pa.RecordBatch]:
    """Each shard with its lists, of rows sorted by shard."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        shard = held[0].column("shard")[0].as_py()
        ids, labels = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("vec_id", "label"))
        vectors = np.concatenate([_rows(b, "v") for b in held])
        held.clear()
        d = vectors.shape[1]
        lists = Shard.of(ids, labels, vectors, model.get(d), {c: r for (n, c), r in radii.items() if n == d})
        return record(shard=pa.array([shard], pa.int64()), lists=pa.array([pickle.dumps(lists)], pa.binary()))

    for batch in _shards(batches):
        if held and held[0].column("shard")[0] != batch.column("shard")[0]:
            yield done()
        held.append(batch)
    if held:
        yield done()
    release()


def walk(batches: Iterator[pa.RecordBatch], kind: type[Search], names: list[str], **wanted) -> Iterator[pa.RecordBatch]:
    """What the anchors of rows sorted by (shard, kind, cluster) find: of each shard the lists come first."""
    shard, of_shard = None, None
    for batch in _shards(batches):
        if batch.column("kind")[0].as_py() == LISTS:
            shard, of_shard = pickle.loads(batch.column("lists")[0].as_py()), batch.column("shard")[0].as_py()
            batch = batch.slice(1)
        if not batch.num_rows or batch.column("shard")[0].as_py() != of_shard:
            continue  # no candidate has come to this shard
        edges = [*np.flatnonzero(runs(batch.column("cluster").to_numpy())).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            for at in range(a, b, MEMBERS):
                part = batch.slice(at, min(MEMBERS, b - at))
                more = {"positives": part.column("positives").to_pylist()} if "positives" in part.schema.names else {}
                search = kind(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _rows(part, "v"), **more, **wanted)
                shard.walk(part.column("cluster")[0].as_py(), search)
                rows = list(search.rows())
                if rows:
                    yield record(**{c: pa.array(x, pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)})
    shard = None
    release()


# ---------------------------------------------------------------- the operator


def labelled(df: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, label, v)``: quantised vectors of the rows that take part, one for each id."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("long").alias("label"), df[vector_col].cast("array<double>").alias("x"))
    rows = rows.where("vec_id is not null and label is not null and size(x) > 0")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def _walked(lists: DataFrame, anchors: DataFrame, shards: int, kind: type[Search], names: list[str], **wanted) -> DataFrame:
    """``names`` of what each shard's walk finds for each of ``anchors (cluster, vec_id, label, v)``, which may have further columns."""
    first = F.size("v").cast("long") * shards
    asked = anchors.select(F.explode(F.sequence(first, first + (shards - 1))).alias("shard"), F.lit(ANCHOR).alias("kind"), *anchors.columns)
    rows = lists.select("shard", F.lit(LISTS).alias("kind"), "lists").unionByName(asked, allowMissingColumns=True)
    dealt = rows.repartition(2 * shards, "shard").sortWithinPartitions("shard", "kind", "cluster")
    return dealt.mapInArrow(lambda it: walk(it, kind, names, **wanted), ", ".join(f"{n} long" for n in names))


def hard_negatives(
    vectors: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    clusters: int = 32, sample: int = 2048, shard_rows: int = 16384, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each row whose id is divisible by ``every``.

    Of an anchor's ``positives`` best rows of its label each gets the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    rows = cut(labelled(vectors, scale, id_col, label_col, vector_col), "vectors")
    shards = max(1, math.ceil(rows.count() / shard_rows))  # of each length of vectors
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    chosen = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).collect()
    model = fit([r.v for r in chosen], clusters)
    placed = cut(anchors.mapInArrow(lambda it: assign(it, model), "vec_id long, label long, v array<double>, cluster long, angle double"), "anchors")
    widest = placed.where(F.size("v").isin(list(model))).groupBy(F.size("v").alias("d"), "cluster").agg(F.max("angle").alias("r")).collect()  # a row for each of the model's clusters at most
    radii = {(r.d, r.cluster): r.r for r in widest}
    placed = placed.select("cluster", "vec_id", "label", "v")

    dealt = rows.withColumn("shard", F.size("v").cast("long") * shards + F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    dealt = dealt.repartition(2 * shards, "shard").sortWithinPartitions("shard")
    lists = cut(dealt.mapInArrow(lambda it: build(it, model, radii), "shard long, lists binary"), "lists")

    found = _walked(lists, placed, shards, Positives, ["vec_id", "id", "score"], k=positives)
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    best = best.groupBy("vec_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))  # so many at most
    asked = cut(placed.join(best, "vec_id"), "positives")
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    met = _walked(lists, asked, shards, Negatives, names, k=negatives, low=low, high=high)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
