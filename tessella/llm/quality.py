"""Document quality by nearest-neighbour voting in a latent semantic space.

Terms are hashed: words, runs of punctuation, runs of capitals and of digits, and
words that repeat the word before. A document is the vector of ``(1 + ln count) *
idf`` of its terms, idf over all documents; a truncated SVD of a bounded sample of
labelled documents gives the latent space. The sample's latent vectors and labels are
broadcast. Every document is projected, its exact cosines with all labelled vectors
are computed as blocked matrix products, and the labels of its ``neighbours`` nearest
vote with weight ``cosine ** sharpness``. Votes of a label are weighted by the label's
share of all learnable labels over its share of the sample, so the score estimates a
probability although the sample is balanced.

Scale: two scans of the texts (term statistics, scores), no shuffle of texts. The
sample is ``per_label`` documents of each label, the first by a hash of the id, whole
texts (the bound is on documents, not on bytes); it is what is collected and broadcast,
with ``buckets`` term statistics.

Defined cases: a null text is empty; empty texts and texts without a known term score
the share of label 1; documents labelled both ways count with each label; labels of other
values than 0 and 1, and labels without a document, are not used; without any label,
all score 0.5; only one label known: its value.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.llm._common import SOLID, byte_class, chunks, hash_words, learnable, record, split_words, texts
from tessella.tables import cut

BUCKETS = 1024
#: Documents in one dense block of term counts.
BLOCK = 256
_PUNCTUATION = byte_class([c for c in range(0x21, 0x7F) if not chr(c).isalnum()])
_CAPITALS = byte_class(range(0x41, 0x5B))
_DIGITS = byte_class(range(0x30, 0x3A))
#: Terms that are not words: repeats, runs of capitals, of digits, of punctuation. Each has a bucket, and one for each
#: power of two that its share of the text's words may have; a quarter of all buckets holds these and punctuation itself.
_REPEAT, _CAPITAL, _DIGIT, _MARK, _LEVELS = 0, 1, 2, 3, 7
_SPECIAL = 4 + 4 * _LEVELS
#: A share's term counts as often as this.
_SHARE = 20


def terms(column: pa.Array, buckets: int) -> np.ndarray:
    """Counts of the hashed terms of each text."""
    n = len(column)
    words = split_words(column, SOLID, lower=True)
    h, doc = hash_words(words), words.doc_of()
    quarter = buckets // 4

    def count(doc: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
        return np.bincount(doc * buckets + bucket, minlength=n * buckets)

    out = count(doc, (h % np.uint64(buckets - quarter)).astype(np.int64) + quarter)
    marks, capitals = split_words(column, _PUNCTUATION), split_words(column, _CAPITALS)
    out += count(marks.doc_of(), (hash_words(marks) % np.uint64(quarter - _SPECIAL)).astype(np.int64) + _SPECIAL)
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    special = {_REPEAT: doc[again], _CAPITAL: capitals.doc_of()[capitals.end - capitals.start > 1], _DIGIT: split_words(column, _DIGITS).doc_of(), _MARK: marks.doc_of()}
    total = np.maximum(words.counts, 1)
    for kind, of in special.items():
        out += count(of, kind)
        share = np.bincount(of, minlength=n) / total
        some = np.flatnonzero(share)
        level = np.clip(np.floor(-np.log2(share[some])), 0, _LEVELS - 1).astype(np.int64)
        out += _SHARE * count(some, 4 + kind * _LEVELS + level)
    return out.reshape(n, buckets)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of (1 + ln count) * idf; zero where there is nothing."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # labelled unit vectors
    labels: np.ndarray
    weights: np.ndarray  # of each labelled vector's vote
    prior: float
    neighbours: int
    sharpness: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def statistics(docs: DataFrame, buckets: int) -> np.ndarray:
    """idf of each bucket over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(buckets, np.int64), 0
        for batch in chunks(batches):
            for a in range(0, batch.num_rows, BLOCK):
                df += (terms(batch.column(0).slice(a, BLOCK), buckets) > 0).sum(0)
            n += batch.num_rows
        yield record(bucket=np.arange(buckets + 1), n=np.append(df, n))

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(buckets + 1)
    df[[r.bucket for r in rows]] = [r.n for r in rows]
    return np.log((1 + df[-1]) / (1 + df[:-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts and labels of at most ``per_label`` learnable documents of each label, and the number of learnable documents of each.

    Documents are chosen among those that have a label and a row in ``docs``; of rows
    repeated under one id one counts.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learnable()).distinct()
    known = cut(marks.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_label) for y in (0, 1)]
    chosen = cut(chosen[0].unionByName(chosen[1]), "chosen")  # a table of known size, which Spark may broadcast
    rows = docs.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return [r.text or "" for r in rows], np.array([r.y for r in rows], np.int64), np.array([sizes.get(0, 0), sizes.get(1, 0)], np.float64)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_label: int = 2000, buckets: int = BUCKETS, rank: int = 64, neighbours: int = 25, sharpness: float = 4.0) -> Model:
    """``docs``: (doc_id, text); ``labels``: (doc_id, label), held-out documents are left out here."""
    idf = statistics(docs, buckets)
    sample, y, sizes = labelled_sample(docs, labels, label, per_label)
    x = np.concatenate([weigh(terms(pa.array(sample[a : a + 500], pa.string()), buckets), idf) for a in range(0, len(sample), 500)]) if sample else np.zeros((0, buckets))
    _, axes = np.linalg.eigh(x.T @ x)  # right singular vectors, the largest last
    axes = axes[:, ::-1][:, :rank]
    share = np.bincount(y, minlength=2) / max(1, len(y))
    total = sizes.sum()
    weights = (sizes / total / np.maximum(share, 1e-12))[y] if total else np.zeros(0)
    return Model(idf, axes.astype(np.float32), _unit(x @ axes).astype(np.float32), y, weights, float(sizes[1] / total) if total else 0.5, neighbours, sharpness)


def vote(column: pa.Array, model: Model, block: int = BLOCK) -> np.ndarray:
    out = np.full(len(column), model.prior)
    for a in range(0, len(column), block):
        x = weigh(terms(column.slice(a, block), len(model.idf)), model.idf).astype(np.float32)
        latent = _unit(x @ model.axes)
        use = np.flatnonzero(np.linalg.norm(latent, axis=1) > 0.5)
        if not len(use) or not len(model.labels):
            continue
        cosine = latent[use] @ model.vectors.T
        k = min(model.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** model.sharpness * model.weights[near]
        out[a + use] = np.clip((weight * model.labels[near]).sum(1) / weight.sum(1), 0, 1)
    return out


def score_quality(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as a further column."""
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            yield batch.append_column(score_col, pa.array(vote(batch.column(at), shared.value)))

    return docs.mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, score`` of every document, from a model fitted on the learnable labels."""
    source = texts(docs)
    return score_quality(source, fit(source, labels, **settings)).select("doc_id", "score")
