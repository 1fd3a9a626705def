"""Toxicity by a counterfactually regularised linear classifier.

Features are the words of a text and their five-byte beginnings, hashed, present or
not; a text's score (before the logistic) is the sum of its features' weights over the
square root of their number, and a bias. A logistic model with an L1 penalty is fitted by
accelerated proximal gradient steps. Every sentence of the labelled texts that names an
identity group is rewritten: each of its identity terms is replaced by each other term of
its list, and by a neutral mention ("people"). The sentence and each copy are scored by
the model, and the mean square of the score's changes is penalised with weight
``fairness``. A group's mere mention thus cannot carry weight that other mentions do not,
and the neutral mention pulls that common weight towards none. Each term alone, against
the neutral mention, is one more such sentence, so that no term is left out.

Scale: one scan scores all texts; nothing is shuffled. The fit uses a bounded sample:
``per_label`` documents of each label, the first by a hash of the id, whole texts (the
bound is on documents, not on bytes); labels' shares among all learnable documents weigh
the two halves of the loss. The model, which is broadcast, has ``2^bits`` weights.

Defined cases: a null text is empty; an empty text has the score of no features; other
label values than 0 and 1, and labels without a document, are not used; without both
labels, every text scores the share of label 1 (0 without any label).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.llm._common import ALNUM, chunks, hash_words, split_words, texts
from tessella.llm.quality import labelled_sample

BITS, BEGINNING, SCALE = 18, 5, 8.0
#: Lists of identity terms that may stand for each other in a sentence.
IDENTITY = [
    "muslim christian jewish hindu buddhist sikh atheist".split(),
    "muslims christians jews hindus buddhists sikhs atheists".split(),
    "black white asian latino arab african european".split(),
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "gay lesbian straight bisexual transgender".split(),
    "immigrant refugee foreigner native".split(),
    "disabled blind deaf old young".split(),
]
NEUTRAL = "people"


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct feature of each text."""
    words = split_words(column, ALNUM, lower=True)
    doc = words.doc_of()
    short = replace(words, end=np.minimum(words.end, words.start + BEGINNING))
    of = np.concatenate([doc, doc])
    feature = np.concatenate([_bucket(hash_words(words), 0), _bucket(hash_words(short), 1)])
    pairs = np.unique(of << BITS | feature)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


_TERMS = {t: group for group in IDENTITY for t in group}
_NAMED = re.compile(r"(?<![0-9a-z\x80-\U0010ffff])(?:" + "|".join(_TERMS) + r")(?![0-9a-z\x80-\U0010ffff])")
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
_SENTENCE = re.compile(r"[.!?\n]+")


def counterfactuals(sample: list[str]) -> Counter:
    """(sentence, rewritten sentence) and how often it occurs: every swap of an identity term in the sample's sentences, with A-Z folded."""
    found = Counter((t, NEUTRAL) for t in _TERMS)
    for text in sample:
        text = text.translate(_FOLD)
        if _NAMED.search(text):
            for sentence in _SENTENCE.split(text):
                for term in sorted(set(_NAMED.findall(sentence))):
                    for other in (*_TERMS[term], NEUTRAL):
                        if other != term:
                            found[sentence, _NAMED.sub(lambda m, t=term, o=other: o if m.group() == t else m.group(), sentence)] += 1
    return found


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Sparse(NamedTuple):
    """Rows of values at columns."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, minlength=self.n)

    def back(self, x: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.column, x[self.row] * self.value, minlength=d)


def scored_features(listed: list[str]) -> Sparse:
    """Each text's features, each with its share of the score; long texts do not add up small weights."""
    parts = [features(pa.array(listed[a : a + 500], pa.string())) for a in range(0, len(listed), 500)]
    row = np.concatenate([p + a for a, (p, _) in zip(range(0, len(listed), 500), parts, strict=True)])
    size = np.bincount(row, minlength=len(listed)).astype(np.float64)
    return Sparse(row, np.concatenate([f for _, f in parts]), (SCALE / np.sqrt(np.maximum(size, 1)))[row], len(listed))


def changes(swaps: Counter) -> Sparse:
    """What the score of each rewritten sentence has more, or less, than the sentence's."""
    before, after = (scored_features([x[i] for x in swaps]) for i in (0, 1))
    place = np.concatenate([before.row, after.row]) << BITS | np.concatenate([before.column, after.column])
    place, which = np.unique(place, return_inverse=True)
    value = np.bincount(which, np.concatenate([-before.value, after.value]))
    changed = value != 0  # what both sentences have in common cancels
    return Sparse(place[changed] >> BITS, place[changed] & ((1 << BITS) - 1), value[changed], len(swaps))


def train(sample: list[str], y: np.ndarray, sizes: np.ndarray, *, l1: float = 1e-4, fairness: float = 1.0, steps: int = 150) -> Model:
    """Minimises the logistic loss (labels by their shares ``sizes``) + fairness * mean squared change of swapped sentences' scores + l1 * |weights|."""
    n = len(y)
    if not n or not y.any() or y.all():
        prior = float(sizes[1] / sizes.sum()) if sizes.sum() else 0.0
        return Model(np.zeros(1 << BITS), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    x, swaps = scored_features(sample), counterfactuals(sample)
    swap, share = changes(swaps), np.array(list(swaps.values()), np.float64)
    share *= 2 * fairness / share.sum()
    used, column = np.unique(x.column, return_inverse=True)
    d = len(used)
    at = np.minimum(np.searchsorted(used, swap.column), d - 1)
    seen = used[at] == swap.column  # features that no labelled text has keep the weight 0: a swap must not give them any
    x, swap = x._replace(column=column), Sparse(swap.row[seen], at[seen], swap.value[seen], swap.n)
    weight = (sizes / sizes.sum() / (np.bincount(y, minlength=2) / n))[y] / n
    # a step for each weight: row sums bound the curvature in the diagonal metric, of the loss by a quarter of them
    reach = np.bincount(x.row, x.value, minlength=n) + 1
    curvature = 0.25 * x.back(weight * reach, d) + 1e-6
    size = swap._replace(value=np.abs(swap.value))
    curvature += size.back(share * size.times(np.ones(d)), d)
    bias_curvature = 0.25 * float((weight * reach).sum())
    bias = bias_before = float(np.log(sizes[1] / sizes[0]))
    w, momentum, before = np.zeros(d), 1.0, np.zeros(d)
    for _ in range(steps):
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, bias_ahead = w + (momentum - 1) / following * (w - before), bias + (momentum - 1) / following * (bias - bias_before)
        error = (_logistic(x.times(ahead) + bias_ahead) - y) * weight
        slope = x.back(error, d) + swap.back(share * swap.times(ahead), d)
        before, bias_before, momentum = w, bias, following
        w = ahead - slope / curvature
        w = np.sign(w) * np.maximum(np.abs(w) - l1 / curvature, 0)
        bias = bias_ahead - error.sum() / bias_curvature
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_label: int = 3000, **settings) -> Model:
    """``docs``: (doc_id, text); ``labels``: (doc_id, label), held-out documents are left out here."""
    return train(*labelled_sample(docs, labels, label, per_label), **settings)


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    row, feature = features(column)
    size = np.bincount(row, minlength=len(column)).astype(np.float64)
    total = np.bincount(row, model.weights[feature], minlength=len(column))
    return _logistic(SCALE * total / np.sqrt(np.maximum(size, 1)) + model.bias)


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as a further column."""
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            yield batch.append_column(score_col, pa.array(score_texts(batch.column(at), shared.value)))

    return docs.mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, score`` of every document, from a model fitted on the learnable labels."""
    source = texts(docs)
    return score_toxicity(source, fit(source, labels, **settings)).select("doc_id", "score")
