"""Grouping of spelling variants by one-edit neighbourhoods over a reduced alphabet.

Words are counted first, once. Two words of the vocabulary are near if they differ by one
inserted, deleted or replaced code point. To find them, code points are hashed to
``symbols`` symbols; of each reduced word, the reduced words within one edit are generated
in full (with ``symbols`` 8 about 16 a letter), and joined with the reduced vocabulary. Two
near words have reduced words within one edit or equal ones, so none is missed, and each
pair is met from either side once; pairs are verified on the original words. A few symbols
keep the neighbourhoods small, which with the letters' own alphabet, of any script, would
grow with its size.

Reduced words are not spelt out but hashed as sums over their letters, so that each
neighbour is had from partial sums in one step, and a word's neighbourhood takes memory in
proportion to its length, however long it is.

A word's form is its most frequent near word, if that is frequent enough; its root is found
by following forms to the last one, in rounds that double the distance.

Scale: the texts are read once, and words are counted in each task before they are shuffled,
so a common word is one row a task. All that follows works on the vocabulary: neighbours
are 16 bytes each, and words move for verification only.

Defined cases: null, empty and wordless texts have no words; rows repeated under one id count
each time; ties of ``n`` go to the smaller word in code-point order; a word without near
words has ``n_near`` 0, no form, and is its own root; an empty vocabulary gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import mix, odd_constants, ranges, record, release, runs, signed, texts
from tessella.tables import cut

SYMBOLS = 8
#: Letters of words that one NumPy pass handles; a longer single word is one pass of its own.
LETTERS = 20_000

# ---------------------------------------------------------------- words


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, word``: each maximal run of Latin letters, in every place, with A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(r"[A-Za-zÀ-ÿ]+"), 0)
    return texts(docs, id_col, text_col).select("doc_id", F.explode(found).alias("word"))


def misspelt(words: DataFrame, every: int = 199) -> DataFrame:
    """``word``: with one letter deleted where ``every`` divides the CRC-32 of ``<doc_id>:<word>``, and unchanged elsewhere (rows without an id, too)."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return words.select("word", h.alias("h")).select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """``word, n`` of the words of so many code points that occur so often."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- reduced neighbourhoods


def reduce(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words' code points, and each word's length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return (codes % symbols).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def neighbourhoods(symbol: np.ndarray, length: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each reduced word; and (word, hash) of each distinct reduced word within one edit of it, itself included.

    A reduced word's hash is the sum of value(symbol) x factor(place) over its letters. Where a letter is deleted or
    inserted, those after it count with the factor of the place before or after their own.
    """
    value, factor = odd_constants(symbols, 61), odd_constants(int(length.max(initial=0)) + 2, 62)
    first = np.cumsum(length) - length
    of, place = np.repeat(np.arange(len(length)), length), ranges(np.zeros(len(length), np.int64), length)
    own = value[symbol]

    def before(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each letter the sum of its word's earlier terms; and each word's whole sum."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return total[:-1] - total[first][of], total[first + length] - total[first]

    here, whole = before(own * factor[place])
    left, all_left = before(own * np.where(place > 0, factor[place - 1], np.uint64(0)))
    right, all_right = before(own * factor[place + 1])
    deleted = here + all_left[of] - left - own * np.where(place > 0, factor[place - 1], np.uint64(0))
    replaced = (whole[of] - own * factor[place])[:, None] + factor[place][:, None] * value
    inserted = (here + all_right[of] - right)[:, None] + factor[place][:, None] * value  # before each letter
    added = whole[:, None] + factor[length][:, None] * value  # after the last
    words = np.arange(len(length))
    word = np.concatenate([words, of, np.repeat(of, symbols), np.repeat(of, symbols), np.repeat(words, symbols)])
    h = mix(np.concatenate([whole, deleted, replaced.ravel(), inserted.ravel(), added.ravel()]))
    order = np.lexsort((h, word))
    word, h = word[order], h[order]
    new = runs(word, h)
    return mix(whole), word[new], h[new]


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Ids and words of rows (id, word), about :data:`LETTERS` letters at a time."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        group = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // LETTERS
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(words)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield ids[a:b], words[a:b]
    release()


def reduced(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    for ids, words in _passes(batches):
        own, _, _ = neighbourhoods(*reduce(words, symbols), symbols)
        yield record(key=signed(own), id=ids)


def neighbours(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    for ids, words in _passes(batches):
        _, word, h = neighbourhoods(*reduce(words, symbols), symbols)
        yield record(key=signed(h), other=ids[word])


def near_words(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, other, other_n``: both directions of every pair of words of ``vocab (word, n)`` at one edit."""
    listed = cut(vocab.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    rows = listed.select("id", "word")
    known = rows.mapInArrow(lambda it: reduced(it, symbols), "key long, id long")
    around = rows.mapInArrow(lambda it: neighbours(it, symbols), "key long, other long")
    met = cut(around.join(known, "key").where("id <> other").select("id", "other"), "candidates")
    other = listed.select(F.col("id").alias("other"), F.col("word").alias("__word"), F.col("n").alias("__n"))
    pairs = met.join(listed, "id").join(other, "other").where(F.levenshtein("word", "__word", 1) == 1)
    return pairs.select("word", "n", F.col("__word").alias("other"), F.col("__n").alias("other_n"))


# ---------------------------------------------------------------- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form: the last word that following ``forms (word, form)``, which have no cycles, reaches."""
    step = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return step
        step = moved.drop("moved")


def group_variants(vocab: DataFrame, *, ratio: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocab (word, n)``; a form is at least ``ratio`` times as frequent."""
    vocab = cut(vocab.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(vocab, symbols).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.n") >= ratio * F.col("n")
    near = cut(near.select("word", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")), "near")
    last = roots(near.where("form is not null"))
    found = vocab.join(near, "word", "left").join(last, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
