"""A persisted index of a corpus, in which quotes are looked up without reading the corpus.

Four tables under one path, in folders by what they are looked up by: ``tokens (text, words)``,
the distinct words of each normalised text as 32-bit hashes, a row for each folder that their hashes are in;
``words (word, token, n)``, each extension's distinct words by hash, and how many of
its texts have them; ``runs (run, word)``, the up to three characters from each position of a
word, written when a word is first met, in folders by their first character; and
``texts (text, nt)``, the normalised texts. Words that share a hash share their texts, which are
compared with the quote in any case. :func:`extend` adds the texts that the index does not have
yet; ``words`` is written after ``runs``, and ``texts`` last, which says what the index has, so
that an extension that failed can simply be run again (what it had written twice counts once).

:func:`matches` looks a quote up by one of its inner words, which must be whole words of a
text: the one that the fewest texts have. A quote without an inner word may begin and end
within words: it is looked up by the words of the vocabulary that contain its longest
piece, which are found by a run of characters. Only the folders of the words looked up,
and of the candidates' texts, are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.quotes import fits, prepare
from tessella.tables import cut, read_or_empty

#: Folders of each table, a power of two, and the longest run of characters.
FOLDERS, RUN = 16, 3
_TABLES = {"tokens": "text {key}, words array<int>", "words": "word int, token string, n bigint", "runs": "run string, word int", "texts": "text {key}, nt string"}
#: Bits of a hash that are not its folder's, and the least hash of each folder.
_BITS = 33 - FOLDERS.bit_length()
_LEAST = [(folder - FOLDERS // 2) << _BITS for folder in range(FOLDERS)]


def _hash(word: Column | str) -> Column:
    return F.hash(word).bitwiseOR(F.lit(1))  # odd, and so never the least hash of a folder


def _folder(by: str) -> Column:
    if by == "word":
        return F.shiftright(by, _BITS) + F.lit(FOLDERS // 2)
    return F.pmod(F.xxhash64(F.substring(by, 1, 1) if by == "run" else by), F.lit(FOLDERS)).cast("int")


def _read(spark: SparkSession, path: str, table: str, key: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/{table}", f"{_TABLES[table].format(key=key)}, folder int", "parquet")


def _write(placed: DataFrame, path: str, table: str) -> None:
    """Append to a table's folders; a large folder is split by Spark."""
    placed.hint("rebalance", "folder").write.mode("append").partitionBy("folder").parquet(f"{path}/{table}")


def _new(corpus: DataFrame, known: DataFrame, text_key: str) -> DataFrame:
    """``(text, nt)`` of the keys that are not known, which only are normalised. Texts are joined only if the index has texts, and grouped only where a key is repeated."""
    keys = corpus.select(text_key).where(F.col(text_key).isNotNull())
    offered = corpus.select(text_key, "text").where(F.col(text_key).isNotNull())
    if not known.isEmpty():
        offered = offered.join(known.select(F.col("text").alias(text_key)), text_key, "left_anti")
    prepared = lambda rows: prepare(rows).select(F.col(text_key).alias("text"), "nt")
    repeated = cut(keys.groupBy(text_key).count().where("count > 1").select(text_key), "repeated")
    if repeated.isEmpty():
        return prepared(offered)
    one = prepared(offered.join(repeated, text_key, "left_semi")).groupBy("text").agg(F.min("nt").alias("nt"))
    return prepared(offered.join(repeated, text_key, "left_anti")).unionByName(one)


def _by_folder(new: DataFrame) -> DataFrame:
    """``(text, folder, words)`` of texts ``(text, nt)``: hashes in order, cut where each folder's least one is put in."""
    hashes = F.concat(F.transform(F.split("nt", " "), _hash), F.array(*[F.lit(x) for x in _LEAST]))
    ordered = new.where("nt <> ''").select("text", F.sort_array(F.array_distinct(hashes)).alias("words"))
    ordered = ordered.withColumn("at", F.array(*[F.array_position("words", F.lit(x)).cast("int") for x in _LEAST]))
    parts = F.transform("at", lambda at, i: F.slice("words", at + 1, F.coalesce(F.get("at", i + 1), F.size("words") + 1) - at - 1))
    return ordered.select("text", F.posexplode(parts).alias("folder", "words")).where(F.size("words") > 0)


def extend(corpus: DataFrame, path: str, text_key: str = "doc_id") -> int:
    """Add the texts of ``corpus (text_key, text)`` whose key the index does not have; returns their number. Empty texts hold no quote and are left out; of rows with one key one counts."""
    spark, key = corpus.sparkSession, corpus.schema[text_key].dataType.simpleString()
    new = cut(_new(corpus, _read(spark, path, "texts", key).select("text"), text_key), "new-texts")
    n = new.count()
    if n:
        _write(_by_folder(new), path, "tokens")
        tokens = new.where("nt <> ''").select(F.explode(F.array_distinct(F.split("nt", " "))).alias("token"))
        words = tokens.groupBy("token").agg(F.count("*").alias("n")).select(_hash("token").alias("word"), "token", "n")
        words = cut(words.withColumn("folder", _folder("word")), "new-words")
        met, unmet = _read(spark, path, "words", key), words
        if not met.isEmpty():
            unmet = words.join(met, ["word", "token"], "left_anti")
        runs = F.regexp_extract_all("token", F.lit(f"(?s)(?=(.{{1,{RUN}}}))"), F.lit(1))
        _write(unmet.select(F.explode(F.array_distinct(runs)).alias("run"), "word").withColumn("folder", _folder("run")), path, "runs")
        _write(words, path, "words")
        _write(new.withColumn("folder", _folder("text")), path, "texts")
    return n


def _of_folders(table: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """``table`` without the folders that hold no value of ``wanted``."""
    folders = [r[0] for r in wanted.select(_folder(by)).distinct().collect()]  # at most FOLDERS numbers
    return table.where(F.col("folder").isin(folders)).drop("folder")


def _within(short: DataFrame, runs: DataFrame, words: DataFrame) -> DataFrame:
    """``(quote_id, word)`` of the words that contain the piece of ``short (quote_id, piece, run)``; a run shorter than ``RUN`` is the beginning of those stored."""
    sizes = [r[0] for r in short.select(F.length("run")).distinct().collect()]  # at most RUN lengths
    if not sizes:
        return short.select("quote_id", F.lit(0).alias("word"))
    begun = F.array_distinct(F.array(*[F.substring("run", 1, size) for size in sizes]))
    met = _of_folders(runs, short, "run").select(F.explode(begun).alias("run"), "word").join(short, "run")
    met = cut(met.select("quote_id", "piece", "word").distinct(), "met")
    return _of_folders(words, met, "word").join(met, "word").where(F.contains("token", "piece")).select("quote_id", "word").distinct()


def matches(quoted: DataFrame, path: str, quote_key: str, text_key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """``(quote_key, text_key)`` of every indexed text that holds the quote. ``quoted`` as of :func:`tessella.operators.quotes.with_segments`."""
    spark = quoted.sparkSession
    tokens, words, runs, texts = (_read(spark, path, t, key_type) for t in _TABLES)
    pieces = F.transform("segments", lambda s: F.split(s, " "))
    inner = F.flatten(F.transform(pieces, lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))))
    longest = F.array_max(F.transform(F.flatten(pieces), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    asked = quoted.where(F.size("segments") > 0).select(F.col(quote_key).alias("quote_id"), "segments", "pattern", F.array_distinct(F.filter(inner, lambda w: w != "")).alias("inner"), longest.alias("piece"))
    asked = cut(asked, "asked")

    whole = asked.select("quote_id", F.explode("inner").alias("token")).withColumn("word", _hash("token"))
    frequency = _of_folders(words, whole, "word").drop("token").join(whole.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    rarest = whole.join(frequency, "word", "left").groupBy("quote_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("word"))
    short = asked.where(F.size("inner") == 0).select("quote_id", "piece", F.substring("piece", 1, RUN).alias("run"))
    chosen = cut(rarest.select("quote_id", "word").unionByName(_within(short, runs, words)), "chosen")
    hits = cut(_of_folders(tokens, chosen, "word").select("text", F.explode("words").alias("word")).join(chosen, "word").select("quote_id", "text").distinct(), "hits")
    met = _of_folders(texts, hits, "text").join(hits, "text").join(asked.select("quote_id", "segments", "pattern"), "quote_id")
    return met.where(fits()).select(F.col("quote_id").alias(quote_key), F.col("text").alias(text_key)).distinct()
