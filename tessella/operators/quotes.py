"""Quotations in reports against an evidence corpus.

A quote is found in a text if its segments (between ellipses) occur in the text in
order and without overlap, after normalisation of both. ``LIKE`` has exactly this
meaning; a plain ``contains`` of the first segment before it decides most pairs cheaply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import for_match, in_order, quotes, segments
from tessella.tables import cut


def extract(reports: DataFrame, markdown: str = "md") -> DataFrame:
    """The reports' other columns with ``quote_no`` (from 0) and ``quote`` for each quotation; repeats stay."""
    keys = [x for x in reports.columns if x != markdown]
    return reports.select(*keys, F.posexplode(quotes(markdown)).alias("quote_no", "quote"))


def with_segments(quoted: DataFrame, quote: str = "quote") -> DataFrame:
    """Quotes with ``segments`` and the ``pattern`` of their order."""
    return quoted.withColumn("segments", segments(quote)).withColumn("pattern", in_order("segments"))


def prepare(evidence: DataFrame, text: str = "text") -> DataFrame:
    """Evidence with a text, normalised once as ``nt``; never null, so that no filter for null needs it worked out a second time."""
    return evidence.where(F.col(text) != "").withColumn("nt", F.coalesce(for_match(text), F.lit("")))


def fits(nt: str = "nt") -> Column:
    return F.contains(F.col(nt), F.element_at("segments", 1)) & F.expr(f"{nt} LIKE pattern")


#: Bytes of one question's evidence that one task searches.
PART_BYTES = 1 << 24


def busy(evidence: DataFrame, keys: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """``keys, parts`` of the questions whose evidence is more than one part, by the sizes of their own texts; one for every ``part_bytes`` of evidence at most."""
    sizes = evidence.groupBy(*keys).agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > part_bytes)
    return sizes.select(*keys, F.ceil(F.col("bytes") / part_bytes).cast("int").alias("parts"))


def dealt(evidence: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence as ``__keys, __nt, __of``: its part of its question's, where ``parts`` (of :func:`busy`) says that there are several; else 0."""
    of = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("text"), F.col("parts"))).otherwise(0).cast("int")
    return evidence.join(parts, keys, "left").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("nt").alias("__nt"), of.alias("__of"))


def found_in(quoted: DataFrame, evidence: DataFrame, keys: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Distinct ``keys, pattern`` of the quotes that an evidence text with the same keys holds.

    A quote and its question's texts meet in one task, which stops at the first text that holds
    the quote. The texts of a busy question are dealt into parts, as many as its own evidence
    needs: a quote is looked for in the first of them, and only where it is not found
    there in the others. ``evidence`` as of :func:`prepare`, with its ``text``.
    """
    asked = quoted.where(F.size("segments") > 0).select(*keys, "segments", "pattern").distinct()

    def semi(asked: DataFrame, held: DataFrame, condition: Column) -> DataFrame:
        for k in keys:
            condition = (asked[k] == held[f"__{k}"]) & condition
        return asked.join(held, condition & fits("__nt"), "left_semi").select(*keys, "pattern").distinct()

    parts = cut(busy(evidence, keys, part_bytes), "busy")
    if parts.isEmpty():
        return semi(asked, evidence.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("nt").alias("__nt")), F.lit(True))
    held = dealt(evidence, parts, keys)
    first = cut(semi(asked, held.where("__of = 0"), F.lit(True)), "found")
    rest = asked.join(parts, keys).join(first, [*keys, "pattern"], "left_anti")
    rest = rest.withColumn("__part", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)))
    return first.unionByName(semi(rest, held.where("__of > 0"), F.col("__part") == F.col("__of")))


def missing(quoted: DataFrame, evidence: DataFrame, keys: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Quotes that no evidence text with the same keys holds; a quote without segments is never missing.

    ``quoted`` as of :func:`with_segments`, ``evidence`` as of :func:`prepare`.
    """
    return quoted.where(F.size("segments") > 0).join(found_in(quoted, evidence, keys, part_bytes), [*keys, "pattern"], "left_anti").select(*quoted.columns)


def message(quote: str = "quote") -> Column:
    return F.concat(F.lit('Quote not found in evidence: "'), F.substring(quote, 1, 80), F.lit('..."'))


def no_evidence(run_id: str = "run_id", qid: str = "qid") -> Column:
    return F.concat(F.lit("No evidence for run '"), F.col(run_id), F.lit("' and question '"), F.col(qid), F.lit("'."))


def verdicts(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """``report_id, passed, n_errors, errors``: a report fails if a quote is missing, or if its run and question have no evidence."""
    keys = ["run_id", "qid"]
    prepared = prepare(evidence)
    there = prepared.groupBy(*keys).agg(F.count("*").alias("n_texts"))
    lost = missing(with_segments(extract(reports)), prepared, keys)
    lost = lost.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("quote_no", message().alias("m")))).alias("lost"))
    joined = reports.select("report_id", *keys).join(there, keys, "left").join(lost, "report_id", "left")
    errors = F.when(F.coalesce("n_texts", F.lit(0)) == 0, F.array(no_evidence())).otherwise(
        F.coalesce(F.transform("lost", lambda x: x["m"]), F.array().cast("array<string>"))
    )
    return joined.select("report_id", errors.alias("errors")).select("report_id", (F.size("errors") == 0).alias("passed"), F.size("errors").cast("long").alias("n_errors"), "errors")


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))


def corpus_matches(quoted: DataFrame, corpus: DataFrame, quote_key: str, text_key: str, text: str = "text", gram: int = 3) -> DataFrame:
    """``(quote_key, text_key)`` of every text of a whole corpus that holds the quote.

    A quote's segments may begin and end within a word, so a join word is taken from
    their inner words: the one that the fewest texts hold (ties: the smaller word). A
    quote without an inner word is joined by a run of ``gram`` characters of its longest
    segment in the same way, a shorter one by that segment. The corpus is read for the
    few candidate words only; what it has of them is written once, and texts are
    normalised again only where a candidate is found.
    ``quoted`` as of :func:`with_segments`, ``corpus`` as of :func:`prepare`.
    """
    inner = F.flatten(F.transform("segments", lambda s: F.slice(F.split(s, " "), 2, F.greatest(F.size(F.split(s, " ")) - 2, F.lit(0)))))
    asked = quoted.where(F.size("segments") > 0).select(quote_key, "segments", "pattern", F.array_distinct(F.filter(inner, lambda w: w != "")).alias("inner"))
    longest = F.element_at(F.array_sort(F.transform("segments", lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), -1)["s"]

    def by(quotes_: DataFrame, tokens: Column, held: Column, name: str) -> DataFrame:
        candidates = quotes_.select(quote_key, F.explode(F.array_distinct(tokens)).alias("token"))
        has = corpus.select(text_key, F.explode(F.array_distinct(held)).alias("token")).join(candidates.select("token").distinct(), "token", "left_semi")
        has = cut(has, f"quote-{name}")
        frequency = has.groupBy("token").agg(F.count("*").alias("n"))
        rarest = candidates.join(frequency, "token", "left").groupBy(quote_key).agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
        hits = rarest.join(has, "token").select(quote_key, text_key).join(quotes_.select(quote_key, "segments", "pattern"), quote_key)
        met = hits.join(corpus.select(text_key, text), text_key).withColumn("nt", for_match(text))
        return met.where(fits()).select(quote_key, text_key)

    matches = by(asked.where(F.size("inner") > 0), F.col("inner"), F.split("nt", " "), "words")
    short = cut(asked.where(F.size("inner") == 0).withColumn("longest", longest).drop("inner"), "quote-short")
    for size in [r[0] for r in short.select(F.least(F.length("longest"), F.lit(gram))).distinct().collect()]:  # at most ``gram`` lengths
        own = short.where(F.least(F.length("longest"), F.lit(gram)) == size)
        matches = matches.unionByName(by(own, _grams(F.col("longest"), size), F.when(F.length("nt") >= size, _grams(F.col("nt"), size)), f"runs-{size}"))
    return matches
