"""A corpus pipeline of five stages: quality, lines, near-duplicates, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that the stage
before it kept, and returns them with the columns of ``documents``; the last returns
where each piece of each document is packed. ``run`` writes each stage's result as
Parquet in the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, lines, minhash, packing, quality
from tessella.llm._common import texts
from tessella.tables import cut, read

#: Documents with a lower quality score are rejected.
QUALITY = 0.3


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote at least QUALITY for good."""
    model = quality.fit(texts(docs), read(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, score_col="__score")
    return scored.where(F.col("__score") >= QUALITY).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates (the first document keeps them); ``n_chars`` follows the text.

    A document of which no word is left, all its lines being in earlier ones, goes; one that had none before stays.
    """
    kept = lines.drop_lines(docs).where((F.col("__n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, in one row.

    Of rows with one id and one text, the one that is smallest in the other columns stays;
    different texts under one id, and rows without an id, are not taken for repeated rows.
    Only rows whose id is repeated are shuffled for this.
    """
    copies = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__copy")).distinct()
    copies = cut(copies, "copies")
    kept = docs.join(copies, docs["doc_id"].cast("long") == copies["__copy"], "left_anti")
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    repeated = cut(repeated, "repeated")
    once = kept.join(repeated, kept["doc_id"] == repeated["__id"], "left_anti")
    rest = F.min(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")])).alias("__rest")
    of_each = kept.join(repeated, kept["doc_id"] == repeated["__id"], "left_semi").groupBy("doc_id", "text").agg(rest)
    return once.unionByName(of_each.select(*[c if c in ("doc_id", "text") else F.col(f"__rest.{c}").alias(c) for c in docs.columns]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    leaks = cut(found.where("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].cast("long") == leaks["__leak"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The quality and packing stages have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
