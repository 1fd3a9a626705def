"""Search responses to snippet records, and their idempotent accumulation.

Responses are JSON text read as VARIANT, because whether a value is an object, an
array or something else decides what it means. A record's key is ``(run_id, qid,
corpus_id, start, end)``, where null equals null; the first writer wins, in the order
``(round, batch, pos)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessella.functions.text import followed

KEY = ["run_id", "qid", "corpus_id", "start", "end"]
RECORD = ["run_id", "qid", "round", "query", "source_seed", "corpus_id", "title", "authors", "open_access", "section", "snippet_kind", "snippet_offset", "text", "ref_mentions", "sentences", "followed_corpus_ids"]


def is_object(v: str) -> Column:
    return F.expr(f"coalesce(schema_of_variant({v}) LIKE 'OBJECT%', false)")


def get(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def identifier(v: str, path: str) -> Column:
    """An id as text; null for what counts as no id: absent, null, empty, false or the number 0."""
    raw = f"try_variant_get({v}, '{path}', 'variant')"
    text = get(v, path)
    is_text = F.expr(f"schema_of_variant({raw}) = 'STRING'")
    number = get(v, path, "double")
    return F.when(is_text, F.when(text != "", text)).when(F.coalesce(number, F.lit(1.0)) != 0, text)


def items(responses: DataFrame, payload: str = "response") -> DataFrame:
    """One row for each object in a response's data array, with its position; other items and shapes give none.

    The data are those of ``result`` if it is an object, else those at the top.
    """
    v = responses.withColumn("__v", F.expr(f"try_parse_json({payload})"))
    v = v.withColumn("__data", F.expr("CASE WHEN coalesce(schema_of_variant(try_variant_get(__v, '$.result', 'variant')) LIKE 'OBJECT%', false) THEN try_variant_get(__v, '$.result.data', 'array<variant>') ELSE try_variant_get(__v, '$.data', 'array<variant>') END"))
    out = v.select(*[c for c in responses.columns if c != payload], F.posexplode("__data").alias("pos", "item"))
    return out.where(is_object("item"))


def flatten(items_: DataFrame, keep: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The record's 16 fields of each item, and the columns to ``keep``; missing fields take their defaults.

    Of the calling context it needs ``run_id, qid, round, query, source_seed, followed``.
    """
    corpus_id = F.coalesce(identifier("item", "$.paper.corpusId"), F.lit(""))
    access = F.expr("try_variant_get(item, '$.paper.openAccessInfo', 'variant')")
    status = F.coalesce(get("item", "$.paper.openAccessInfo.status"), F.lit(""))
    mentions = F.expr("coalesce(try_variant_get(item, '$.snippet.annotations.refMentions', 'array<variant>'), array())")
    sentences = F.expr("coalesce(try_variant_get(item, '$.snippet.annotations.sentences', 'array<variant>'), array())")
    step = items_.withColumns({"__access": access, "__mentions": mentions, "__sentences": sentences, "corpus_id": corpus_id})
    objects = "filter({}, x -> coalesce(schema_of_variant(x) LIKE 'OBJECT%', false))"
    matched = """CASE WHEN schema_of_variant(try_variant_get(x, '$.matchedPaperCorpusId', 'variant')) = 'STRING'
        THEN nullif(try_variant_get(x, '$.matchedPaperCorpusId', 'string'), '')
        WHEN coalesce(try_variant_get(x, '$.matchedPaperCorpusId', 'double'), 1) <> 0 THEN try_variant_get(x, '$.matchedPaperCorpusId', 'string') END"""
    span = "'start', try_variant_get(x, '$.start', 'bigint'), 'end', try_variant_get(x, '$.end', 'bigint')"
    ids = F.element_at(followed("followed"), F.col("corpus_id"))
    return step.select(
        "run_id", "qid", "round", "query", "source_seed", "corpus_id",
        F.coalesce(get("item", "$.paper.title"), F.lit("")).alias("title"),
        F.coalesce(get("item", "$.paper.authors", "array<string>"), F.array().cast("array<string>")).alias("authors"),
        F.when(is_object("__access"), (status != "") & (status != "CLOSED")).alias("open_access"),
        F.coalesce(get("item", "$.snippet.section"), F.lit("")).alias("section"),
        F.coalesce(get("item", "$.snippet.snippetKind"), F.lit("")).alias("snippet_kind"),
        F.struct(get("item", "$.snippet.snippetOffset.start", "bigint").alias("start"), get("item", "$.snippet.snippetOffset.end", "bigint").alias("end")).alias("snippet_offset"),
        F.coalesce(get("item", "$.snippet.text"), F.lit("")).alias("text"),
        F.expr(f"transform({objects.format('__mentions')}, x -> named_struct({span}, 'matched_corpus_id', {matched}))").alias("ref_mentions"),
        F.expr(f"transform({objects.format('__sentences')}, x -> named_struct({span}))").alias("sentences"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("followed_corpus_ids"),
        *keep,
    )


def keyed(records: DataFrame) -> DataFrame:
    return records.withColumns({"start": F.col("snippet_offset.start"), "end": F.col("snippet_offset.end")})


def first_of_each(records: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each key in the given order. Null equals null in the key."""
    window = Window.partitionBy(*KEY).orderBy(*order)
    return keyed(records).withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n", "start", "end")


def fresh(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose key the cache does not have yet."""
    known = keyed(existing).select(*[F.col(k).alias(f"__{k}") for k in KEY]).distinct()
    condition = F.lit(True)
    for k in KEY:
        condition = F.col(k).eqNullSafe(F.col(f"__{k}")) & condition
    return keyed(records).join(known, condition, "left_anti").drop("start", "end")


def append(existing: DataFrame, records: DataFrame, order: list[str]) -> DataFrame:
    """The cache after an append: what it had, and the first new record of each key. Repeating it changes nothing."""
    added = fresh(first_of_each(records, order), existing)
    return existing.unionByName(added.select(*existing.columns))


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows``, and the number of them, which the very job that reads them will have counted."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def growth(records: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """``run_id, qid, round, offered, added``: records offered and newly added in each round."""
    added = fresh(first_of_each(records, order), existing).groupBy("run_id", "qid", "round").agg(F.count("*").alias("added"))
    offered = records.groupBy("run_id", "qid", "round").agg(F.count("*").alias("offered"))
    return offered.join(added, ["run_id", "qid", "round"], "left").withColumn("added", F.coalesce("added", F.lit(0)))


def summary(records: DataFrame) -> DataFrame:
    """``run_id, qid, n, rounds, titled, by_round``: records of each question, its rounds, records with a title, and a map from each round to its records.

    Records are counted by round first, so a busy question is a few rows when it is put together.
    """
    each = records.groupBy("run_id", "qid", "round").agg(F.count("*").alias("n"), F.count_if(F.col("title") != "").alias("titled"))
    rounds = F.map_from_entries(F.collect_list(F.when(F.col("round").isNotNull(), F.struct("round", "n"))))
    return each.groupBy("run_id", "qid").agg(F.sum("n").alias("n"), F.count("round").alias("rounds"), F.sum("titled").alias("titled"), rounds.alias("by_round"))


def running_total(counts: DataFrame, n: str = "added") -> DataFrame:
    """Counts with ``total``: the records of a question up to each round."""
    order = Window.partitionBy("run_id", "qid").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("total", F.sum(n).over(order))


def evidence(records: DataFrame) -> DataFrame:
    """``run_id, qid, text`` of the records with a text."""
    return records.where("text <> ''").select("run_id", "qid", "text")


def manifest_questions(manifests: DataFrame) -> DataFrame:
    """``run_id, created, qid, question, seeds``: one row for each question of a run manifest; none if it lists none."""
    return manifests.select("run_id", "created", F.explode("questions").alias("q")).select("run_id", "created", "q.qid", F.col("q.text").alias("question"), "q.seeds")
