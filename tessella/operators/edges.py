"""Reduction of ontology edges.

Edges are ``(cell, relation, pr)``. :func:`reduce_edges` keeps targets that some cell
asserts, drops excluded ones, flags asserted edges, prunes relations that a more
specific one of the same pair entails, and labels what remains. Joins are declared by
key only; the small dimensions (relations, exclusions, ancestors) are left to Spark's
own size check for broadcasting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import OBO, curie
from tessella.tables import cut

# Marker relations with their senses, the order of senses in reports, and excluded targets.
SENSES = {
    f"{OBO}RO_0002104": "positive",
    f"{OBO}RO_0002292": "positive",
    f"{OBO}BFO_0000051": "positive",
    f"{OBO}CL_4030046": "negative",
    f"{OBO}CL_4030045": "negative",
    f"{OBO}RO_0015015": "high",
    f"{OBO}RO_0015016": "low",
}
SENSE_ORDER = ("positive", "high", "low", "negative", "other")
EXCLUDED = (f"{OBO}PR_000000001",)
KEY = ["cell", "relation", "pr"]


def sense(relation: str = "relation"):
    """The sense of a relation; ``other`` for relations that are not marker relations."""
    table = F.create_map(*[F.lit(x) for pair in SENSES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(relation)), F.lit("other"))


def sense_position(column: str = "sense"):
    return F.array_position(F.array(*[F.lit(s) for s in SENSE_ORDER]), F.col(column))


def typed(edges: DataFrame, cells: DataFrame, known: DataFrame) -> DataFrame:
    """Edges from known cells to known targets (``cells (cell)``, ``known (pr)``)."""
    return edges.join(cells.select("cell").distinct(), "cell", "left_semi").join(known.select("pr").distinct(), "pr", "left_semi")


def targets(asserted: DataFrame, excluded: DataFrame) -> DataFrame:
    """``pr``: targets that some cell asserts by any relation, without the excluded ones."""
    return asserted.select("pr").distinct().join(excluded.select("pr"), "pr", "left_anti")


def _bit(relations: list[str]):
    """The bit of a row's relation in ``relations``, of which there are at most 62."""
    bits = F.create_map(*[F.lit(x) for i, r in enumerate(relations) for x in (r, 1 << i)])
    return F.element_at(bits, F.col("relation")).cast("long")


def _pairs(inferred: DataFrame, asserted: DataFrame | None, relations: list[str]) -> DataFrame:
    """``cell, pr, held, said``: one row for each inferred pair, with the bits of the relations by which it is inferred, and asserted.

    The rows are dealt by cell, once: what is made of a pair afterwards, and the labels of
    cells, need no other shuffle of them.
    """

    def rows(edges: DataFrame, held: bool) -> DataFrame:
        bits = [(_bit(relations) if own else F.lit(0).cast("long")).alias(name) for name, own in (("held", held), ("said", not held))]
        return edges.where(F.col("relation").isin(relations)).select("cell", "pr", *bits)

    both = rows(inferred, True)
    if asserted is not None:
        both = both.unionByName(rows(asserted.where("cell is not null"), False))  # without a cell nothing is the same edge
    return both.repartition("cell").groupBy("cell", "pr").agg(F.bit_or("held").alias("held"), F.bit_or("said").alias("said")).where("held <> 0")


def _has(bits: str, i: int):
    return F.col(bits).bitwiseAND(F.lit(1 << i).cast("long")) != 0


def _edges_of(pairs: DataFrame, relations: list[str]) -> DataFrame:
    """The other columns of ``pairs`` with ``relation, asserted``: a row for each relation held."""
    each = F.array(*[F.when(_has("held", i), F.struct(F.lit(r).alias("relation"), _has("said", i).alias("asserted"))) for i, r in enumerate(relations)])
    return pairs.select(*[c for c in pairs.columns if c not in ("held", "said")], F.inline(F.filter(each, lambda x: x.isNotNull())))


def kept_edges(inferred: DataFrame, asserted: DataFrame, excluded: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Distinct inferred edges whose relation is listed, whose target some cell asserts by any relation, and is not excluded."""
    listed = list(dict.fromkeys(relations)) if relations is not None else list(SENSES)
    blocks = [listed[i : i + 62] for i in range(0, len(listed), 62)] or [[]]
    kept = [_edges_of(_pairs(inferred, None, b).join(targets(asserted, excluded), "pr", "left_semi"), b).select(*KEY) if b else inferred.select(*KEY).where("false") for b in blocks]
    return reduce(DataFrame.unionByName, kept)


def flag_asserted(edges: DataFrame, asserted: DataFrame) -> DataFrame:
    """``edges`` with ``asserted``: whether exactly this edge is asserted."""
    said = asserted.select(*KEY).distinct().withColumn("asserted", F.lit(True))
    return edges.join(said, KEY, "left").withColumn("asserted", F.coalesce("asserted", F.lit(False)))


def inferred_only(edges: DataFrame, asserted: DataFrame) -> DataFrame:
    return edges.join(asserted.select(*KEY).distinct(), KEY, "left_anti")


def closure(parents: DataFrame, listed: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """All pairs ``(sub, super)`` of a parent table's transitive closure, without pairs of one node with itself.

    Paths may pass through any node; with ``listed (node)``, both ends must be listed.
    Each round joins the pairs that the last one added with all pairs, at either end, so
    the length of the paths found doubles; it stops when no pair is new, so cycles end
    too. Rounds are written to the shared folder, which keeps plans short. Pairs that are
    still growing after ``max_rounds`` (paths of 2^64 steps by default) are an error.
    """
    pairs = new = cut(parents.select("sub", "super").where("sub is not null and super is not null").distinct(), "closure")
    for _ in range(max_rounds):
        before = new.alias("a").join(pairs.alias("b"), F.col("a.super") == F.col("b.sub")).select("a.sub", "b.super")
        after = pairs.alias("a").join(new.alias("b"), F.col("a.super") == F.col("b.sub")).select("a.sub", "b.super")
        new = cut(before.unionByName(after).distinct().join(pairs, ["sub", "super"], "left_anti"), "closure")
        if new.isEmpty():
            break
        pairs = pairs.unionByName(new)
    else:
        raise ValueError(f"the closure still grows after {max_rounds} rounds")
    pairs = pairs.where("sub <> super")
    if listed is not None:
        for end in ("sub", "super"):
            pairs = pairs.join(listed.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return pairs.select("sub", "super")


def ancestor_sets(pairs: DataFrame) -> DataFrame:
    """``sub, supers``: each node's ancestors, sorted."""
    return pairs.groupBy("sub").agg(F.sort_array(F.collect_set("super")).alias("supers"))


def most_specific(edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Edges without those whose relation is an ancestor of another relation of the same ``(cell, pr)``."""
    entailed = edges.join(ancestors.select(F.col("sub").alias("relation"), "super"), "relation").select("cell", "pr", F.col("super").alias("relation")).distinct()
    return edges.join(entailed, KEY, "left_anti")


def one_label(labels: DataFrame, entity: str, label: str) -> DataFrame:
    """One label for each entity: the smallest that is not empty."""
    return labels.groupBy(entity).agg(F.min(F.when(F.length(label) > 0, F.col(label))).alias(label))


def label_edges(edges: DataFrame, cell_labels: DataFrame, relation_labels: DataFrame) -> DataFrame:
    """Edges with ``cell_label`` (none: empty) and ``relation_label`` (none: the relation's compact form).

    Labels are united to one for each entity before the joins, which then cannot multiply edges.
    """
    cells = one_label(cell_labels, "cell", "cell_label")
    relations = one_label(relation_labels, "relation", "relation_label")
    return (
        edges.join(cells, "cell", "left")
        .join(relations, "relation", "left")
        .withColumns({"cell_label": F.coalesce("cell_label", F.lit("")), "relation_label": F.coalesce("relation_label", curie("relation"))})
    )


def _without_entailed(pairs: DataFrame, ancestors: DataFrame, relations: list[str]) -> DataFrame:
    """``pairs`` whose ``held`` lacks the relations that are ancestors of another one held; a pair without a cell keeps all."""
    listed = ancestors.where(F.col("sub").isin(relations) & F.col("super").isin(relations) & (F.col("sub") != F.col("super")))
    entails = [0] * len(relations)
    for sub, above in listed.select("sub", "super").distinct().collect():  # at most one for each two of the few relations
        entails[relations.index(sub)] |= 1 << relations.index(above)
    bits = [F.when(_has("held", i), F.lit(x).cast("long")).otherwise(F.lit(0).cast("long")) for i, x in enumerate(entails) if x]
    if not bits:
        return pairs
    entailed = F.when(F.col("cell").isNull(), F.lit(0).cast("long")).otherwise(reduce(lambda x, y: x.bitwiseOR(y), bits))
    return pairs.withColumn("held", F.col("held").bitwiseAND(F.bitwise_not(entailed))).where("held <> 0")


def reduced_pairs(inferred: DataFrame, asserted: DataFrame, ancestors: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``cell, pr, held, said``: pairs with the bits of their marker relations, pruned, to any target; with ``cells`` (one row a cell) also its other columns."""
    relations = list(SENSES)
    pairs = _without_entailed(_pairs(inferred, asserted, relations), ancestors, relations)
    return pairs if cells is None else pairs.join(cells, "cell", "left")


def reduced_keys(inferred: DataFrame, asserted: DataFrame, ancestors: DataFrame, excluded: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``cell, relation, pr, asserted`` of the kept edges, flagged and pruned; with ``cells`` (one row a cell) also its other columns.

    The marker relations are few, so a pair's relations are bits of one number: edges are
    made distinct, flagged and pruned in one aggregate by pair, and are dealt only twice, by cell
    (where cells are labelled too) and by target. The results are those of :func:`kept_edges`,
    :func:`flag_asserted` and :func:`most_specific`, which take any relations.
    """
    pairs = reduced_pairs(inferred, asserted, ancestors, cells)
    found = _edges_of(pairs.join(targets(asserted, excluded), "pr", "left_semi"), list(SENSES))
    return found.select(*KEY, "asserted", *([x for x in cells.columns if x != "cell"] if cells is not None else []))


def _described(kept: DataFrame, relation_labels: DataFrame) -> DataFrame:
    """Reduced edges with the labels that their cells have; columns of theirs that are not an edge's stay behind it."""
    named = F.broadcast(one_label(relation_labels.where(F.col("relation").isin(*SENSES)), "relation", "relation_label"))  # a row for each marker relation at most
    more = [c for c in kept.columns if c not in (*KEY, "cell_label", "asserted")]
    return kept.join(named, "relation", "left").select(
        "cell", F.coalesce("cell_label", F.lit("")).alias("cell_label"), "relation", F.coalesce("relation_label", curie("relation")).alias("relation_label"), sense().alias("sense"), "asserted", "pr", *more,
    )


def reduce_edges(inferred: DataFrame, asserted: DataFrame, ancestors: DataFrame, cell_labels: DataFrame, relation_labels: DataFrame, excluded: DataFrame) -> DataFrame:
    """``cell, cell_label, relation, relation_label, sense, asserted, pr``: all steps in order."""
    return _described(reduced_keys(inferred, asserted, ancestors, excluded, one_label(cell_labels, "cell", "cell_label")), relation_labels)


def edges_of(pairs: DataFrame, known: DataFrame, relation_labels: DataFrame) -> DataFrame:
    """The edges of :func:`reduce_edges` from its pairs (:func:`reduced_pairs`, with ``cell_label``) to ``known (pr, ...)``, with the other columns of this.

    Pairs are dealt by target, also to few targets, so that those of one target, which repeat what is known of it, stand together.
    """
    return _described(_edges_of(pairs.join(known.hint("merge"), "pr"), list(SENSES)), relation_labels)


def excluded_targets(spark: SparkSession, targets: tuple[str, ...] = EXCLUDED) -> DataFrame:
    return spark.createDataFrame([(t,) for t in targets], "pr string")


def sense_counts(edges: DataFrame) -> DataFrame:
    """Edges of each sense for each cell; none: 0."""
    counted = edges.groupBy("cell").pivot("sense", list(SENSE_ORDER)).count()
    return counted.select("cell", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in SENSE_ORDER])


def summary(edges: DataFrame) -> DataFrame:
    """One row: distinct cells, edges, asserted edges."""
    return edges.agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("edges"), F.count_if("asserted").alias("asserted_edges"))
