"""Annotation of targets: metadata, CD tokens, species identifiers.

Inputs are long tables of statements, so several multi-valued attributes of an entity
never multiply each other: one conditional aggregate for each entity replaces a chain
of outer joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import OBO, cd_tokens

# Synonym scopes in order of preference, and the species of interest.
SCOPES = ("label", "exact", "related", "narrow", "broad")
TAXA = {f"{OBO}NCBITaxon_10090": "mouse", f"{OBO}NCBITaxon_9606": "human"}
UNIPROT = "UniProtKB:"


def metadata(statements: DataFrame) -> DataFrame:
    """``pr, label, taxa, exact, related, narrow, broad, xrefs, uniprot`` from ``(pr, attribute, value)``.

    ``attribute`` is a scope, ``xref`` or ``taxon``. Targets without a label have no
    row; of several labels the smallest counts; arrays are sorted and distinct; taxa
    other than the two known ones are left out.
    """

    def values(attribute: str):
        return F.sort_array(F.collect_set(F.when(F.col("attribute") == attribute, F.col("value"))))

    known = F.create_map(*[F.lit(x) for pair in TAXA.items() for x in pair])
    taxon = F.when(F.col("attribute") == "taxon", F.element_at(known, F.col("value")))
    grouped = statements.groupBy("pr").agg(
        F.min(F.when(F.col("attribute") == "label", F.col("value"))).alias("label"),
        F.sort_array(F.collect_set(taxon)).alias("taxa"),
        *[values(s).alias(s) for s in SCOPES[1:]],
        values("xref").alias("xrefs"),
    )
    return grouped.where("label is not null").withColumn("uniprot", F.filter("xrefs", lambda x: x.startswith(UNIPROT)))


def names(meta: DataFrame) -> DataFrame:
    """``pr, scope, scope_ord, name``: every name with its scope."""
    of = [F.struct(F.lit(s).alias("scope"), F.lit(i).alias("scope_ord"), (F.array("label") if s == "label" else F.col(s)).alias("names")) for i, s in enumerate(SCOPES)]
    listed = meta.select("pr", F.explode(F.array(*of)).alias("x"))
    return listed.select("pr", "x.scope", "x.scope_ord", F.explode("x.names").alias("name"))


def cd_names(named: DataFrame) -> DataFrame:
    """``pr, token, scope``: each distinct CD token with the first scope, in order of preference, that has it."""
    found = named.select("pr", "scope", "scope_ord", F.explode(cd_tokens("name")).alias("token"))
    return found.groupBy("pr", "token").agg(F.min_by("scope", "scope_ord").alias("scope"))


def cd_lists(tokens: DataFrame) -> DataFrame:
    """``pr, cd``: tokens with their scopes, sorted by token."""
    return tokens.groupBy("pr").agg(F.array_sort(F.collect_list(F.struct("token", "scope"))).alias("cd"))


def species_ids(used: DataFrame, subclasses: DataFrame, taxa: DataFrame, xrefs: DataFrame, species: DataFrame) -> DataFrame:
    """``pr, species, xref``: UniProt ids of a target by way of its species-specific subclasses.

    ``used (pr)``, ``subclasses (sub, super)``, ``taxa (sub, taxon)``, ``xrefs (sub, xref)``,
    ``species (taxon, species)``, of which there are a few rows.
    """
    chain = subclasses.join(used.select(F.col("pr").alias("super")).distinct(), "super", "left_semi")
    chain = chain.join(taxa.join(species, "taxon"), "sub").join(xrefs.where(F.col("xref").startswith(UNIPROT)), "sub")
    return chain.select(F.col("super").alias("pr"), "species", "xref").distinct()


def species_table(ids: DataFrame) -> DataFrame:
    """``pr, human, mouse``: sorted ids of each species."""
    return ids.groupBy("pr").pivot("species", ["human", "mouse"]).agg(F.sort_array(F.collect_set("xref")))


def merge_species(meta: DataFrame, neutral: DataFrame) -> DataFrame:
    """``pr, human, mouse``: ids by way of subclasses first, then the target's own where its taxon is the species; for targets of either table."""
    none = F.array().cast("array<string>")

    def merged(species: str):
        own = F.when(F.array_contains("taxa", species), F.col("uniprot")).otherwise(none)
        return F.array_union(F.coalesce(species, none), F.coalesce(own, none)).alias(species)

    return meta.select("pr", "taxa", "uniprot").join(neutral, "pr", "full").select("pr", merged("human"), merged("mouse"))
