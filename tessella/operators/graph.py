"""The edges' and targets' tables from a table of quads: the graph patterns that all further steps start from.

Patterns over quads are joins of the quads with themselves. Those that share a subject (a
star: what an entity is, what it is called) are one conditional aggregate by subject; those
that follow an object (a chain: cell, target, its subclass, its identifier) are equi joins. Each
graph is read once, with the graph as a partition filter and the predicates pushed to the
files; what a graph gives is written in the shared folder, and the tables are taken from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import OBO
from tessella.operators.annotate import TAXA, UNIPROT
from tessella.operators.edges import SENSES
from tessella.sources.files import read_graph
from tessella.tables import cut

# Predicates, what defines cells and targets, and the statements' attributes.
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OIO = "http://www.geneontology.org/formats/oboInOwl#"
DEFINED_BY, LABEL, SUBPROPERTY, SUBCLASS = (f"{RDFS}{x}" for x in ("isDefinedBy", "label", "subPropertyOf", "subClassOf"))
IN_TAXON = f"{OBO}RO_0002160"
XREF = f"{OIO}hasDbXref"
CELLS, TARGETS = f"{OBO}cl.owl", f"{OBO}pr.owl"
ATTRIBUTES = {
    LABEL: "label",
    f"{OIO}hasExactSynonym": "exact",
    f"{OIO}hasRelatedSynonym": "related",
    f"{OIO}hasNarrowSynonym": "narrow",
    f"{OIO}hasBroadSynonym": "broad",
    XREF: "xref",
    IN_TAXON: "taxon",
}


@dataclass(frozen=True)
class Ontology:
    """``facts``: what the ontology states of entities and relations; ``entities``: one row each, ``s, is_cell, is_target, label``;
    ``inferred_rows`` and ``asserted_rows``: what the two edge graphs give, as ``s, p, o`` (asserted ones with ``is_cell``)."""

    facts: DataFrame
    entities: DataFrame
    inferred_rows: DataFrame
    asserted_rows: DataFrame
    relations: tuple[str, ...]

    @property
    def cells(self) -> DataFrame:
        return self.entities.where("is_cell").select(F.col("s").alias("cell"))

    @property
    def targets(self) -> DataFrame:
        return self.entities.where("is_target").select(F.col("s").alias("pr"))

    def _edges(self, rows: DataFrame) -> DataFrame:
        edges = rows.select(F.col("s").alias("cell"), F.col("p").alias("relation"), F.col("o").alias("pr"))
        return edges.join(self.cells, "cell", "left_semi").join(self.targets, "pr", "left_semi").select("cell", "relation", "pr").distinct()

    @property
    def inferred(self) -> DataFrame:
        """``cell, relation, pr`` of the marker relations, from cells to targets."""
        return self._edges(self.inferred_rows.where(F.col("p").isin(*self.relations)))

    @property
    def asserted(self) -> DataFrame:
        """``cell, relation, pr`` by any relation, from cells to targets."""
        return self._edges(self.asserted_rows.where("is_cell"))

    @property
    def parents(self) -> DataFrame:
        """``sub, super`` of all relations; paths between the listed ones may pass through others."""
        return self.facts.where(F.col("p") == SUBPROPERTY).select(F.col("s").alias("sub"), F.col("o").alias("super")).distinct()

    @property
    def cell_labels(self) -> DataFrame:
        return self.entities.where("is_cell and label is not null").select(F.col("s").alias("cell"), F.col("label").alias("cell_label"))

    @property
    def relation_labels(self) -> DataFrame:
        named = self.entities.where(F.col("s").isin(*self.relations) & F.col("label").isNotNull())
        return named.select(F.col("s").alias("relation"), F.col("label").alias("relation_label"))

    @property
    def used(self) -> DataFrame:
        """``pr``: targets that some cell asserts."""
        return self.asserted.select("pr").distinct()

    @property
    def statements(self) -> DataFrame:
        """``pr, attribute, value`` of the targets in use."""
        known = F.create_map(*[F.lit(x) for pair in ATTRIBUTES.items() for x in pair])
        said = self.facts.select(F.col("s").alias("pr"), F.element_at(known, F.col("p")).alias("attribute"), F.col("o").alias("value"))
        return said.where("attribute is not null").join(self.used, "pr", "left_semi").distinct()

    @property
    def subclasses(self) -> DataFrame:
        """``sub, super``: direct subclasses."""
        return self.asserted_rows.where(F.col("p") == SUBCLASS).select(F.col("s").alias("sub"), F.col("o").alias("super")).distinct()

    @property
    def taxa(self) -> DataFrame:
        """``sub, taxon`` for the species of interest."""
        return self.inferred_rows.where(F.col("p") == IN_TAXON).select(F.col("s").alias("sub"), F.col("o").alias("taxon")).distinct()

    @property
    def xrefs(self) -> DataFrame:
        """``sub, xref``: identifiers of any entity in the database of interest."""
        return self.facts.where((F.col("p") == XREF) & F.col("o").startswith(UNIPROT)).select(F.col("s").alias("sub"), F.col("o").alias("xref")).distinct()


def entities(facts: DataFrame) -> DataFrame:
    """``s, is_cell, is_target, label`` of every subject that is defined or named: one aggregate by subject; of several labels the smallest that is not empty."""

    def defined(by: str):
        return F.bool_or((F.col("p") == DEFINED_BY) & (F.col("o") == by))

    label = F.min(F.when((F.col("p") == LABEL) & (F.col("o") != ""), F.col("o")))
    known = facts.where(F.col("p").isin(DEFINED_BY, LABEL) & F.col("s").isNotNull())
    return known.groupBy("s").agg(defined(CELLS).alias("is_cell"), defined(TARGETS).alias("is_target"), label.alias("label"))


def read_ontology(
    spark: SparkSession, path: str, *, ontology: str = "ontology", inferred: str = "redundant", asserted: str = "nonredundant", relations: tuple[str, ...] = tuple(SENSES)
) -> Ontology:
    """The tables of quads written at ``path``; ``ontology``, ``inferred`` and ``asserted`` name the graphs.

    Of the inferred graph, which holds every entailed statement, only the marker relations and
    the taxa of interest are kept; of the asserted one the statements about cells, by any
    relation, and the subclasses. Rows with a null in subject, predicate or object match no
    pattern; repeated quads count once.
    """
    facts = cut(read_graph(spark, path, ontology, [DEFINED_BY, SUBPROPERTY, *ATTRIBUTES]), "facts")
    known = cut(entities(facts), "entities")
    wanted = F.col("p").isin(*relations) | F.col("o").isin(*TAXA)
    entailed = cut(read_graph(spark, path, inferred, [*relations, IN_TAXON]).where(wanted), "inferred")
    cells = known.where("is_cell").select("s", F.lit(True).alias("is_cell"))
    said = read_graph(spark, path, asserted).join(cells, "s", "left").withColumn("is_cell", F.coalesce("is_cell", F.lit(False)))
    said = cut(said.where(F.col("is_cell") | (F.col("p") == SUBCLASS)), "asserted")
    return Ontology(facts, known, entailed, said, tuple(relations))
