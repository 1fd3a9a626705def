"""The registered queries of the curation operators, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import grammar
from tessella.functions.text import OBO, first_bar, for_match, segments, slug, split_bar, utc_seconds
from tessella.operators import annotate, edges, graph, markers, quote_index, quotes, reports, sheets, snippets
from tessella.plans.bindings import ctes, frame, marker_error
from tessella.sources import files
from tessella.sources.files import BINDINGS as RESULT_SCHEMA
from tessella.sources.files import RECORDS, flatten_bindings
from tessella.streaming import checks
from tessella.streaming import snippets as streams
from tessella.tables import cut, new_path, read, read_or_empty, shuffles_removed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """``t.name`` is a table or binding of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(name: str, sql: str, *uses: str):
    """Register a function of :class:`Tables` with its SQL; ``uses`` are the bindings that the SQL names."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        head, sql_text = ctes(*uses) if uses else "", sql.strip()
        ORACLE_SQL[name] = (f"{head}, {sql_text[5:]}" if sql_text.startswith("WITH ") else f"{head}\n{sql_text}") if head else sql_text
        return build

    return register


def joined(column: str, by: str = "|"):
    return F.array_join(column, by).alias(column)


# ---------------------------------------------------------------- edges

_EDGE = ("inferred", "asserted", "excluded", "parents", "cell_labels", "relation_labels")
_MARKERS = ", ".join(f"'{r}'" for r in edges.SENSES)
_SENSE = "CASE relation " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, s in edges.SENSES.items()) + " ELSE 'other' END"
_ORDER = "CASE sense " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(edges.SENSE_ORDER)) + " END"
_CURIE = f"regexp_replace({{}}, '^{OBO}(CL|PR|NCBITaxon|RO|BFO)_', '\\1:')"
_KEPT = f"""k AS (SELECT DISTINCT cell, relation, pr FROM inferred WHERE relation IN ({_MARKERS}) AND pr IN (SELECT pr FROM asserted) AND pr NOT IN (SELECT pr FROM excluded))"""
_FLAGGED = f"""{_KEPT}, f AS (SELECT k.*, a.cell IS NOT NULL AS asserted FROM k LEFT JOIN (SELECT DISTINCT * FROM asserted) a USING (cell, relation, pr))"""
_CLOSED = "anc(sub, super) AS (SELECT sub, super FROM parents UNION SELECT anc.sub, p.super FROM anc JOIN parents p ON p.sub = anc.super)"
_PRUNED = f"""{_FLAGGED}, {_CLOSED}, s AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o JOIN anc ON anc.sub = o.relation WHERE o.cell = f.cell AND o.pr = f.pr AND anc.super = f.relation AND anc.sub <> anc.super))"""
_REDUCED = f"""{_PRUNED}, r AS (
  SELECT s.cell, coalesce(cl.l, '') AS cell_label, s.relation, coalesce(rl.l, {_CURIE.format("s.relation")}) AS relation_label, {_SENSE.replace("relation", "s.relation", 1)} AS sense, asserted, pr
  FROM s LEFT JOIN (SELECT cell, min(cell_label) AS l FROM cell_labels WHERE cell_label <> '' GROUP BY 1) cl ON cl.cell = s.cell
  LEFT JOIN (SELECT relation, min(relation_label) AS l FROM relation_labels WHERE relation_label <> '' GROUP BY 1) rl ON rl.relation = s.relation)"""


def kept(t: Tables) -> DataFrame:
    return edges.kept_edges(t.inferred, t.asserted, t.excluded)


def pruned(t: Tables) -> DataFrame:
    return edges.reduced_keys(t.inferred, t.asserted, edges.closure(t.parents), t.excluded)


def reduced(t: Tables) -> DataFrame:
    return edges.reduce_edges(t.inferred, t.asserted, edges.closure(t.parents), t.cell_labels, t.relation_labels, t.excluded)


@query("edge_reduce", f"WITH {_KEPT} SELECT * FROM k", *_EDGE)
def _(t):
    return kept(t)


@query("edge_asserted_flag", f"WITH {_FLAGGED} SELECT * FROM f", *_EDGE)
def _(t):
    return edges.flag_asserted(kept(t), t.asserted)


@query("edge_inferred_only", f"WITH {_FLAGGED} SELECT cell, relation, pr FROM f WHERE NOT asserted", *_EDGE)
def _(t):
    return edges.inferred_only(kept(t), t.asserted)


@query("quad_graph_scan", "SELECT DISTINCT cell AS s, relation AS p, pr AS o FROM asserted", "asserted")
def _(t):
    path = new_path(t.spark, "quads")
    graphs = [x.select(F.lit(g).alias("graph"), F.col("cell").alias("s"), F.col("relation").alias("p"), F.col("pr").alias("o")).distinct() for g, x in (("redundant", t.inferred), ("nonredundant", t.asserted))]
    files.write_quads(graphs[0].unionByName(graphs[1]), path, ("redundant", "nonredundant"))
    return files.read_graph(t.spark, path, "nonredundant")


@query("edge_typed", "SELECT cell, relation, pr FROM inferred WHERE cell IN (SELECT cell FROM cell_labels) AND pr IN (SELECT pr FROM statements WHERE attribute = 'label')", "inferred", "cell_labels", "statements")
def _(t):
    return edges.typed(t.inferred, t.cell_labels, t.statements.where("attribute = 'label'")).select("cell", "relation", "pr")


_HIERARCHY = "c(sub, super) AS (SELECT sub, super FROM hierarchy UNION SELECT c.sub, h.super FROM c JOIN hierarchy h ON h.sub = c.super), l AS (SELECT c.* FROM c JOIN listed a ON a.node = sub JOIN listed b ON b.node = super WHERE sub <> super)"


@query("relation_closure", f"WITH {_HIERARCHY} SELECT * FROM l", "hierarchy", "listed")
def _(t):
    return edges.closure(t.hierarchy, t.listed)


@query("ancestor_sets", f"WITH {_HIERARCHY} SELECT sub, string_agg(super, '|' ORDER BY super) AS supers FROM l GROUP BY sub", "hierarchy", "listed")
def _(t):
    return edges.ancestor_sets(edges.closure(t.hierarchy, t.listed)).withColumn("supers", F.array_join(F.col("supers").cast("array<string>"), "|"))


@query("edge_most_specific", f"WITH {_PRUNED} SELECT * FROM s", *_EDGE)
def _(t):
    return pruned(t)


@query("edge_labels", f"WITH {_REDUCED} SELECT cell, cell_label, relation, relation_label, pr FROM r", *_EDGE)
def _(t):
    return reduced(t).select("cell", "cell_label", "relation", "relation_label", "pr")


@query("edge_sense_counts", f"WITH {_REDUCED} SELECT cell, {', '.join(f'''count(*) FILTER (sense = '{s}') AS {s}''' for s in edges.SENSE_ORDER)} FROM r GROUP BY cell", *_EDGE)
def _(t):
    return edges.sense_counts(reduced(t))


@query("edge_summary", f"WITH {_REDUCED} SELECT count(DISTINCT cell) AS cells, count(*) AS edges, count(*) FILTER (asserted) AS asserted_edges FROM r", *_EDGE)
def _(t):
    return edges.summary(reduced(t))


@query(
    "query_json_flatten",
    "SELECT DISTINCT cell, CASE WHEN said THEN relation END AS relation, pr FROM edges",
    "edges",
)
def _(t):
    def value(name):
        return F.struct(F.lit("uri").alias("type"), F.col(name).alias("value"))

    bound = F.map_filter(F.create_map(F.lit("cell"), value("cell"), F.lit("r"), value("relation"), F.lit("pr"), value("pr")), lambda k, _: (k != "r") | F.col("said"))
    answers = t.edges.distinct().groupBy("cell").agg(F.collect_list(bound).alias("bindings")).select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("json"))
    parsed = answers.select(F.from_json("json", RESULT_SCHEMA).alias("x")).select("x.results")
    return flatten_bindings(parsed, ["cell", "r", "pr"]).withColumnRenamed("r", "relation").distinct()


# ---------------------------------------------------------------- annotation

_SPECIES = "sp AS (SELECT DISTINCT c.super AS pr, s.species, x.xref FROM subclasses c JOIN taxa USING (sub) JOIN species s USING (taxon) JOIN xrefs x USING (sub) WHERE x.xref LIKE 'UniProtKB:%' AND c.super IN (SELECT pr FROM asserted))"
_LISTS = ", ".join(f"array_to_string(list_sort(list_distinct(list(value) FILTER (attribute = '{s}'))), '|') AS {n}" for s, n in (("exact", "exact"), ("related", "related"), ("narrow", "narrow"), ("broad", "broad"), ("xref", "xrefs")))
_META = f"""m AS (SELECT pr, min(value) FILTER (attribute = 'label') AS label,
    array_to_string(list_sort(list_distinct(list(sp.species) FILTER (attribute = 'taxon'))), '|') AS taxa, {_LISTS},
    array_to_string(list_sort(list_distinct(list(value) FILTER (attribute = 'xref' AND value LIKE 'UniProtKB:%'))), '|') AS uniprot
    FROM statements LEFT JOIN species sp ON attribute = 'taxon' AND sp.taxon = value GROUP BY pr HAVING count(*) FILTER (attribute = 'label') > 0)"""
_META_COLUMNS = ["pr", "label", "taxa", "exact", "related", "narrow", "broad", "xrefs", "uniprot"]
_CD = """n AS (SELECT pr, value AS name, CASE attribute WHEN 'label' THEN 0 WHEN 'exact' THEN 1 WHEN 'related' THEN 2 WHEN 'narrow' THEN 3 WHEN 'broad' THEN 4 END AS o, attribute AS scope FROM statements
    WHERE attribute IN ('exact', 'related', 'narrow', 'broad') AND pr IN (SELECT pr FROM statements WHERE attribute = 'label') UNION ALL SELECT pr, min(value), 0, 'label' FROM statements WHERE attribute = 'label' GROUP BY pr),
  tok AS (SELECT pr, o, scope, unnest(regexp_extract_all(name, '\\bCDw?\\d+[A-Za-z0-9]{0,4}\\b')) AS token FROM n),
  cd AS (SELECT pr, token, arg_min(scope, o) AS scope FROM tok GROUP BY pr, token)"""
_MERGED = f"""{_SPECIES}, {_META}, w AS (SELECT pr, array_to_string(list_sort(list(xref) FILTER (species = 'human')), '|') AS human, array_to_string(list_sort(list(xref) FILTER (species = 'mouse')), '|') AS mouse FROM sp GROUP BY pr),
  mg AS (SELECT coalesce(m.pr, w.pr) AS pr, {", ".join(f"array_to_string(list_concat(coalesce(string_split(nullif(w.{s}, ''), '|'), []), list_filter(CASE WHEN contains(coalesce(m.taxa, ''), '{s}') THEN coalesce(string_split(nullif(m.uniprot, ''), '|'), []) ELSE [] END, lambda x: NOT list_contains(coalesce(string_split(nullif(w.{s}, ''), '|'), []), x))), '|') AS {s}" for s in ("human", "mouse"))}
    FROM m FULL JOIN w ON m.pr = w.pr)"""


def species(t: Tables, used: DataFrame | None = None) -> DataFrame:
    return annotate.species_ids(t.asserted if used is None else used, t.subclasses, t.taxa, t.xrefs, t.species)


def merged(t: Tables, meta: DataFrame, used: DataFrame | None = None) -> DataFrame:
    return annotate.merge_species(meta, annotate.species_table(species(t, used)))


@query("entity_metadata", f"WITH {_META} SELECT {', '.join(f'''coalesce({c}, '') AS {c}''' for c in _META_COLUMNS)} FROM m", "statements", "species")
def _(t):
    return annotate.metadata(t.statements).select("pr", "label", *[joined(c) for c in _META_COLUMNS[2:]])


@query("cd_tokens", f"WITH {_CD} SELECT pr, token, scope FROM cd", "statements")
def _(t):
    return annotate.cd_names(annotate.names(annotate.metadata(t.statements)))


@query("species_ids", f"WITH {_SPECIES} SELECT * FROM sp", "asserted", "subclasses", "taxa", "xrefs", "species")
def _(t):
    return species(t)


@query("species_merge", f"WITH {_MERGED} SELECT pr, coalesce(human, '') AS human, coalesce(mouse, '') AS mouse FROM mg", "asserted", "subclasses", "taxa", "xrefs", "species", "statements")
def _(t):
    return merged(t, annotate.metadata(t.statements)).select("pr", joined("human"), joined("mouse"))


_ALL = (*_EDGE, "statements", "subclasses", "taxa", "xrefs", "species")
_WIDE = f"""{_REDUCED}, {_MERGED}, {_CD}, cdl AS (SELECT pr, string_agg(token || ' (' || scope || ')', '; ' ORDER BY token) AS x, string_agg(token || ' (' || scope || ')', ', ' ORDER BY token) AS y FROM cd GROUP BY pr),
  wide AS (SELECT r.*, coalesce(m.label, '') AS label, coalesce(m.xrefs, '') AS xrefs, coalesce(cdl.x, '') AS cdx, cdl.y AS cdy, coalesce(mg.human, '') AS human, coalesce(mg.mouse, '') AS mouse
    FROM r LEFT JOIN m ON m.pr = r.pr LEFT JOIN cdl ON cdl.pr = r.pr LEFT JOIN mg ON mg.pr = r.pr)"""


def texts(t: Tables, used: DataFrame | None = None) -> DataFrame:
    meta = cut(annotate.metadata(t.statements), "metadata")  # three parts of the plan read it
    return reports.target_texts(meta, annotate.cd_lists(annotate.cd_names(annotate.names(meta))), merged(t, meta, used))


def wide(t: Tables) -> DataFrame:
    return reports.with_texts(reduced(t), texts(t))


def wide_in_rounds(t: Tables, rounds: int | None = None) -> list[tuple[DataFrame, int]]:
    """:func:`wide` for files, of which no more is shuffled at a time than a round; pairs and texts are written first, and what was shuffled for them is removed."""
    with shuffles_removed(t.spark):
        pairs = cut(edges.reduced_pairs(t.inferred, t.asserted, edges.closure(t.parents), edges.one_label(t.cell_labels, "cell", "cell_label")), "pairs")
        said = cut(t.asserted.select("pr").distinct(), "targets")
        known = cut(reports.with_texts(edges.targets(said, t.excluded), texts(t, said)), "texts")
        return [(edges.edges_of(x, known, t.relation_labels), end) for x, end in reports.in_rounds(pairs, reports.parts(pairs), rounds)]


@query(
    "edge_export",
    f"""WITH {_WIDE} SELECT {_CURIE.format("cell")} AS cell, cell_label, {_CURIE.format("relation")} AS relation, relation_label, sense, CASE WHEN asserted THEN 'True' ELSE 'False' END AS asserted,
    {_CURIE.format("pr")} AS pr, label AS pr_label, cdx AS cd_synonym, replace(human, '|', '; ') AS uniprot_human, replace(mouse, '|', '; ') AS uniprot_mouse, replace(xrefs, '|', '; ') AS xrefs FROM wide""",
    *_ALL,
)
def _(t):
    once = cut(wide(t), "annotated")  # sorting samples its input first
    return reports.sorted_edges(once, reports.parts(once))


@query("edge_export_file", ORACLE_SQL["edge_export"])
def _(t):
    path = new_path(t.spark, "tsv")
    files.write_edge_export(wide_in_rounds(t), path, "gzip")
    schema = ", ".join(f"{c} string" for c in reports.COLUMNS)
    back = t.spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in reports.COLUMNS])


_LINES = f"""{_WIDE}, lines AS (SELECT cell, cell_label, sense, row_number() OVER (PARTITION BY cell ORDER BY {_ORDER}, coalesce(nullif(label, ''), pr), pr, relation) AS position,
    '- `' || {_CURIE.format("pr")} || '` ' || coalesce(nullif(label, ''), {_CURIE.format("pr")}) || coalesce(' — CD: ' || cdy, '') || CASE WHEN human <> '' THEN ' — UniProt(human): ' || replace(human, '|', ', ') ELSE '' END
    || CASE WHEN mouse <> '' THEN ' — UniProt(mouse): ' || replace(mouse, '|', ', ') ELSE '' END || CASE WHEN asserted THEN '' ELSE ' — _(inferred only)_' END AS line FROM wide)"""


@query("edge_report_lines", f"WITH {_LINES} SELECT cell, sense, cast(position AS INT) AS position, line FROM lines", *_ALL)
def _(t):
    return reports.marker_lines(wide(t)).drop("cell_label")


_HEADING = "CASE sense " + " ".join(f"WHEN '{s}' THEN '{h}'" for s, h in reports.HEADINGS.items()) + " END"


@query(
    "edge_report_sections",
    f"""WITH {_LINES}, part AS (SELECT cell, cell_label, {_ORDER} AS o, '**' || {_HEADING} || '**' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY position) || chr(10) AS x FROM lines GROUP BY cell, cell_label, sense)
    SELECT cell, '## ' || {_CURIE.format("cell")} || CASE WHEN cell_label <> '' THEN ' — ' || cell_label ELSE '' END || chr(10) || chr(10) || string_agg(x, chr(10) ORDER BY o) AS section FROM part GROUP BY cell, cell_label""",
    *_ALL,
)
def _(t):
    return reports.cell_sections(reports.marker_lines(wide(t)))


@query(
    "edge_report_file",
    f"""WITH sections AS ({ORACLE_SQL["edge_report_sections"]}), counts AS ({ORACLE_SQL["edge_summary"]}),
    head AS (SELECT unnest(['{reports.EDGE_TITLE}', '', '_Generated from the given tables._', '', '- Cell types: **' || cells || '**', '- CL→PR edges (inferred): **' || edges || '** (of which directly asserted: **' || asserted_edges || '**)', '', '{reports.LEGEND}', '']) AS line FROM counts)
    SELECT line, count(*) AS n FROM (SELECT line FROM head UNION ALL SELECT unnest(string_split(section, chr(10))) FROM sections) GROUP BY line""",
)
def _(t):
    path = new_path(t.spark, "reports")
    files.write_edge_reports(wide_in_rounds(t), path, compression="gzip")
    return t.spark.read.text(f"{path}/edges_md").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- the same from written quads

# the patterns as joins of quads; the tables take the names of the bindings that the other queries start from
_PATTERNS = f"""cells AS (SELECT DISTINCT s AS cell FROM quads WHERE graph = 'ontology' AND p = '{graph.DEFINED_BY}' AND o = '{graph.CELLS}'),
  targets AS (SELECT DISTINCT s AS pr FROM quads WHERE graph = 'ontology' AND p = '{graph.DEFINED_BY}' AND o = '{graph.TARGETS}'),
  inferred AS (SELECT DISTINCT s AS cell, p AS relation, o AS pr FROM quads JOIN cells ON cell = s JOIN targets ON pr = o WHERE graph = 'redundant' AND p IN ({_MARKERS})),
  asserted AS (SELECT DISTINCT s AS cell, p AS relation, o AS pr FROM quads JOIN cells ON cell = s JOIN targets ON pr = o WHERE graph = 'nonredundant'),
  parents AS (SELECT DISTINCT s AS sub, o AS super FROM quads WHERE graph = 'ontology' AND p = '{graph.SUBPROPERTY}'),
  cell_labels AS (SELECT s AS cell, o AS cell_label FROM quads JOIN cells ON cell = s WHERE graph = 'ontology' AND p = '{graph.LABEL}'),
  relation_labels AS (SELECT s AS relation, o AS relation_label FROM quads WHERE graph = 'ontology' AND p = '{graph.LABEL}' AND s IN ({_MARKERS})),
  statements AS (SELECT DISTINCT s AS pr, CASE p {" ".join(f"WHEN '{p}' THEN '{a}'" for p, a in graph.ATTRIBUTES.items())} END AS attribute, o AS value FROM quads
    WHERE graph = 'ontology' AND s IN (SELECT pr FROM asserted) AND p IN ({", ".join(f"'{p}'" for p in graph.ATTRIBUTES)})),
  subclasses AS (SELECT DISTINCT s AS sub, o AS super FROM quads WHERE graph = 'nonredundant' AND p = '{graph.SUBCLASS}'),
  taxa AS (SELECT DISTINCT s AS sub, o AS taxon FROM quads WHERE graph = 'redundant' AND p = '{graph.IN_TAXON}'),
  xrefs AS (SELECT DISTINCT s AS sub, o AS xref FROM quads WHERE graph = 'ontology' AND p = '{graph.XREF}')"""


def _of_quads(sql: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {_PATTERNS}, {sql})"


def read_quads(t: Tables) -> graph.Ontology:
    path = new_path(t.spark, "quads")
    files.write_quads(t.quads, path, ("ontology", "redundant", "nonredundant"))
    return graph.read_ontology(t.spark, path)


@query("quad_edges", _of_quads(f"{_KEPT} SELECT * FROM k"), "quads", "excluded")
def _(t):
    found = read_quads(t)
    return edges.kept_edges(found.inferred, found.asserted, t.excluded)


@query("quad_reduce", _of_quads(f"{_REDUCED} SELECT * FROM r"), "quads", "excluded")
def _(t):
    found = read_quads(t)
    return edges.reduce_edges(found.inferred, found.asserted, edges.closure(found.parents), found.cell_labels, found.relation_labels, t.excluded)


@query("quad_metadata", _of_quads(f"{_META} SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in _META_COLUMNS)} FROM m"), "quads", "species")
def _(t):
    return annotate.metadata(read_quads(t).statements).select("pr", "label", *[joined(c) for c in _META_COLUMNS[2:]])


@query("quad_species", _of_quads(f"{_MERGED} SELECT pr, coalesce(human, '') AS human, coalesce(mouse, '') AS mouse FROM mg"), "quads", "species")
def _(t):
    found = read_quads(t)
    meta, ids = annotate.metadata(found.statements), annotate.species_ids(found.asserted, found.subclasses, found.taxa, found.xrefs, t.species)
    return annotate.merge_species(meta, annotate.species_table(ids)).select("pr", joined("human"), joined("mouse"))


@query("label_parts", "SELECT p_partkey, array_to_string(list_filter(string_split(x, '|'), lambda p: p <> ''), '~') AS parts, string_split(x, '|')[1] AS first FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '|' || p_name || '||' || p_brand ELSE p_type || '|' END AS x FROM part)")
def _(t):
    x = t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '|' || p_name || '||' || p_brand ELSE p_type || '|' END AS x")
    return x.select("p_partkey", F.array_join(split_bar("x"), "~").alias("parts"), first_bar("x").alias("first"))


@query("utc_text", "SELECT o_orderkey, strftime(cast(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%S+00:00') AS moment FROM orders")
def _(t):
    seconds = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400 + F.col("o_orderkey") % 86400
    return t.orders.select("o_orderkey", utc_seconds(F.timestamp_seconds(seconds)).alias("moment"))


# ---------------------------------------------------------------- marker cells

_COLUMNS = {c: i for i, c in enumerate(markers.MARKER_COLUMNS)}
_CELLS = "cells AS (" + " UNION ALL ".join(
    f"""SELECT row, coalesce(trim("Subset name"), 'nan') AS subset, '{c}' AS "column", {i + 1} AS col_ord, "{c}" AS value, row - 2 + {i} AS k FROM sheet WHERE "{c}" IS NOT NULL AND "{c}" <> 'N/A'""" for c, i in _COLUMNS.items()
) + ")"
_CHECKED = f"{_CELLS}, v AS (SELECT *, {marker_error('k')} AS error FROM cells)"
_TOKENS = f"""{_CELLS}, tk AS (SELECT *, list_transform(regexp_extract_all(value, ' +|[()\\[\\]|]|[^ ()\\[\\]|]+'), lambda x: CASE WHEN x LIKE ' %' THEN ' ' ELSE x END) AS toks FROM cells)"""
_WORDS = f"""{_TOKENS}, wd AS (SELECT row, subset, "column", i - 1 AS pos, toks[i] AS word FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM tk)
    WHERE toks[i] NOT IN (' ', '(', ')', '[', ']', '|') AND NOT (i = 1 AND toks[i] = 'live/') AND NOT (i > 1 AND toks[i - 1] IN (')', ']') AND regexp_full_match(toks[i], '(?:lo|hi|int|[+\\-])(?:/(?:lo|hi|int|[+\\-]))*')))"""
_SPLIT = "'^([A-Za-z][A-Za-z0-9.\\-]*?)((?:lo|hi|int|[+\\-])(?:/(?:lo|hi|int|[+\\-]))*)?$'"
_FOUND = f"""{_WORDS}, fd AS (SELECT row, subset, "column", pos, regexp_extract(word, {_SPLIT}, 1) AS marker, regexp_extract(word, {_SPLIT}, 2) AS qualifier FROM wd WHERE regexp_matches(word, {_SPLIT}))"""


def checked(t: Tables) -> DataFrame:
    return markers.cells(t.sheet)


def validated(t: Tables) -> DataFrame:
    return markers.validate(checked(t))


@query("sheet_unpivot", f'WITH {_CELLS} SELECT row, subset, "column", col_ord, value FROM cells', "sheet")
def _(t):
    return checked(t)


@query("marker_tokens", f"""WITH {_TOKENS} SELECT row, "column", array_to_string(toks, '~') AS tokens FROM tk""", "sheet")
def _(t):
    return checked(t).select("row", "column", F.array_join(grammar.tokens("value"), "~").alias("tokens"))


@query("marker_words", f"""WITH {_WORDS} SELECT row, "column", cast(pos AS INT) AS pos, regexp_extract(word, {_SPLIT}, 1) AS marker, regexp_extract(word, {_SPLIT}, 2) AS qualifier FROM wd""", "sheet")
def _(t):
    return markers.words(checked(t)).select("row", "column", "pos", grammar.marker("word").alias("marker"), grammar.qualifier("word").alias("qualifier"))


@query("marker_validate", f'WITH {_CHECKED} SELECT row, "column", error FROM v', "sheet")
def _(t):
    return validated(t).select("row", "column", "error")


@query("marker_failures", f'WITH {_CHECKED} SELECT row, subset, "column", col_ord, trim(value) AS value, error FROM v WHERE error IS NOT NULL', "sheet")
def _(t):
    return markers.failures(validated(t)).orderBy("row", "col_ord")


@query("marker_summary", f"WITH {_CHECKED} SELECT count(*) AS checked, count(error) AS invalid FROM v", "sheet")
def _(t):
    return markers.totals(validated(t))


_CLASS = "CASE WHEN error = 'missing '')''' THEN 'missing closer' " + " ".join(
    f"WHEN starts_with(error, '{f}') THEN '{f}'" for f in ("invalid marker token", "expected marker or group", "mixed ''|'' and space", "top-level ''|''", "missing space", "unexpected", "empty expression")
) + " END"


@query("marker_error_histogram", f"WITH {_CHECKED} SELECT {_CLASS} AS error_class, count(*) AS n FROM v WHERE error IS NOT NULL GROUP BY 1", "sheet")
def _(t):
    return markers.histogram(validated(t))


@query("marker_error_rollup", f'WITH {_CHECKED} SELECT "column", error_class, count(*) AS n FROM (SELECT *, {_CLASS} AS error_class FROM v WHERE error IS NOT NULL) GROUP BY ROLLUP ("column", error_class)', "sheet")
def _(t):
    return markers.subtotals(validated(t))


@query(
    "marker_error_cube",
    f"""WITH {_CHECKED} SELECT "column", subset, error_class, cast(grouping_id("column", subset, error_class) AS INT) AS level, count(*) AS n
    FROM (SELECT "column", nullif(subset, 'nan') AS subset, {_CLASS} AS error_class FROM v WHERE error IS NOT NULL) GROUP BY CUBE ("column", subset, error_class)""",
    "sheet",
)
def _(t):
    return markers.cube(validated(t).withColumn("subset", F.nullif("subset", F.lit("nan"))))  # here a missing subset is null


@query(
    "marker_report_lines",
    f"""WITH {_CHECKED} SELECT row, col_ord, '| ' || row || ' | ' || replace(subset, '|', '\\|') || ' | ' || "column" || ' | ' || replace(error, '|', '\\|') || ' | `' || replace(trim(value), '|', '\\|') || '` |' AS line FROM v WHERE error IS NOT NULL""",
    "sheet",
)
def _(t):
    return reports.failure_lines(markers.failures(validated(t)).orderBy("row", "col_ord"))


_SHEET_REPORT = f"""WITH {_CHECKED}, bad AS (SELECT * FROM v WHERE error IS NOT NULL), n AS (SELECT (SELECT count(*) FROM v) AS checked, (SELECT count(*) FROM bad) AS invalid),
    head AS (SELECT unnest(list_concat(['{reports.VALIDATION_TITLE}', '', '> **Auto-generated** by the grammar''s validator. Do not edit by hand: edit the sheet and validate it again.', '', '- Source: `sheet`', '- Cells checked: **' || checked || '**',
      '- Invalid cells: **' || invalid || '**', '- Grammar: here', ''], CASE WHEN invalid = 0 THEN ['{reports.ALL_VALID}'] ELSE ['## Invalid cells', '', '{reports.TABLE_HEAD[0]}', '{reports.TABLE_HEAD[1]}', '', '{reports.REMARK}'] END)) AS line FROM n)
    SELECT line, count(*) AS n FROM (SELECT line FROM head UNION ALL SELECT '| ' || row || ' | ' || replace(subset, '|', '\\|') || ' | ' || "column" || ' | ' || replace(error, '|', '\\|') || ' | `' || replace(trim(value), '|', '\\|') || '` |' FROM bad) GROUP BY line"""


@query("marker_report_file", _SHEET_REPORT, "sheet")
def _(t):
    path, found = new_path(t.spark, "validation"), cut(validated(t), "validated")
    files.write_validation_report(markers.failures(found), markers.totals(found), "sheet", path, "here")
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# sheets of a thousand rows each, written and read again: rows are numbered anew
_BOOKS = "bk AS (SELECT *, cast(floor((row - 2) / 1000) AS INT) AS book FROM sheet), rn AS (SELECT row AS old, book, row_number() OVER (PARTITION BY book ORDER BY row) + 1 AS row FROM bk)"


@query("sheet_scan", f"""WITH {_BOOKS}, {_CHECKED} SELECT rn.book, cast(rn.row AS BIGINT) AS row, subset, "column", value, error FROM v JOIN rn ON rn.old = v.row""", "sheet")
def _(t):
    path = new_path(t.spark, "sheets")
    files.write_sheets(t.sheet.withColumn("book", F.floor((F.col("row") - 2) / 1000).cast("int")), path, "book")
    keyed = files.read_sheet(t.spark, path).withColumn("row", F.struct("book", F.col("row").alias("line")))
    return markers.validate(markers.cells(keyed)).select("row.book", F.col("row.line").alias("row"), "subset", "column", "value", "error")


@query("marker_inventory", f"WITH {_FOUND} SELECT row, subset, \"column\", cast(pos AS INT) AS pos, marker, qualifier FROM fd", "sheet")
def _(t):
    return markers.inventory(checked(t))


@query(
    "marker_usage",
    f"""WITH {_FOUND} SELECT marker, count(*) AS n, array_to_string(list_sort(list_distinct(list("column"))), '|') AS columns, count(DISTINCT subset) AS n_subsets FROM fd GROUP BY 1""",
    "sheet",
)
def _(t):
    return markers.usage(markers.inventory(checked(t))).select("marker", "n", joined("columns"), "n_subsets")


@query("marker_usage_by_subset", f"WITH {_FOUND} SELECT marker, subset, count(*) AS n FROM fd GROUP BY ALL", "sheet")
def _(t):
    return markers.usage_by_subset(markers.inventory(checked(t)))


@query("marker_alias", f'WITH {_FOUND} SELECT row, "column", cast(pos AS INT) AS pos, coalesce(canonical, marker) AS canonical FROM fd LEFT JOIN aliases ON alias = marker', "sheet", "aliases")
def _(t):
    return markers.canonical(markers.inventory(checked(t)), t.aliases).select("row", "column", "pos", "canonical")


@query("marker_top", f"WITH {_FOUND} SELECT marker, count(*) AS n FROM fd GROUP BY 1 ORDER BY n DESC, marker LIMIT 10", "sheet")
def _(t):
    return markers.most_common(markers.inventory(checked(t)), 10)


def _n(ch: str) -> str:
    return f"length(replace(value, '{ch}', ''))"


_LINT = {
    "unbalanced": f"""SELECT row, "column", value AS detail FROM cells WHERE {_n('(')} <> {_n(')')} OR {_n('[')} <> {_n(']')}""",
    "free_text": f"""SELECT row, "column", sum(cast(regexp_extract(word, {_SPLIT}, 2) = '' AS INT)) || '/' || count(*) AS detail FROM wd GROUP BY 1, 2 HAVING count(*) >= 4 AND sum(cast(regexp_extract(word, {_SPLIT}, 2) = '' AS INT)) > 0.5 * count(*)""",
    "space_in_name": """SELECT row, "column", toks[i] || ' ' || toks[i + 2] AS detail FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM tk) WHERE toks[i] NOT IN (' ', '(', ')', '[', ']', '|') AND toks[i + 1] = ' ' AND regexp_matches(toks[i + 2], '^[0-9]')""",
    "no_delimiter": """SELECT row, "column", value AS detail FROM cells WHERE regexp_matches(value, '[)\\]][A-Za-z]')""",
    "stacked": """SELECT row, "column", marker || qualifier AS detail FROM fd WHERE regexp_matches(marker, '(hi|lo|int)$') AND qualifier <> ''""",
    "bare": """SELECT row, "column", marker || qualifier AS detail FROM fd WHERE qualifier = ''""",
    "stray_space": """SELECT row, "column", value AS detail FROM cells WHERE value <> trim(value) OR contains(value, '  ')""",
}
_LINT_SETS = {
    "several_names": "SELECT coalesce(canonical, marker) AS canonical, array_to_string(list_sort(list_distinct(list(marker))), '|') AS names FROM fd LEFT JOIN aliases ON alias = marker GROUP BY 1 HAVING count(DISTINCT marker) > 1",
    "casing": "SELECT lower(marker) AS folded, array_to_string(list_sort(list_distinct(list(marker))), '|') AS names FROM fd GROUP BY 1 HAVING count(DISTINCT marker) > 1",
    "negated_and_not": """SELECT "group" FROM (SELECT regexp_replace(g, '-$', '') AS "group", g LIKE '%-' AS neg FROM (SELECT unnest(regexp_extract_all(value, '[(\\[][^()\\[\\]]*[)\\]]-?')) AS g FROM cells)) GROUP BY 1 HAVING count(DISTINCT neg) > 1""",
}
# the cells that have one of the names or groups
_LINT_CELLS = {
    "several_names": """SELECT DISTINCT row, "column" FROM fd LEFT JOIN aliases ON alias = marker WHERE coalesce(canonical, marker) IN (SELECT canonical FROM ({}))""",
    "casing": """SELECT DISTINCT row, "column" FROM fd WHERE lower(marker) IN (SELECT folded FROM ({}))""",
    "negated_and_not": """SELECT DISTINCT row, "column" FROM (SELECT row, "column", unnest(regexp_extract_all(value, '[(\\[][^()\\[\\]]*[)\\]]-?')) AS g FROM cells) WHERE regexp_replace(g, '-$', '') IN (SELECT "group" FROM ({}))""",
}


def _lint(name: str, build) -> None:
    sql = _LINT.get(name) or _LINT_SETS[name]
    uses = ("sheet", "aliases") if name == "several_names" else ("sheet",)
    query(f"lint_{name}", f"WITH {_FOUND} {sql}", *uses)(build)


for _name in _LINT:
    _lint(_name, lambda t, f=getattr(markers, _name): f(checked(t)).select("row", "column", "detail"))
_lint("several_names", lambda t: markers.several_names(markers.inventory(checked(t)), t.aliases).select("canonical", joined("names")))
_lint("casing", lambda t: markers.casing(markers.inventory(checked(t))).select("folded", joined("names")))
_lint("negated_and_not", lambda t: markers.negated_and_not(checked(t)))


_SEVERITY = "CASE lint " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in markers.SEVERITY.items()) + " END"
_COUNTS = [f"""SELECT '{k}' AS lint, count(*) AS n, count(DISTINCT (row, "column")) AS cells FROM ({x})""" for k, x in _LINT.items()]
_COUNTS += [f"SELECT '{k}', (SELECT count(*) FROM ({x})), (SELECT count(*) FROM ({_LINT_CELLS[k].replace('{}', x)}))" for k, x in _LINT_SETS.items()]


@query("lint_summary", f"WITH {_FOUND} SELECT lint, {_SEVERITY} AS severity, n, cells FROM ({' UNION ALL '.join(_COUNTS)}) WHERE n > 0", "sheet", "aliases")
def _(t):
    return markers.lint_summary(checked(t), t.aliases)


@query("lint_issues", f"WITH {_FOUND} " + "SELECT row, \"column\", lint, " + _SEVERITY + " AS severity, detail FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS lint, * FROM ({x})" for k, x in _LINT.items()) + ")", "sheet")
def _(t):
    return markers.cell_issues(checked(t)).drop("subset")


# ---------------------------------------------------------------- quotes

_NORM = "trim(regexp_replace(translate(lower({}), '–—―‘’“”', '---'''''''''), '\\s+', ' ', 'g'))"
_SEGMENTS = f"list_filter(list_transform(regexp_split_to_array({{}}, '\\.{{{{3}}}}|…|\\.\\s\\.\\s\\.'), lambda x: {_NORM.format('x')}), lambda x: x <> '')".replace("{{3}}", "{3}")
_HELD = f"ev AS (SELECT run_id, qid, {_NORM.format('text')} AS nt FROM evidence WHERE text <> '')"
_ASKED = "qs AS (SELECT *, " + _SEGMENTS.replace("{}", "quote") + " AS segs FROM {}), qp AS (SELECT *, '%' || array_to_string(segs, '%') || '%' AS pattern FROM qs)"


@query("quote_extract", """SELECT page_id, cast(i - 1 AS INT) AS quote_no, q[i] AS quote FROM (SELECT page_id, q, unnest(range(1, len(q) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '>\\s*"([^"]+)"', 1) AS q FROM pages))""")
def _(t):
    return quotes.extract(t.pages.select("page_id", "html"), "html")


@query("quote_normalise", f"SELECT doc_id, {_NORM.format('text')} AS nt FROM documents")
def _(t):
    return t.documents.select("doc_id", for_match("text").alias("nt"))


@query("quote_segments", f"WITH {_ASKED.replace('FROM {}', 'FROM ellipses')} SELECT item_id, array_to_string(segs, '~') AS segments FROM qp", "ellipses")
def _(t):
    return t.ellipses.select("item_id", F.array_join(segments("quote"), "~").alias("segments"))


@query(
    "quote_missing",
    f"WITH {_HELD}, {_ASKED.replace('FROM {}', 'FROM asked')} SELECT item_id, substr(quote, 1, 80) AS shown FROM qp WHERE len(segs) > 0 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.run_id = qp.run_id AND ev.qid = qp.qid AND nt LIKE pattern)",
    "evidence", "asked",
)
def _(t):
    lost = quotes.missing(quotes.with_segments(t.asked), quotes.prepare(t.evidence), ["run_id", "qid"])
    return lost.select("item_id", F.substring("quote", 1, 80).alias("shown"))


@query(
    "report_verdict",
    f"""WITH {_HELD}, q0 AS (SELECT report_id, run_id, qid, unnest(q) AS quote, unnest(range(len(q))) AS quote_no FROM (SELECT *, regexp_extract_all(md, '>\\s*"([^"]+)"', 1) AS q FROM reports)), {_ASKED.replace("FROM {}", "FROM q0")},
    lost AS (SELECT report_id, count(*) AS n, string_agg('Quote not found in evidence: "' || substr(quote, 1, 80) || '..."', ' // ' ORDER BY quote_no) AS said FROM qp WHERE len(segs) > 0 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.run_id = qp.run_id AND ev.qid = qp.qid AND nt LIKE pattern) GROUP BY 1),
    x AS (SELECT report_id, r.run_id, r.qid, EXISTS (SELECT 1 FROM ev WHERE ev.run_id = r.run_id AND ev.qid = r.qid) AS there, coalesce(lost.n, 0) AS n, lost.said FROM reports r LEFT JOIN lost USING (report_id))
    SELECT report_id, there AND n = 0 AS passed, cast(CASE WHEN there THEN n ELSE 1 END AS BIGINT) AS n_errors,
      CASE WHEN there THEN coalesce(said, '') ELSE 'No evidence for run ''' || run_id || ''' and question ''' || qid || '''.' END AS errors FROM x""",
    "evidence", "reports",
)
def _(t):
    return quotes.verdicts(t.reports, t.evidence).withColumn("errors", F.array_join("errors", " // "))


@query("report_scan", "SELECT report_id, md FROM reports", "reports")
def _(t):
    path = new_path(t.spark, "markdown")
    t.reports.select("report_id", F.col("md").alias("value")).repartition("report_id").write.partitionBy("report_id").text(path)
    back = files.read_reports(t.spark, f"{path}/report_id=*")
    return back.select(F.regexp_extract("report_id", "report_id=([^/]*)", 1).alias("report_id"), F.regexp_replace("md", r"\n\z", "").alias("md"))


@query(
    "quote_corpus_match",
    f"WITH {_ASKED.replace('FROM {}', 'FROM ellipses')} SELECT item_id, doc_id FROM qp JOIN (SELECT doc_id, {_NORM.format('text')} AS nt FROM documents WHERE text <> '') ON nt LIKE pattern WHERE len(segs) > 0",
    "ellipses",
)
def _(t):
    return quotes.corpus_matches(quotes.with_segments(t.ellipses), quotes.prepare(t.documents.select("doc_id", "text")), "item_id", "doc_id")


@query("quote_index_match", ORACLE_SQL["quote_corpus_match"])
def _(t):
    path, corpus = new_path(t.spark, "quote-index"), t.documents.select("doc_id", "text")
    for texts in (corpus.where("doc_id % 3 > 0"), corpus):  # the second adds the others only
        quote_index.extend(texts, path)
    return quote_index.matches(quotes.with_segments(t.ellipses), path, "item_id")


# ---------------------------------------------------------------- search responses


def responses(t: Tables) -> DataFrame:
    """One response for each document, in both shapes, with ids and access states of every kind, and stray array items."""
    corpus = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("source"))).otherwise(F.concat(F.lit('{"source":'), (F.col("doc_id") % 7).cast("string"), F.lit("}")))
    access = F.expr("""CASE doc_id % 4 WHEN 0 THEN '{"status":"GOLD"}' WHEN 1 THEN '{"status":"CLOSED"}' WHEN 2 THEN '{"status":null}' ELSE '"unknown"' END""")
    rest = F.to_json(F.struct(F.col("lang").alias("title"), F.array("lang", "source").alias("authors")))
    paper = F.concat(F.lit('{"corpusId":'), F.regexp_extract(corpus, r'^\{"source":(.*)\}$', 1), F.lit(',"openAccessInfo":'), access, F.lit(","), F.substr(rest, F.lit(2)))
    snippet = F.to_json(
        F.struct(
            "text",
            F.lit("body").alias("snippetKind"),
            F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("section"),
            F.struct(F.col("n_chars").alias("start")).alias("snippetOffset"),
            F.struct(F.array(F.struct(F.col("doc_id").alias("start"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("string")).otherwise("").alias("matchedPaperCorpusId"))).alias("refMentions"), F.when(F.col("doc_id") % 4 > 0, F.array(F.struct("doc_id", F.col("n_chars").alias("end")))).alias("sentences")).alias("annotations"),
        )
    )
    data = F.concat(F.lit('{"data":[null,{"paper":'), paper, F.lit(',"snippet":'), snippet, F.lit('},"stray",3]}'))
    response = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"result":'), data, F.lit("}"))).otherwise(data)
    return t.searches.select("run_id", "qid", "round", "query", "source_seed", "followed", "batch", response.alias("response"))


def records(t: Tables) -> DataFrame:
    return streams.records(responses(t))


_ORDER_BY = ["round", "batch", "pos"]
_RECORDS = """rc AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 7 = 0 THEN '' ELSE cast(doc_id % 7 AS VARCHAR) END AS corpus_id FROM searches)"""
_FIRST = f"{_RECORDS}, fr AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY run_id, qid, corpus_id, n_chars ORDER BY round, doc_id) = 1)"
_FRESH = f"""{_RECORDS}, old AS (SELECT * FROM rc WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY run_id, qid, corpus_id, n_chars ORDER BY round, doc_id) = 1),
  nw AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY run_id, qid, corpus_id, n_chars ORDER BY round, doc_id) = 1),
  ad AS (SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.run_id = nw.run_id AND old.qid = nw.qid AND old.corpus_id = nw.corpus_id AND old.n_chars IS NOT DISTINCT FROM nw.n_chars)),
  al AS (SELECT * FROM old UNION ALL SELECT * FROM ad)"""


def cached(t: Tables) -> DataFrame:
    old = records(t).where(F.col("batch") % 3 == 0)
    return snippets.first_of_each(old, _ORDER_BY).select(*snippets.RECORD)


@query(
    "snippet_flatten",
    f"""WITH {_RECORDS} SELECT run_id, qid, round, query, source_seed, corpus_id, lang AS title, lang || '|' || source AS authors, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS open_access,
    CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS section, 'body' AS snippet_kind, n_chars AS "start", cast(NULL AS BIGINT) AS "end", coalesce(text, '') AS text, doc_id || ':' || CASE WHEN doc_id % 3 > 0 THEN cast(doc_id % 3 AS VARCHAR) ELSE '-' END AS mentions, CASE WHEN doc_id % 4 > 0 THEN '-:' || n_chars ELSE '' END AS sentences,
    CASE corpus_id WHEN 'src1' THEN '13' WHEN '3' THEN '4|5=6' ELSE '' END AS followed FROM rc""",
    "searches",
)
def _(t):
    mention = F.transform("ref_mentions", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), F.coalesce(m["matched_corpus_id"], F.lit("-"))))
    return snippets.keyed(records(t)).select(
        "run_id", "qid", "round", "query", "source_seed", "corpus_id", "title", joined("authors"), "open_access", "section", "snippet_kind", "start", "end", "text",
        F.array_join(mention, "|").alias("mentions"), F.array_join(F.transform("sentences", lambda x: F.concat(F.coalesce(x["start"].cast("string"), F.lit("-")), F.lit(":"), x["end"].cast("string"))), "|").alias("sentences"), F.array_join("followed_corpus_ids", "|").alias("followed"),
    )


@query("snippet_dedup", f"WITH {_FIRST} SELECT run_id, qid, round, corpus_id, n_chars, text FROM fr", "searches")
def _(t):
    return snippets.keyed(snippets.first_of_each(records(t), _ORDER_BY)).select("run_id", "qid", "round", "corpus_id", F.col("start").alias("n_chars"), "text")


@query("snippet_append", f"WITH {_FRESH} SELECT run_id, qid, round, corpus_id, n_chars, text FROM al", "searches")
def _(t):
    return snippets.keyed(snippets.append(cached(t), records(t), _ORDER_BY)).select("run_id", "qid", "round", "corpus_id", F.col("start").alias("n_chars"), "text")


_GROWTH = f"{_FRESH}, gw AS (SELECT run_id, qid, round, count(*) AS offered FROM rc GROUP BY ALL), ga AS (SELECT run_id, qid, round, count(*) AS added FROM ad GROUP BY ALL), gr AS (SELECT run_id, qid, round, offered, coalesce(added, 0) AS added FROM gw LEFT JOIN ga USING (run_id, qid, round))"


@query("snippet_growth", f"WITH {_GROWTH} SELECT * FROM gr", "searches")
def _(t):
    return snippets.growth(records(t), cached(t), _ORDER_BY)


@query("snippet_running_total", f"WITH {_GROWTH} SELECT *, cast(sum(added) OVER (PARTITION BY run_id, qid ORDER BY round) AS BIGINT) AS total FROM gr", "searches")
def _(t):
    return snippets.running_total(snippets.growth(records(t), cached(t), _ORDER_BY))


@query("snippet_followed", f"WITH {_RECORDS} SELECT corpus_id, CASE corpus_id WHEN 'src1' THEN '13' WHEN '3' THEN '4|5=6' ELSE '' END AS followed, count(*) AS n FROM rc GROUP BY ALL", "searches")
def _(t):
    return records(t).groupBy("corpus_id", F.array_join("followed_corpus_ids", "|").alias("followed")).agg(F.count("*").alias("n"))


@query(
    "snippet_summary",
    f"""WITH {_FIRST}, pr AS (SELECT run_id, qid, round, count(*) AS n, count(*) FILTER (lang <> '') AS titled FROM fr GROUP BY ALL)
    SELECT run_id, qid, cast(sum(n) AS BIGINT) AS n, count(*) AS rounds, cast(sum(titled) AS BIGINT) AS titled, string_agg(round || ':' || n, ' ' ORDER BY round) AS by_round FROM pr GROUP BY 1, 2""",
    "searches",
)
def _(t):
    found = snippets.summary(snippets.first_of_each(records(t), _ORDER_BY))
    told = F.transform(F.array_sort(F.map_entries("by_round")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return found.withColumn("by_round", F.array_join(told, " "))


@query(
    "snippet_cache_file",
    f"WITH {_RECORDS} SELECT run_id, qid, round, corpus_id, lang || '|' || source AS authors, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS open_access, n_chars AS \"start\", coalesce(text, '') AS text FROM rc WHERE run_id = 'r1'",
    "searches",
)
def _(t):
    path = new_path(t.spark, "cache")
    for rest in (0, 1):  # two appends
        files.append_records(records(t).where(F.col("batch") % 2 == rest).select(*snippets.RECORD), path)
    return snippets.keyed(files.read_records(t.spark, path, run_id="r1")).select("run_id", "qid", "round", "corpus_id", joined("authors"), "open_access", "start", "text")


_OFFERS = f"""{_RECORDS}, f1 AS (SELECT DISTINCT run_id, qid, corpus_id, n_chars FROM rc WHERE doc_id % 3 = 0), f2 AS (SELECT DISTINCT run_id, qid, corpus_id, n_chars FROM rc),
  ct AS (SELECT (SELECT count(*) FROM rc WHERE doc_id % 3 = 0) AS a, (SELECT count(*) FROM f1) AS b, (SELECT count(*) FROM rc) AS c, (SELECT count(*) FROM f2) AS d)"""


@query("snippet_append_counts", f"WITH {_OFFERS} SELECT 1 AS call, a AS offered, b AS added FROM ct UNION ALL SELECT 2, c, d - b FROM ct UNION ALL SELECT 3, c, 0 FROM ct", "searches")
def _(t):
    path, found = new_path(t.spark, "counts"), cut(records(t), "records")
    calls = [files.append_new(x, path, _ORDER_BY) for x in (found.where(F.col("batch") % 3 == 0), found, found)]  # the last one has nothing new
    return t.spark.createDataFrame([(i, c["offered"], c["added"]) for i, c in enumerate(calls, 1)], "call int, offered long, added long")


@query("snippet_evidence", f"WITH {_RECORDS} SELECT run_id, qid, text FROM rc WHERE text <> ''", "searches")
def _(t):
    return snippets.evidence(records(t))


@query("manifest_explode", "SELECT run_id, created, 't' || turn AS qid, text AS question, role || '|' || turn AS seeds FROM manifests", "manifests")
def _(t):
    question = F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("qid"), "text", F.array("role", F.col("turn").cast("string")).alias("seeds"))
    made = t.manifests.groupBy("run_id", "created").agg(F.collect_list(question).alias("questions"))
    return snippets.manifest_questions(made).withColumn("seeds", F.array_join("seeds", "|"))


@query("manifest_file", "SELECT run_id, created, 't' || turn AS qid, text AS question, role || '|' || turn AS seeds FROM manifests", "manifests")
def _(t):
    path = new_path(t.spark, "manifests")
    seeds = F.array("role", F.col("turn").cast("string"))
    files.write_manifests(t.manifests.select("run_id", "created", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("qid"), "text", seeds.alias("seeds")), path)
    return snippets.manifest_questions(files.read_manifests(t.spark, path)).withColumn("seeds", F.array_join("seeds", "|"))


# ---------------------------------------------------------------- tabs

_ROWS = 'rw AS (SELECT * FROM tab WHERE state IS NOT NULL OR priority IS NOT NULL OR target IS NOT NULL)'


@query("sheet_drop_empty_rows", f"WITH {_ROWS} SELECT * FROM rw", "tab")
def _(t):
    return sheets.clean_tab(t.tab, has_header=True, keys=["key"])


@query("sheet_drop_empty_columns", f'WITH {_ROWS} SELECT "key", state, priority FROM rw', "tab")
def _(t):
    return sheets.clean_tab(t.tab, has_header=False, keys=["key"])


@query("sheet_slug", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def _(t):
    return t.documents.select("doc_id", slug("text").alias("slug"))


@query("tab_files", f"""WITH {_ROWS} SELECT 'orders_by_state' AS slug, "key", state, priority, cast(NULL AS VARCHAR) AS target FROM rw""", "tab")
def _(t):
    folder, some = new_path(t.spark, "tabs"), F.coalesce("state", "priority", "target").isNotNull()
    tab = t.tab.withColumn("key", F.when(some, F.col("key")))  # as in a workbook, an empty row has no key either
    written = files.write_tabs({"Orders by state": (tab, True), "Nothing (yet)": (tab.where("false"), True)}, folder)
    schema = "`key` long, state string, priority string, target string"
    return reduce(DataFrame.unionByName, [t.spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}").select(F.lit(name).alias("slug"), "*") for name in written])


@query("tab_layout_file", f"""WITH {_ROWS} SELECT cast("key" AS VARCHAR) AS c0, state AS c1, CASE WHEN state IS NOT NULL THEN ' a, "b"' || chr(10) || state END AS c3, priority AS c4 FROM rw""", "tab")
def _(t):
    """A layout tab: no header, an empty column, quoted cells with separators and line ends, and rows that end with their last value."""
    path, quoted = new_path(t.spark, "layout"), F.concat(F.lit('" a, ""b""\n'), F.col("state"), F.lit('"'))
    cells = [F.col("key").cast("string"), F.col("state"), F.lit(""), quoted, F.col("priority")]
    line = F.concat_ws(",", *[F.coalesce(x, F.lit("")) for x in cells])
    some = t.tab.where(F.coalesce("state", "priority", "target").isNotNull())
    some.select(F.regexp_replace(line, ",+$", "").alias("line")).write.text(path)
    return sheets.clean_tab(files.read_tab(t.spark, path, has_header=False).drop("row"), has_header=False)


# ---------------------------------------------------------------- streams


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parquet*")


def _to_table(stream: DataFrame, name: str) -> DataFrame:
    """What a stream without further input writes to the shared folder."""
    path = new_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class Streamed(Tables):
    """Tables, and the bindings that rest on them, as streams."""

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name, _stream)


@query("snippet_stream_dedup", f"WITH {_RECORDS} SELECT DISTINCT run_id, qid, corpus_id, n_chars FROM rc", "searches")
def _(t):
    found = streams.deduplicated(records(Streamed(t.spark, t.sf_dir))).select("run_id", "qid", "corpus_id", F.col("snippet_offset.start").alias("n_chars"))
    return _to_table(found, "stream-dedup")


@query("snippet_stream_dedup_within", f"WITH {_RECORDS} SELECT DISTINCT run_id, qid, corpus_id, n_chars FROM rc", "searches")
def _(t):
    arrived = records(Streamed(t.spark, t.sf_dir)).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("round")))
    found = streams.deduplicated_within(arrived, "at", "1 hour").select("run_id", "qid", "corpus_id", F.col("snippet_offset.start").alias("n_chars"))
    return _to_table(found, "stream-dedup-within")


@query("snippet_stream_append", f"WITH {_FIRST} SELECT run_id, qid, round, corpus_id, n_chars, text FROM fr", "searches")
def _(t):
    path = new_path(t.spark, "stream-append")
    for state in ("first", "second"):  # the second stream, with a checkpoint of its own, finds all of it in the cache
        streams.append_stream(records(Streamed(t.spark, t.sf_dir)), f"{path}/cache", f"{path}/{state}", RECORDS).awaitTermination()
    return snippets.keyed(streams.read_cache(t.spark, f"{path}/cache", RECORDS)).select("run_id", "qid", "round", "corpus_id", F.col("start").alias("n_chars"), "text")


@query("snippet_cache_compacted", f"WITH {_FIRST} SELECT run_id, qid, round, corpus_id, n_chars, text FROM fr", "searches")
def _(t):
    path = new_path(t.spark, "cache-compacted")
    for state in ("first", "second"):  # the second stream finds all of it in the compacted cache
        streams.append_stream(records(Streamed(t.spark, t.sf_dir)), f"{path}/cache", f"{path}/{state}", RECORDS).awaitTermination()
        streams.compact(t.spark, f"{path}/cache", RECORDS)
    return snippets.keyed(streams.read_cache(t.spark, f"{path}/cache", RECORDS)).select("run_id", "qid", "round", "corpus_id", F.col("start").alias("n_chars"), "text")


@query("snippet_stream_counts", f"WITH {_OFFERS} SELECT 1 AS call, c AS offered, d AS added FROM ct UNION ALL SELECT 2, c, 0 FROM ct", "searches")
def _(t):
    path, counts = new_path(t.spark, "stream-counts"), {}
    for call in (1, 2):
        report = lambda _, n, call=call: counts.setdefault(call, []).append(n)
        streams.append_stream(records(Streamed(t.spark, t.sf_dir)), f"{path}/cache", f"{path}/{call}", RECORDS, report).awaitTermination()
    rows = [(call, sum(n["offered"] for n in batches), sum(n["added"] for n in batches)) for call, batches in counts.items()]
    return t.spark.createDataFrame(rows, "call int, offered long, added long")


def _ingested(t: Tables) -> str:
    """Responses, and lines and payloads that are no JSON, in files that come in two batches, with a restart between."""
    folder, path, found = new_path(t.spark, "incoming"), new_path(t.spark, "ingested"), responses(t)
    line = F.to_json(F.struct(*[c for c in found.columns]))
    broken = F.concat(F.lit('{"run_id": "broken '), F.col("batch").cast("string"))
    payload = F.to_json(F.struct("run_id", "qid", F.concat(F.lit("[no JSON "), F.col("batch").cast("string")).alias("response")))
    for rest in (0, 1):
        now = found.where(F.col("batch") % 2 == rest)
        lines = now.select(F.explode(F.array(line, F.when(F.col("batch") % 10 < 2, broken), F.when(F.col("batch") % 15 < 2, payload))).alias("line")).where("line is not null")
        lines.write.mode("append").text(folder)
        streams.ingest_files(t.spark, folder, path)
    return path


@query("snippet_stream_files", f"WITH {_RECORDS} SELECT DISTINCT run_id, qid, corpus_id, n_chars FROM rc", "searches")
def _(t):
    found = t.spark.read.schema(RECORDS).parquet(f"{_ingested(t)}/records")
    return found.select("run_id", "qid", "corpus_id", F.col("snippet_offset.start").alias("n_chars"))


@query(
    "snippet_stream_malformed",
    """SELECT cast(NULL AS VARCHAR) AS run_id, '{"run_id": "broken ' || doc_id AS payload FROM searches WHERE doc_id % 10 < 2 UNION ALL SELECT run_id, '[no JSON ' || doc_id FROM searches WHERE doc_id % 15 < 2""",
    "searches",
)
def _(t):
    return t.spark.read.schema("run_id string, qid string, payload string").parquet(f"{_ingested(t)}/malformed").select("run_id", "payload")


@query(
    "quote_stream_found",
    f"WITH {_HELD}, {_ASKED.replace('FROM {}', 'FROM asked')} SELECT item_id FROM qp WHERE len(segs) > 0 AND EXISTS (SELECT 1 FROM ev WHERE ev.run_id = qp.run_id AND ev.qid = qp.qid AND nt LIKE pattern)",
    "evidence", "asked",
)
def _(t):
    path, arriving = new_path(t.spark, "stream-quotes"), Streamed(t.spark, t.sf_dir).asked
    checks.find_quotes(arriving, quotes.prepare(t.evidence), ["run_id", "qid"], path, f"{path}-state").awaitTermination()
    return read_or_empty(t.spark, path, "item_id long", "parquet").select("item_id")


@query("marker_stream_validate", f'WITH {_CHECKED} SELECT row, "column", error FROM v WHERE error IS NOT NULL', "sheet")
def _(t):
    path = new_path(t.spark, "stream-cells")
    checks.find_invalid_cells(checked(Streamed(t.spark, t.sf_dir)), path, f"{path}-state").awaitTermination()
    return read_or_empty(t.spark, path, "row long, column string, error string", "parquet").select("row", "column", "error")
