"""The operators' inputs, derived from the shared test tables by SQL that Spark and DuckDB both run.

A binding is a SELECT in which ``{name}`` is a table or another binding. Spark gets it
as a DataFrame by :func:`frame`, DuckDB as common table expressions by :func:`ctes`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.functions.text import OBO
from tessella.operators import graph
from tessella.tables import read

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_RELATION = f"""CASE l_returnflag || l_linestatus
    WHEN 'AF' THEN '{OBO}RO_0002104' WHEN 'AO' THEN '{OBO}BFO_0000051' WHEN 'NF' THEN '{OBO}CL_4030046'
    WHEN 'NO' THEN '{OBO}CL_4030045' WHEN 'RF' THEN '{OBO}RO_0015015' ELSE '{OBO}RO_0002292' END"""


def _group(key: str, size: int) -> str:
    """The number of a key's group of ``size``: groups stay small, and their number grows with the tables."""
    return f"cast(floor({key} / {size}) AS BIGINT)"


def _pr(key: str) -> str:
    return f"'{OBO}PR_' || lpad(cast({_group(key, 8)} AS STRING), 9, '0')"


def _cell(key: str) -> str:
    return f"'{OBO}CL_' || lpad(cast({_group(key, 3)} AS STRING), 9, '0')"


def marker_cell(k: str) -> str:
    """A marker expression of each valid form and of each kind of error, by ``k``."""
    a, b, c, d = (f"cast({k} % {m} + {n} AS STRING)" for m, n in ((7, 3), (11, 20), (5, 40), (3, 60)))
    forms = [
        f"'live/ CD' || {a} || '+ CD' || {b} || '- '",
        f"'CD' || {a} || '+ (CD' || {b} || '+|CD' || {c} || 'lo/-) [CD' || {d} || ' CD' || {b} || 'hi]-'",
        f"'(CD' || {a} || '+|CD' || {b} || '+ CD' || {c} || '-)'",
        f"'CD' || {a} || '+|CD' || {b} || '-'",
        f"'(CD' || {a} || '+ CD' || {b} || '-)CD' || {c} || '+'",
        f"'CD' || {a} || '+ ' || {b} || '+'",
        f"'CD' || {a} || '+ (CD' || {b} || '+'",
        f"'CD' || {a} || '+ )'",
        "'   '",
        f"'[CD' || {a} || '+(CD' || {b} || '-)]'",
        f"'[CD' || {d} || ' CD' || {b} || 'hi] CCR' || {c} || '+'",
        f"'Cd' || {a} || 'hi-  cd' || {b} || '+ stain it now'",
    ]
    return f"CASE {k} % 12 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def marker_error(k: str) -> str:
    """The error that each form has by the grammar; null where it is valid."""
    b, c = f"cast({k} % 11 + 20 AS STRING)", f"cast({k} % 5 + 40 AS STRING)"
    errors = {
        2: "'mixed ''|'' and space in a group'",
        3: "'top-level ''|'' must be inside a group'",
        4: f"'missing space before ''CD' || {c} || '+'''",
        5: f"'invalid marker token ''' || {b} || '+'''",
        6: "'missing '')'''",
        7: "'expected marker or group, found '')'''",
        8: "'empty expression'",
        9: "'unexpected ''('' in group'",
    }
    return f"CASE {k} % 12 " + " ".join(f"WHEN {i} THEN {e}" for i, e in errors.items()) + " END"


BINDINGS = {
    # ontology edges
    "edges": f"""SELECT {_cell("o_custkey")} AS cell, {_RELATION} AS relation, {_pr("l_partkey")} AS pr,
        l_linenumber = 1 AND {_group("l_partkey", 8)} % 5 < 4 AS said FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "inferred": "SELECT cell, relation, pr FROM {edges}",
    "asserted": "SELECT cell, relation, pr FROM {edges} WHERE said",
    "excluded": f"SELECT DISTINCT {_pr('p_partkey')} AS pr FROM {{part}} WHERE {_group('p_partkey', 8)} % 50 = 7",
    "parents": f"""SELECT '{OBO}RO_0015015' AS sub, '{OBO}RO_0002104' AS super UNION ALL SELECT '{OBO}RO_0002104', '{OBO}RO_9000001'
        UNION ALL SELECT '{OBO}RO_9000001', '{OBO}BFO_0000051' UNION ALL SELECT '{OBO}CL_4030046', '{OBO}CL_4030045'""",
    "cell_labels": f"SELECT {_cell('c_custkey')} AS cell, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS cell_label FROM {{customer}} WHERE {_group('c_custkey', 3)} % 30 < 29",
    "relation_labels": f"SELECT '{OBO}RO_0002104' AS relation, 'has plasma membrane part' AS relation_label UNION ALL SELECT '{OBO}RO_0002104', 'has membrane part' UNION ALL SELECT '{OBO}BFO_0000051', 'has part' UNION ALL SELECT '{OBO}CL_4030045', ''",
    "hierarchy": "SELECT p_partkey AS sub, cast(floor(p_partkey / 3) AS BIGINT) AS super FROM {part} WHERE p_partkey > 0",
    "listed": "SELECT p_partkey AS node FROM {part} WHERE p_size % 2 = 0",
    # names and identifiers of targets
    "statements": f"""SELECT {_pr("p_partkey")} AS pr, 'label' AS attribute, p_name AS value FROM {{part}} WHERE {_group("p_partkey", 8)} % 10 < 9
        UNION ALL SELECT {_pr("p_partkey")}, 'exact', 'CD' || cast(p_size AS STRING) FROM {{part}} WHERE p_size % 2 = 0
        UNION ALL SELECT {_pr("p_partkey")}, 'related', p_brand || ' CD' || cast(p_size AS STRING) || 'RA antigen' FROM {{part}}
        UNION ALL SELECT {_pr("p_partkey")}, 'narrow', 'CDw' || cast(p_size AS STRING) || ' or CD' || cast(p_size % 9 AS STRING) FROM {{part}}
        UNION ALL SELECT {_pr("p_partkey")}, 'broad', p_type FROM {{part}}
        UNION ALL SELECT {_pr("p_partkey")}, 'xref', CASE WHEN p_partkey % 3 = 0 THEN 'UniProtKB:P' ELSE 'OTHER:' END || lpad(cast(p_partkey AS STRING), 7, '0') FROM {{part}}
        UNION ALL SELECT {_pr("p_partkey")}, 'taxon', '{OBO}NCBITaxon_' || CASE p_partkey % 3 WHEN 0 THEN '10090' WHEN 1 THEN '9606' ELSE '1' END FROM {{part}} WHERE {_group("p_partkey", 8)} % 2 = 0 AND p_partkey % 100 < 50""",
    "subclasses": f"SELECT '{OBO}PR_S' || cast(p_partkey AS STRING) AS sub, {_pr('p_partkey')} AS super FROM {{part}}",
    "taxa": f"SELECT '{OBO}PR_S' || cast(p_partkey AS STRING) AS sub, '{OBO}NCBITaxon_' || CASE p_partkey % 4 WHEN 0 THEN '10090' WHEN 1 THEN '9606' ELSE '1' END AS taxon FROM {{part}}",
    "xrefs": f"SELECT '{OBO}PR_S' || cast(p_partkey AS STRING) AS sub, CASE WHEN p_size % 3 = 0 THEN 'OTHER:' ELSE 'UniProtKB:' END || p_brand AS xref FROM {{part}}",
    "species": f"SELECT '{OBO}NCBITaxon_10090' AS taxon, 'mouse' AS species UNION ALL SELECT '{OBO}NCBITaxon_9606', 'human'",
    # all of the above as quads, with statements of other predicates and of entities that are neither cells nor targets
    "quads": f"""SELECT 'redundant' AS graph, cell AS s, relation AS p, pr AS o FROM {{inferred}} UNION ALL SELECT 'redundant', cell, '{OBO}RO_0000000', pr FROM {{inferred}}
        UNION ALL SELECT 'redundant', sub, '{graph.IN_TAXON}', taxon FROM {{taxa}} UNION ALL SELECT 'redundant', sub, '{graph.SUBCLASS}', super FROM {{subclasses}}
        UNION ALL SELECT 'nonredundant', cell, relation, pr FROM {{asserted}} UNION ALL SELECT 'nonredundant', sub, '{graph.SUBCLASS}', super FROM {{subclasses}}
        UNION ALL SELECT 'ontology', cell, '{graph.DEFINED_BY}', '{graph.CELLS}' FROM {{cell_labels}} UNION ALL SELECT 'ontology', cell, '{graph.LABEL}', cell_label FROM {{cell_labels}}
        UNION ALL SELECT 'ontology', pr, '{graph.DEFINED_BY}', '{graph.TARGETS}' FROM {{statements}} WHERE attribute = 'related'
        UNION ALL SELECT 'ontology', pr, CASE attribute {" ".join(f"WHEN '{a}' THEN '{p}'" for p, a in graph.ATTRIBUTES.items())} END, value FROM {{statements}}
        UNION ALL SELECT 'ontology', relation, '{graph.LABEL}', relation_label FROM {{relation_labels}} UNION ALL SELECT 'ontology', sub, '{graph.SUBPROPERTY}', super FROM {{parents}}
        UNION ALL SELECT 'ontology', sub, '{graph.XREF}', xref FROM {{xrefs}} UNION ALL SELECT 'ontology', pr, 'comment', value FROM {{statements}}""",
    # marker cells
    "sheet": f"""SELECT p_partkey + 2 AS row, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE ' ' || p_name END AS `Subset name`,
        {marker_cell("p_partkey")} AS `Required exclusion`, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE {marker_cell("(p_partkey + 1)")} END AS `Ideal exclusion`,
        {marker_cell("(p_partkey + 2)")} AS `Required phenotypic markers`, CASE WHEN p_partkey % 4 = 0 THEN 'N/A' ELSE {marker_cell("(p_partkey + 3)")} END AS `Ideal phenotypic markers` FROM {{part}}""",
    "aliases": "SELECT 'CCR40' AS alias, 'CD60' AS canonical UNION ALL SELECT 'CCR41', 'CD61' UNION ALL SELECT 'CCR42', 'CD199'",
    # quotes
    "ellipses": """SELECT item_id, CASE item_id % 4 WHEN 0 THEN substr(text, 3, 40) || ' ... ' || substr(text, 60, 40) WHEN 1 THEN substr(text, 60, 40) || '…' || substr(text, 3, 40)
        WHEN 2 THEN '. . . ' || substr(text, 10, 60) || ' . . . ' ELSE text END AS quote FROM {benchmark}""",
    "evidence": "SELECT lang AS run_id, 'q' || cast(doc_id % 5 AS STRING) AS qid, text FROM {documents}",
    "asked": "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'es' END AS run_id, 'q' || cast(item_id % 6 AS STRING) AS qid, quote FROM {ellipses}",
    "reports": """SELECT 'r' || cast(item_id AS STRING) AS report_id, run_id, qid, CASE WHEN item_id % 7 = 0 THEN 'no quotation' ELSE 'As stated > "' || quote || '" and again >  "' || quote || '"' END AS md FROM {asked}""",
    # search responses: the calling context with the values of which the response is made
    "searches": """SELECT doc_id, 'r' || cast(doc_id % 3 AS STRING) AS run_id, 'q' || cast(doc_id % 4 AS STRING) AS qid, cast(doc_id % 5 AS INT) AS round, 'query' AS query, source AS source_seed,
        ' src1 = 11, 12 ;src2=;3=4,5=6;src1=13;nothing' AS followed, lang, source, text, n_chars, doc_id AS batch FROM {documents}""",
    "manifests": "SELECT 'run' || cast(conv_id AS STRING) AS run_id, 'then' AS created, conv_id, turn, role, text FROM {conversations}",
    # workbook tabs
    "tab": """SELECT o_orderkey AS `key`, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 10 < 8 AND o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,
        CASE WHEN o_orderkey < 0 THEN 'never' END AS target FROM {orders}""",
}


def _needed(names: list[str]) -> list[str]:
    """The bindings that ``names`` rest on, each after those it uses."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in BINDINGS and name not in out:
            for used in re.findall(r"\{(\w+)\}", BINDINGS[name]):
                visit(used)
            out.append(name)

    for n in names:
        visit(n)
    return out


def frame(spark: SparkSession, sf_dir: str, name: str, source: Callable[[SparkSession, str, str], DataFrame] = read) -> DataFrame:
    """A binding or a table as a DataFrame; ``source`` gives the tables."""
    if name not in BINDINGS:
        return source(spark, sf_dir, name)
    text = BINDINGS[name]
    used = {n: frame(spark, sf_dir, n, source) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **used)


def ctes(*names: str) -> str:
    """``WITH`` and the bindings for DuckDB."""
    parts = [f"{n} AS ({BINDINGS[n].replace('{', '').replace('}', '').replace('`', chr(34))})" for n in _needed(list(names))]
    return "WITH RECURSIVE " + ",\n".join(parts)
