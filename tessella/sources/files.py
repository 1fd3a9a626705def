"""Readers and writers of the curation data's file forms."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import slug
from tessella.operators.edges import summary
from tessella.operators.reports import after_parts, cell_sections, edge_report_head, marker_lines, parts, sorted_edges, validation_report
from tessella.operators.sheets import clean_tab, is_empty
from tessella.operators.snippets import RECORD, counted, first_of_each, fresh
from tessella.tables import cut, read_or_empty, shuffles_removed

QUADS = "graph string, s string, p string, o string"
BINDINGS = "results struct<bindings: array<map<string, struct<type: string, value: string>>>>"
RECORDS = (
    "run_id string, qid string, round int, query string, source_seed string, corpus_id string, title string, authors array<string>, open_access boolean, "
    "section string, snippet_kind string, snippet_offset struct<start: bigint, end: bigint>, text string, "
    "ref_mentions array<struct<start: bigint, end: bigint, matched_corpus_id: string>>, sentences array<struct<start: bigint, end: bigint>>, followed_corpus_ids array<string>"
)
MANIFEST = "run_id string, created string, questions array<struct<qid: string, text: string, seeds: array<string>>>"


def write_quads(quads: DataFrame, path: str, graphs: tuple[str, ...] = ()) -> None:
    """One folder for each named graph, so that reading a graph reads nothing else.

    Those of ``graphs`` are written one by one, each from its own quads, and need not be sorted
    by graph in the memory of a task; the others, if there are any, are written together.
    """
    others = quads.where(~F.coalesce(F.col("graph").isin(*graphs), F.lit(False))) if graphs else quads
    others.write.mode("overwrite").partitionBy("graph").parquet(path)
    for g in graphs:
        quads.where(F.col("graph") == g).select("s", "p", "o").write.mode("overwrite").parquet(f"{path}/graph={g}")


def read_graph(spark: SparkSession, path: str, graph: str, predicates: list[str] | None = None) -> DataFrame:
    """``s, p, o`` of one named graph, of any predicate or of those listed; both filters reach the files."""
    quads = spark.read.schema(QUADS).parquet(path).where(F.col("graph") == graph)
    return (quads.where(F.col("p").isin(*predicates)) if predicates is not None else quads).select("s", "p", "o")


def flatten_bindings(results: DataFrame, variables: list[str]) -> DataFrame:
    """Query results in their JSON form (:data:`BINDINGS`) as rows; an unbound variable is null."""
    rows = results.select(F.explode("results.bindings").alias("b"))
    values = rows.select(F.transform_values("b", lambda _, v: v["value"]).alias("b"))
    return values.select(*[F.try_element_at("b", F.lit(v)).alias(v) for v in variables])


def read_bindings(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    return flatten_bindings(spark.read.schema(BINDINGS).option("multiLine", True).json(path), variables)


def read_sheet(spark: SparkSession, path: str, row: str = "row") -> DataFrame:
    """CSV sheets, one file or a folder of them, as text columns with ``row``, the 1-based row in its sheet (in place of a column of this name).

    A sheet may hold line ends within cells, so Spark reads each file in one piece, in
    order: a record's number is its place after the first record of its file.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return _numbered(spark.read.options(**options).csv(path), 2, row)


def write_sheets(sheets: DataFrame, path: str, book: str, row: str = "row") -> None:
    """Each ``book``'s rows, in the order of ``row``, as one CSV file with a header under ``book=``; :func:`read_sheet` numbers them anew."""
    ordered = sheets.repartition(book).sortWithinPartitions(book, row).drop(row)
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.write.mode("overwrite").options(**options).partitionBy(book).csv(path)


def read_tab(spark: SparkSession, path: str, has_header: bool, row: str = "row") -> DataFrame:
    """A tab's CSV as text columns with ``row``, the 1-based row in its file: named by its header, or by position (``c0``, ``c1``, ...) as a layout tab has none.

    Rows of a layout tab may differ in width: the tab is as wide as its widest row, and
    shorter rows are null beyond their end. An empty file has no columns but ``row``.
    """
    if has_header:
        return read_sheet(spark, path, row)
    # separators outside quotes, of the widest line; a quoted cell may hold separators and line ends
    lines = F.split(F.regexp_replace("value", r'"[^"]*"', ""), r"\r\n|\n|\r")
    separators = F.array_max(F.transform(lines, lambda x: F.when(x == "", -1).otherwise(F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))))
    width = (spark.read.text(path, wholetext=True).agg(F.max(separators)).first()[0] or 0) + 1
    names = [f"c{i}" for i in range(width)]
    options = {"multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxColumns": max(20480, width)}
    tab = spark.read.schema(", ".join(f"{n} string" for n in [*names, "__rest"])).options(**options).csv(path).drop("__rest")
    return _numbered(tab, 1, row)


def _numbered(table: DataFrame, first_row: int, row: str) -> DataFrame:
    """Rows of files that Spark reads each in one piece, with their number in their file."""
    placed = table.select("*", F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__id"))
    first = placed.groupBy("__file").agg(F.min("__id").alias("__first"))
    numbered = placed.join(first, "__file")
    return numbered.select(*[numbered[f"`{c}`"] for c in table.columns if c != row], (F.col("__id") - F.col("__first") + first_row).alias(row))


def write_tabs(tabs: dict[str, tuple[DataFrame, bool]], folder: str) -> list[str]:
    """Each tab that is not empty as CSV under its slug; ``tabs``: name to (table, whether it has a header)."""
    written = []
    for name, (tab, has_header) in tabs.items():
        if is_empty(tab):
            continue
        own = tab.sparkSession.range(1).select(slug(F.lit(name))).first()[0]
        clean_tab(tab, has_header).write.mode("overwrite").option("header", has_header).csv(f"{folder}/{own}")
        written.append(own)
    return written


def _named(value: Column) -> Column:
    """An id as a folder's name: an empty one, which would read back as null, gets a sign before it, and so does one that begins with this sign."""
    return F.when((value == "") | value.startswith("="), F.concat(F.lit("="), value)).otherwise(value)


def append_records(records: DataFrame, path: str) -> int:
    """Add JSON lines under ``run_id=/qid=`` folders and return their number, as the write itself counts it; existing files are never touched."""
    rows, seen = counted(records)
    rows.withColumns({c: _named(F.col(c)) for c in ("run_id", "qid")}).write.mode("append").partitionBy("run_id", "qid").json(path)
    return seen.get["n"]


def append_new(records: DataFrame, path: str, order: list[str]) -> dict[str, int]:
    """Add the first record, in the given order, of each key that the cache does not have yet; ``offered`` and ``added`` are counted by the job that writes.

    Appending the same records again adds nothing.
    """
    rows, offered = counted(records)
    first = first_of_each(rows, order)
    known = read_records(records.sparkSession, path)
    added = append_records(fresh(first, known).select(*RECORD), path)
    return {"offered": offered.get["n"], "added": added}


def read_records(spark: SparkSession, path: str, run_id: str | None = None, qid: str | None = None) -> DataFrame:
    """Cached records; blank lines are skipped, a malformed line is an error, a missing folder gives none. Of a run or question, only its folders are read."""
    found = read_or_empty(spark, path, RECORDS, "json", mode="FAILFAST")
    for column, value in (("run_id", run_id), ("qid", qid)):
        found = found.where(F.col(column) == _named(F.lit(value))) if value is not None else found
    return found.withColumns({c: F.regexp_replace(c, "^=", "") for c in ("run_id", "qid")})


def write_manifests(questions: DataFrame, path: str) -> None:
    """One JSON document, a line, for each run of ``questions (run_id, created, qid, text, seeds)``; a run's questions in their order by qid."""
    listed = questions.groupBy("run_id", "created").agg(F.array_sort(F.collect_list(F.struct("qid", "text", "seeds"))).alias("questions"))
    listed.write.mode("overwrite").json(path)


def write_manifest(questions: DataFrame, run_id: str, created: str, path: str) -> None:
    """The questions ``(qid, text, seeds)`` of one run."""
    write_manifests(questions.select(F.lit(run_id).alias("run_id"), F.lit(created).alias("created"), "qid", "text", "seeds"), path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of any number of runs, one a line; none where nothing has been written."""
    return read_or_empty(spark, path, MANIFEST, "json")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest whose document may go over several lines."""
    return read_or_empty(spark, path, MANIFEST, "json", multiLine=True)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``report_id, md``: whole markdown files with their paths."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report_id"), F.col("value").alias("md"))


def write_tsv(table: DataFrame, path: str, compression: str = "none", mode: str = "overwrite") -> None:
    """A tab-separated table with a header; values must hold no tabs or line ends. Large ones are to be compressed: an edge repeats all its target's texts."""
    table.write.mode(mode).options(sep="\t", header=True, quote="", emptyValue="", compression=compression).csv(path)


def write_edge_export(rounds: Iterable[tuple[DataFrame, int]], path: str, compression: str = "none") -> None:
    """The export of annotated edges with their ``part``, made and shuffled round by round (:func:`tessella.operators.reports.in_rounds`).

    Files are named after their parts, and so are in order; the first file of a later round has a header only.
    """
    for i, (wide, end) in enumerate(rounds):
        with shuffles_removed(wide.sparkSession):
            write_tsv(sorted_edges(wide, end), path, compression, "append" if i else "overwrite")


def write_edge_reports(wide: DataFrame | Iterable[tuple[DataFrame, int]], folder: str, generated: str = "from the given tables", compression: str = "none") -> None:
    """Both reports of one run, the export and the markdown with its head, from annotated edges, whole or in rounds as for :func:`write_edge_export`, that are worked out once.

    Both are made in ranges of cells that hold about equally many edges; lines of the
    markdown are dealt by these ranges once, and a cell's section is made where its lines are.
    """
    written, before = [], 0
    for each, end in [(wide, None)] if isinstance(wide, DataFrame) else wide:
        mode = "append" if written else "overwrite"
        with shuffles_removed(each.sparkSession):
            once = cut(each, "annotated")
            n_parts = parts(once)
            write_tsv(sorted_edges(once, end or n_parts), f"{folder}/edges_tsv", compression, mode)
            sections = cell_sections(marker_lines(once, n_parts)).sortWithinPartitions("cell").select("section")
            after_parts(sections, before + 2).write.mode(mode).option("compression", compression).text(f"{folder}/edges_md")  # the head is the first part of all
        written.append(once)
        before += n_parts
    head = edge_report_head(summary(reduce(DataFrame.unionByName, written)), generated).repartition(1).sortWithinPartitions("position").select(F.col("line").alias("section"))
    head.write.mode("append").option("compression", compression).text(f"{folder}/edges_md")


def write_validation_report(failures: DataFrame, totals: DataFrame, source: str, path: str, grammar: str = "see `tessella.functions.grammar`") -> None:
    """The complete validation report as text files in their order."""
    write_lines(validation_report(failures, totals, source, grammar), path, "line", ["part", "row", "col_ord"])


def write_lines(lines: DataFrame, path: str, line: str, order: list[str]) -> None:
    """Lines of a report in their order, as text files."""
    lines.orderBy(*order).select(line).write.mode("overwrite").text(path)
