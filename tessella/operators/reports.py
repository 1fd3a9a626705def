"""Reports as tables of rows and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import clean_tsv, curie, escape_bar, yes_no
from tessella.operators.edges import SENSE_ORDER, sense_position
from tessella.tables import cut

COLUMNS = ("cell", "cell_label", "relation", "relation_label", "sense", "asserted", "pr", "pr_label", "cd_synonym", "uniprot_human", "uniprot_mouse", "xrefs")
# Headings of the senses.
HEADINGS = {
    "positive": "Positive (marker present)",
    "high": "High / bright",
    "low": "Low / dim",
    "negative": "Negative (marker absent)",
    "other": "Other relations",
}

# Titles, legend and table head of the reports.
EDGE_TITLE = "# CL → PR (Cell Ontology → PRO) marker relationships"
LEGEND = (
    "Relation senses: positive = *has plasma membrane part* / *expresses* / *has part*; negative = *lacks (plasma membrane) part*; "
    "high/low = *has high/low plasma membrane amount*. Markers flagged _(inferred only)_ are not directly asserted on the cell type."
)
VALIDATION_TITLE = "# Marker Syntax Validation"
TABLE_HEAD = ("| Sheet row | Subset | Column | Error | Value |", "|-----------|--------|--------|-------|-------|")
ALL_VALID = "✅ All marker cells conform to the grammar."
REMARK = "What the grammar accepts may still be doubtful: see the lint of the same cells."


def _scoped(separator: str):
    return F.array_join(F.transform("cd", lambda x: F.concat(x["token"], F.lit(" ("), x["scope"], F.lit(")"))), separator)


def target_texts(meta: DataFrame, cd: DataFrame, species: DataFrame) -> DataFrame:
    """``pr, label, xrefs, cd, cd_line, human, human_line, mouse, mouse_line``: what the reports say of each target, as text.

    Texts are made once a target, of which there are far fewer than edges; those named
    ``_line`` are for the markdown report, the others for the export.
    """
    joined = meta.select("pr", "label", "xrefs").join(cd, "pr", "left").join(species, "pr", "full")

    def both(name: str):
        return [clean_tsv(F.array_join(name, "; ")).alias(name), F.array_join(name, ", ").alias(f"{name}_line")]

    return joined.select(
        "pr", "label", clean_tsv(F.array_join("xrefs", "; ")).alias("xrefs"), clean_tsv(_scoped("; ")).alias("cd"), _scoped(", ").alias("cd_line"), *both("human"), *both("mouse"),
    )


_TEXTS = ("label", "xrefs", "cd", "cd_line", "human", "human_line", "mouse", "mouse_line")


def with_texts(table: DataFrame, texts: DataFrame) -> DataFrame:
    """``table (pr, ...)`` with the texts of its targets (:func:`target_texts`); missing ones empty."""
    return table.join(texts, "pr", "left").withColumns({k: F.coalesce(k, F.lit("")) for k in _TEXTS})


def annotated(edges: DataFrame, meta: DataFrame, cd: DataFrame, species: DataFrame) -> DataFrame:
    """Edges with the texts of their target; missing ones empty."""
    return with_texts(edges, target_texts(meta, cd, species))


def edge_table(wide: DataFrame) -> DataFrame:
    """The twelve text columns of the edge export; sort with :func:`sorted_edges`."""
    return wide.select(
        clean_tsv(curie("cell")).alias("cell"),
        clean_tsv("cell_label").alias("cell_label"),
        clean_tsv(curie("relation")).alias("relation"),
        clean_tsv("relation_label").alias("relation_label"),
        clean_tsv("sense").alias("sense"),
        yes_no("asserted").alias("asserted"),
        clean_tsv(curie("pr")).alias("pr"),
        clean_tsv("label").alias("pr_label"),
        F.col("cd").alias("cd_synonym"),
        F.col("human").alias("uniprot_human"),
        F.col("mouse").alias("uniprot_mouse"),
        "xrefs",
    )


#: Annotated edges that one task sorts; with their texts they take about 1 KB each.
PART_ROWS = 1 << 16


def parts(wide: DataFrame, part_rows: int = PART_ROWS) -> int:
    """Tasks for sorting a written table, by its rows: their texts compress too differently to tell it from bytes."""
    return max(1, -(-wide.count() // part_rows))


#: Rounds in which a large export is made, and the parts that each has at least.
ROUNDS, ROUND_PARTS = 8, 32


def in_rounds(pairs: DataFrame, n_parts: int, rounds: int | None = None) -> list[tuple[DataFrame, int]]:
    """``pairs`` with their ``part``, of ``n_parts`` ranges of cells, in rounds: each the next parts, with the number of the part after its last.

    ``pairs`` are read twice. What is shuffled for an export grows with the edges that are made at
    a time: of a large table, no more than an eighth is.
    """
    dealt = cut(pairs.repartitionByRange(n_parts, "cell").withColumn("part", F.spark_partition_id()), "dealt")
    rounds = max(1, min(ROUNDS, n_parts // ROUND_PARTS)) if rounds is None else rounds
    ends = [n_parts * i // rounds for i in range(rounds + 1)]
    return [(dealt.where((F.col("part") >= a) & (F.col("part") < b)), b) for a, b in zip(ends, ends[1:], strict=False)]


def after_parts(table: DataFrame, n: int) -> DataFrame:
    """``table`` behind ``n`` parts without rows, at least two, as Spark unites two single parts to one: its files' names follow those of ``n`` parts that are written by themselves."""
    none = table.sparkSession.range(0, n, 1, n).where("id < 0").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])
    return none.unionAll(table)


def sorted_edges(wide: DataFrame, n_parts: int | None = None) -> DataFrame:
    """The edge export in its order, in ``n_parts`` ranges of cells, or as many as Spark makes; edges that have a ``part`` (:func:`in_rounds`) are dealt by it."""
    order = ("cell", "sense", "pr", "relation")
    if n_parts is None:
        return edge_table(wide.orderBy(*order))
    dealt = wide.repartitionById(n_parts, F.col("part")) if "part" in wide.columns else wide.repartitionByRange(n_parts, *order)
    return edge_table(dealt.sortWithinPartitions(*order))


def marker_lines(wide: DataFrame, n_parts: int | None = None) -> DataFrame:
    """``cell, sense, position, line``: one bullet for each edge, numbered within its cell by sense, label and target; with ``n_parts`` in that many ranges of cells."""
    shown = F.when(F.col("label") != "", F.col("label"))
    line = F.concat(
        F.lit("- "),
        F.concat_ws(
            " — ",
            F.concat(F.lit("`"), curie("pr"), F.lit("` "), F.coalesce(shown, curie("pr"))),
            *[F.when(F.col(x) != "", F.concat(F.lit(f"{title}: "), F.col(x))) for x, title in (("cd_line", "CD"), ("human_line", "UniProt(human)"), ("mouse_line", "UniProt(mouse)"))],
            F.when(~F.col("asserted"), F.lit("_(inferred only)_")),
        ),
    )
    # the line is made first, so that not all the texts of which it is made are shuffled with it
    made = wide.select("cell", "cell_label", "sense", sense_position().alias("o"), F.coalesce(shown, F.col("pr")).alias("shown"), "pr", "relation", line.alias("line"))
    order = Window.partitionBy("cell").orderBy("o", "shown", "pr", "relation")
    return (made if n_parts is None else made.repartitionByRange(n_parts, "cell")).select("cell", "cell_label", "sense", F.row_number().over(order).alias("position"), "line")


def cell_sections(lines: DataFrame) -> DataFrame:
    """``cell, section``: a markdown section for each cell; empty senses have no heading."""
    bucket = F.struct(sense_position().alias("o"), "sense", "position", "line")
    headings = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])
    grouped = lines.groupBy("cell", "cell_label").agg(F.array_sort(F.collect_list(bucket)).alias("rows"))

    def part(name: str):
        own = F.filter("rows", lambda r: r["sense"] == name)
        text = F.concat(F.lit("**"), F.element_at(headings, F.lit(name)), F.lit("**\n\n"), F.array_join(F.transform(own, lambda r: r["line"]), "\n"), F.lit("\n"))
        return F.when(F.size(own) > 0, text)

    heading = F.concat(F.lit("## "), curie("cell"), F.when(F.col("cell_label") != "", F.concat(F.lit(" — "), F.col("cell_label"))).otherwise(""))
    return grouped.select("cell", F.concat(heading, F.lit("\n\n"), F.concat_ws("\n", *[part(s) for s in SENSE_ORDER])).alias("section"))


def failure_lines(failures: DataFrame) -> DataFrame:
    """``row, col_ord, line``: one row of a markdown table for each invalid cell."""
    line = F.concat(
        F.lit("| "), F.col("row").cast("string"), F.lit(" | "), escape_bar("subset"), F.lit(" | "), F.col("column"),
        F.lit(" | "), escape_bar("error"), F.lit(" | `"), escape_bar("value"), F.lit("` |"),
    )
    return failures.select("row", "col_ord", line.alias("line"))


def edge_report_head(edges: DataFrame, generated: str) -> DataFrame:
    """``position, line``: title, counts and legend of the edge report, from :func:`tessella.operators.edges.summary`; ``generated``: when and from what."""

    def count(name: str):
        return F.concat(F.lit("**"), F.col(name).cast("string"), F.lit("**"))

    head = F.array(
        F.lit(EDGE_TITLE), F.lit(""), F.lit(f"_Generated {generated}._"), F.lit(""),
        F.concat(F.lit("- Cell types: "), count("cells")),
        F.concat(F.lit("- CL→PR edges (inferred): "), count("edges"), F.lit(" (of which directly asserted: "), count("asserted_edges"), F.lit(")")),
        F.lit(""), F.lit(LEGEND), F.lit(""),
    )
    return edges.select(F.posexplode(head).alias("position", "line"))


def validation_report(failures: DataFrame, totals: DataFrame, source: str, grammar: str) -> DataFrame:
    """``part, row, col_ord, line``: the complete validation report in its order.

    Head, one table row for each invalid cell, and a remark; a report without failures says so
    instead of a table. ``totals``: (checked, invalid); ``grammar``: where the grammar is described.
    """

    def count(name: str):
        return F.concat(F.lit("**"), F.col(name).cast("string"), F.lit("**"))

    counts = [
        F.lit(VALIDATION_TITLE), F.lit(""), F.lit("> **Auto-generated** by the grammar's validator. Do not edit by hand: edit the sheet and validate it again."), F.lit(""),
        F.lit(f"- Source: `{source}`"), F.concat(F.lit("- Cells checked: "), count("checked")), F.concat(F.lit("- Invalid cells: "), count("invalid")), F.lit(f"- Grammar: {grammar}"), F.lit(""),
    ]
    table = [F.lit(x) for x in ("## Invalid cells", "", *TABLE_HEAD)]
    head = F.concat(F.array(*counts), F.when(F.col("invalid") == 0, F.array(F.lit(ALL_VALID))).otherwise(F.array(*table)))
    foot = F.when(F.col("invalid") > 0, F.array(F.lit(""), F.lit(REMARK)))

    def lines(part: int, of):
        return totals.select(F.lit(part).alias("part"), F.posexplode(of).alias("row", "line")).select("part", F.col("row").cast("long").alias("row"), F.lit(0).alias("col_ord"), "line")

    cells = failure_lines(failures).select(F.lit(1).alias("part"), F.col("row").cast("long").alias("row"), "col_ord", "line")
    return lines(0, head).unionByName(cells).unionByName(lines(2, foot))
