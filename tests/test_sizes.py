"""What a size asks of the operators: each input dealt few times, files that do not repeat texts, tasks by rows."""

import functools
import gzip
import itertools
import pathlib
import time

from pyspark.sql import functions as F

from tessella.functions.text import OBO
from tessella.operators import edges, reports
from tessella.sources import files

EDGE = "cell string, relation string, pr string"
RELATIONS = list(edges.SENSES)


def test_bits_give_what_the_separate_steps_give(spark):
    inferred = [(c, r, p) for i, (c, r, p) in enumerate(itertools.product(("c1", "c2", None), [*RELATIONS, "other", None], ("p1", "p2", "p3", "gone", None))) if i % 3]
    asserted = [x for i, x in enumerate(inferred) if i % 4 == 0 and x[2] != "p3"] + [("c9", "other", "p2"), ("c1", RELATIONS[0], "gone")]
    a, b, gone = spark.createDataFrame(inferred * 2, EDGE), spark.createDataFrame(asserted, EDGE), spark.createDataFrame([("gone",)], "pr string")
    ancestors = edges.closure(spark.createDataFrame([(RELATIONS[5], RELATIONS[0]), (RELATIONS[0], "unlisted"), ("unlisted", RELATIONS[2]), (RELATIONS[3], RELATIONS[4]), (RELATIONS[4], RELATIONS[3])], "sub string, super string"))
    kept = edges.kept_edges(a, b, gone)
    assert sorted(map(str, kept.collect())) == sorted({str(r) for r in a.collect() if r.relation in RELATIONS and r.pr in {x[2] for x in asserted} - {"gone", None}})
    steps = edges.most_specific(edges.flag_asserted(kept, b), ancestors).select("cell", "relation", "pr", "asserted")
    found = edges.reduced_keys(a, b, ancestors, gone)
    assert sorted(map(str, found.collect())) == sorted(map(str, steps.collect())) and found.count() > 20


def test_edges_are_dealt_by_cell_and_by_target_only(spark, tmp_path):
    for name in ("inferred", "asserted"):
        spark.createDataFrame([("c", RELATIONS[0], "p")], EDGE).write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("inferred", "asserted"))
    parents, names, gone = spark.createDataFrame([(RELATIONS[5], RELATIONS[0])], "sub string, super string"), spark.createDataFrame([("c", "x")], "cell string, cell_label string"), edges.excluded_targets(spark)
    plan = edges.reduce_edges(a, b, edges.closure(parents), names, spark.createDataFrame([], "relation string, relation_label string"), gone)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3, plan  # inferred edges once (twice before, for what they entail), asserted ones for flags and for targets


def _wide(spark, n_cells: int):
    rows = [(f"{OBO}CL_{c:04d}", f"cell {c}", RELATIONS[p % 3], "has", "positive", p % 2 == 0, f"{OBO}PR_{p}", f"name {p}", "x", "CD4 (label)", "CD4 (label)", "h", "h", "m", "m") for c in range(n_cells) for p in range(7)]
    columns = "cell, cell_label, relation, relation_label, sense, asserted boolean, pr, label, xrefs, cd, cd_line, human, human_line, mouse, mouse_line"
    return spark.createDataFrame(rows, ", ".join(c if " " in c else f"{c} string" for c in columns.split(", "))).repartition(3)


def test_reports_are_compressed_and_in_order(spark, tmp_path, monkeypatch):
    wide = _wide(spark, 60)
    monkeypatch.setattr(reports, "PART_ROWS", 50)
    monkeypatch.setattr(reports.parts, "__defaults__", (50,))
    files.write_edge_reports(wide, str(tmp_path), compression="gzip")

    def text(name):
        return [gzip.open(p, "rt").read() for p in sorted((tmp_path / name).glob("part-*.gz"))]

    tsv, md = text("edges_tsv"), text("edges_md")
    assert len(tsv) > 3 and len(md) > 3  # in ranges, by rows
    lines = [x for t in tsv for x in t.splitlines()[1:]]
    assert lines == sorted(lines, key=lambda x: (x.split("\t")[0], x.split("\t")[4], f"{OBO}PR_" + x.split("\t")[6][3:])) and len(lines) == 420
    headings = [x for x in "".join(md).splitlines() if x.startswith("## ")]
    assert "".join(md).startswith(reports.EDGE_TITLE) and headings == [f"## CL:{c:04d} — cell {c}" for c in range(60)]
    whole = reports.cell_sections(reports.marker_lines(wide)).orderBy("cell").select("section").collect()
    assert "".join(md).endswith("".join(r.section + "\n" for r in whole))


def test_lines_are_made_before_they_are_dealt(spark):
    wide = _wide(spark, 2)
    plan = reports.marker_lines(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "human_line" not in plan.split("Window")[1].split("Project")[0], plan


def _cells(spark, values):
    return spark.createDataFrame([(i, "s", "Required exclusion", 1, v) for i, v in enumerate(values)], "row int, subset string, column string, col_ord int, value string")


def test_each_value_is_judged_once(spark):
    from tessella.operators import markers

    found = markers.validate(_cells(spark, ["CD4+", "CD4+", None, "   ", "CD4+ )", "   "]))
    assert [r.error for r in found.orderBy("row").collect()] == [None, None, None, "empty expression", "expected marker or group, found ')'", "empty expression"]
    assert found.columns == ["row", "subset", "column", "col_ord", "value", "error"]
    plan = markers.failures(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "Aggregate [value" in plan, plan  # it was worked out in the filter and again in the column


def test_cells_of_a_stream_are_judged_as_those_of_a_table(spark, tmp_path):
    from tessella.operators import markers
    from tessella.streaming import checks

    values = ["CD4+", None, "CD4+ )", "   ", "CD4+|CD8+", "CD4+ )"]
    for part in (values[:3], values[3:]):
        _cells(spark, part).withColumn("error", F.lit("of before")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    want = sorted(map(str, markers.validate(spark.read.parquet(f"{tmp_path}/in")).where("error is not null").select("row", "value", "error").collect()))
    checks.invalid_cells(stream).writeStream.format("memory").queryName("judged").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("judged").columns == markers.validate(_cells(spark, [])).columns
    assert sorted(map(str, spark.table("judged").select("row", "value", "error").collect())) == want and len(want) == 4
    checks.find_invalid_cells(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, found.select("row", "value", "error").collect())) == want and found.select("batch_no").distinct().count() == 2


def test_lint_summary_counts_cells_stated_twice(spark):
    from tessella.operators import markers

    once = _cells(spark, ["CD4", "cd4+", "CD4 CD4", " (CD4+ CD8-)-", "(CD4+ CD8-)", "CCR40+ CD60+"])
    aliases = spark.createDataFrame([("CCR40", "CD60")], "alias string, canonical string")
    found = {r.lint: (r.n, r.cells) for r in markers.lint_summary(once.unionByName(once.where("row = 2")), aliases).collect()}
    assert found == {"bare": (5, 2), "stray_space": (1, 1), "casing": (1, 5), "several_names": (1, 1), "negated_and_not": (1, 2)}


def test_graphs_are_written_one_by_one(spark, tmp_path):
    quads = [(g, "s", "p", f"o{i}") for g in ("ontology", "redundant", "elsewhere", None) for i in range(3)]
    frame = spark.createDataFrame(quads, files.QUADS)
    files.write_quads(frame, f"{tmp_path}/q", ("ontology", "redundant", "none of these"))
    for g in ("ontology", "redundant", "elsewhere"):
        assert sorted(map(tuple, files.read_graph(spark, f"{tmp_path}/q", g).collect())) == [("s", "p", f"o{i}") for i in range(3)]
    assert spark.read.parquet(f"{tmp_path}/q").count() == 12 and files.read_graph(spark, f"{tmp_path}/q", "none of these").count() == 0
    files.write_quads(frame.limit(0), f"{tmp_path}/q", ("ontology",))
    assert not [p for p in (tmp_path / "q").iterdir() if p.name in ("graph=redundant", "graph=elsewhere")]


def test_quote_index_grows_by_what_is_new(spark, tmp_path):
    """Words of a text go to their folders together, and a word's runs are written once, three characters from each position."""
    from tessella.operators import quote_index

    vocabulary = [f"w{i:03d}x" for i in range(400)]
    corpus = spark.createDataFrame([(i, " ".join(vocabulary)) for i in range(9)], "doc_id long, text string")
    path = f"{tmp_path}/index"
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    assert quote_index.extend(corpus.where("doc_id < 4"), path) == 4
    n_runs = table("runs").count()
    assert n_runs <= sum(map(len, vocabulary))
    assert quote_index.extend(corpus, path) == 5
    assert table("runs").count() == n_runs  # no new word
    assert table("tokens").count() <= 9 * quote_index.FOLDERS
    assert [r.n for r in table("words").groupBy("token").agg(F.sum("n").alias("n")).select("n").distinct().collect()] == [9]


def test_quote_index_by_pieces_of_every_length(spark, tmp_path):
    from tessella.operators import quote_index, quotes

    texts = [(1, "alphabet 𝒳𝒴zeta soup"), (2, "bet"), (3, "a"), (3, "ab"), (4, "t"), (5, "é𝒴"), (6, "   "), (7, None), (None, "alphabet")]
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    pieces = ["a", "t", "al", "et", "alp", "pha", "bet", "abet", "alphabet", "𝒳", "𝒴", "𝒳𝒴", "𝒴z", "𝒳𝒴zeta", "eta", "zet sou", "phabet 𝒳𝒴", "soup", "oupe", "b", "alphabet 𝒳𝒴zeta soup", "é"]
    quoted = quotes.with_segments(spark.createDataFrame(list(enumerate(pieces)), "item_id long, quote string"))
    path = f"{tmp_path}/index"
    assert quote_index.extend(corpus.where("doc_id <> 2"), path) == 5 and quote_index.extend(corpus, path) == 1
    held = {1: "alphabet 𝒳𝒴zeta soup", 2: "bet", 3: "a", 4: "t", 5: "é𝒴"}  # of the rows with key 3, the smaller text
    found = sorted(map(tuple, quote_index.matches(quoted, path, "item_id").collect()))
    assert found == sorted((i, d) for i, p in enumerate(pieces) for d, text in held.items() if p in text)


def _shuffled(spark) -> int:
    """Shuffle files on the disks of this session's only executor."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(1 for d in folders for _ in pathlib.Path(d).glob("*/shuffle_*.data"))


def test_a_written_step_leaves_no_shuffle(spark, tmp_path):
    from tessella.tables import shuffles_removed

    key, df = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.range(1000).repartition(3)
    held, before = spark.conf.get(key), _shuffled(spark)
    with shuffles_removed(spark):
        df.write.parquet(f"{tmp_path}/a")
    end = time.time() + 20
    while _shuffled(spark) > before and time.time() < end:  # files are removed behind the statement
        time.sleep(0.2)
    assert _shuffled(spark) <= before and spark.conf.get(key) == held and spark.read.parquet(f"{tmp_path}/a").count() == 1000


def test_an_export_in_rounds_is_the_whole_export(spark, tmp_path):
    wide = _wide(spark, 60).unionByName(_wide(spark, 1).withColumn("cell", F.lit(None).cast("string")))
    rounds = reports.in_rounds(wide, 9, 3)
    held = [{r.cell for r in x.select("cell").collect()} for x, _ in rounds]
    assert [end for _, end in rounds] == [3, 6, 9] and sum(map(len, held)) == 61 == len(set.union(*held))  # a cell is in one round
    assert None in held[0] and all(max(x or "" for x in a) < min(b) for a, b in itertools.pairwise(held))
    files.write_edge_export(rounds, f"{tmp_path}/export", "gzip")
    files.write_edge_reports(rounds, f"{tmp_path}/rounds")
    files.write_edge_reports(wide, f"{tmp_path}/whole")

    def rows(folder):
        texts = [(gzip.open(p, "rt") if p.suffix == ".gz" else p.open()).read() for p in sorted((tmp_path / folder).glob("part-*"))]
        return [x for t in texts for x in t.splitlines()[folder != "rounds/edges_md" and folder != "whole/edges_md" :]]

    assert rows("export") == rows("rounds/edges_tsv") == rows("whole/edges_tsv") and len(rows("export")) == 427
    assert sorted(rows("rounds/edges_md")) == sorted(rows("whole/edges_md")) and len(list((tmp_path / "export").glob("part-*"))) > 6
    md = [x for x in rows("rounds/edges_md") if x.startswith("## ")]
    assert rows("rounds/edges_md")[0] == reports.EDGE_TITLE and md[-60:] == [f"## CL:{c:04d} — cell {c}" for c in range(60)]
    assert [x for x, n in ((x, reports.in_rounds(wide, x)) for x in (1, 63, 64)) if len(n) == 2] == [64]  # a round has 32 parts at least


def test_rounds_hold_the_edges_of_one_plan(spark):
    from tessella.plans import queries

    t = queries.Tables(spark, "/root/testdata/sf0.001")
    whole = queries.wide(t)
    rounds = [x.select(whole.columns) for x, _ in queries.wide_in_rounds(t, 1)]
    assert sorted(map(str, functools.reduce(lambda a, b: a.unionByName(b), rounds).collect())) == sorted(map(str, whole.collect()))
