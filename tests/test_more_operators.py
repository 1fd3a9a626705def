"""Quads, issues, subtotals, counts, files, and quotes with busy questions."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.text import OBO
from tessella.operators import annotate, edges, graph, markers, quote_index, quotes, sheets, snippets
from tessella.sources import files
from tessella.streaming import checks
from tessella.streaming import snippets as streams

POSITIVE, PART = f"{OBO}RO_0002104", f"{OBO}BFO_0000051"


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


# ---------------------------------------------------------------- quads


@pytest.fixture
def ontology(spark, tmp_path):
    def say(name, *triples):
        return [(name, *t) for t in triples]

    quads = say("redundant", ("c1", POSITIVE, "p1"), ("c1", POSITIVE, "p1"), ("c1", PART, "p1"), ("c1", "other", "p1"), ("c1", POSITIVE, "x"), ("x", POSITIVE, "p1"), ("c1", POSITIVE, "p3"), ("c1", None, "p1"))
    quads += say("redundant", ("m1", graph.IN_TAXON, f"{OBO}NCBITaxon_9606"), ("m2", graph.IN_TAXON, "elsewhere"), ("m3", graph.IN_TAXON, f"{OBO}NCBITaxon_10090"))
    quads += say("nonredundant", ("c1", "any", "p1"), ("c1", POSITIVE, "p2"), ("x", POSITIVE, "p3"), ("m1", graph.SUBCLASS, "p1"), ("m2", graph.SUBCLASS, "p1"), ("m3", graph.SUBCLASS, "p3"), ("m4", "other", "p1"))
    quads += say("ontology", *[(c, graph.DEFINED_BY, graph.CELLS) for c in ("c1", "c2", None)], *[(p, graph.DEFINED_BY, graph.TARGETS) for p in ("p1", "p2", "p3")], ("x", graph.DEFINED_BY, "elsewhere"))
    quads += say("ontology", ("c1", graph.LABEL, "late"), ("c1", graph.LABEL, "early"), ("c1", graph.LABEL, ""), ("c2", graph.LABEL, ""), (POSITIVE, graph.LABEL, "has"), ("other", graph.LABEL, "no marker relation"))
    quads += say("ontology", (POSITIVE, graph.SUBPROPERTY, "between"), ("between", graph.SUBPROPERTY, PART), ("p1", graph.LABEL, "one"), ("p1", "comment", "no name"), ("p1", graph.XREF, "UniProtKB:own"), ("p3", graph.LABEL, "unused"))
    quads += say("ontology", ("m1", graph.XREF, "UniProtKB:m1"), ("m1", graph.XREF, "OTHER:m1"), ("m2", graph.XREF, "UniProtKB:m2"), ("p1", graph.IN_TAXON, f"{OBO}NCBITaxon_10090"))
    quads += say("elsewhere", ("c2", POSITIVE, "p1"), ("c2", graph.DEFINED_BY, graph.CELLS))
    files.write_quads(spark.createDataFrame(quads, files.QUADS), f"{tmp_path}/quads")
    return f"{tmp_path}/quads"


def test_tables_of_quads(spark, ontology):
    found = graph.read_ontology(spark, ontology)
    assert rows(found.cells, "cell") == [("c1",), ("c2",)] and rows(found.targets, "pr") == [("p1",), ("p2",), ("p3",)]
    assert rows(found.inferred, "relation", "pr") == [("c1", PART, "p1"), ("c1", POSITIVE, "p1"), ("c1", POSITIVE, "p3")]
    assert rows(found.asserted, "pr") == [("c1", "any", "p1"), ("c1", POSITIVE, "p2")]
    assert rows(found.parents, "sub") == [("between", PART), (POSITIVE, "between")]
    assert rows(found.cell_labels) == [("c1", "early")] and rows(found.relation_labels) == [(POSITIVE, "has")]
    assert rows(found.statements, "attribute") == [("p1", "label", "one"), ("p1", "taxon", f"{OBO}NCBITaxon_10090"), ("p1", "xref", "UniProtKB:own")]
    reduced = edges.reduce_edges(found.inferred, found.asserted, edges.closure(found.parents), found.cell_labels, found.relation_labels, edges.excluded_targets(spark))
    assert rows(reduced) == [("c1", "early", POSITIVE, "has", "positive", False, "p1")]  # the general relation is entailed by way of one between
    species = spark.createDataFrame(list(annotate.TAXA.items()), "taxon string, species string")
    ids = annotate.species_ids(found.asserted, found.subclasses, found.taxa, found.xrefs, species)
    assert rows(ids) == [("p1", "human", "UniProtKB:m1")]
    merged = annotate.merge_species(annotate.metadata(found.statements), annotate.species_table(ids))
    assert rows(merged) == [("p1", ["UniProtKB:m1"], ["UniProtKB:own"])]


def test_each_graph_is_read_once_with_both_filters(spark, ontology, monkeypatch):
    read, seen = files.read_graph, []

    def watched(spark, path, name, predicates=None):
        found = read(spark, path, name, predicates)
        seen.append((name, found._jdf.queryExecution().executedPlan().toString()))
        return found

    monkeypatch.setattr(graph, "read_graph", watched)
    found = graph.read_ontology(spark, ontology)
    assert sorted(name for name, _ in seen) == ["nonredundant", "ontology", "redundant"]
    for name, plan in seen:
        assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(graph" in plan
        assert ("PushedFilters: [In(p" in plan) == (name != "nonredundant")
    plan = found.statements._jdf.queryExecution().executedPlan().toString()
    assert ontology not in plan and "CartesianProduct" not in plan  # the tables come from what was read


def test_quads_of_nothing(spark, tmp_path):
    files.write_quads(spark.createDataFrame([("elsewhere", "a", "b", "c")], files.QUADS), f"{tmp_path}/quads")
    found = graph.read_ontology(spark, f"{tmp_path}/quads")
    assert all(x.count() == 0 for x in (found.inferred, found.asserted, found.statements, found.subclasses, found.taxa, found.xrefs, found.parents, found.cell_labels))


# ---------------------------------------------------------------- issues and subtotals


def sheet_cells(spark, *values):
    return markers.cells(spark.createDataFrame([(i + 2, "s" if i else None, v) for i, v in enumerate(values)], "row int, `Subset name` string, `Required exclusion` string"))


def test_issues_have_severity_and_cells(spark):
    cells = sheet_cells(spark, "(CD3+ cd3-  X", "CD4+ CD4lohi", "A- (B+)C+", "CD 5+ one two three", "(B+)- D", "fine+")
    issues = {}
    for r in markers.cell_issues(cells).collect():
        issues.setdefault((r.lint, r.severity), set()).add((r.row, r.detail))
    assert issues["unbalanced", "High"] == {(2, "(CD3+ cd3-  X")} and issues["stray_space", "Low"] == {(2, "(CD3+ cd3-  X")}
    assert issues["stacked", "Medium"] == {(3, "CD4lohi")} and issues["no_delimiter", "Medium"] == {(4, "A- (B+)C+")}
    assert issues["space_in_name", "High"] == {(5, "CD 5+")} and issues["free_text", "High"] == {(5, "5/5")}
    assert {d for _, d in issues["bare", "Medium"]} == {"X", "CD", "one", "two", "three", "D"}
    found = {r.lint: (r.severity, r.n, r.cells) for r in markers.lint_summary(cells, spark.createDataFrame([("A", "CD4")], "alias string, canonical string")).collect()}
    assert found["bare"] == ("Medium", 6, 3) and found["casing"] == ("Low", 1, 1) and found["negated_and_not"] == ("Review", 1, 2)
    assert found["several_names"] == ("Medium", 1, 2) and set(found) == {k for k, _ in issues} | {"casing", "several_names", "negated_and_not"}


def test_lints_of_single_cells_shuffle_nothing(spark):
    plan = markers.cell_issues(sheet_cells(spark, "A+"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and markers.cell_issues(sheet_cells(spark, None, "N/A")).count() == 0
    assert markers.lint_summary(sheet_cells(spark, "A+"), spark.createDataFrame([], "alias string, canonical string")).count() == 0


def test_subtotals_tell_a_missing_subset_from_a_total(spark):
    failed = spark.createDataFrame([("c", None, "unexpected x"), ("c", "s", "unexpected y"), ("d", "s", None), ("d", "s", "missing ')'")], "column string, subset string, error string")
    found = {tuple(r)[:4]: r.n for r in markers.cube(failed).collect()}
    assert found[None, None, None, 7] == 3 and found["c", None, None, 3] == 2 and found["c", None, None, 1] == 1  # all of c, and c without a subset
    assert found[None, None, "unexpected", 6] == 2 and found[None, "s", None, 5] == 2 and found["d", "s", "missing closer", 0] == 1
    assert (found[None, None, None, 5], len(found)) == (1, 3 + 3 + 2 + 3 + 2 + 2 + 2 + 1)


# ---------------------------------------------------------------- caches and files

CALL = "run_id string, qid string, round int, query string, source_seed string, followed string, batch long, response string"


def calls(spark, *ids):
    text = '{"data":[{"paper":{"corpusId":"%s"},"snippet":{"text":"t"}}]}'
    return spark.createDataFrame([(run, q, r, "q", None, None, i, text % c) for i, (run, q, r, c) in enumerate(ids)], CALL)


def test_appends_return_what_they_counted(spark, tmp_path):
    found = streams.records(calls(spark, ("r", "q", 1, "a"), ("r", "q", 1, "a"), ("r", "", 1, "b"), (None, None, 2, "c"), ("", "=x", 1, "d"), ("=", "=", 1, "e")))
    path = f"{tmp_path}/cache"
    assert files.append_new(found, path, streams.ORDER) == {"offered": 6, "added": 5}
    assert files.append_new(found, path, streams.ORDER) == {"offered": 6, "added": 0}  # empty, missing and signed ids are known again
    assert {(r.run_id, r.qid, r.corpus_id) for r in files.read_records(spark, path).collect()} == {("r", "q", "a"), ("r", "", "b"), (None, None, "c"), ("", "=x", "d"), ("=", "=", "e")}
    assert [r.corpus_id for r in files.read_records(spark, path, "r", "").collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(run_id" in files.read_records(spark, path, "r")._jdf.queryExecution().executedPlan().toString()
    assert files.append_records(found.select(*snippets.RECORD), path) == 6


def test_stream_reports_its_counts(spark, tmp_path):
    told = {}
    for n in (1, 2):
        calls(spark, ("r", "q", 1, "a"), ("r", "q", 2, f"b{n}"), ("r", "q", 2, f"b{n}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.records(spark.readStream.schema(CALL).parquet(f"{tmp_path}/in"))
        streams.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", files.RECORDS, told.__setitem__).awaitTermination()
    assert told == {0: {"offered": 3, "added": 2}, 1: {"offered": 3, "added": 1}}


def test_counts_by_round(spark):
    found = snippets.summary(streams.records(calls(spark, ("r", "q", 1, "a"), ("r", "q", 3, "b"), ("r", "q", 3, "c"), ("r", "z", 2, "a")))).orderBy("qid").collect()
    assert [(r.qid, r.n, r.rounds, r.titled, r.by_round) for r in found] == [("q", 3, 2, 0, {1: 1, 3: 2}), ("z", 1, 1, 0, {2: 1})]


def test_ingest_of_files_goes_on_after_a_restart(spark, tmp_path):
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    line = '{"run_id":"r","qid":"q","round":1,"batch":%d,"response":%s}\n'
    body = '{"data":[{"paper":{"corpusId":"%s"}}]}'
    text = '"' + (body % "b").replace('"', '\\"') + '"'
    (folder / "1.json").write_text(line % (1, body % "a") + line % (2, text) + "{broken\n" + line % (3, '"no JSON"') + line % (4, '"[1]"'))
    streams.ingest_files(spark, str(folder), out)
    (folder / "2.json").write_text(line % (5, body % "a") + line % (6, body % "c") + "also broken\n")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    streams.ingest_files(spark, str(folder), out)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    assert sorted(r.corpus_id for r in spark.read.schema(files.RECORDS).parquet(f"{out}/records").collect()) == ["a", "b", "c"]
    aside = spark.read.schema("run_id string, qid string, payload string").parquet(f"{out}/malformed").collect()
    assert sorted((r.payload, r.run_id) for r in aside) == [("also broken", None), ("no JSON", "r"), ("{broken", None)]
    assert list((tmp_path / "out/state/records/state").rglob("*.zip"))  # RocksDB's snapshots


def test_layout_tabs_are_read_by_position(spark, tmp_path):
    (tmp_path / "tab.csv").write_text('Title,,\n"a, ""b""\nc",,x,,y\n ,z\n')
    found = files.read_tab(spark, f"{tmp_path}/tab.csv", has_header=False)
    assert found.columns == ["c0", "c1", "c2", "c3", "c4", "row"]
    assert rows(found, "row") == [("Title", None, None, None, None, 1), ('a, "b"\nc', None, "x", None, "y", 2), (" ", "z", None, None, None, 3)]
    assert sheets.clean_tab(found.drop("row"), has_header=False).columns == ["c0", "c1", "c2", "c4"]
    (tmp_path / "none.csv").write_text("")
    assert files.read_tab(spark, f"{tmp_path}/none.csv", has_header=False).count() == 0
    (tmp_path / "head.csv").write_text("h,k\n1,2\n")
    assert rows(files.read_tab(spark, f"{tmp_path}/head.csv", has_header=True)) == [("1", "2", 2)]


# ---------------------------------------------------------------- quotes


def busy_evidence(spark, n=600):
    """One question holds half of all texts."""
    texts = [("busy" if i % 2 else f"q{i % 7}", f"text number {i} " + "filler " * 20 + f"end {i}") for i in range(n)]
    return quotes.prepare(spark.createDataFrame(texts, "k string, text string")), texts


@pytest.mark.parametrize("part_bytes", [1 << 24, 2000])
def test_quotes_of_a_busy_question(spark, part_bytes):
    evidence, texts = busy_evidence(spark)
    asked = [(i, k, f"Number {i} ... end {i}") for i, (k, _) in enumerate(texts)] + [(1000 + i, "busy", f"number {i} filler end") for i in range(5)] + [(2000, "absent", "end 1"), (2001, "busy", "...")]
    quoted = quotes.with_segments(spark.createDataFrame(asked, "id int, k string, quote string"))
    lost = quotes.missing(quoted, evidence, ["k"], part_bytes)
    assert sorted(r.id for r in lost.collect()) == [1000, 1001, 1002, 1003, 1004, 2000]


def test_busy_questions_are_dealt_by_their_own_evidence(spark):
    evidence, _ = busy_evidence(spark)
    total = evidence.where("k = 'busy'").agg(F.sum(F.octet_length("text"))).first()[0]
    parts = quotes.busy(evidence, ["k"], total // 20)
    assert dict(rows(parts))["busy"] == 21 and all(n == 3 for k, n in rows(parts) if k != "busy")
    assert rows(quotes.busy(evidence, ["k"], total // 2 + 1)) == [("busy", 2)]
    sizes = [r["count"] for r in quotes.dealt(evidence, parts, ["k"]).where("__k = 'busy'").groupBy("__of").count().collect()]
    assert len(sizes) == 21 and sum(sizes) == 300 and max(sizes) < 3 * 300 / 21


@pytest.mark.parametrize("part_bytes", [1 << 24, 500])
def test_stream_of_quotes_against_a_busy_question(spark, tmp_path, part_bytes):
    evidence, _ = busy_evidence(spark, 60)
    for n, quoted in enumerate(([(1, "busy", "filler filler"), (1, "busy", "filler filler"), (2, "busy", "nowhere")], [(3, "q2", "number 2 filler"), (4, "busy", "number 2 filler"), (5, None, "filler")])):
        spark.createDataFrame(quoted, "id int, k string, quote string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id int, k string, quote string").parquet(f"{tmp_path}/in")
        checks.find_quotes(stream, evidence, ["k"], f"{tmp_path}/out", f"{tmp_path}/state", part_bytes).awaitTermination()
        found = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert found == ([1, 1], [1, 1, 3])[n]  # in however many parts a row is found, it comes once


def test_quote_index_is_extended_and_reads_no_corpus(spark, tmp_path):
    texts = [(1, "The quick brown fox — jumps over"), (2, "a lazy dog's bark"), (3, None), (4, ""), (5, "quickly brown")]
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    path = f"{tmp_path}/index"
    asked = [(1, "quick brown fox"), (2, "QUICK  brown"), (3, "ck brow"), (4, "fox ... over"), (5, "azy"), (6, "dog’s"), (7, "x"), (8, "absent word here"), (9, "…"), (10, "own"), (11, "fox - jumps ov")]
    quoted = quotes.with_segments(spark.createDataFrame(asked, "item_id long, quote string"))
    assert quote_index.matches(quoted, path, "item_id").count() == 0  # nothing is indexed yet
    assert quote_index.extend(corpus.where("doc_id < 3"), path) == 2 and quote_index.extend(corpus, path) == 1 and quote_index.extend(corpus, path) == 0
    found = quote_index.matches(quoted, path, "item_id")
    want = sorted((i, d) for i, d in [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 1), (10, 1), (10, 5), (11, 1)])
    assert sorted(rows(found)) == want == sorted(rows(quotes.corpus_matches(quoted, quotes.prepare(corpus), "item_id", "doc_id")))


def test_an_extension_that_failed_is_run_again(spark, tmp_path):
    import shutil

    corpus = spark.createDataFrame([(1, "one two three"), (2, "two three four")], "doc_id long, text string")
    path = f"{tmp_path}/index"
    quote_index.extend(corpus, path)
    shutil.rmtree(f"{path}/texts")  # as if it had ended before its last table
    assert quote_index.extend(corpus, path) == 2
    quoted = quotes.with_segments(spark.createDataFrame([(1, "two three"), (2, "one two three")], "item_id long, quote string"))
    assert sorted(rows(quote_index.matches(quoted, path, "item_id"))) == [(1, 1), (1, 2), (2, 1)]


def test_compaction_leaves_the_cache_unchanged(spark, tmp_path):
    """Batches read only the parts of their questions; a compaction changes no record, and none is added again after it."""
    out, told = f"{tmp_path}/out", {}
    add = lambda rows, n, writer="w": streams.appender(out, files.RECORDS, writer, told.__setitem__, part_rows=20)(streams.records(calls(spark, *rows)), n)
    content = lambda: sorted(map(str, streams.read_cache(spark, out, files.RECORDS).collect()))
    assert streams.compact(spark, out, files.RECORDS) == 0 and content() == []
    batches = [[("r", f"q{k}", 1, f"c{i}") for k in range(n, n + 30) for i in range(2)] for n in (0, 10, 20)] + [[("r", "q0", 2, f"d{i}") for i in range(50)] + [(None, None, 1, "n"), ("", "", 1, "e")]]
    for n, rows in enumerate(batches):
        add(rows, n)
    before = content()
    assert len(before) == 30 * 2 + 10 * 2 + 10 * 2 + 52 and [told[n]["added"] for n in range(4)] == [60, 20, 20, 52]
    small = len(list((tmp_path / "out" / "batches").rglob("*.parquet")))
    assert streams.compact(spark, out, files.RECORDS, part_rows=20) == small
    assert content() == before and not list((tmp_path / "out" / "batches").rglob("*.parquet"))
    assert streams.compact(spark, out, files.RECORDS, part_rows=20) == 0 and content() == before
    folders = {p.parent.name for p in (tmp_path / "out" / "compacted" / "records").rglob("*.parquet")}
    assert folders == {f"part={k}" for k in range(8)}  # 152 records, 20 a part

    compacted, _ = streams._tables(spark, out, files.RECORDS)
    one = streams.records(calls(spark, ("r", "q7", 1, "c0")))
    read = {r.file.split("/")[-2] for r in streams.of_questions(compacted, one).select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    assert len(read) == 1 and streams.of_questions(compacted, one).where("qid = 'q7'").count() == 2

    add(batches[3], 3)  # a batch that runs again after it was folded in
    add([("r", "q7", 1, "c0"), ("r", "q7", 3, "new"), (None, None, 1, "n")], 0, "other")
    assert told[3]["added"] == 0 and told[0] == {"offered": 3, "added": 1}
    assert len(content()) == len(before) + 1
    assert streams.compact(spark, out, files.RECORDS, part_rows=1000) == 1 and len(content()) == len(before) + 1
    assert [p.name for p in (tmp_path / "out" / "compacted" / "records").iterdir()] == ["generation=2"]


def test_an_interrupted_compaction_is_taken_up_again(spark, tmp_path, monkeypatch):
    out = f"{tmp_path}/out"
    for n in range(3):
        streams.appender(out, files.RECORDS, "w")(streams.records(calls(spark, ("r", "q", n, f"c{n}"))), n)
    content = lambda: sorted(map(str, streams.read_cache(spark, out, files.RECORDS).collect()))
    before = content()
    spark.range(1).write.parquet(f"{out}/compacted/records/generation=1")  # records were being written when it stopped
    assert content() == before
    with monkeypatch.context() as stopped:
        stopped.setattr(streams, "_remove", lambda *_: None)  # committed, but nothing removed
        assert streams.compact(spark, out, files.RECORDS) == 3
    assert content() == before and len(list((tmp_path / "out" / "batches").rglob("*.parquet"))) == 3
    assert streams.compact(spark, out, files.RECORDS) == 0
    assert content() == before and not list((tmp_path / "out" / "batches").rglob("*.parquet"))
