"""Operators on small frames."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.text import MISSING, OBO
from tessella.operators import annotate, edges, markers, quotes, reports, sheets, snippets
from tessella.sources import files
from tessella.streaming import checks
from tessella.streaming import snippets as streams

HAS_PART, MEMBRANE, EXPRESSES = f"{OBO}BFO_0000051", f"{OBO}RO_0002104", f"{OBO}RO_0002292"
EDGE = "cell string, relation string, pr string"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---------------------------------------------------------------- edges


def reduce(spark, inferred, asserted, parents=(), cells=(), relations=(), excluded=edges.EXCLUDED):
    found = edges.reduce_edges(
        spark.createDataFrame(inferred, EDGE),
        spark.createDataFrame(asserted, EDGE),
        edges.closure(spark.createDataFrame(list(parents), "sub string, super string")),
        spark.createDataFrame(list(cells), "cell string, cell_label string"),
        spark.createDataFrame(list(relations), "relation string, relation_label string"),
        edges.excluded_targets(spark, excluded),
    )
    return {(r.cell, r.relation, r.pr): r for r in found.collect()}


def test_flags_and_keeps(spark):
    inferred = [("c1", MEMBRANE, "p1"), ("c2", MEMBRANE, "p1"), ("c2", MEMBRANE, "p2"), ("c2", MEMBRANE, "p1"), ("c1", "other", "p1"), ("c3", EXPRESSES, edges.EXCLUDED[0]), ("c3", MEMBRANE, "p3")]
    asserted = [("c1", MEMBRANE, "p1"), ("c3", EXPRESSES, edges.EXCLUDED[0]), ("c9", "any relation", "p3")]
    found = reduce(spark, inferred, asserted)
    assert {k: r.asserted for k, r in found.items()} == {("c1", MEMBRANE, "p1"): True, ("c2", MEMBRANE, "p1"): False, ("c3", MEMBRANE, "p3"): False}


def test_prunes_to_the_most_specific(spark):
    inferred = [("c1", MEMBRANE, "p1"), ("c1", HAS_PART, "p1"), ("c2", HAS_PART, "p1"), ("c1", EXPRESSES, "p1")]
    found = reduce(spark, inferred, inferred, [(MEMBRANE, "unlisted"), ("unlisted", HAS_PART)])
    assert set(found) == {("c1", MEMBRANE, "p1"), ("c2", HAS_PART, "p1"), ("c1", EXPRESSES, "p1")}
    again = edges.most_specific(spark.createDataFrame(list(found), EDGE), spark.createDataFrame([(MEMBRANE, HAS_PART)], "sub string, super string"))
    assert set(map(tuple, again.collect())) == set(found)


def test_labels(spark):
    found = reduce(spark, [("c1", MEMBRANE, "p"), ("c2", HAS_PART, "p")], [("c1", MEMBRANE, "p")], cells=[("c1", "b"), ("c1", "a"), ("c1", "")], relations=[(MEMBRANE, "has_part"), (MEMBRANE, "has part")])
    assert [(r.cell_label, r.relation_label, r.sense) for _, r in sorted(found.items())] == [("a", "has part", "positive"), ("", "BFO:0000051", "positive")]


def test_closure_ends_on_cycles(spark):
    pairs = edges.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "a")], "sub string, super string"))
    assert rows(pairs, "sub", "super") == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]
    assert rows(edges.ancestor_sets(pairs), "sub")[0] == ("a", ["b", "c"])
    assert edges.closure(spark.createDataFrame([], "sub string, super string")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "sub int, super int")
    assert edges.closure(chain).count() == 20 * 21 // 2
    with pytest.raises(ValueError, match="2 rounds"):
        edges.closure(chain, max_rounds=2)


# ---------------------------------------------------------------- annotation and reports


def statements(spark, *found):
    return spark.createDataFrame(list(found), "pr string, attribute string, value string")


def test_metadata_and_tokens(spark):
    meta = annotate.metadata(
        statements(spark, ("p1", "label", "T-cell surface CD4"), ("p1", "exact", "CD4"), ("p1", "related", "CD99 x"), ("p1", "narrow", "CDw4 and CD99"), ("p1", "xref", "UniProtKB:P01"), ("p1", "xref", "X:1"),
                   ("p1", "taxon", f"{OBO}NCBITaxon_9606"), ("p1", "taxon", f"{OBO}NCBITaxon_1"), ("p2", "exact", "no label"), ("p3", "label", "b"), ("p3", "label", "a"))
    )
    assert [(r.pr, r.label, r.taxa, r.exact, r.xrefs, r.uniprot) for r in meta.orderBy("pr").collect()] == [("p1", "T-cell surface CD4", ["human"], ["CD4"], ["UniProtKB:P01", "X:1"], ["UniProtKB:P01"]), ("p3", "a", [], [], [], [])]
    tokens = annotate.cd_names(annotate.names(meta))
    assert rows(tokens, "token") == [("p1", "CD4", "label"), ("p1", "CD99", "related"), ("p1", "CDw4", "narrow")]


def test_species(spark):
    ids = annotate.species_ids(
        spark.createDataFrame([("p1",)], "pr string"), spark.createDataFrame([("s1", "p1"), ("s2", "p1"), ("s3", "p2")], "sub string, super string"),
        spark.createDataFrame([("s1", "tm"), ("s2", "th"), ("s3", "th")], "sub string, taxon string"), spark.createDataFrame([("s1", "UniProtKB:M"), ("s1", "UniProtKB:M"), ("s2", "X:1"), ("s2", "UniProtKB:H")], "sub string, xref string"),
        spark.createDataFrame([("tm", "mouse"), ("th", "human")], "taxon string, species string"),
    )
    assert rows(ids, "species") == [("p1", "human", "UniProtKB:H"), ("p1", "mouse", "UniProtKB:M")]
    meta = annotate.metadata(statements(spark, ("p1", "label", "x"), ("p1", "xref", "UniProtKB:H"), ("p1", "xref", "UniProtKB:A"), ("p1", "taxon", f"{OBO}NCBITaxon_9606"), ("p4", "label", "y"), ("p4", "xref", "UniProtKB:Q")))
    assert rows(annotate.merge_species(meta, annotate.species_table(ids)), "pr") == [("p1", ["UniProtKB:H", "UniProtKB:A"], ["UniProtKB:M"]), ("p4", [], [])]


def test_report_of_two_edges(spark, tmp_path):
    found = spark.createDataFrame([("c\t1", "cell one", MEMBRANE, "has", "positive", True, f"{OBO}PR_1"), ("c\t1", "cell one", f"{OBO}CL_4030046", "lacks", "negative", False, f"{OBO}PR_2")], "cell string, cell_label string, relation string, relation_label string, sense string, asserted boolean, pr string")
    meta = annotate.metadata(statements(spark, (f"{OBO}PR_1", "label", "CD4 molecule"), (f"{OBO}PR_1", "xref", "X:1")))
    species = spark.createDataFrame([(f"{OBO}PR_1", ["UniProtKB:H"], [])], "pr string, human array<string>, mouse array<string>")
    wide = reports.annotated(found, meta, annotate.cd_lists(annotate.cd_names(annotate.names(meta))), species)
    assert rows(reports.sorted_edges(wide)) == [
        ("c 1", "cell one", "CL:4030046", "lacks", "negative", "False", "PR:2", "", "", "", "", ""),
        ("c 1", "cell one", "RO:0002104", "has", "positive", "True", "PR:1", "CD4 molecule", "CD4 (label)", "UniProtKB:H", "", "X:1"),
    ]
    lines = reports.marker_lines(wide)
    assert [r.line for r in lines.orderBy("position").collect()] == ["- `PR:1` CD4 molecule — CD: CD4 (label) — UniProt(human): UniProtKB:H", "- `PR:2` PR:2 — _(inferred only)_"]
    section = reports.cell_sections(lines).first().section
    assert section.startswith("## c\t1 — cell one\n\n**Positive (marker present)**\n\n- `PR:1`") and section.endswith("**Negative (marker absent)**\n\n- `PR:2` PR:2 — _(inferred only)_\n")
    files.write_edge_reports(wide, str(tmp_path), "today")
    assert "".join(p.read_text() for p in sorted((tmp_path / "edges_tsv").glob("part-*"))).count("\n") >= 3
    report = "".join(p.read_text() for p in sorted((tmp_path / "edges_md").glob("part-*")))
    head, legend = report.removesuffix(section + "\n"), reports.LEGEND
    assert head == f"{reports.EDGE_TITLE}\n\n_Generated today._\n\n- Cell types: **1**\n- CL→PR edges (inferred): **2** (of which directly asserted: **1**)\n\n{legend}\n\n"


def test_typed_edges(spark):
    found = edges.typed(spark.createDataFrame([("c1", MEMBRANE, "p1"), ("c1", MEMBRANE, "p2"), ("c2", MEMBRANE, "p1")], EDGE), spark.createDataFrame([("c1",), ("c1",)], "cell string"), spark.createDataFrame([("p1",)], "pr string"))
    assert rows(found.select("cell", "relation", "pr")) == [("c1", MEMBRANE, "p1")]


# ---------------------------------------------------------------- sheets and markers


@pytest.fixture
def sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('Subset name,Required exclusion,Required phenotypic markers,Note\nA,,CD45+ CD3+,x\n B ,N/A,"CD4+ ""x""",y\n,CD3+|CD4+,(CD8+ ,\n', encoding="utf-8")
    return files.read_sheet(spark, str(path))


def test_sheet_scan(spark, sheet):
    validated = markers.validate(markers.cells(sheet))
    assert rows(validated.select("row", "subset", "column", "value", "error"), "row", "col_ord") == [
        (2, "A", "Required phenotypic markers", "CD45+ CD3+", None),
        (3, "B", "Required phenotypic markers", 'CD4+ "x"', "invalid marker token '\"x\"'"),
        (4, "nan", "Required exclusion", "CD3+|CD4+", "top-level '|' must be inside a group"),
        (4, "nan", "Required phenotypic markers", "(CD8+ ", "expected marker or group, found None"),
    ]
    assert rows(markers.totals(validated)) == [(4, 3)]
    line = rows(reports.failure_lines(markers.failures(validated)), "row", "col_ord")[1][2]
    assert line == "| 4 | nan | Required exclusion | top-level '\\|' must be inside a group | `CD3+\\|CD4+` |"
    report = reports.validation_report(markers.failures(validated), markers.totals(validated), "s.csv", "there")
    found = [r.line for r in report.orderBy("part", "row", "col_ord").collect()]
    assert found[0] == "# Marker Syntax Validation" and found[4:9] == ["- Source: `s.csv`", "- Cells checked: **4**", "- Invalid cells: **3**", "- Grammar: there", ""]
    assert found[9:13] == ["## Invalid cells", "", *reports.TABLE_HEAD] and found[13].startswith("| 3 | B | ") and found[14] == line and len(found) == 18
    none = validated.where("error is null")
    good = reports.validation_report(markers.failures(none), markers.totals(none), "s.csv", "there").orderBy("part", "row").collect()
    assert good[-1].line == "✅ All marker cells conform to the grammar." and len(good) == 10


def test_validation_report_file(spark, sheet, tmp_path):
    validated = markers.validate(markers.cells(sheet))
    files.write_validation_report(markers.failures(validated), markers.totals(validated), "s.csv", f"{tmp_path}/report")
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.startswith("# Marker Syntax Validation\n\n> ") and text.count("\n| ") == 4 and text.endswith(f"` |\n\n{reports.REMARK}\n")


def test_sheets_are_numbered_one_by_one(spark, tmp_path):
    rows_ = spark.createDataFrame([(b, i, f"{b}\n{i}", " x ") for b in (1, 2, 3) for i in range(5)], "book int, row int, `Subset name` string, note string")
    files.write_sheets(rows_.repartition(4), f"{tmp_path}/books", "book")
    back = files.read_sheet(spark, f"{tmp_path}/books").select("book", "row", "Subset name", "note")
    assert rows(back, "book", "row") == [(b, i + 2, f"{b}\n{i}", " x ") for b in (1, 2, 3) for i in range(5)]


def test_sheet_without_marker_columns(spark):
    assert markers.cells(spark.createDataFrame([(2, "x")], "row long, other string")).count() == 0
    assert rows(markers.cells(spark.createDataFrame([(2, "A+")] + [(3, m) for m in MISSING], "row long, `Ideal exclusion` string")).select("subset", "value")) == [("", "A+")]


def cells(spark, *found):
    return spark.createDataFrame([(i, "s", "c", v) for i, v in enumerate(found)], "row int, subset string, column string, value string")


def test_inventory_and_lint(spark):
    checked = cells(spark, "live/ CD4+ [cd8 CD4hi]-", "CD4+ 9- ", "(A+ B-)C [A+] (A+ B-)-", "CD123hi-", "one two three four+", "(X")
    found = markers.inventory(checked)
    assert [r.marker + r.qualifier for r in found.where("row = 0").orderBy("pos").collect()] == ["CD4+", "cd8", "CD4hi"]
    lints = {r.lint: r.n for r in markers.lint_summary(checked, spark.createDataFrame([("A", "X")], "alias string, canonical string")).collect()}
    assert lints == {"unbalanced": 1, "free_text": 1, "space_in_name": 1, "no_delimiter": 1, "stray_space": 1, "stacked": 1, "bare": 6, "several_names": 1, "negated_and_not": 1}
    assert rows(markers.most_common(found, 2)) == [("A", 3), ("CD4", 3)]
    assert rows(markers.usage(found).where("marker = 'A'")) == [("A", 3, ["c"], 1)] and rows(markers.usage_by_subset(found).where("marker = 'A'")) == [("A", "s", 3)]
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan  # a token's neighbours are in its own array


def test_tabs(spark, tmp_path):
    tab = spark.createDataFrame([("a", None, None), (None, None, None), ("b", "x", None)], "k string, v string, empty string")
    assert sheets.clean_tab(tab, True).columns == ["k", "v", "empty"] and sheets.clean_tab(tab, True).count() == 2
    assert sheets.clean_tab(tab, False).columns == ["k", "v"]
    assert files.write_tabs({"My Tab (1)": (tab, True), "none": (tab.where("false"), True)}, str(tmp_path)) == ["my_tab_1"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/my_tab_1").count() == 2
    assert [r.row for r in sheets.numbered(tab.repartition(3)).orderBy("row").collect()] == [2, 3, 4]


# ---------------------------------------------------------------- quotes


def plain_match(quote, text):
    import re

    def norm(t):
        t = re.sub("[–—―]", "-", t.lower())
        return re.sub(r"\s+", " ", re.sub("[‘’“”]", "'", t)).strip()

    at = 0
    for part in filter(None, (norm(p) for p in re.split(r"\.{3}|…|\.\s\.\s\.", quote))):
        found = norm(text).find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    return True


TEXTS = ["The Cells – express “CD4” and\nCD8 on 50% of_all \\ cells. . . . again", "naive cells express ccr7 and cd62l and ccr7", "x"]
QUOTES = ["cells - EXPRESS", "cells ... cd8 on 50% of", "cd8 … cells - express", "naive ... and ... ccr7", "ccr7 ... ccr7 ... ccr7", "...", "50_ of", "of_all \\ cells", "cells express ... x", "elf", "nai", "on 5"]


def test_quote_matching_is_the_plain_loop(spark):
    quoted = quotes.with_segments(spark.createDataFrame([(i, q) for i, q in enumerate(QUOTES)], "q int, quote string"))
    evidence = quotes.prepare(spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", None])], "t int, text string"))
    want = sorted((q, t) for q, quote in enumerate(QUOTES) for t, text in enumerate(TEXTS) if quote != "..." and plain_match(quote, text))
    assert sorted(rows(quotes.corpus_matches(quoted, evidence, "q", "t"))) == want
    lost = quotes.missing(quoted.withColumn("k", F.lit(1)), evidence.withColumn("k", F.lit(1)), ["k"])
    assert {r.q for r in lost.collect()} == set(range(len(QUOTES))) - {q for q, _ in want} - {5}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.text("ab c.…%_", min_size=1, max_size=9), st.text("ab c.%_", max_size=14)), min_size=1, max_size=12))
def test_like_is_the_plain_loop(spark, pairs):
    df = quotes.with_segments(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, quote string, text string")).withColumn("nt", F.col("text"))
    from tessella.functions.text import for_match

    got = [r.ok for r in df.withColumn("nt", for_match("text")).select("i", F.coalesce(F.when(F.size("segments") == 0, True).otherwise(quotes.fits()), F.lit(False)).alias("ok")).orderBy("i").collect()]
    assert got == [plain_match(q, t) for q, t in pairs]


def test_matching_of_many_short_quotes_has_no_nested_loop(spark):
    quoted = quotes.with_segments(spark.createDataFrame([(0, "ive"), (1, "e"), (2, "na ... ls"), (3, "no such")], "q int, quote string"))
    evidence = quotes.prepare(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "t int, text string"))
    found = quotes.corpus_matches(quoted, evidence, "q", "t")
    assert sorted(rows(found)) == [(0, 1), (1, 0), (1, 1), (2, 1)]
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_verdicts(spark):
    reports_ = spark.createDataFrame(
        [("a", "r", "q", '> "cells - express"'), ("b", "r", "q", 'x > "never said" > "never said"'), ("c", "r", "q", "no quotes"), ("d", "r", "none", "no quotes"), ("e", "r", "q", None)], "report_id string, run_id string, qid string, md string"
    )
    evidence = spark.createDataFrame([("r", "q", TEXTS[0]), ("r", "none", "")], "run_id string, qid string, text string")
    assert rows(quotes.verdicts(reports_, evidence), "report_id") == [
        ("a", True, 0, []), ("b", False, 2, ['Quote not found in evidence: "never said..."'] * 2), ("c", True, 0, []), ("d", False, 1, ["No evidence for run 'r' and question 'none'."]), ("e", True, 0, []),
    ]


# ---------------------------------------------------------------- snippets

ITEM = '{"score":1,"paper":{"corpusId":"p1","title":"T","authors":["A","B"],"openAccessInfo":{"status":"GREEN"}},"snippet":{"text":"t","snippetKind":"body","section":"S","snippetOffset":{"start":1,"end":9},"annotations":{"refMentions":[{"start":1,"end":2,"matchedPaperCorpusId":77},"x",{"start":3}],"sentences":[{"start":0,"end":5},null]}}}'
CALL = "run_id string, qid string, round int, query string, source_seed string, followed string, batch long, response string"


def call(response, qid="q", round_=1, batch=0, followed="p1=c2,c3"):
    return ("r", qid, round_, "query", None, followed, batch, response)


def test_flatten(spark):
    found = streams.records(spark.createDataFrame([call('{"result":{"data":[%s,{},3,null]}}' % ITEM), call('{"data":"no list"}'), call('{"result":{},"data":[{}]}'), call("[1]"), call("not json"), call(None)], CALL)).orderBy("pos").collect()
    assert len(found) == 2
    full, bare = found
    assert (full.corpus_id, full.title, full.authors, full.open_access, full.section, full.snippet_kind, tuple(full.snippet_offset), full.text) == ("p1", "T", ["A", "B"], True, "S", "body", (1, 9), "t")
    assert [tuple(m) for m in full.ref_mentions] == [(1, 2, "77"), (3, None, None)] and [tuple(s) for s in full.sentences] == [(0, 5)] and full.followed_corpus_ids == ["c2", "c3"]
    assert (bare.corpus_id, bare.title, bare.authors, bare.open_access, tuple(bare.snippet_offset), bare.text, bare.ref_mentions, bare.sentences, bare.followed_corpus_ids) == ("", "", [], None, (None, None), "", [], [], [])


@pytest.mark.parametrize(("paper", "corpus_id", "access"), [('{"corpusId":0}', "", None), ('{"corpusId":"0","openAccessInfo":{"status":"CLOSED"}}', "0", False), ('{"corpusId":12,"openAccessInfo":{"status":null}}', "12", False), ('{"corpusId":"","openAccessInfo":"GOLD"}', "", None)])
def test_ids_and_access(spark, paper, corpus_id, access):
    record = streams.records(spark.createDataFrame([call('{"data":[{"paper":%s}]}' % paper)], CALL)).first()
    assert (record.corpus_id, record.open_access) == (corpus_id, access)


def test_append_is_idempotent(spark):
    calls = [call('{"data":[%s,%s]}' % (ITEM, ITEM)), call('{"data":[%s]}' % ITEM.replace('"T"', '"later"'), round_=2, batch=1), call('{"data":[%s,{}]}' % ITEM, qid="other", batch=2), call('{"data":[{}]}', qid="other", round_=2, batch=3)]
    records = streams.records(spark.createDataFrame(calls, CALL))
    empty = spark.createDataFrame([], files.RECORDS)
    once = snippets.append(empty, records, streams.ORDER)
    assert sorted((r.qid, r.title) for r in once.collect()) == [("other", ""), ("other", "T"), ("q", "T")]
    assert snippets.append(once, records, streams.ORDER).count() == 3
    assert rows(snippets.running_total(snippets.growth(records, empty, streams.ORDER)), "qid", "round") == [("r", "other", 1, 2, 2, 2), ("r", "other", 2, 1, 0, 2), ("r", "q", 1, 2, 1, 1), ("r", "q", 2, 1, 0, 1)]


def test_files(spark, tmp_path):
    records = streams.records(spark.createDataFrame([call('{"data":[%s]}' % ITEM)], CALL)).select(*snippets.RECORD)
    files.append_records(records, f"{tmp_path}/cache")
    files.append_records(records.withColumn("qid", F.lit("z")), f"{tmp_path}/cache")
    assert files.read_records(spark, f"{tmp_path}/cache").count() == 2 and files.read_records(spark, f"{tmp_path}/cache", "r", "q").first().text == "t"
    assert files.read_records(spark, f"{tmp_path}/missing").count() == 0 and files.read_manifest(spark, f"{tmp_path}/missing").count() == 0
    (tmp_path / "cache/run_id=r/qid=q/bad.json").write_text("\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_records(spark, f"{tmp_path}/cache").collect()
    files.write_manifest(spark.createDataFrame([("q2", "B?", []), ("q1", "A?", ["s"])], "qid string, text string, seeds array<string>"), "run", "now", f"{tmp_path}/manifest")
    assert rows(snippets.manifest_questions(files.read_manifest(spark, f"{tmp_path}/manifest")), "qid") == [("run", "now", "q1", "A?", ["s"]), ("run", "now", "q2", "B?", [])]
    (tmp_path / "report.md").write_text('line\n> "q"\n')
    assert files.read_reports(spark, f"{tmp_path}/report.md").first().md == 'line\n> "q"\n'


def test_quads_and_bindings(spark, tmp_path):
    quads = spark.createDataFrame([("redundant", "a", "p", "b"), ("ontology", "c", "p", "d")], files.QUADS)
    files.write_quads(quads, f"{tmp_path}/quads")
    graph = files.read_graph(spark, f"{tmp_path}/quads", "redundant")
    assert rows(graph) == [("a", "p", "b")] and "PartitionFilters: [isnotnull(graph" in graph._jdf.queryExecution().toString()
    (tmp_path / "r.json").write_text('{"head":{},"results":{"bindings":[{"x":{"type":"uri","value":"1"},"y":{"type":"literal","value":"2"}},{"x":{"type":"uri","value":"3"}}]}}')
    assert rows(files.read_bindings(spark, f"{tmp_path}/r.json", ["x", "y"]), "x") == [("1", "2"), ("3", None)]


def test_intermediate_tables(spark, tmp_path):
    from types import SimpleNamespace

    from tessella import tables

    kept = tables.cut(spark.range(3), "kept")
    assert kept.count() == 3 and tables.discard(spark) >= 1 and tables.discard(spark) == 0
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.scratch(unset)
    assert tables.scratch(SimpleNamespace(conf=unset.conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:")


def test_sinks(spark, tmp_path):
    files.write_tsv(spark.createDataFrame([("a b", "")], "x string, y string").coalesce(1), f"{tmp_path}/tsv")
    text = "".join(p.read_text() for p in (tmp_path / "tsv").glob("part-*"))
    assert text == "x\ty\na b\t\n"
    files.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string"), f"{tmp_path}/lines", "line", ["n"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/lines").collect()] == ["a", "b"]


# ---------------------------------------------------------------- streams


def stream_of(spark, path, *batches):
    spark.createDataFrame(list(batches), CALL).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(CALL).parquet(path)


def test_stream_append_is_exact(spark, tmp_path):
    path = f"{tmp_path}/in"
    for n, batches in enumerate([[call('{"data":[%s]}' % ITEM)], [call('{"data":[%s,{}]}' % ITEM, round_=2, batch=1)]]):
        streams.append_stream(streams.records(stream_of(spark, path, *batches)), f"{tmp_path}/out", f"{tmp_path}/state", files.RECORDS).awaitTermination()
        assert streams.read_cache(spark, f"{tmp_path}/out", files.RECORDS).count() == n + 1
    again = streams.records(spark.read.schema(CALL).parquet(path))
    own = streams.stream_id(spark, f"{tmp_path}/state")
    streams.appender(f"{tmp_path}/out", files.RECORDS, own)(again, 1)  # a batch that runs again
    assert streams.read_cache(spark, f"{tmp_path}/out", files.RECORDS).count() == 2


def test_streams_with_other_checkpoints_add_to_the_cache(spark, tmp_path):
    """Batch numbers start again with a new checkpoint; what an earlier stream wrote stays, and its records come first."""
    calls = [call('{"data":[%s]}' % ITEM), call('{"data":[%s,%s]}' % (ITEM.replace('"T"', '"later"'), ITEM.replace('"p1"', '"p2"')), round_=2, batch=1), call('{"data":[{}]}', qid="other", round_=3, batch=2)]
    for n, one in enumerate(calls):
        streams.append_stream(streams.records(stream_of(spark, f"{tmp_path}/in{n}", one)), f"{tmp_path}/out", f"{tmp_path}/state{n}", files.RECORDS).awaitTermination()
    found = streams.read_cache(spark, f"{tmp_path}/out", files.RECORDS)
    assert sorted((r.qid, r.corpus_id, r.title, r.round) for r in found.collect()) == [("other", "", "", 3), ("q", "p1", "T", 1), ("q", "p2", "T", 2)]


def test_reading_a_cache_writes_nothing(spark, tmp_path):
    assert streams.read_cache(spark, f"{tmp_path}/none", files.RECORDS).count() == 0
    assert not (tmp_path / "none").exists()


def test_stream_deduplication(spark, tmp_path):
    found = streams.records(stream_of(spark, f"{tmp_path}/in", call('{"data":[%s,%s]}' % (ITEM, ITEM)), call('{"data":[%s]}' % ITEM, qid="b")))
    for name, deduplicated in (("all", streams.deduplicated(found)), ("within", streams.deduplicated_within(found.withColumn("at", F.current_timestamp()), "at", "1 hour"))):
        deduplicated.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == 2


def test_stream_checks(spark, tmp_path):
    spark.createDataFrame([("k", "A+|B", '> "x"')], "k string, value string, quote string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, value string, quote string").parquet(f"{tmp_path}/in")
    checks.invalid_cells(stream).writeStream.format("memory").queryName("cells").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("cells").first().error == "top-level '|' must be inside a group"
    evidence = quotes.prepare(spark.createDataFrame([("k", '> "x" y')], "k string, text string"))
    checks.found_quotes(stream, evidence, ["k"]).writeStream.format("memory").queryName("quotes").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("quotes").count() == 1
