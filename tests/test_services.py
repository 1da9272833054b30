"""Provider answers, guards, follow-up state, archives, reviews and workbooks on small fixtures."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verispan.operators import followup, reviews
from verispan.sources import providers, workbook


def test_json_mappings(spark):
    pages = {
        "crossref": {"title": ["A"], "DOI": "10.1/X", "published-online": {"date-parts": [[2022, 1]]}, "issued": {"date-parts": [[2023]]}, "author": [{"given": "Anna", "family": "Li"}], "container-title": ["J"], "abstract": "<p>b</p>"},
        "openalex": {"display_name": "A", "ids": {"doi": "https://doi.org/10.1/x", "pmid": "https://p/7"}, "id": "https://o/W1", "publication_year": 2023, "abstract_inverted_index": {"cells": [1], "Two": [0, 2]}, "authorships": [{"author": {"display_name": "Anna Li"}}]},
        "europepmc": {"title": "A", "doi": "10.1/x", "pubYear": "2023", "source": "MED", "id": "7", "authorList": {"author": [{"lastName": "Li", "firstName": "Anna"}]}},
        "s2": {"title": "A", "externalIds": {"DOI": "10.1/x"}, "paperId": "p", "year": 2023, "authors": [{"name": "Anna Li"}]},
        "datacite": {"data": {"attributes": {"titles": [{"title": "A"}], "doi": "10.1/x", "publicationYear": 2023, "creators": [{"familyName": "Li", "givenName": "Anna"}]}}},
    }
    for name, page in pages.items():
        df = spark.createDataFrame([(json.dumps(page),), ("{}",), (None,)], "record string")
        r, *empty = providers.map_records(df, name).collect()
        assert (r.title, r.year, r.identifiers["doi"], len(r.authors)) == ("A", 2023, "10.1/x", 1) and all(e.title is None for e in empty)
        if name == "openalex":
            assert r.abstract == "Two cells Two" and r.identifiers["openalex"] == "W1"


def test_xml_pages(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1.2v3</id><title>A\n b</title><published>2020-01-01</published><author><name>Anna Li</name></author></entry></feed>'
    rows = {r.k: r for r in providers.xml_records(spark.createDataFrame([(1, atom), (2, "<broken")], "k int, x string"), "k", "x", "atom").collect()}
    assert (rows[1].title, rows[1].identifiers, rows[1].year) == ("A b", {"arxiv": "1.2v3"}, 2020) and "ParseError" in rows[2].error
    pm = "<s><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A <i>b</i></ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2019 Dec</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><CollectiveName>Acme</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/X</ArticleId></ArticleIdList></PubmedData></PubmedArticle></s>"
    (r,) = providers.xml_records(spark.createDataFrame([(1, pm)], "k int, x string"), "k", "x", "pubmed").collect()
    assert (r.title, r.year, r.identifiers, r.authors) == ("A b", 2019, {"pmid": "7", "doi": "10.1/x"}, ["Acme"])


def test_guards_and_lookups(spark):
    providers.read_only("graphql", "query { a }")
    providers.read_only("sparql", "SELECT * WHERE { ?a <http://x/service> ?b }")
    for kind, text in (("graphql", "mutation { a }"), ("sparql", "INSERT DATA { }"), ("sparql", "SELECT * { SERVICE <x> { } }"), ("path", "https://x"), ("path", "a/../b")):
        with pytest.raises(ValueError):
            providers.read_only(kind, text)
    one = lambda acc, name, tax: {"primaryAccession": acc, "organism": {"taxonId": tax}, "genes": [{"geneName": {"value": name}}]}
    rows = [(1, json.dumps({"results": [one("P1", "G", 9606), one("P2", "H", 9606), one("P3", "G", 1)]})), (2, json.dumps({"results": [one("P1", "G", 9606), one("P2", "G", 9606)]})), (3, json.dumps({"results": []})), (4, None)]
    df = spark.createDataFrame(rows, "k int, body string").withColumns({"s": F.lit("G"), "t": F.lit(9606)})
    got = {r.k: (r.status, r.accession) for r in providers.resolve_accession(df, "k", "body", "s", "t").collect()}
    assert got == {1: ("resolved", "P1"), 2: ("ambiguous", None), 3: ("not_resolved", None), 4: ("lookup_failed", None)}
    frame = lambda rs: spark.createDataFrame(rs, "doi string, title string")
    out = providers.first_lookup(spark.createDataFrame([("a",), ("b",), ("c",)], "doi string"), [("crossref", frame([("a", "A")])), ("datacite", frame([("a", "X"), ("b", "B")]))])
    assert {(r.doi, r.service, r.title) for r in out.collect()} == {("a", "crossref", "A"), ("b", "datacite", "B"), ("c", "not_found", None)}


def test_signals(spark):
    c = spark.createDataFrame([("f1", 0.01, "statistical_signal"), ("f1", 0.001, "statistical_signal"), ("f2", 0.0001, "quality_limited_signal")], "feature string, q_value double, signal_class string")
    t = spark.createDataFrame([("f3", 0.0005)], "feature string, q_value double")
    r = spark.createDataFrame([("a", "b", 8, -0.7, 0.02), ("a", "c", 7, 0.9, 0.001)], "feature_a string, feature_b string, n int, rho double, q_value double")
    pick = lambda **kw: [(x.kind, x.feature) for x in followup.choose_signals(c, t, r, **kw).collect()]
    assert pick() == [("time_trend", "f3"), ("differential", "f1"), ("correlation", "a | b")] and pick(warnings=1) == [("differential", "f1")] and pick(most=1) == [("time_trend", "f3")]
    names = spark.createDataFrame([("GPX4",), ("bad name",)], "f string").select(followup.feature_term(F.col("f"), "gene_symbol").alias("t")).collect()
    assert [n.t for n in names] == ["GPX4", None]


def test_budget_and_resume(spark, tmp_path):
    calls = []

    def perform(kind, payload):
        calls.append(payload["q"])
        if payload["q"] == "bad":
            raise OSError("no answer")
        return {"n": 1}

    state = "file://" + str(tmp_path / "state")
    wanted = [("search", {"q": q}) for q in ("a", "bad", "b", "c")]
    assert followup.run_queries(spark, wanted, perform, state, budget=3)[0] == "budget_exhausted" and calls == ["a", "bad", "b"]
    status, rows = followup.run_queries(spark, wanted, perform, state, budget=3)
    assert status == "partial" and calls == ["a", "bad", "b", "c"] and rows.count() == 4
    followup.run_queries(spark, wanted, perform, state, budget=3, retry_failed=True)
    assert calls == ["a", "bad", "b", "c", "bad"]


def test_archive(spark, tmp_path):
    frame = lambda rs: spark.createDataFrame(rs, "k string, v string, n int")
    path = "file://" + str(tmp_path / "library")
    followup.archive(spark, path, frame([("a", "old", 1), ("a", "later", 2)]), "k", "n")
    got = followup.archive(spark, path, frame([("a", "new", 0), ("b", "new", 0)]), "k", "n").collect()
    assert {(r.k, r.v) for r in got} == {("a", "old"), ("b", "new")} and spark.read.parquet(path + "/state=1").count() == 1


def test_reconstruction(spark):
    df = spark.createDataFrame
    sources, blocks = df([("s",)], "source_id string"), df([("s", "B1", "Cells  grew\nfast.")], "source_id string, block_id string, original string")
    evidence = df([("e1", "x", "observation"), ("e2", "x", "inference"), ("e3", "", "odd")], "evidence_id string, statement string, kind string")
    anchors = df([("e1", "s", "B1", "grew fast", None, None, None), ("e2", "s", "B1", "shrank", None, None, None), ("e2", "z", None, None, 1, "d", False)], "evidence_id string, source_id string, block_id string, quote string, page int, visual_description string, visual_checked boolean")
    claims = df([("c1", "t", "supported", "r", "b", "d", ["x"], ["e1"]), ("c2", "t", "supported", "r", "b", "", [], ["e2", "e9"])], "claim_id string, text string, status string, rationale string, boundary string, decisive_test string, alternative_explanations array<string>, evidence_ids array<string>")
    experiments = df([("x1", "q", None, "g", "u", "5", "i", "r", "s", "o", ["model"], ["e1"])], "experiment_id string, question string, model string, groups string, biological_unit string, sample_size string, intervention string, readout string, statistics string, outcome string, not_reported array<string>, evidence_ids array<string>")
    got = {tuple(r) for r in reviews.reconstruction_issues(sources, blocks, evidence, anchors, claims, experiments).collect()}
    assert got == {("e3", "undescribed_evidence"), ("e3", "no_anchor"), ("e2", "unknown_source"), ("e2", "excerpt_absent"), ("e2", "visual_unchecked"), ("c2", "unknown_evidence"), ("c2", "missing_decisive_test"), ("c2", "no_alternatives"), ("c2", "interpretation_only")}


def test_month(spark):
    df = spark.createDataFrame
    corpus = df([("r1", "a", False), ("r2", None, False), ("r3", "a", True), ("r4", "a", False)], "record_id string, abstract string, retraction_notice_flag boolean")
    paper = lambda i, key, **kw: (i, True, "fits", True, True, "primary_research", "abstract", "f", "m", "l", "p", key)
    papers = df([paper("r1", "k1"), paper("r2", "k2"), paper("r3", "k3"), paper("r9", "k1")], "record_id string, include boolean, reason string, life_sciences boolean, month_verified boolean, article_type string, reading_level string, finding string, methods string, limitations string, source_locator string, study_key string")
    trends = df([("t1", "a", "b", "c", "d", "monthly_signal", ["r1", "r2"]), ("t2", "a", "b", "c", "", "odd", ["r1", "r1"])], "trend_id string, title string, finding string, limitations string, next_experiment string, kind string, paper_ids array<string>")
    got = {tuple(r) for r in reviews.month_issues(corpus, papers, trends).collect()}
    assert got == {("r9", "not_in_corpus"), ("r4", "not_screened"), ("r2", "no_abstract"), ("r9", "no_abstract"), ("r3", "retracted"), ("t2", "needs_two_studies"), ("t2", "bad_references"), ("t2", "no_kind"), ("t2", "missing_next_experiment")}
    sections = df([("intro", ["c1", "c9"]), ("end", [])], "section string, claim_ids array<string>")
    claims = df([("c1",), ("c2",)], "claim_id string")
    assert {tuple(r) for r in reviews.unused_claims(sections, claims).collect()} == {("c2", "unused_claim"), ("c9", "unknown_claim"), ("end", "section_without_claims")}


def test_plans(spark):
    good = {f: "stated" for f in reviews.PLAN}
    rows = [("p1", *good.values(), ["c"], ["a"], 5, "why", "reviewed", "me"), ("p2", *{**good, "blinding": "TODO", "model": None}.values(), [], ["a"], 1, "why", "draft", "me")]
    schema = "plan_id string, " + ", ".join(f"{f} string" for f in reviews.PLAN) + ", comparators array<string>, alternative_explanations array<string>, n_per_group int, sample_rationale string, review_status string, assessor string"
    got = {tuple(r) for r in reviews.plan_issues(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("p2", "missing_blinding"), ("p2", "missing_model"), ("p2", "missing_comparators"), ("p2", "sample_size"), ("p2", "not_reviewed")}


def test_workbook(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="raw" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>sample</t></si><si><t>feature</t></si><si><t>s1</t></si></sst>")
        cells = '<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>value</t></is></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>1.5</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {m}><sheetData>{cells}</sheetData></worksheet>")
    (row,) = workbook.read_workbook(spark, str(tmp_path / "w.xlsx"), header_row=2).collect()
    assert (row.sample, row.feature, row.value, row["__source_row"]) == ("s1", None, "1.5", 3)
    with pytest.raises(ValueError):
        workbook.read_workbook(spark, str(tmp_path / "w.xlsx"), "other")
