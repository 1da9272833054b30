"""Records, ledgers, documents, sources and the stream on small fixtures."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from verispan.functions import text
from verispan.operators import documents, enrichment, ledger, records
from verispan.sources import paged, references, tables


def test_text_functions(spark):
    df = spark.createDataFrame([("https://doi.org/10.1234/A(B).", "<b>Na&iuml;ve</b>  Mice, 2!", "Li, Anna", "Trends in X")], "doi string, title string, name string, journal string")
    r = df.select(text.normalize_doi(F.col("doi")).alias("d"), text.normalize_title(F.col("title")).alias("t"), text.author_parts(F.col("name")).alias("a"), text.in_scope(F.col("journal"), "cns").alias("s"), text.in_scope(F.col("journal"), "nature").alias("n")).first()
    assert (r.d, r.t, r.a.family, r.a.given, r.a.unparsed, r.s, r.n) == ("10.1234/a(b)", "naïve mice 2", "Li", "Anna", False, True, False)
    bad = spark.createDataFrame([("10.12/x",), ("",), (None,)], "doi string").select(text.normalize_doi(F.col("doi")).alias("d")).collect()
    assert [x.d for x in bad] == [None] * 3


def dedupe(spark, rows):
    df = spark.createDataFrame(rows, "ord long, doi string, identifiers map<string,string>, title string, year int, author string")
    return {r.ord: r.kept_order for r in records.deduplicate(df, "ord", F.col("doi"), F.col("identifiers"), "title", "year", F.col("author")).collect()}


def test_deduplication(spark):
    long = "A rather long title about cells"
    rows = [
        (1, "10.1/a", {}, long, 2020, "Li"), (2, "10.1/a", {"pmid": "7"}, "other", 2021, "Wu"), (3, None, {"PMID": "x", "pmid": "7"}, "x", 2020, "Y"), (4, "10.1/b", {"pmid": "7"}, long, 2020, "Li"),
        (5, None, {"arxiv": "1v1"}, "p", 2020, "Z"), (6, None, {"arxiv": "1v2"}, "p", 2020, "Z"), (7, None, None, long, 2020, "Li"), (8, None, {}, long.upper() + "!", 2020, "li"), (9, None, {}, long, None, "Li"), (10, None, {}, "short", 2020, "Li"), (11, None, {}, "short", 2020, "Li"),
    ]
    got = dedupe(spark, rows)
    # 2 joins 1 by DOI and brings the pmid that 3 joins by; 4 has another DOI and stays; versions stay apart
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}
    assert dedupe(spark, rows[:0] or [(1, None, None, None, None, None)]) == {1: 1}


def test_ranking_and_export_round_trip(spark):
    rows = [(1, "Senescence of cells", 2026, 1000, "J", "10.1/a", [("Anna", "Li")], {"pmid": "7"}), (2, "Unrelated", 2026, 9999, None, None, [], {})]
    df = spark.createDataFrame(rows, "rec_no long, title string, year int, citations int, journal string, doi string, authors array<struct<given:string,family:string>>, identifiers map<string,string>")
    got = {r.rec_no: r.score for r in records.prioritize(df, ["senescence"], ["title"], "year", "citations", 2026).collect()}
    assert got[2] == 0 and got[1] == pytest.approx(100)
    df = df.withColumn("record_id", records.record_id(F.col("doi"), F.col("identifiers"), F.col("title")))
    for fmt in ("ris", "enw", "bib"):
        entries = {r.rec_no: r.entry for r in records.export_lines(df, fmt).collect()}
        (back,) = references.records_of(entries[1])
        assert (back["title"], back["year"], back["doi"], back["authors"], back["journal"]) == ("Senescence of cells", 2026, "10.1/a", ["Li, Anna"], "J")
        assert back["identifiers"].get("pmid") == "7"
    assert "<dc:creator>Li, Anna</dc:creator>" in records.export_lines(df, "rdf").first().entry


def test_reference_formats():
    ris = "TY  - JOUR\nTI  - A long\n  title\nAU  - Acme Group\nSP  - 12\nEP  - 18\nPY  - 2020/05\nER  - \nTY  - GEN\nTI  - B\nER  - "
    a, b = references.records_of(ris)
    assert (a["title"], a["pages"], a["year"], a["authors"], b["title"]) == ("A long title", "12-18", 2020, ["Acme Group"], "B")
    nbib = "PMID- 1\nTI  - A\nFAU - Li, Anna\nAID - 10.1/x [doi]\n\nPMID- 2\nTI  - B\n"
    a, b = references.records_of(nbib)
    assert (a["doi"], a["identifiers"], a["authors"], b["identifiers"]) == ("10.1/x", {"pmid": "1"}, ["Li, Anna"], {"pmid": "2"})
    bib = '@article{k, title = {The {DNA} way}, author = "Li, Anna and {Acme Group}", year = 2020, eprint = {1.2v3}, archivePrefix = {arXiv}}'
    (a,) = references.records_of(bib)
    assert (a["title"], a["authors"], a["year"], a["identifiers"]) == ("The {DNA} way", ["Li, Anna", "Acme Group"], 2020, {"arxiv": "1.2v3"})
    assert references.records_of("no format") == references.records_of(None) == []


LEDGER = "n int, record_id string, duplicate_of string, title_abstract_decision string, report_id string, retrieval string, fulltext_decision string, exclusion_reason string, study_id string"


def test_screening_flow(spark):
    rows = [(1, "a", None, "include", "R1", "retrieved", "include", None, "S"), (2, "b", None, "include", "R2", "retrieved", "include", None, "S"), (3, "c", "a", None, None, None, None, None, None), (4, "d", None, "include", "R3", "not_retrieved", None, None, None), (5, "e", None, "exclude", None, None, None, None, None)]
    r = ledger.screening_flow(spark.createDataFrame(rows, LEDGER), "n").first()
    assert (r.reports_included, r.studies_included, r.reports_not_retrieved, r.valid, r.complete, r.duplicate_records_removed) == (2, 1, 1, True, True, 1)
    rows.append((6, "f", "c", None, None, None, None, None, None))
    rows.append((7, "g", None, "include", "R4", "retrieved", "exclude", None, None))
    rows.append((8, "h", None, None, None, None, None, None, None))
    r = ledger.screening_flow(spark.createDataFrame(rows, LEDGER), "n").first()
    assert (r.valid, r.complete, r.errors, r.records_pending_screening) == (False, False, 2, 1)


@pytest.mark.parametrize(
    "row, status",
    [
        (("33.3", "%", ".333333", "fraction", 1), "compatible_with_declared_rounding"), (("33.3", "%", ".333333", "fraction", None), "numeric_mismatch"), (("1", "percentage_point", ".01", "fraction", None), "incompatible_units"),
        (("1", "mg", "1000", "ug", None), "exact_or_unit_equivalent"), (("1", "parsec", "1", "mg", None), "unsupported_unit"),
    ],
)
def test_numbers(spark, row, status):
    df = spark.createDataFrame([row], "a string, ua string, b string, ub string, dp int")
    c = F.col
    assert df.select(ledger.numeric_status(c("a").cast("decimal(20,9)"), c("ua"), c("b").cast("decimal(20,9)"), c("ub"), c("dp")).alias("s")).first().s == status


def test_claims(spark):
    claims = spark.createDataFrame([("c1", "supported", "t", "me", "because", "direct"), ("c2", "supported", "t", None, None, None), ("c3", "odd", "", None, None, None), ("c1", "pending", "t", None, None, None)], "claim_id string, status string, text string, assessor string, rationale string, evidence_type string")
    sources = spark.createDataFrame([("c1", "s.md", None, "p. 1", "rose by  two", "h"), ("c3", None, None, None, None, None)], "claim_id string, path string, url string, locator string, excerpt string, source_sha256 string")
    texts = spark.createDataFrame([("s.md", "It rose by\ntwo.", "h")], "path string, text string, sha256 string")
    got = {(r.claim_id, r.code) for r in ledger.validate_claims(claims, sources, texts).collect()}
    assert got == {("c1", "id"), ("c2", "source"), ("c2", "semantic_review"), ("c2", "evidence_type"), ("c3", "status"), ("c3", "text"), ("c3", "locator"), ("c3", "source")}
    changed = texts.withColumn("sha256", F.lit("other")).withColumn("text", F.lit("fell"))
    assert {("c1", "source_hash"), ("c1", "excerpt")} <= {(r.claim_id, r.code) for r in ledger.validate_claims(claims, sources, changed).collect()}


def test_reviews_and_rules(spark):
    rows = [("a", "x", "complete", "h"), ("b", "y", "complete", "h")]
    ready = lambda rs: ledger.collect_reviews(spark.createDataFrame(rs, "reviewer string, context string, status string, packet_sha256 string"), "h", 2).first().ready
    assert ready(rows) and not ready([rows[0], ("b", "x", "complete", "h")]) and not ready([rows[0], ("b", "y", "complete", "new")])
    df = spark.createDataFrame([(1, "q", 5), (2, "", 1)], "k int, question string, n int")
    got = {tuple(r) for r in ledger.required_fields(df, "k", {"question": F.col("question") != "", "n": F.col("n") >= 2}).collect()}
    assert got == {(2, "question"), (2, "n")}


def test_enrichment_over_measured_genes(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "gene string")
    sets = spark.createDataFrame([("s1", g) for g in ("A", "B", "UNMEASURED")] + [("s2", g) for g in "CD"], "term string, gene string")
    got = {r.term: r for r in enrichment.enrich(one(["A", "B", "OUTSIDE"]), one("ABCD"), sets).collect()}
    assert got["s1"].p_value == pytest.approx(1 / 6) and got["s1"].universe_n == 4 and got["s2"].p_value == 1


def test_enrichment_of_a_large_universe(spark):
    """More than a million genes, and sets from one gene to many pieces of a tail, against sums of logs of gamma."""
    n, k = 1_100_000, 30_000
    genes = spark.range(n).select(F.col("id").alias("gene"))
    sizes = {"one": 1, "few": 40, "many": 20_000}
    sets = None
    for term, size in sizes.items():
        part = spark.range(size).select(F.lit(term).alias("term"), (F.col("id") * (n // size)).alias("gene"))
        sets = part if sets is None else sets.union(part)
    got = {r.term: r for r in enrichment.enrich(genes.filter(F.col("gene") % 3 == 0).limit(k), genes, sets).collect()}
    lf = lambda v: math.lgamma(v + 1)
    for term, size in sizes.items():
        r = got[term]
        assert (r.term_n, r.selected_n, r.universe_n) == (size, k, n) and r.overlap > 0
        logs = [lf(size) - lf(x) - lf(size - x) + lf(n - size) - lf(k - x) - lf(n - size - k + x) - lf(n) + lf(k) + lf(n - k) for x in range(r.overlap, size + 1)]
        assert r.p_value == pytest.approx(min(1.0, math.fsum(map(math.exp, logs))), rel=1e-6)


def test_log_factorials(spark):
    ns = [*range(40), 1000, 10**6, 10**9]
    got = spark.createDataFrame([(v,) for v in ns], "n long").select("n", enrichment.log_factorial(F.col("n")).alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.n + 1), rel=1e-14, abs=1e-14) for r in got)


def test_math_lint():
    assert documents.math_problems("a $x$ and\n```\n$\n```\n\\begin{a}\\end{a} % $") == []
    assert documents.math_problems("$a\n\\]\\begin{x}\\end{y}") == [(2, "unmatched_close", "\\]"), (2, "unmatched_close", "\\end{y}"), (1, "unclosed", "$"), (2, "unclosed", "\\begin{x}")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('note\n"x\ny",sample,feature, \n\n1,s1,f,\n"2\n2",s2,,\n,,,\n3,s3,g,\n')
    df = tables.read_table(spark, str(tmp_path / "a.csv"), header_row=2)
    assert df.columns == ["x\ny", "sample", "feature", "__source_row", "__source_file", "__source_sha256"]
    assert [(r[0], r.feature, r.__getitem__("__source_row")) for r in df.orderBy("__source_row").collect()] == [("1", "f", 5), ("2\n2", None, 6), ("3", "g", 9)]
    for bad in ("a,a\n1,2\n", "a,__b\n1,2\n", "a,b\n1\n"):
        with pytest.raises(ValueError):
            tables.table_of(bad, ",")
    (tmp_path / "g.gmt").write_text("s1\tx\tA\tB\ns2\ty\tC\n")
    assert {tuple(r) for r in tables.read_gene_sets(spark, str(tmp_path / "g.gmt")).collect()} == {("s1", "A"), ("s1", "B"), ("s2", "C")}
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"title": "A"}, {"title": "B"}]}))
    assert tables.read_records(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "docs").mkdir()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "docs/a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "docs/b.md").write_text("# A\n\ntext\nmore\n\n\nlast")
    (tmp_path / "docs/c.xml").write_text("<article><front/></article>")
    files = spark.read.format("binaryFile").load(str(tmp_path / "docs"))
    got = documents.file_blocks(files).collect()
    by = {(r.path.rsplit("/", 1)[1], r.ordinal): r for r in got}
    assert [(by["a.docx", i].original, by["a.docx", i].locator) for i in (1, 2)] == [("One", "paragraph 1"), ("Two", "paragraph 3")]
    assert [by["b.md", i].locator for i in (1, 2, 3)] == ["line 1", "line 3", "line 7"] and "no body" in by["c.xml", None].error
    kinds = {r.path.rsplit(".", 1)[1]: r.k for r in files.select("path", documents.payload_kind(F.col("content")).alias("k")).collect()}
    assert kinds == {"docx": "zip", "md": "other", "xml": "jats"}


def test_paged_source(spark):
    paged.register(spark)
    df = spark.read.format("paged").options(url="https://x", queries=json.dumps(["ok", "broken"]), page_size=2, pages=5, total_path="total", transport="tests_transport:fake_pages").load()
    spark.sparkContext.addPyFile(__import__("pathlib").Path(__file__).with_name("tests_transport.py").as_posix())
    got = df.collect()
    ok = [json.loads(r.record)["id"] for r in got if r.query == "ok"]
    assert ok == [1, 2, 3, 4] and {r.stop_reason for r in got if r.query == "ok"} == {"exhausted"} and {r.expected_total for r in got} == {5}
    assert [json.loads(r.record)["id"] for r in got if r.query == "broken"] == [1, 2] and got[-1].stop_reason.startswith("failed")


def test_stream(spark, tmp_path):
    from verispan.streaming.technical import stream_units

    spark.createDataFrame([("u", "2025-01-01 00:10:00", 1.0), ("u", "2025-01-01 00:20:00", 3.0), ("u", "2025-01-01 05:00:00", None)], "unit string, t string, value double").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("unit string, t timestamp, value double").parquet(str(tmp_path / "in"))
    q = stream_units(stream, "t", ["unit"]).writeStream.format("memory").queryName("units_stream").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.window_start.hour: (r.value, r.observed_technical_n, r.technical_rows) for r in spark.table("units_stream").collect()}
    assert got == {0: (2.0, 2, 2), 5: (None, 0, 1)}


def test_coverage_and_bounds(spark):
    a = spark.createDataFrame([("x", "B1"), ("x", "B2")], "s string, b string")
    b = spark.createDataFrame([("x", "B2"), ("x", "B9")], "s string, b string")
    assert {(r.b, r.side) for r in ledger.coverage(a, b, ["s", "b"]).collect()} == {("B1", "not_translated"), ("B9", "not_in_source")}
    rows = spark.createDataFrame([(1, "rs7412", ".5"), (2, "rs123", "-.3"), (3, "rs7412", ".2")], "n int, rsid string, beta string")
    (r,) = documents.bounded_scan(rows, "n", {"rsid": "rs7412"}, 1, 100).collect()
    assert (r.beta, r.scanned_rows, r.truncated) == (".5", 1, True)
    cuts: list = []
    assert documents.cut_json({"a": [1, 2, 3], "b": {"c": {"d": 1}}, "t": "xxxx"}, 2, 2, 3, cuts=cuts) == {"a": [1, 2], "b": {"c": None}, "t": "xxx"}
    assert cuts == ["$.a", "$.b.c", "$.t"]
