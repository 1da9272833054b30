"""Merged records, dedupe order, study tests, and helpers of plans, on small fixtures."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verispan import scale
from verispan.operators import corpus, kernels, records
from verispan.operators import contrasts as C
from verispan.operators import units as U
from verispan.plans import problems, study


def greedy(rows):
    """Each record into the first kept one that it may join, one by one."""
    kept, out = [], {}
    for o, doi, ids in rows:
        have = {k: v for k, v in {"doi": doi, **ids}.items() if v}
        for k in kept:
            veto = any(have.get(x) and k["ids"].get(x) and have[x] != k["ids"][x] for x in ("doi", "arxiv"))
            if not veto and any(have.get(x) and have[x] == k["ids"].get(x) for x in records.KEYS):
                k["ids"] = {**have, **k["ids"]}
                out[o] = k["o"]
                break
        else:
            kept.append({"o": o, "ids": have})
            out[o] = o
    return out


@pytest.mark.parametrize("seed", range(4))
def test_indexed_fold_is_greedy(seed):
    rng = random.Random(seed)
    pick = lambda name, n: rng.choice([None, None, *[f"{name}{i}" for i in range(n)]])
    rows = [(i, pick("d", 6), {"arxiv": pick("a", 5), "pmid": pick("p", 8), "openalex": pick("o", 8)}) for i in range(400)]
    pdf = pd.DataFrame({"ord": [r[0] for r in rows], "ids": [{k: v for k, v in {"doi": r[1], **r[2]}.items() if v} for r in rows], "title_block": None})
    assert {r.ord: r.kept_ord for r in records._fold(pdf).itertuples()} == greedy(rows)


def test_merged_records(spark):
    rows = [(1, "10.1/a", "T", None, [], {"pmid": "1"}), (2, "10.1/a", "U", 2001, [("A", "B")], {"pmid": "2", "arxiv": "x"}), (3, None, "V", 2002, [], {})]
    df = spark.createDataFrame(rows, "o long, doi string, title string, year int, authors array<struct<family:string,given:string>>, identifiers map<string,string>")
    mapping = spark.createDataFrame([(1, 1, False), (2, 1, True), (3, 3, False)], "o long, kept_order long, merged boolean")
    merged = corpus.merged_records(df, mapping, "o", ["pmid", "arxiv"])
    got = {r.o: r for r in merged.collect()}
    assert got[1].title == "T" and got[1].year == 2001 and len(got[1].authors) == 1 and got[1].identifiers == {"pmid": "1", "arxiv": "x"} and got[1].merged_from == 2
    lost = {(r.field, r.kept, r.alternative) for r in corpus.merge_conflicts(df, mapping, merged, "o").collect()}
    assert lost == {("title", "T", "U")}
    assert corpus.merged_records(df.limit(0), mapping, "o", ["pmid"]).collect() == []


def test_compare_and_variants(spark):
    row = ("T", "2001", ["A et al"], "T <i>", "1999", ["A"], [2001])
    df = spark.createDataFrame([row], "t string, y string, a array<string>, t2 string, y2 string, a2 array<string>, ys array<int>")
    pairs = df.select(F.lit(1).alias("k"), F.struct(F.col("t").alias("title"), F.col("y").cast("int").alias("year"), F.col("a").alias("authors")).alias("supplied"), F.struct(F.col("t2").alias("title"), F.col("y2").cast("int").alias("year"), F.col("a2").alias("authors"), F.col("ys").alias("years")).alias("canonical"))
    got = {r.field: r.status for r in corpus.compare_records(pairs, ["k"]).collect()}
    assert got["title"] == "match" and got["year"] == "matches_alternate_publication_date" and got["authors"] == "truncated_presentation_needs_style_check" and got["volume"] == "not_supplied"
    texts = spark.createDataFrame([("chr7:55-A-g",), ("23:5-A-T",), ("x 5 A A",), ("7:55",), (None,)], "t string")
    assert [tuple(r) for r in corpus.parse_variant(texts, F.col("t")).select("chrom", "pos", "ref", "alt", "status").collect()] == [("7", 55, "A", "G", "ok"), (None, None, None, None, "bad_chromosome"), (None, None, None, None, "same_alleles"), *[(None, None, None, None, "malformed")] * 2]


def test_intervals(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 4.0), ("h", 1.0), ("n", None)], "g string, value double")
    got = {r.g: r for r in U.figure_summary(df, ["g"]).collect()}
    sem = np.std([1, 2, 4], ddof=1) / 3**0.5
    assert got["g"].ci_high - got["g"].mean == pytest.approx(4.302652729911275 * sem) and got["h"].ci_low is None and "n" not in got


def test_degenerate_strata(spark):
    """Constant, single and missing values divide nothing by zero."""
    rows = [("r", "g", u, f, v) for f in ("a", "b") for u, v in (("u1", 1.0), ("u2", 1.0), ("u3", 1.0), ("u4", None))] + [("r", "h", "u1", "a", 2.0), ("q", "g", "u1", "a", None)]
    df = spark.createDataFrame(rows, "run string, grp string, unit string, feature string, value double")
    assert [r.status for r in C.spearman(df, ["run", "grp"], "unit", "feature", ["a", "b"]).collect()] == ["descriptive_small_n"]
    pairs = C.welch(C.two_sided(df, ["run", "feature"], "grp", [("g", "h")]))
    rows = C.classify(C.bh_adjust(pairs, []))
    assert {r.status for r in rows.collect()} == {"descriptive_small_n"}
    assert C.mann_whitney(df, ["run", "feature"], "grp", "g", "h").count() == 1
    assert U.detection(df, ["run"], "grp", "unit", "feature").count() == 4
    assert C.paired_t(df, ["run", "feature"], "unit", "grp", "g", "h").count() == 3


def test_ties_in_fdr(spark):
    p = [0.5] * 50 + [0.01, 0.02, 1.0, 1.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    live = np.array([x for x in p if x is not None])
    rank = np.array([(live <= x).sum() for x in live])
    raw = live * len(live) / rank
    want = [min(1.0, raw[live >= x].min()) for x in live]
    got = [r.q_value for r in C.bh_adjust(df, []).orderBy("i").collect()]
    assert got[:-1] == pytest.approx(want) and got[-1] is None


def config(**analysis):
    return {"study": {"design": "independent", "data_scale": "log2", "independent_units_confirmed": True}, "comparisons": [{"test": "t", "reference": "c"}], "analysis": analysis}


def observations(spark, batch=True):
    rng = random.Random(5)
    rows = [(f"f{f}", f"s{g}{u}", g, f"{g}{u}", f"b{u % 2}", 5.0 + (g == "t") * (f == 0) * 3 + (u % 2) + rng.gauss(0, 0.1)) for f in range(3) for g in ("t", "c") for u in range(6)]
    return spark.createDataFrame(rows, "feature string, sample string, group string, unit string, batch string, value double")


@pytest.mark.parametrize("test", ["welch", "mannwhitney", "ols"])
def test_study_methods(spark, test):
    df = observations(spark).drop("batch")
    out = {r.feature: r for r in study.analyse(df, config(test=test)).contrasts.collect()}
    assert all(r.status == "tested" and r.method == test for r in out.values()) and out["f0"].p_value < 0.01
    if test != "mannwhitney":
        assert out["f0"].ci_low < out["f0"].effect < out["f0"].ci_high


def test_study_batches_and_files(spark, tmp_path):
    done = study.analyse(observations(spark), config(adjust_batch=True))
    out = {r.feature: r for r in done.contrasts.collect()}
    assert out["f0"].method == "ols" and out["f0"].effect == pytest.approx(3, abs=0.3) and out["f0"].p_value < 1e-6
    names = study.write_study(done, f"file://{tmp_path}/study")
    assert "contrasts" in names and spark.read.option("header", True).csv(f"file://{tmp_path}/study/contrasts").count() == 3
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    other = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, sha256 string")
    assert study.analysis_identity(config(), files, "1") != study.analysis_identity(config(), other, "1")
    assert {tuple(r) for r in study.integrity_issues(files, other).collect()} == {("b", "changed"), ("c", "unexpected")}


def test_helpers_start_no_job(spark, data):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    df = spark.read.parquet(f"{data}/records.parquet").select("rec_no", "provider")
    feeds = spark.read.parquet(f"{data}/feeds.parquet")
    counted = df.groupBy("provider").count()
    before = len(tracker.getJobIdsForGroup(None))
    scale.spread(counted)
    scale.spread(df)
    assert scale.proven_small(feeds) and not scale.proven_small(feeds.join(feeds, "provider"))
    scale.attach(df, feeds.groupBy("provider").agg(F.min("zone").alias("zone")), ["provider"])
    scale.attach(df, counted.join(counted.withColumnRenamed("count", "m"), "provider"), ["provider"])
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_late_load_parses_only_new_texts(spark, data):
    from verispan.operators import timestamps

    path = scale.new_path(spark, "late")
    ev, feeds = spark.read.parquet(f"{data}/date_evidence.parquet"), spark.read.parquet(f"{data}/feeds.parquet")
    run = lambda x: timestamps.normalise_dates(x, feeds, "evidence_id", "first_publication_date", "date_parts", "provider", path)
    first = run(ev.filter("evidence_id % 2 = 0")).collect()
    size = spark.read.parquet(path).count()
    whole = {r.evidence_id: r.normal_form for r in run(ev).collect()}
    more = spark.read.parquet(path).count()
    again = {r.evidence_id: r.normal_form for r in run(ev).collect()}
    assert size < more == spark.read.parquet(path).count() and whole == again
    spark.read.parquet(path).write.mode("append").parquet(path)  # a run that broke after its rows were written
    assert {r.evidence_id: r.normal_form for r in run(ev).collect()} == whole
    assert {r.evidence_id: r.normal_form for r in first}.items() <= whole.items()
    assert {k: v for k, v in whole.items() if v} == {r.evidence_id: r.normal_form for r in problems.p5_found(spark, data).collect()}
    padded = spark.createDataFrame([(1, " " * 300 + "2024-05-01" + " " * 300, None, "x")], "evidence_id long, first_publication_date string, date_parts array<array<int>>, provider string")
    assert [r.normal_form for r in run(padded).collect()] == ["2024-05-01"]
