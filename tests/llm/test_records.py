"""Duplicates and representatives against plain Python, and their edge cases."""

import html
import json
import random
import re
import unicodedata
from collections import Counter, defaultdict
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from verispan.llm import duplicates, queries, representative


def simple_doi(s):
    m = re.search(r"10\.\d{4,}/\S+", unquote(s or ""))
    return m and re.sub(r"[.,;\">]+$", "", m[0]).lower() or None


def simple_title(s):
    s = re.sub(r"</?[A-Za-z][^>]*>", "", html.unescape(s or ""))
    return "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if c.isalnum()) or None


def stated(raw):
    if raw.startswith("{"):
        got = {k.lower(): v for k, v in json.loads(raw).items()}
        return got.get("doi"), got.get("title")
    text = re.sub(r"\n(?![A-Z%]\S{0,3}\s)", " ", raw)
    find = lambda p: (m := re.search(p, text, re.M)) and m[1]
    return find(r"^(?:DO  -|%R) (.*)$"), find(r"^(?:TI  -|%T) (.*)$")


def test_classes_against_brute_force(spark, data):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{data}/records.parquet").collect():
        doi, title = (r.doi, r.title) if r.doi is not None or r.title is not None else stated(r.raw_entry or "")
        key = (simple_doi(doi), simple_title(title))
        if all(key):
            groups[key].append(r.rec_no)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    got = [tuple(r) for r in queries.p1_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize(
    "text, key",
    [
        ("https://x/10.5555%2FAb(C)d.", "10.5555/ab(c)d"), ("10.5555/a(b)", "10.5555/a(b)"), ("(10.5555/ab)", "10.5555/ab"), ("10.5555/", None), ("5555/x", None), (None, None), ("", None),
        ("<10.1000.10/x;y>;", "10.1000.10/x;y"), ("10.5555/...", None), ("doi 10.5555/é", "10.5555/é"),
    ],
)
def test_doi_key(text, key):
    assert duplicates.doi_key(text) == key


def test_title_key():
    assert duplicates.title_key("Naïve <i>A</i>-&alpha; &amp; p &lt; 5") == duplicates.title_key("NAÏVE a α P 5") == "naïveaαp5"
    assert duplicates.title_key(" - ") is None and duplicates.title_key("ﬁve²") == "five2"


def test_class_edges(spark):
    long = "x" * 200_000
    rows = [(1, "10.5555/a", "T", None, 0), (2, "10.5555/A", "t.", None, 0), (2, "10.5555/A", "t.", None, 0), (3, None, None, '{"DOI": "10.5555/a", "title": "T"}', 0), (4, "10.5555/a", None, '{"title": "T"}', 0),
            (5, None, None, None, 0), (6, None, None, None, 0), (7, "", "", "DO  - 10.5555/a\nTI  - T", 0), (8, "10.5555/b", long, None, 0), (9, "10.5555/B", long.upper(), None, None),
            (10, None, None, "@article{k, title = {{T}}, doi = {10.5555/a}}", 0), (11, None, None, "DO  - 10.5555/a\nTI  - T\n  ", 0), (12, None, None, "PMID- 1\nTI  - T\nAID - 10.5555/a [doi]", 0)]
    df = spark.createDataFrame(rows, "rec_no long, doi string, title string, raw_entry string, copies int")
    out = duplicates.duplicate_classes(df)
    got = {r.rec_no: (r.class_key, r.copies) for r in out.collect()}
    assert out.count() == len(rows)
    assert [got[i] for i in (1, 2, 3, 10, 11, 12)] == [(1, 7)] * 6
    assert [got[i] for i in (4, 5, 6, 7)] == [(i, 1) for i in (4, 5, 6, 7)]
    assert got[8] == got[9] == (8, 2)
    assert duplicates.duplicate_classes(df.limit(0)).collect() == []


USABLE = ("journal", "year", "authors", "doi")


def test_survivors_against_brute_force(spark, data):
    trust = {r.provider: r.trust_rank for r in spark.read.parquet(f"{data}/feeds.parquet").collect()}
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{data}/records.parquet").collect():
        if r.identifiers and r.identifiers.get("pmid"):
            groups[r.identifiers["pmid"]].append(r)
    void = {"", "-", "n/a", "n.a.", "null", "unknown", "not available"}
    more = {"others", "et al", "et al.", "and others"}
    ok = {
        "journal": lambda r: (r.journal or "").strip().lower() not in void,
        "year": lambda r: r.year is not None and 1950 <= r.year <= 2026,
        "authors": lambda r: bool(r.authors) and all((a.family or "").strip() and a.family not in more for a in r.authors),
        "doi": lambda r: bool(re.search(r"10\.\d{4,}/\S*\w", unquote(r.doi or ""))),
    }
    want = set()
    for p, g in groups.items():
        for f, test in ok.items():
            if len(g) > 1 and (u := [r for r in g if test(r)]):
                want.add((p, f, min(u, key=lambda r: (trust[r.provider], -r.accessed_at.timestamp(), r.rec_no)).rec_no))
    got = [tuple(r) for r in queries.p2_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_survivor_edges_and_layers(spark):
    rows = [("g", 1, "n/a", 2020, None), ("g", 2, "J", 1900, 5), ("g", 3, "K", 2020, 5), ("g", 4, "L", 2020, 1), ("h", 5, "J", 2020, 1), (None, 6, "J", 2020, 1), (None, 7, "J", 2020, 1), ("t", 8, "A", 2020, 1), ("t", 9, "B", 2020, 1)]
    df = spark.createDataFrame(rows, "g string, k long, journal string, year int, trust int")
    df = df.withColumns({"at": F.timestamp_seconds(F.when(F.col("k") == 4, None).otherwise(F.lit(100))), "authors": F.expr("array(named_struct('family', 'et al.'))"), "doi": F.lit("10.5555/x")})
    pick = lambda x: {tuple(r) for r in representative.surviving_fields(x, F.col("g"), representative.usable_fields(), "trust", "at", "k").collect()}
    assert pick(df) == {("g", "journal", 4), ("g", "year", 4), ("g", "doi", 4), ("t", "journal", 8), ("t", "year", 8), ("t", "doi", 8)}
    assert pick(df.limit(0)) == set()
    layers = {r.key: r.layer for r in representative.dominance_layers(df, F.col("g"), representative.usable_fields(), "trust", "at", "k").collect()}
    assert layers[4] == layers[3] == 1 and layers[2] == layers[1] == 2 and layers[8] == 1


def test_skyline_of_whole_records(spark):
    """Layer 1 holds the undominated records; a dominated one stays out of the choice though it has the field."""
    both, one = ("J", 2020), ("J", 1900)
    rows = [("g", 1, *both, 3, 50), ("g", 2, *one, 1, 10), ("g", 3, *one, 3, 40), ("g", 4, *both, 4, 50), ("g", 5, *one, 2, 60), ("g", 6, *both, 3, 50)]
    df = spark.createDataFrame(rows, "g string, k long, journal string, year int, trust int, t long").withColumns({"at": F.timestamp_seconds("t"), "authors": F.expr("array(named_struct('family', 'et al.'))"), "doi": F.lit(None).cast("string")})
    cells = representative.group_cells(df, F.col("g"), representative.usable_fields(), "trust", "at", "k")
    layer = {c["key"]: c["layer"] for r in representative.layered_cells(cells).collect() for c in r.cells}
    assert layer == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1}  # 6 ties with 1 in its cell
    got = {(r.field_name, r.key) for r in representative.surviving_fields(df, F.col("g"), representative.usable_fields(), "trust", "at", "k").collect()}
    assert got == {("journal", 2), ("year", 1)}


@pytest.mark.parametrize("parts", [2, 7])
def test_layers_of_all_records(spark, parts):
    rng = random.Random(parts)
    rows = [("big" if i % 3 else f"g{i % 40}", i, rng.choice([None, "n/a", "J"]), rng.choice([1900, 2020]), rng.choice([1, 2, 3, None]), rng.choice([None, *range(60)])) for i in range(900)]
    rows += [(g, 10_000 + k, *rest) for g, k, *rest in rows[:50]] + [(None, 1, "J", 2020, 1, 1), ("single", 2, "J", 2020, 1, 1)]
    df = spark.createDataFrame(rows, "g string, k long, journal string, year int, trust int, t long").withColumns({"at": F.timestamp_seconds("t"), "authors": F.expr("array(named_struct('family', 'et al.'))"), "doi": F.lit("10.5555/x")})
    groups = defaultdict(list)
    for g, k, journal, year, trust, t in rows:
        if g not in (None, "single"):
            have = frozenset(["journal"] * (journal == "J") + ["year"] * (year != 1900))
            groups[g].append((have, trust or 99, -t if t is not None else 99, k))
    want = {}
    for g, members in groups.items():
        depth = {}
        for p in sorted({m[:3] for m in members}, key=lambda m: (m[2], -len(m[0]), m[1])):
            depth[p] = 1 + max((n for o, n in depth.items() if o[0] >= p[0] and o[1] <= p[1] and o[2] <= p[2]), default=0)
        want |= {m[3]: (len(members), depth[m[:3]]) for m in members}
    usual = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = representative.dominance_layers(df, F.col("g"), representative.usable_fields(), "trust", "at", "k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual[0])
        spark.conf.set("spark.sql.adaptive.enabled", usual[1])
    assert len(out) == len(want) and {r.key: (r.records, r.layer) for r in out} == want
    assert representative.dominance_layers(df.limit(0), F.col("g"), representative.usable_fields(), "trust", "at", "k").collect() == []


def test_layer_report_counts_every_record(spark, data):
    sizes = Counter(r.identifiers["pmid"] for r in spark.read.parquet(f"{data}/records.parquet").collect() if r.identifiers and r.identifiers.get("pmid") is not None)
    assert sum(r.candidates for r in queries.p2_layers(spark, data).collect()) == sum(n for n in sizes.values() if n > 1)


def test_collapsed_counts(spark, data):
    n = Counter(r.copies for r in queries.p1_collapsed(spark, data).collect())
    assert sum(k * v for k, v in n.items()) == spark.read.parquet(f"{data}/records.parquet").count()
