"""Scans, leakage, mixing and chunking on small fixtures, against brute force and by exact round trips."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verispan.llm import chunking, leakage, mixing, queries, scans, tokens

needs_tokens = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT), reason="no tokenizer file")


def test_leaks_against_brute_force(spark, data):
    items = spark.read.parquet(f"{data}/eval_items.parquet").collect()
    index = defaultdict(set)
    for r in items:
        w = leakage.words_of(r.text)
        for i in range(len(w) - 11):
            index[tuple(w[i : i + 12])].add(r.item_id)
    want = set()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        w = leakage.words_of(r.text or "")
        want |= {(r.doc_id, x) for i in range(len(w) - 11) for x in index.get(tuple(w[i : i + 12]), ())}
    got = [tuple(r) for r in queries.p8_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_leak_edges(spark):
    item = "In 12 mice of strain B6 we saw a rise of 30 percent within two hours after dosing"
    same = item.upper().replace(" ", "\n")
    other = item.replace("12", "45").replace("B6", "C7").replace("30", "80")
    rows = [(1, f"x {same} y"), (2, other), (3, item.replace("12", "45").replace("saw", "met")), (4, None), (5, ""), (6, "short"), (7, ("pad " * 50_000) + item), (7, item), (8, item[: len(item) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(9, item), (10, None), (11, "few words")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_items(docs.drop("item_id"), items).collect()} == {(1, 9), (7, 9)}
    assert {tuple(r) for r in leakage.leaked_items(docs, items).collect()} == {(1, 9), (7, 9)}
    kinds = {r.doc_id: r.leak for r in leakage.leak_report(docs, items).collect()}
    assert kinds[1] == kinds[7] == "verbatim" and kinds[2] == "reparameterised" and kinds.get(3) != "verbatim"
    assert leakage.leaked_items(docs.limit(0), items).collect() == leakage.leaked_items(docs, items.limit(0)).collect() == []


@needs_tokens
def test_token_ids_are_exact(spark, data):
    tok = tokens.tokenizer()
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text]
    texts += ["", " ", "a  b", "a \n b", "x\n\n y ", "'s it's", "日本語 テキスト", "a b c", "😀 ok".encode("utf-16", "surrogatepass").decode("utf-16")]
    for t in texts:
        ids = tok.encoding.encode_ordinary(t)
        assert tok.encode(t) == ids and tok.count(t) == len(ids)


def long_text(words, seed=1):
    rnd = random.Random(seed)
    out = []
    while len(out) < words:
        out.append(" ".join(rnd.choice(("cell", "growth", "marker", "signal", "ligand", "assay", "fold")) + str(rnd.randrange(90)) for _ in range(rnd.randint(6, 18))) + ".")
    return "".join(s + ("\n\n" if i % 9 == 8 else " ") for i, s in enumerate(out))[:-1]


@needs_tokens
def test_pieces_round_trip(spark):
    tok = tokens.tokenizer()
    hard = ["字" * 6000, "x" * 30_000, long_text(4000), "\n" * 5000, "a" + "🙂" * 4000, long_text(20) * 200]
    rows = [(i, t) for i, t in enumerate(hard)] + [(90, None), (91, ""), (92, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = defaultdict(list)
    for r in chunking.split_oversized(df).collect():
        got[r.doc_id].append(r)
    counts = {i: tok.count(t) for i, t in rows if t}
    assert set(got) == {i for i, n in counts.items() if n > 2048}
    for i, pieces in got.items():
        raw = hard[i].encode()
        pieces.sort(key=lambda r: r.piece_no)
        assert pieces[0].start_byte == 0 and pieces[-1].end_byte == len(raw) and {p.pieces for p in pieces} == {len(pieces)}
        starts = {}
        at = 0
        for k, x in enumerate(tok.encode(hard[i])):
            starts[at] = k
            at += int(tok.length[x])
        starts[at] = counts[i]
        for p in pieces:
            assert raw[p.start_byte : p.end_byte].decode() == p.piece and tok.count(p.piece) <= 2048
        for p, q in zip(pieces, pieces[1:]):
            assert 128 <= starts[p.end_byte] - starts[q.start_byte] <= 131
    # cuts stand at natural boundaries where there are any
    assert all(p.piece.rstrip().endswith(".") for p in got[2])
    assert chunking.split_oversized(df.limit(0)).collect() == []


@needs_tokens
def test_edits_stay_local():
    a = long_text(12_000)
    i = len(a) // 3
    b = a[:i] + " an inserted remark about nothing" + a[i:]
    cut = lambda t: [t.encode()[x:y] for x, y, _ in chunking.pieces_of(t, 2048, 128, tokens.DEFAULT)]
    pa, pb = cut(a), cut(b)
    changed = len(set(pb) - set(pa))
    assert len(pb) > 15 and changed <= 5


@needs_tokens
def test_found_is_every_long_text(spark, data):
    tok = tokens.tokenizer()
    want = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text and tok.count(r.text) > 2048}
    assert {r.doc_id for r in queries.p10_found(spark, data).collect()} == want


def test_budgets():
    leaf = lambda s, d, lang, share, cap: {"source": s, "domain": d, "language": lang, "share": share, "capacity": cap}
    leaves = [leaf("a", "x", "en", 0.4, 1000), leaf("b", "x", "en", 0.2, 50), leaf("c", "x", "de", 0.2, 1000), leaf("d", "y", "en", 0.2, 1000)]
    exact = mixing.plan_budgets(leaves, None)
    assert exact == pytest.approx({"a": 100, "b": 50, "c": 50, "d": 50})
    more = mixing.plan_budgets(leaves, 500)
    assert more == pytest.approx({"a": 250, "b": 50, "c": 100, "d": 100})  # the sibling takes the shortage
    full = mixing.plan_budgets(leaves, 10_000)
    assert full == pytest.approx({"a": 1000, "b": 50, "c": 1000, "d": 1000})
    assert mixing.plan_budgets([], 5) == {} and mixing.plan_budgets([leaf("a", "", "", 0.0, 9)], None) == {"a": 0.0}


@needs_tokens
@pytest.mark.parametrize("total", [None, 900, 100_000])
def test_mix(spark, total):
    docs = [(i, f"text number {i} " + "word " * (i % 7), ("s1", "s2", "s3", None, "zz")[i % 5], "en", "k", 1) for i in range(400)]
    docs += [(1000, docs[0][1], "s1", "en", "k", 1), (1001, docs[0][1], "s2", None, None, 1), (1002, None, "s1", "en", "k", 1), (1003, "", "s1", "en", "k", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, doc_kind string, tokens int")
    targets = spark.createDataFrame([("s1", 0.5, 1), ("s2", 0.3, 3), ("s3", 0.2, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix_sources(df, targets, total)
    rows, shares = mix.collect(), {r.source: r for r in shares.collect()}
    texts = {i: t for i, t, *_ in docs}
    uses = Counter(texts[r.doc_id] for r in rows)
    cap = {"s1": 1, "s2": 3, "s3": 2}
    assert all(uses[texts[r.doc_id]] <= cap[r.source] for r in rows) and {r.source for r in rows} <= set(cap)
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    for s, r in shares.items():
        assert r.tokens == sum(x.n_tokens for x in rows if x.source == s) and abs(r.tokens - r.budget_tokens) <= 11  # half of the longest text
    assert sum(r.share for r in shares.values()) == pytest.approx(1)
    if total is None:
        assert all(abs(r.share - r.target_share) < 0.02 for r in shares.values())
    again = mixing.mix_sources(df, targets, total)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@needs_tokens
def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, doc_kind string")
    targets = spark.createDataFrame([("s1", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix_sources(docs, targets)
    assert mix.collect() == [] and [r.tokens for r in shares.collect()] == [0]


def test_source_without_room_does_not_empty_the_mix():
    leaf = lambda s, share, cap, domain="d", lang="en": {"source": s, "domain": domain, "language": lang, "share": share, "capacity": cap}
    leaves = [leaf("a", 0.2, 0), leaf("b", 0.2, 100), leaf("c", 0.2, 1000, lang="de"), leaf("e", 0.4, 1000, "k"), leaf("z", 0.0, 50)]
    assert mixing.plan_budgets(leaves, None) == pytest.approx({"a": 0, "b": 100, "c": 50, "e": 100, "z": 0})
    lone = [leaf("a", 0.5, 0, None, None), leaf("b", 0.2, 100), leaf("c", 0.3, 90, "k")]
    assert mixing.plan_budgets(lone, None) == pytest.approx({"a": 0, "b": 60, "c": 90})
    assert mixing.plan_budgets([leaf("a", 1.0, 0)], None) == {"a": 0.0}


@needs_tokens
@pytest.mark.parametrize("cap", [0, None])
def test_mix_without_room_in_one_source(spark, cap):
    docs = spark.createDataFrame([(i, f"text number {i} of many", ("s1", "s2", "s3")[i % 3], "en", "k") for i in range(120)], "doc_id long, text string, source string, lang string, doc_kind string")
    targets = spark.createDataFrame([("s1", 0.5, cap), ("s2", 0.25, 1), ("s3", 0.25, 2), ("s4", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix_sources(docs, targets)
    got = {r.source: r.share for r in shares.collect()}
    assert got["s1"] == got["s4"] == 0 and got["s2"] == pytest.approx(0.5, abs=0.05) and got["s3"] == pytest.approx(0.5, abs=0.05)
    assert mix.filter("source = 's2'").count() >= 39


@needs_tokens
def test_budget_follows_the_data(spark, data):
    shares = queries.p9_budgeted(spark, data).collect()
    room = {r.source: r.available_tokens * r.max_repeats for r in shares}
    whole = sum(r.available_tokens for r in shares if r.max_repeats > 0 and r.target_share > 0)
    assert whole - len(shares) <= sum(r.budget_tokens for r in shares) <= whole
    short = [r for r in shares if r.target_share * whole > room[r.source] + 1]
    assert short and all(r.budget_tokens >= room[r.source] - 1 for r in short)
    assert any(r.budget_tokens > r.target_share * whole + 1 for r in shares)
    uses = {r.source: r.t for r in queries.p9_budgeted_mix(spark, data).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert uses == {r.source: r.tokens for r in shares if r.tokens}


def scan_fixture(spark):
    body = "The marker fell and the signal rose in all cells without any delay after treatment was given twice"
    rows = []

    def add(source, page, blk, text, kind="text"):
        rows.append((source, len(rows) + 1, f"B{len(rows):05d}", f"page {page}, text block {blk}" if page else f"paragraph {blk}", kind, text))

    for s in range(1, 9):
        for p in range(1, 5):
            add(s, p, 1, f"Journal of Made Things\n{body} by treatment group.\nA control group was kept for each of them.")
            add(s, p, 2, f"{body}.\nA time-course of treatment was planned.\nWe saw 12 treatment effects.")
            add(s, p, 3, f"{100 + p}")
    add(1, 5, 1, "Journal of Madc Things\nThe rnarker fell and the treat-\nment was given with a time-\ncourse after the trea¬")
    add(1, 5, 2, "105")
    add(1, 6, 1, "Journal of Made Things\ntment. A signa1 rose in AB12Q5.\nThe delay was 2-\n4 days.")
    add(1, 6, 2, "G1 5 7\n27\nG2 7 9", "table")
    add(1, 6, 3, "106")
    add(9, None, 1, "Journal of Made Things\nThe signal rose with-\nout any delay.")
    add(9, None, 2, None)
    add(9, None, 3, "")
    rows.append((10, 1, "Z", None, None, "The treat-\nment"))
    return rows, spark.createDataFrame(rows, "source_id long, ordinal int, block_id string, locator string, kind string, original string").withColumn("page", F.lit("clash"))


def test_scan_noise(spark):
    rows, df = scan_fixture(spark)
    blocks = {r[2]: r for r in rows}
    got = {(r.source_id, r.block_id, r.line_no, r.noise_kind, r.repaired) for r in scans.scan_noise(df).collect()}
    assert sum(x[3] == "running_header" for x in got) == 34 and sum(x[3] == "page_number" for x in got) == 34
    words = {(x[0], blocks[x[1]][5].split("\n")[x[2] - 1][:12], x[3], x[4]) for x in got if x[3] in ("hyphen", "char")}
    assert words == {
        (1, "The rnarker ", "char", "marker"), (1, "The rnarker ", "hyphen", "treatment"), (1, "ment was giv", "hyphen", "time-course"), (1, "course after", "hyphen", "treatment"),
        (1, "tment. A sig", "char", "signal"), (9, "The signal r", "hyphen", "without"), (10, "The treat-", "hyphen", "treatment"),
    }
    assert scans.scan_noise(df.limit(0)).collect() == []


def test_paragraphs(spark):
    _, df = scan_fixture(spark)
    text = {(r.source_id, r.page, r.blk): r.text for r in scans.repaired_paragraphs(df).collect()}
    assert text[1, 5, 1] == "The marker fell and the treatment was given with a time-course after the treatment."
    assert text[1, 6, 1].startswith("A signal rose in AB12Q5.") and text[1, 6, 2] == "G1 5 7\n27\nG2 7 9"
    assert (1, 6, 3) not in text and next(t for k, t in text.items() if k[0] == 9).endswith("without any delay.")


def test_headers_with_lost_and_doubled_letters(spark):
    """A head line differs from the one on most pages by a lost, a doubled or two wrong letters; a body line that differs more stays."""
    heads = ["Annals of Airway Studies"] * 8 + ["Annals of Airwy Studies", "Annals of Aiirway Studies", "Amnals of Airvay Studies", "Anecdotes of Hallway Life"]
    rows = [(1, i, f"B{i:05d}", f"page {i + 1}, text block 1", "text", f"{h}\nthe {w} cell of sample {w} grew in {w} serum\nand was counted by {w} hands on day {w}\nwhere {w} colonies were left\n") for i, (h, w) in enumerate(zip(heads, "one two six ten red blue warm cold wide thin long short".split()))]
    df = spark.createDataFrame(rows, "source_id long, ordinal int, block_id string, locator string, kind string, original string")
    found = {r.block_id for r in scans.scan_noise(df).filter("noise_kind = 'running_header' and line_no = 1").collect()}
    assert found == {f"B{i:05d}" for i in range(11)}


def test_changed_names_are_found(spark, data):
    """Items whose names are replaced throughout, each name by another one: documents made of them are re-parameterised, none is lost."""
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    ordinary = leakage.ordinary_words(docs, items, "doc_id", "item_id", "text")
    names = {w for r in items.collect() for w in leakage.words_of(r.text) if leakage.slot(w, ordinary) == "$"}
    assert {"fendrazole", "quelimab"} <= names and len(names) < len(ordinary)
    fake = {w: f"zorb{''.join(chr(97 + int(d)) for d in str(i))}ix" for i, w in enumerate(sorted(names))}
    some = [(r.item_id, " ".join(fake.get(w, w) for w in leakage.words_of(r.text))) for r in items.collect() if len(leakage.words_of(r.text)) >= 30]
    changed = [(1_000_000 + k, t) for k, t in some if any(w in fake.values() for w in t.split())]
    got = {(r.doc_id - 1_000_000, r.item_id) for r in leakage.leak_report(docs.unionByName(spark.createDataFrame(changed, "doc_id long, text string")), items).collect() if r.doc_id >= 1_000_000}
    assert len(changed) > 50 and len({(k - 1_000_000, k - 1_000_000) for k, _ in changed} & got) >= 0.99 * len(changed)
    # a window with a changed name in it is shared as well: the template has more windows than the words
    shared = leakage.shared_windows(spark.createDataFrame(changed, "doc_id long, text string").unionByName(docs), items).filter("doc_id - 1000000 = item_id")
    with_name = shared.filter(F.col("words") != F.col("item_words")).count()
    assert with_name > 0.5 * sum(1 for k, t in changed for i in range(len(t.split()) - 11) if any(w in fake.values() for w in t.split()[i : i + 12]))
