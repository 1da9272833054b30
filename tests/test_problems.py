"""Rejects, timestamps and nested records against plain Python on whole small tables and on edge cases."""

import datetime as dt
import json
import math
import re
from collections import Counter
from zoneinfo import ZoneInfo

import pytest

from verispan.operators import nested, rejects, timestamps
from verispan.plans import problems
from verispan.plans.problems import SHAPES


def fields_of(line, sep):
    """The fields of a line, or None if its quoting is broken."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i += 1
            text = ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                text += line[i:j]
                i = j + 1
                if line[i : i + 1] == '"':
                    text += '"'
                    i += 1
                else:
                    break
            if i < len(line) and line[i] != sep:
                return None
        else:
            j = line.find(sep, i)
            j = len(line) if j < 0 else j
            text = line[i:j]
            if '"' in text:
                return None
            i = j
        out.append(text)
        if i >= len(line):
            return out
        i += 1


def reason_of(line, sep, order):
    f = fields_of(line, sep)
    if f is None:
        return "quoting"
    if len(f) != 6:
        return "column_count"
    row = dict(zip(order, f))
    if not row["feature"].strip() or not row["sample"].strip():
        return "invalid_value"
    v = row["value"].strip()
    if v and not (re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", v) and math.isfinite(float(v))):
        return "invalid_value"
    return None


def test_rejects_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/assay_lines.parquet").collect()
    orders = {}
    for r in rows:
        if r.line_no == 1:
            sep = "\t" if r.source_file.endswith(".tsv") else ","
            orders[r.source_file] = (sep, fields_of(r.raw_line, sep))
    want = {r.line_id: reason_of(r.raw_line, *orders[r.source_file]) for r in rows if r.line_no != 1}
    got = {r.line_id: r for r in rejects.parse_lines(spark.read.parquet(f"{data}/assay_lines.parquet")).collect()}
    assert {k: r.reason for k, r in got.items()} == want
    for r in rows:
        if r.line_no != 1 and want[r.line_id] is None:
            row = dict(zip(orders[r.source_file][1], fields_of(r.raw_line, orders[r.source_file][0])))
            g = got[r.line_id]
            assert (g.feature, g.sample) == (row["feature"], row["sample"])
            assert g.value == (float(row["value"]) if row["value"].strip() else None)
    assert {r.line_id for r in problems.p3_found(spark, data).collect()} == {k for k, v in want.items() if v}


def test_rejects_edges(spark):
    long = '"' + 'a""' * 30_000 + '"'
    rows = [
        (1, "a.csv", 1, '﻿"value",sample,feature,unit,group,technical', 9),
        (2, "a.csv", 2, "1e999,s,f,u,g,1", 9),
        (3, "a.csv", 3, f"1,s,{long},u,g,1", 9),
        (4, "a.csv", 4, None, 9),
        (5, "a.csv", 5, "", 9),
        (6, "a.csv", 6, ' .5 ,s,"f ""x""",u,g,', 9),
        (7, "b.tsv", 2, "a\tb", 9),
        (8, "b.tsv", 3, 'a"\tb', 9),
        (9, None, None, "1,2", None),
        (10, "c.csv", 1, "feature,sample", 9),
        (11, "c.csv", 2, "x,y", 9),
        (12, "a.csv", 7, "1,\xa0,f,u,g,1", 9),
        (13, "a.csv", 7, "1,\xa0,f,u,g,1", 9),
        (14, "a.csv", 8, "1,s,f,u,g", 9),
        (15, "a.csv", 9, "x,s,f,u,g,1", 9),
    ]
    df = spark.createDataFrame(rows, "line_id long, source_file string, line_no int, raw_line string, sep int")
    got = {r.line_id: r for r in rejects.parse_lines(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        2: "invalid_value", 3: None, 4: "column_count", 5: "column_count", 6: None, 7: "no_schema", 8: "quoting", 9: "no_schema",
        11: "no_schema", 12: "invalid_value", 13: "invalid_value", 14: "column_count", 15: "invalid_value",
    }
    assert got[6].value == 0.5 and got[6].feature == 'f "x"' and len(got[3].feature) == 60_000
    assert (got[12].broken_field, got[14].broken_field, got[15].broken_field, got[2].broken_field) == ("sample", "technical", "value", "value")
    assert rejects.parse_lines(df.limit(0)).collect() == []


MONTHS = {m: i + 1 for i, m in enumerate(timestamps.MONTHS)}


def zoned(y, mo, d, h, mi, s, zone):
    try:
        wall = dt.datetime(y, mo, d, h, mi, s)
    except ValueError:
        return None
    if isinstance(zone, str):
        z = ZoneInfo(zone)
        # fold=0: the first of two wall times, and the offset before the jump of a skipped one
        off = wall.replace(tzinfo=z, fold=0).utcoffset()
    else:
        off = zone
    return (wall - off).strftime("%Y-%m-%dT%H:%M:%SZ")


def form_of(text, zone, day_first):
    s = " ".join(text.split()).strip("﻿ ")
    if re.fullmatch(r"[0-9]{10}|[0-9]{13}", s):
        return dt.datetime.fromtimestamp(int(s[:10]), dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    s = re.sub(r"^[A-Z][a-z]{2}, ", "", s)
    time = None
    m = re.fullmatch(r"(.*\d),?[ Tt]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?(?: ([AP]M))? ?(.*)", s) or re.fullmatch(
        r"([0-9]{8})T([0-9]{2})([0-9]{2})([0-9]{2})()(.*)", s
    )
    if m:
        s = m[1]
        h = int(m[2])
        if m[5]:
            h = h % 12 + 12 * (m[5] == "PM")
        z = m[6].strip("[]")
        fixed = timestamps.ABBREVIATIONS.get(z.upper())
        if z == "":
            z = zone
        elif fixed or z[0] in "+-":
            t = (fixed or z).replace(":", "")
            z = dt.timedelta(minutes=int(t[1:3]) * 60 + int(t[3:5])) * (-1 if t[0] == "-" else 1)
        time = (h, int(m[3]), int(m[4] or 0), z)
    for pattern, order in (
        (r"(\d{4})([-/.])(\d\d?)\2(\d\d?)", "y-md"), (r"(\d{4})-(\d\d)", "ym"), (r"(\d{4})", "y"), (r"(\d{4})(\d\d)(\d\d)", "ymd"),
        (r"(\d\d?)([-/.])(\d\d?)\2(\d{4})", "d-my" if day_first else "m-dy"), (r"(\d\d?) ([A-Z][a-z]+) (\d{4})", "dMy"),
        (r"([A-Z][a-z]+) (\d\d?), (\d{4})", "Mdy"), (r"(\d{4}) ([A-Z][a-z]+) (\d\d?)", "yMd"), (r"([A-Z][a-z]+) (\d{4})", "My"),
    ):
        m = re.fullmatch(pattern, s)
        if m:
            got = {}
            for k, v in zip(order, m.groups()):
                if k == "M":
                    got["m"] = MONTHS.get(v[:3].lower(), 0)
                elif k != "-":
                    got[k] = int(v)
            break
    else:
        m = re.fullmatch(r"(\d{4})-(\d{3})", s)
        if not m:
            return None
        try:
            day = dt.date(int(m[1]), 1, 1) + dt.timedelta(days=int(m[2]) - 1)
        except (ValueError, OverflowError):
            return None
        return day.isoformat() if day.year == int(m[1]) and m[2] != "000" else None
    try:
        dt.date(got["y"], got.get("m", 1), got.get("d", 1))
    except ValueError:
        return None
    if time:
        return zoned(got["y"], got["m"], got["d"], *time)
    return "-".join(f"{got[k]:0{4 if k == 'y' else 2}d}" for k in "ymd" if k in got)


def parts_of(parts):
    if not parts or not parts[0] or parts[0][0] is None:
        return None
    got = [*parts[0], None, None]
    n = 1 + (got[1] is not None) + (got[1] is not None and got[2] is not None)
    try:
        dt.date(got[0], *([*got[1:n], 1, 1][:2]))
    except ValueError:
        return None
    return "-".join(f"{x:0{4 if i == 0 else 2}d}" for i, x in enumerate(got[:n]))


def test_dates_against_brute_force(spark, data):
    feeds = {r.provider: r for r in spark.read.parquet(f"{data}/feeds.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{data}/date_evidence.parquet").collect():
        f = feeds[r.provider]
        form = parts_of(r.date_parts)
        if form is None and r.first_publication_date is not None:
            form = form_of(r.first_publication_date, f.zone, f.day_first)
        if form:
            want[r.evidence_id] = form
    got = [(r.evidence_id, r.normal_form) for r in problems.p5_found(spark, data).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_padded_dates(spark):
    pad = " \t\n\u00a0" * 100
    texts = [f"{pad}2020-02-29{pad}", f"24{pad}Dec.{pad}2020", f"2020-02-29{pad}x", "2020-02-29" + "x" * 300, pad]
    df = spark.createDataFrame([(i, t, None, "p") for i, t in enumerate(texts)], "id long, txt string, parts array<array<int>>, provider string")
    feeds = spark.createDataFrame([("p", "UTC", True)], "provider string, zone string, day_first boolean")
    got = {r.id: r.normal_form for r in timestamps.normalise_dates(df, feeds, "id", "txt", "parts", "provider").collect()}
    assert got == {0: "2020-02-29", 1: "2020-12-24", 2: None, 3: None, 4: None}


@pytest.mark.parametrize("zone", ["America/New_York", None])
def test_date_edges(spark, zone, tmp_path):
    texts = ["2021-03-14 02:30", "2021-11-07 01:30", "2021-02-29", "2020-02-29", "2019-366", "24 Dec. 2020", "2021-06-01T10:00:00+99:00", "2021-06-01T10:00:00 Mars/Base",
             "x" * 100_000, "", None, "2021-06-01T12:00:00[Europe/Berlin]", "1 Jan 0000", "12/11/2020", "0001-01-01", "Dec 1, 2020 12:05 AM EST", "2016-12-31T23:59:60Z"]
    rows = [(i, t, None, "p" if i % 20 != 19 else "q", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, txt string, parts array<array<int>>, provider string, zone string")
    feeds = spark.createDataFrame([("p", zone, True), (None, "UTC", True)], "provider string, zone string, day_first boolean")
    path = "file://" + str(tmp_path / "dictionary")
    got = {r.id: r.normal_form for r in timestamps.normalise_dates(df, feeds, "id", "txt", "parts", "provider", path).collect()}
    ny = zone is not None
    want = ["2021-03-14T07:30:00Z" if ny else None, "2021-11-07T05:30:00Z" if ny else None, None, "2020-02-29", None, "2020-12-24", None, None, None, None, None,
            "2021-06-01T10:00:00Z", None, "2020-11-12", "0001-01-01", "2020-12-01T05:05:00Z", None]
    assert [got[i] for i in range(len(texts))] == want
    n = spark.read.parquet(path).count()
    again = df.union(spark.createDataFrame([(99, "5 May 2020", None, "p", None)], df.schema))
    timestamps.normalise_dates(again, feeds, "id", "txt", "parts", "provider", path).collect()
    assert spark.read.parquet(path).count() == n + 1  # only the unseen text was parsed
    assert timestamps.normalise_dates(df.limit(0), feeds, "id", "txt", "parts", "provider").collect() == []


def paths_of(body):
    def opened(x):
        if isinstance(x, str) and x[:1] in "{[":
            return json.loads(x)
        return x

    def entries(x, name, own):
        x = opened(x)
        if x is None:
            return []
        if isinstance(x, list):
            return [opened(y) for y in x]
        if isinstance(x, dict) and name not in x and not (x.keys() & own):
            return [{name: k, **v} for k, v in x.items()]
        return [x]

    b = json.loads(body)
    path = (b.get("request") or {}).get("path") or ""
    answer = opened(b.get("response")) or {}
    for r in entries(answer.get("records"), "accession", {"genes", "comments", "organism"}):
        for g in entries(r.get("genes"), "symbol", {"xrefs"}):
            for x in entries(g.get("xrefs"), "id", {"db"}):
                yield path, "records", r["accession"], g["symbol"], x if isinstance(x, str) else f"{x['db']}:{x['id']}"
    for r in entries((opened(answer.get("details")) or {}).get("regions"), "name", {"tracks"}):
        for t in entries(r.get("tracks"), "track", {"hits"}):
            for h in entries(t.get("hits"), "hit", {"extra"}):
                yield path, "details", r["name"], t["track"], h["hit"]


def test_nested_against_brute_force(spark, data):
    want = Counter((r.check_id, *p) for r in spark.read.parquet(f"{data}/database_checks.parquet").collect() for p in paths_of(r.body))
    assert Counter(tuple(r) for r in problems.p6_found(spark, data).collect()) == want


def test_nested_edges(spark):
    one = '{"request": {"path": null}, "response": {"records": [{"accession": "A", "genes": {"symbol": "G", "xrefs": ["X:1", "X:1", null, {"id": 1, "db": "X"}]}}]}}'
    two = '{"response": {"records": [{"genes": [{"xrefs": [{"db": "X", "id": "1"}, "X:1", "X:1"], "symbol": "G"}], "accession": "A"}]}, "request": {"path": null}}'
    deep = "[" * 100_000 + "]" * 100_000
    rows = [(1, one, 5), (2, two, 5), (2, two, 5), (3, None, 5), (4, "", 5), (5, "{broken", 5), (6, deep, 5), (7, "[1, 2]", 5), (8, "3", None)]
    df = spark.createDataFrame(rows, "check_id long, body string, root_id int")
    flat = nested.flatten(df, "check_id", shapes=SHAPES)
    roots = [(r.check_id, r.root_id) for r in flat.roots.collect()]
    assert Counter(k for k, _ in roots) == Counter(r[0] for r in rows)
    by = dict(roots)
    assert by[3] is by[4] is by[5] is by[6] is None and by[7] and by[8]
    assert flat.objects.count() == flat.objects.select("node_id").distinct().count()
    # three spellings of one reference are one object; key order and shape of a branch do not matter
    assert flat.objects.filter("attributes['db'] = 'X'").count() == 1 and by[1] == by[2]
    got = Counter(tuple(r) for r in nested.branch_paths(flat, "check_id").collect())
    assert got == Counter({(1, "", "records", "A", "G", "X:1"): 3, (2, "", "records", "A", "G", "X:1"): 6})
    assert nested.branch_paths(nested.flatten(df.limit(0), "check_id", shapes=SHAPES), "check_id").collect() == []
