"""Tables, line sets and gene sets from files, with the line each row came from."""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = "__"


def header_problems(names: list[str]) -> list[str]:
    """What makes a header unusable: blank, repeated or reserved names."""
    out = []
    if any(not n for n in names):
        out.append("blank column name")
    if len(set(names)) < len(names):
        out.append("repeated column name")
    if any(n.startswith(RESERVED) for n in names):
        out.append("reserved column name")
    return out


def physical_rows(text: str, sep: str) -> Iterator[tuple[int, list[str]]]:
    """(line a row starts on, fields); line breaks inside quotes belong to the row."""
    reader = csv.reader(io.StringIO(text), delimiter=sep, strict=True)
    before = 0
    for fields in reader:
        yield before + 1, fields
        before = reader.line_num


def table_of(text: str, sep: str, header_row: int = 1) -> tuple[list[str], list[tuple[int, list[str | None]]]]:
    """(names, rows) of a delimited text: all text, empty cells null, wholly empty rows and trailing empty columns dropped."""
    rows = list(physical_rows(text.lstrip("﻿"), sep))
    if len(rows) < header_row:
        raise ValueError("no header row")
    names = [n.strip() for n in rows[header_row - 1][1]]
    body = rows[header_row:]
    while names and not names[-1] and all(len(f) < len(names) or not f[len(names) - 1] for _, f in body):
        names.pop()
        body = [(i, f[: len(names)]) for i, f in body]
    problems = header_problems(names)
    if problems:
        raise ValueError("; ".join(problems))
    out = []
    for i, f in body:
        if not any(f):
            continue
        if len(f) != len(names):
            raise ValueError(f"line {i} has {len(f)} fields, not {len(names)}")
        out.append((i, [x or None for x in f]))
    return names, out


MOST_BYTES = 1 << 30
"""A quoted file is one stream for one task; larger ones are refused and belong to ``parse_lines``."""
HEAD_LINES = 1000
"""A header ends within so many lines."""


def read_table(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """The rows of .csv, .tsv or .txt files of one header as text columns with ``__source_row``, ``__source_file`` and ``__source_sha256``.

    One file is one quoted stream, so it is parsed in one task and may hold ``MOST_BYTES``; a folder
    of plain line files is what ``parse_lines`` reads in parallel. The driver reads the first lines only.
    """
    sep = "," if path.lower().endswith(".csv") else "\t"
    top = "\n".join(r.value for r in spark.read.text(path).limit(HEAD_LINES).collect()).lstrip("﻿")
    rows = []
    try:
        for row in physical_rows(top, sep):
            rows.append(row)
            if len(rows) == header_row:
                break
    except csv.Error:  # the text ends within quotes
        pass
    if len(rows) < header_row:
        raise ValueError("no header row")
    head = [n.strip() for n in rows[-1][1]]
    while head and not head[-1]:
        head.pop()
    if problems := header_problems(head):
        raise ValueError("; ".join(problems))
    files = spark.read.format("binaryFile").load(path)
    too_large = F.raise_error(F.concat(F.lit("too large for one quoted stream: "), "path")).cast("binary")
    files = files.select("path", F.when(F.col("length") > MOST_BYTES, too_large).otherwise(F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                digest = hashlib.sha256(bytes(data)).hexdigest()
                names, rows = table_of(bytes(data).decode("utf-8-sig"), sep, header_row)
                if names != head:
                    raise ValueError(f"another header in {p}")
                yield pd.DataFrame([(*f, i, p, digest) for i, f in rows], columns=[*head, "__source_row", "__source_file", "__source_sha256"])

    return files.mapInPandas(run, ", ".join(f"`{n}` string" for n in head) + ", __source_row int, __source_file string, __source_sha256 string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The distinct non-blank lines of a file, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''").distinct()


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """``term, gene`` of a GMT file; refuses rows without members and repeated terms."""
    rows = spark.read.text(path).filter("trim(value) <> ''").select(F.split("value", "\t").alias("f"))
    sets = rows.select(F.get("f", F.lit(0)).alias("term"), F.filter(F.slice("f", 3, F.greatest(F.size("f"), F.lit(1))), lambda g: g != "").alias("genes"), F.size("f").alias("n"))
    if sets.filter("n < 3").limit(1).count():
        raise ValueError("a gene set needs a term, a description and members")
    if sets.groupBy("term").count().filter("count > 1").limit(1).count():
        raise ValueError("repeated term")
    return sets.select("term", F.explode("genes").alias("gene"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file: an array, or an object with ``records``."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode("records").alias("r")).select("r.*") if "records" in df.columns else df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
