"""Records that differ only in formatting: one class each, with the number of copies.

Byte-identical raw rows are collapsed with counts first, so the costly canonical form is made once
per distinct spelling; distinct spellings are then grouped again on their full canonical text.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.scale import attach, written

DOI = re.compile(r"(?<![0-9.])10\.[0-9]{4,9}(?:\.[0-9]+)*/\S+")
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
PAIRS = {")": "(", "]": "[", "}": "{", ">": "<"}


def doi_key(text: str | None) -> str | None:
    """The identifier ``10.<registrant>/<suffix>`` in a text, in lower case; None if there is none.

    Percent encoding is resolved and whatever stands around it is cut: everything before, and at the
    end quotes, marks of punctuation and closing brackets without their opening one.
    """
    if not text:
        return None
    m = DOI.search(unquote(text) if "%" in text else text)
    if not m:
        return None
    doi = m[0]
    while doi:
        last = doi[-1]
        if last in ".,;:!?'\"`*|\\​﻿“”’" or (last in PAIRS and doi.count(last) > doi.count(PAIRS[last])):
            doi = doi[:-1]
        else:
            break
    doi = doi.lower()
    return doi if any(c.isalnum() for c in doi.partition("/")[2]) else None


def title_key(text: str | None) -> str | None:
    """The letters and digits of a title in order, after markup, character entities, case and Unicode encoding; None if there are none."""
    if not text:
        return None
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return "".join(c for c in text if c.isalnum()) or None


TAGGED = re.compile(r"^([A-Z][A-Z0-9]{1,3}) {0,3}- ?(.*)$")
PERCENT = re.compile(r"^%(\S) (.*)$")
BIBTEX = re.compile(r"\b(doi|title)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\")", re.I)


def raw_fields(entry: str | None) -> tuple[str | None, str | None]:
    """(doi text, title text) that an entry as received states: JSON, tagged lines, percent lines or BibTeX."""
    if not entry:
        return None, None
    text = entry.strip("﻿ \t\r\n")
    if text[:1] == "{":
        try:
            got = json.loads(text)
        except (ValueError, RecursionError):
            got = None
        if isinstance(got, dict):
            low = {k.lower(): v for k, v in got.items()}
            values = []
            for name in ("doi", "title"):
                v = low.get(name)
                v = v[0] if isinstance(v, list) and v else v
                values.append(v if isinstance(v, str) else None)
            return values[0], values[1]
    if text[:1] == "@":
        found = {m[1].lower(): m[2] if m[2] is not None else m[3] for m in BIBTEX.finditer(text)}
        title = found.get("title")
        return found.get("doi"), title and re.sub(r"[{}]", "", title)
    tags: dict[str, str] = {}
    last = None
    for line in text.splitlines():
        m = TAGGED.match(line) or PERCENT.match(line)
        if m:
            last = m[1]
            if last in ("AID", "LID") and "[doi]" not in m[2]:
                continue
            if last in tags:
                last = None
            else:
                tags[last] = m[2]
        elif last and line.strip():
            tags[last] += " " + line.strip()
    if not tags:
        return text, None
    pick = lambda *names: next((tags[n] for n in names if n in tags), None)
    return pick("DO", "R", "AID", "LID"), pick("TI", "T1", "T")


def _canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        dois, titles = [], []
        for doi, title, raw in zip(pdf["doi"], pdf["title"], pdf["raw"]):
            if doi is None and title is None:
                doi, title = raw_fields(raw)
            dois.append(doi_key(doi))
            titles.append(title_key(title))
        yield pd.DataFrame({"raw_id": pdf["raw_id"], "copies": pdf["copies"], "first_key": pdf["first_key"], "doi_key": dois, "title_key": titles})


def duplicate_classes(df: DataFrame, key: str = "rec_no", doi: str = "doi", title: str = "title", raw: str | None = "raw_entry") -> DataFrame:
    """One row per row of ``df``: ``key``, ``class_key`` (the smallest key of its class), ``copies``, ``doi_key``, ``title_key``.

    Defined cases: a record whose doi or title is absent (null, empty, or without an identifier or
    any letter or digit) is a class of its own, also beside exact copies of it; ``raw`` counts only
    where both columns are null; texts of any length are used whole; rows repeated with the same key
    stay rows; a null key sorts last; an empty table gives an empty result. Other columns are ignored.
    """
    spell = df.select(
        F.col(key).alias("__key"),
        F.col(doi).alias("doi"),
        F.col(title).alias("title"),
        (F.col(raw) if raw else F.lit(None).cast("string")).alias("raw"),
    )
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("doi", "title", "raw")]
    # 128 bits name a spelling where it need not be carried along
    spell = spell.withColumn("raw_id", F.unhex(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)))
    distinct = spell.groupBy("raw_id", "doi", "title", "raw").agg(F.count("*").alias("copies"), F.min("__key").alias("first_key"))
    kind = dict(spell.dtypes)["__key"]
    canon = written(distinct.mapInPandas(_canonical, f"raw_id binary, copies long, first_key {kind}, doi_key string, title_key string"), "duplicate-spellings")
    canon = canon.withColumnRenamed("copies", "rows_of")
    is_present = F.col("doi_key").isNotNull() & F.col("title_key").isNotNull()
    present = canon.filter(is_present)
    classes = present.groupBy("doi_key", "title_key").agg(F.min("first_key").alias("class_key"), F.sum("rows_of").alias("copies"), F.count("*").alias("spellings"))
    named = attach(present, classes, ["doi_key", "title_key"], "inner", weight="spellings")
    alone = canon.filter(~is_present).withColumns({"class_key": F.lit(None).cast(kind), "copies": F.lit(None).cast("long")})
    named = named.unionByName(alone).drop("first_key")
    out = attach(spell.select("__key", "raw_id"), named, ["raw_id"], "left", weight="rows_of")
    return out.select(
        F.col("__key").alias(key), F.coalesce("class_key", "__key").alias("class_key"), F.coalesce("copies", F.lit(1)).alias("copies"), "doi_key", "title_key"
    )
