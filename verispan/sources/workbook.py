"""Sheets of a workbook file (zipped XML) as text tables, read with the standard library."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from verispan.sources.tables import header_problems

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_of(ref: str) -> int:
    """The zero-based column of a cell reference."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> dict[str, list[tuple[int, list[str | None]]]]:
    """Sheet name -> (row number, cells); empty cells are null, numbers keep their text."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{M}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{M}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{M}sheet"):
            target = targets[s.get(R)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for i, row in enumerate(root.iter(f"{M}row"), 1):
                cells: list[str | None] = []
                for j, c in enumerate(row.iter(f"{M}c")):
                    at = column_of(c.get("r")) if c.get("r") else j
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find(f"{M}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{M}t")) or None
                    elif v is not None and v.text:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else {"1": "true", "0": "false"}.get(v.text, v.text) if c.get("t") == "b" else v.text
                rows.append((int(row.get("r") or i), cells))
            out[s.get("name")] = rows
    return out


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """One sheet as text columns with ``__source_row`` and ``__source_sheet``; without a name there must be only one sheet."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    found = sheets(bytes(data))
    if sheet is None:
        if len(found) != 1:
            raise ValueError(f"name one of the sheets {sorted(found)}")
        sheet = next(iter(found))
    if sheet not in found:
        raise ValueError(f"no sheet {sheet}")
    rows = found[sheet]
    head = next((c for n, c in rows if n == header_row), [])
    names = [(x or "").strip() for x in head]
    while names and not names[-1] and all(len(c) < len(names) or c[len(names) - 1] is None for n, c in rows if n > header_row):
        names.pop()
    problems = header_problems(names)
    if problems:
        raise ValueError("; ".join(problems))
    body = []
    for n, c in rows:
        if n > header_row and any(x is not None for x in c):
            if any(x is not None for x in c[len(names) :]):
                raise ValueError(f"row {n} has more cells than the header")
            body.append((*(c + [None] * len(names))[: len(names)], n, sheet))
    return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names) + ", __source_row int, __source_sheet string")
