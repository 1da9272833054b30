"""Paged remote searches as a Python data source with an injected transport.

``format("paged")`` reads one partition per query. A transport is any importable callable
``module:function`` taking (url, params) and returning a decoded JSON page, so tests and offline runs
use fixtures. Pages, rows and repeats are bounded; a late failure keeps the earlier pages.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from verispan.operators.nested import scalar


def pick(page, path: str):
    """The value under a dotted path; list positions are numbers; None if it is missing."""
    for part in path.split(".") if path else ():
        if isinstance(page, list) and part.isdigit() and int(part) < len(page):
            page = page[int(part)]
        elif isinstance(page, dict) and part in page:
            page = page[part]
        else:
            return None
    return page


def https_json(url: str, params: dict) -> dict:
    """One GET over https with a time and size limit."""
    if not url.startswith("https://"):
        raise ValueError("only https is read")
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=25) as answer:
        data = answer.read(16 * 1024 * 1024 + 1)
    if len(data) > 16 * 1024 * 1024:
        raise ValueError("the answer is too large")
    return json.loads(data)


class PagedSource(DataSource):
    """Options: url, queries (JSON list), record_path, limit, pages, page_size, mode offset or cursor, offset_param, size_param, cursor_path, cursor_param, total_path, transport."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, page int, position int, row_sha256 string, record string, stop_reason string, expected_total long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        o = self.o = {k.lower(): v for k, v in options.items()}
        self.limit, self.pages, self.size = int(o.get("limit", 100)), int(o.get("pages", 3)), int(o.get("page_size", 50))
        if not (1 <= self.limit <= 1000 and 1 <= self.pages <= 20 and 1 <= self.size <= 100):
            raise ValueError("bounds are 1..1000 records, 1..20 pages, 1..100 a page")
        self.queries = json.loads(o["queries"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, query = self.o, partition.value
        module, _, name = o.get("transport", "verispan.sources.paged:https_json").partition(":")
        fetch = getattr(importlib.import_module(module), name)
        seen: set[str] = set()
        cursors: set[str] = set()
        rows, cursor, total, stop = [], o.get("first_cursor", "*"), None, "page_limit"
        for page in range(self.pages):
            params = {o.get("query_param", "query"): query, o.get("size_param", "size"): self.size}
            if o.get("mode", "offset") == "offset":
                params[o.get("offset_param", "offset")] = page * self.size
            else:
                params[o.get("cursor_param", "cursor")] = cursor
            try:
                answer = fetch(o["url"], params)
            except Exception as e:
                stop = f"failed: {type(e).__name__}"
                break
            found = pick(answer, o.get("record_path", "results")) or []
            got = pick(answer, o["total_path"]) if "total_path" in o else None
            total = int(scalar(got)) if got is not None else total
            for i, record in enumerate(found):
                text = json.dumps(record, ensure_ascii=False, sort_keys=True)
                sha = hashlib.sha256(text.encode()).hexdigest()
                if sha not in seen:
                    seen.add(sha)
                    rows.append((query, page, i, sha, text))
            if len(rows) >= self.limit:
                stop = "limit"
                break
            if len(found) < self.size:
                stop = "exhausted"
                break
            if o.get("mode", "offset") == "cursor":
                cursors.add(cursor)
                cursor = pick(answer, o.get("cursor_path", "next"))
                if not cursor or cursor in cursors:
                    stop = "exhausted" if not cursor else "repeated_cursor"
                    break
        for r in rows[: self.limit]:
            yield (*r, stop, total)
        if not rows:
            yield (query, None, None, None, None, stop, total)


def register(spark) -> None:
    """Make ``format("paged")`` known to a session."""
    spark.dataSource.register(PagedSource)
