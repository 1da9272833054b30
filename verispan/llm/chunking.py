"""Oversized texts as pieces under a token limit, cut at content-defined natural boundaries.

A rolling hash over token ids marks landmarks that depend only on nearby content. From each cut the
first landmark beyond the minimum size is taken and moved to the best natural boundary near it:
paragraph, then sentence or line, then word. An edit therefore moves cuts only until the next
landmark that both versions share. Each piece but the first starts ``overlap`` tokens before its cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.llm.tokens import DEFAULT, tokenizer
from verispan.scale import spread

WINDOW = 16  # tokens under the rolling hash
SPACING = 128  # a landmark every so many tokens on average
NEAR = 96  # a landmark moves at most so far to reach a stronger boundary
PARAGRAPH = re.compile(rb"\n[ \t\r]*\n\s*")
SENTENCE = re.compile(rb"[.!?][\"')\]*]*(?=\s)|\n|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xef\xbc\x9b")
WORD = re.compile(rb"(?=\s)|\xef\xbc\x8c")


def landmarks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the ``WINDOW`` ids before them hits the mask."""
    n = len(ids)
    if n < WINDOW:
        return np.empty(0, np.int64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            h = h * np.uint64(0xD6E8FEB86659FD93) + x[i : n - WINDOW + 1 + i]
        h ^= h >> np.uint64(29)
    return np.flatnonzero(h % np.uint64(SPACING) == 0) + WINDOW


def boundaries(raw: bytes, starts: np.ndarray) -> list[np.ndarray]:
    """Token positions at which a paragraph, a sentence or line, a word starts, and any whole character."""
    out = []
    for pattern in (PARAGRAPH, SENTENCE, WORD):
        at = np.array([m.end() for m in pattern.finditer(raw)], np.int64)
        k = np.searchsorted(starts, at)
        k = k[k < len(starts)]
        at = at[: len(k)]
        out.append(np.unique(k[starts[k] == at]))
    whole = np.frombuffer(raw, np.uint8)[starts] & 0xC0 != 0x80
    out.append(np.flatnonzero(whole))
    return out


def cuts(ids: np.ndarray, raw: bytes, starts: np.ndarray, least: int, most: int) -> list[int]:
    """Cut positions in tokens from 0 to ``len(ids)``; no segment is longer than ``most``."""
    n, done = len(ids), [0]
    marks, levels = landmarks(ids), boundaries(raw, starts)

    def near(kind: np.ndarray, at: int, low: int, high: int) -> int | None:
        a, b = np.searchsorted(kind, (low, high + 1))
        if a == b:
            return None
        part = kind[a:b]
        return int(part[np.argmin(np.abs(part - at))])

    while n - done[-1] > most:
        low, high = done[-1] + least, done[-1] + most
        k = np.searchsorted(marks, low)
        at = int(marks[k]) if k < len(marks) and marks[k] <= high else high
        found = None
        for kind in levels[:2]:  # a strong boundary near the landmark, else anywhere in reach
            found = found or near(kind, at, max(low, at - NEAR), min(high, at + NEAR))
        for kind in levels:
            found = found or near(kind, at, low, high)
        done.append(found or high)
    return [*done, n]


def pieces_of(text: str, limit: int, overlap: int, path: str) -> list[tuple[int, int, int]]:
    """(first byte, end byte, tokens) of the pieces of a text of more than ``limit`` tokens, else nothing."""
    tok = tokenizer(path)
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= limit:  # a token has at least one byte
        return []
    ids = np.array(tok.encode(text), np.int64)
    if len(ids) <= limit:
        return []
    ends = np.cumsum(tok.length[ids])
    starts = np.concatenate(([0], ends[:-1]))
    whole = np.frombuffer(raw, np.uint8)[starts] & 0xC0 != 0x80
    slack = 8  # a piece that starts inside a word may take a few tokens more when it is encoded by itself
    while True:
        most = limit - overlap - slack
        at = cuts(ids, raw, starts, max(1, most // 2), max(1, most))
        out = []
        for i in range(len(at) - 1):
            first = max(0, at[i] - overlap) if i else 0
            while not whole[first]:
                first -= 1
            end = len(raw) if at[i + 1] == len(ids) else int(starts[at[i + 1]])
            out.append((int(starts[first]), end, tok.count(raw[starts[first] : end].decode("utf-8", "replace"))))
        if most <= 1 or max(n for _, _, n in out) <= limit:
            return out
        slack *= 2


def split_oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2048, overlap: int = 128, tokens: str = DEFAULT, with_text: bool = True) -> DataFrame:
    """The pieces of each text above ``limit`` tokens: ``key, piece_no, pieces, n_tokens, start_byte, end_byte`` and ``piece``.

    Consecutive pieces share ``overlap`` tokens (one more or two where a token ends inside a
    character); every byte of the text is in a piece. ``n_tokens`` is what the piece has when it is
    encoded by itself; a text of which a piece exceeds the limit that way is cut again with more room. ``tokens`` is the tokenizer's file.

    Defined cases: null, empty and short texts give no rows; a text without any boundary is cut
    between whole characters; rows repeated with the same key are cut each; an empty table gives an
    empty result; other columns are ignored.
    """
    kind = dict(df.dtypes)[key]
    long = df.select(F.col(key).alias("__key"), F.col(text).alias("text")).filter(F.octet_length("text") > limit)
    schema = f"__key {kind}, piece_no int, pieces int, n_tokens int, start_byte long, end_byte long" + (", piece string" if with_text else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["__key", "piece_no", "pieces", "n_tokens", "start_byte", "end_byte"] + ["piece"] * with_text
        for pdf in batches:
            rows: list = []
            size = 0
            for k, t in zip(pdf["__key"], pdf["text"]):
                found = pieces_of(t, limit, overlap, tokens)
                raw = t.encode("utf-8", "surrogatepass") if found and with_text else b""
                for i, (a, b, n) in enumerate(found):
                    rows.append((k, i, len(found), n, a, b, *([raw[a:b].decode("utf-8", "replace")] if with_text else [])))
                    size += b - a
                if size > 4_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return spread(long).mapInPandas(cut, schema).withColumnRenamed("__key", key)
