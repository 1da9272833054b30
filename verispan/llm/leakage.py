"""Evaluation passages in a training corpus.

Words are canonicalised to a template: numbers, units, code-like words and names become typed
placeholders. A name is known by its use, not by its letter case in one text: of the words of the
items those are names that a public tokenizer has no whole or half word for, that the corpus hardly
knows, or that it writes with a capital inside sentences. Every word of a document that is no
ordinary word of the items counts as a name, too, so that it can stand where an item has another.

Windows of the template are hash-joined, then the slots are compared: equal slots are a verbatim
passage, slots that map one to one are a re-parameterised question. A window with fewer than half
its words ordinary says too little as a template and is hashed with its own words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.llm.tokens import DEFAULT, tokenizer
from verispan.scale import spread, written

WORD = re.compile(r"[^\W_]+")
# Unit words that a re-parameterised question may change.
UNITS = frozenset(
    "mg g kg ug µg ng pg ml l ul µl nl mm cm m km um µm nm mmol mol nmol umol µmol s sec min h hr hrs hours hour minutes minute days day weeks week months month years year degrees percent hz khz bp kb mb".split()
)
CAPITAL = re.compile(r"(?:(?<=[^\W\d_] )|(?<=[,;] ))[A-Z][^\W_]+")
PIECES = 3
"""A name takes at least so many tokens of the tokenizer."""
RARE = 0.0005
"""A word in a smaller share of the documents is a name."""
MOST_WORDS = 2_000_000
"""The distinct words of the items are handled on the driver; more are refused."""
BLOOM_BITS = 1 << 27
"""The filter of item windows that the scan of the documents carries has at most so many bits (16 MB)."""
BROADCAST_WINDOWS = 100_000
"""Item windows are broadcast to the documents' if there are at most so many rows (some 20 MB); else both are shuffled."""


def words_of(text: str) -> list[str]:
    """The maximal runs of letters and digits in lower case."""
    found = WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


def slot(word: str, ordinary: frozenset[str]) -> str | None:
    """The placeholder of a word, None for an ordinary word."""
    if word.isdigit():
        return "#"
    if word in UNITS:
        return "%"
    if any(c.isdigit() for c in word):
        return "@"
    return None if word in ordinary else "$"


def word_hash(token: str) -> int:
    """64 bits of a template token."""
    import xxhash

    return xxhash.xxh64_intdigest(token)


class Hashes(dict):
    """word -> (hash of its template token, hash of the word, 1 if it is ordinary)."""

    def __init__(self, ordinary: frozenset[str]) -> None:
        super().__init__()
        self.ordinary = ordinary

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) > 500_000:
            self.clear()
        kind = slot(word, self.ordinary)
        h = self[word] = (word_hash(kind or word), word_hash(word), kind is None)
        return h


def ordinary_words(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str, tokens: str = DEFAULT) -> frozenset[str]:
    """The words of the items that are no names, by counts over all documents."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": sorted({w for t in pdf["text"] for w in words_of(t)})})

    some = items.filter(F.length(text) > 0).select(F.col(text).alias("text"))
    rows = some.mapInPandas(words, "word string").distinct().limit(MOST_WORDS + 1).toPandas()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in the items")
    vocabulary = frozenset(rows["word"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, capital, total = Counter(), Counter(), 0
        for pdf in batches:
            for t in pdf["text"]:
                total += 1
                n.update(vocabulary.intersection(words_of(t)))
                capital.update(vocabulary.intersection({w.lower() for w in CAPITAL.findall(t)}))
        yield pd.DataFrame({"word": ["", *n], "docs": [total, *n.values()], "capital": [0, *(capital[w] for w in n)]})

    rows = spread(docs.select(F.col(text).alias("text")).filter(F.length("text") > 0)).mapInPandas(count, "word string, docs long, capital long")
    seen = {r.word: r for r in rows.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("capital").alias("capital")).collect()}
    if "" not in seen:
        return vocabulary
    tok, total = tokenizer(tokens), seen[""].docs

    def is_name(w: str) -> bool:
        r = seen.get(w)
        return r is None or r.docs < RARE * total or r.capital >= 0.5 * r.docs or len(tok.encoding.encode_ordinary(" " + w)) >= PIECES

    return frozenset(w for w in vocabulary if not is_name(w))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 63-bit hash of each window of ``size`` token hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
        out ^= out >> np.uint64(31)
    return (out & np.uint64(0x7FFFFFFFFFFFFFFF)).astype(np.int64)


def template_hashes(found: list[tuple[int, int, int]], size: int) -> np.ndarray:
    """The hash of each window: of the template, or of the words themselves where fewer than half are ordinary."""
    t, w, o = (np.array(x, np.uint64) for x in zip(*found))
    known = np.concatenate(([0], np.cumsum(o.astype(np.int64))))
    return np.where(known[size:] - known[:-size] >= size // 2, window_hashes(t, size), window_hashes(w ^ np.uint64(0xA24BAED4963EE407), size))


WINDOWS = "__key {}, at int, window_hash long, words array<string>"


def probes(h, bits: int):
    """The two places of a hash in a filter of ``bits`` bits."""
    return h & (bits - 1), (h >> 31) & (bits - 1)


def _windows(size: int, ordinary: frozenset[str], bloom: np.ndarray | None):
    """A map over batches (key, text) to the template windows of each text, only those that may be in ``bloom`` if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes(ordinary)
        for pdf in batches:
            rows: list = []
            for k, text in zip(pdf["__key"], pdf["text"]):
                words = words_of(text) if text else []
                if len(words) < size:
                    continue
                h = template_hashes([known[w] for w in words], size)
                hits = range(len(h))
                if bloom is not None:
                    a, b = probes(h, 64 * len(bloom))
                    hits = np.flatnonzero((bloom[a >> 6] >> (a & 63).astype(np.uint64)) & (bloom[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1))
                rows += [(k, int(i), int(h[i]), words[i : i + size]) for i in hits]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["__key", "at", "window_hash", "words"])
                    rows = []
            yield pd.DataFrame(rows, columns=["__key", "at", "window_hash", "words"])

    return run


def template_windows(df: DataFrame, key: str, text: str, size: int, ordinary: frozenset[str], bloom: np.ndarray | None = None) -> DataFrame:
    """``key, at, window_hash, words`` for the template windows of ``size`` words."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("text")).filter(F.length("text") >= 2 * size - 1)
    return spread(rows).mapInPandas(_windows(size, ordinary, bloom), WINDOWS.format(kind)).withColumnRenamed("__key", key)


def window_filter(windows: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``n`` window hashes as 64-bit words: at most ``BLOOM_BITS``, whatever ``n`` is; bits are set by an aggregate."""
    bits = 1 << min(BLOOM_BITS.bit_length() - 1, max(12, (64 * n).bit_length()))
    h = F.col("window_hash")
    both = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftright(h, 31).bitwiseAND(F.lit(bits - 1))))
    words = windows.select(both.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    bloom = np.zeros(bits // 64, np.int64)
    bloom[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bloom.view(np.uint64)


def shared_windows(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", size: int = 12, tokens: str = DEFAULT, verbatim: bool = False) -> DataFrame:
    """Pairs of equal template windows: ``doc, item, at, item_at, words, item_words``; with ``verbatim`` only those of equal words.

    Defined cases: null and empty texts and texts shorter than ``size`` words share nothing; letter
    case is ignored; whole texts are read; repeated rows give repeated pairs; an empty table on
    either side gives an empty result; other columns are ignored.
    """
    ordinary = ordinary_words(docs, items, doc, item, text, tokens)
    of_items = template_windows(items, item, text, size, ordinary).select(item, F.col("at").alias("item_at"), "window_hash", F.col("words").alias("item_words"))
    of_items = written(of_items, "item-windows")
    n = of_items.count()
    of_docs = template_windows(docs, doc, text, size, ordinary, window_filter(of_items, n))
    same = of_docs["window_hash"] == of_items["window_hash"]
    if verbatim:  # part of the key, so that items of one template do not meet in one task
        same = same & (of_docs["words"] == of_items["item_words"])
    return of_docs.join(F.broadcast(of_items) if n <= BROADCAST_WINDOWS else of_items, same).drop(of_items["window_hash"])


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", size: int = 12, tokens: str = DEFAULT) -> DataFrame:
    """``doc, item``: the document holds at least ``size`` consecutive words of the item."""
    return shared_windows(docs, items, doc, item, text, size, tokens, verbatim=True).select(doc, item).distinct()


def leak_report(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", size: int = 12, tokens: str = DEFAULT) -> DataFrame:
    """Each pair of document and item that share template windows, as ``verbatim``, ``reparameterised`` or ``same_template``.

    ``reparameterised``: no window is verbatim, but each slot value of the item stands for one value
    in the document throughout and the other way round. ``windows`` counts shared windows.
    """
    shared = shared_windows(docs, items, doc, item, text, size, tokens)
    shared = shared.withColumn("verbatim", F.col("words") == F.col("item_words"))
    pairs = F.arrays_zip("words", "item_words")  # with the slots that stayed: a value must not stand for itself and another
    changed = shared.filter(~F.col("verbatim")).select(doc, item, F.explode(pairs).alias("p")).select(doc, item, F.col("p.words").alias("w"), F.col("p.item_words").alias("v")).distinct()
    one = changed.groupBy(doc, item, "v").agg(F.count("*").alias("n")).groupBy(doc, item).agg(F.max("n").alias("forward"))
    two = changed.groupBy(doc, item, "w").agg(F.count("*").alias("n")).groupBy(doc, item).agg(F.max("n").alias("back"))
    base = shared.groupBy(doc, item).agg(F.count("*").alias("windows"), F.sum(F.col("verbatim").cast("long")).alias("verbatim_windows"))
    out = base.join(one, [doc, item], "left").join(two, [doc, item], "left")
    kind = F.when(F.col("verbatim_windows") > 0, "verbatim").when((F.col("forward") == 1) & (F.col("back") == 1), "reparameterised").otherwise("same_template")
    return out.select(doc, item, "windows", "verbatim_windows", kind.alias("leak"))
