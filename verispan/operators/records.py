"""Bibliographic records: identity, order-exact deduplication, ranking, comparison and export."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions.text import normalize_title, squeeze
from verispan.scale import attach, written

ID_ORDER = ("pmid", "pmcid", "arxiv", "openalex", "s2")
KEYS = ("doi", *ID_ORDER)


def record_id(doi: Column, identifiers: Column, fallback: Column) -> Column:
    """A versioned preprint, then the DOI, then the first other identifier, then a digest of ``fallback``."""
    arxiv = identifiers["arxiv"]
    named = [F.when(F.coalesce(identifiers[k], F.lit("")) != "", F.concat(F.lit(f"{k}:"), identifiers[k])) for k in ID_ORDER]
    return F.coalesce(F.when(arxiv.rlike("v[0-9]+$"), F.concat(F.lit("arxiv:"), arxiv)), F.concat(F.lit("doi:"), doi), *named, F.concat(F.lit("rec:"), F.substring(F.sha2(fallback, 256), 1, 20)))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of the graph record - block, given rows (node, block): the smallest node of each component.

    Labels spread over blocks and jump to the label of their label, so rounds grow with the logarithm
    of the longest chain; each round is a table in the shared folder.
    """
    edges = written(edges.select("node", "block").distinct(), "component-edges")
    labels = edges.select("node").distinct().withColumn("component", F.col("node"))
    labels = written(labels, "component-labels")
    for _ in range(most_rounds):
        low = edges.join(labels, "node").groupBy("block").agg(F.min("component").alias("low"))
        new = edges.join(low, "block").groupBy("node").agg(F.min("low").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = written(new, "component-labels")
        changed = not new.join(labels, ["node", "component"], "left_anti").isEmpty()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


MOST_TOGETHER = 500_000
"""Distinct identities of one component are folded in one task; more, which only a stand-in identifier can tie together, are refused."""
FOLD = "ord long, kept_ord long, merged boolean"


class Kept:
    """Kept records by what can lead to them, so that a record meets only those it may join."""

    def __init__(self) -> None:
        self.ids: dict[int, dict[str, str]] = {}
        self.blocks: dict[int, str | None] = {}
        self.by_id: dict[tuple[str, str], dict[tuple[str | None, str | None], list[int]]] = {}
        self.by_block: dict[str, int] = {}

    @staticmethod
    def vetoes(ids: dict[str, str]) -> tuple[str | None, str | None]:
        return ids.get("doi"), ids.get("arxiv")

    def file(self, ord_: int, names: dict[str, str]) -> None:
        at = self.vetoes(self.ids[ord_])
        for item in names.items():
            heapq.heappush(self.by_id.setdefault(item, {}).setdefault(at, []), ord_)

    def first(self, ids: dict[str, str], block: str | None) -> int | None:
        """The first kept record that shares an identifier and has no other DOI or preprint id; without identifiers, of the same title."""
        if not ids:
            return self.by_block.get(block) if block is not None else None
        doi, arxiv = self.vetoes(ids)
        best = None
        for item in ids.items():
            found = self.by_id.get(item)
            if not found:
                continue
            if doi and arxiv:
                fits = [(d, x) for d in (doi, None) for x in (arxiv, None)]
            else:  # a record without DOI or preprint id may join any
                fits = [k for k in found if (not doi or k[0] in (doi, None)) and (not arxiv or k[1] in (arxiv, None))]
            for k in fits:
                heap = found.get(k, [])
                while heap and self.vetoes(self.ids[heap[0]]) != k:  # has gained an id since
                    heapq.heappop(heap)
                if heap and (best is None or heap[0] < best):
                    best = heap[0]
        return best

    def add(self, ord_: int, ids: dict[str, str], block: str | None) -> None:
        self.ids[ord_], self.blocks[ord_] = dict(ids), block
        self.file(ord_, ids)
        if not ids and block is not None:
            self.by_block.setdefault(block, ord_)

    def merge(self, target: int, ids: dict[str, str], block: str | None) -> None:
        before = self.vetoes(self.ids[target])
        gained = {k: v for k, v in ids.items() if k not in self.ids[target]}
        self.ids[target] |= gained
        self.file(target, self.ids[target] if self.vetoes(self.ids[target]) != before else gained)


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Records of one component in order, each merged into the first kept record that it may join."""
    kept, out = Kept(), []
    for r in pdf.sort_values("ord").itertuples(index=False):
        ids = {k: v for k, v in (r.ids if isinstance(r.ids, dict) else dict(r.ids or [])).items() if v}
        target = kept.first(ids, r.title_block)
        if target is None:
            kept.add(r.ord, ids, r.title_block)
            out.append((r.ord, r.ord, False))
        else:
            kept.merge(target, ids, r.title_block)
            out.append((r.ord, target, True))
    return pd.DataFrame(out, columns=["ord", "kept_ord", "merged"])


def deduplicate(records: DataFrame, order: str, doi: Column, identifiers: Column, title: str, year: str, first_author: Column) -> DataFrame:
    """``order, kept_order, merged``: which earlier record each record is merged into.

    A record joins the first kept record that shares an identifier (letter case ignored), unless both
    have different DOIs or preprint ids; records without identifiers join on a long title, year and
    first author. Records with the same identity follow their first one, so only distinct
    identities of a component meet in one task. Kept records gain the identifiers they lacked.
    """
    ids = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in KEYS]), F.array(doi, *[F.lower(identifiers[k]) for k in ID_ORDER])), lambda k, v: F.coalesce(v, F.lit("")) != "")
    words = normalize_title(F.col(title))
    block = F.when((F.length(words) > 24) & (F.col(year) > 0) & (first_author != ""), F.concat_ws("\x1f", words, F.col(year).cast("string"), F.lower(first_author)))
    rows = records.select(F.col(order).cast("long").alias("ord"), ids.alias("ids"), block.alias("title_block"))
    # a title decides only where there is no identifier
    rows = rows.withColumn("title_block", F.when(F.size("ids") == 0, F.col("title_block")))
    rows = rows.withColumn("identity", F.sha2(F.to_json(F.struct(F.array_sort(F.map_entries("ids")).alias("i"), "title_block")), 256))
    rows = rows.withColumn("identity", F.when((F.size("ids") > 0) | F.col("title_block").isNotNull(), F.col("identity")).otherwise(F.col("ord").cast("string")))
    rows = written(rows.select("ord", "ids", "title_block", "identity"), "record-identities")
    first = rows.groupBy("identity").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.min_by("ids", "ord").alias("ids"))
    # titles tie no two identities: equal ones are one identity
    edges = first.select(F.col("ord").alias("node"), F.explode(F.transform(F.map_entries("ids"), lambda e: F.xxhash64(e["key"], e["value"]))).alias("block"))
    edges = written(edges, "identity-blocks")
    shared = edges.groupBy("block").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1")
    edges = attach(edges, shared.select("block", "first"), ["block"], "inner").select("node", "block")
    comp = written(components(edges), "record-components")
    sizes = comp.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_TOGETHER).limit(1).collect()
    if sizes:
        raise ValueError(f"{sizes[0]['n']} records hang together by shared identifiers: an identifier stands in for missing ones")
    many = first.join(comp, F.col("ord") == F.col("node")).select("component", "ord", "ids", F.lit(None).cast("string").alias("title_block"))
    folded = many.groupBy("component").applyInPandas(_fold, FOLD)
    kept = first.join(folded.select("ord", "kept_ord"), "ord", "left").select("identity", F.coalesce("kept_ord", "ord").alias("kept_order"), "n")
    out = attach(rows.select("ord", "identity"), kept, ["identity"], weight="n")
    return out.select(F.col("ord").alias(order), "kept_order", (F.col("ord") != F.col("kept_order")).alias("merged"))


def prioritize(records: DataFrame, keywords: Sequence[str], text: Sequence[str], year: str, citations: str, now: int) -> DataFrame:
    """``score`` of 0 to 100: share of keywords found, recency within ten years, citations; 0 without any keyword."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text]))
    hits = F.size(F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: whole.contains(k)))
    recent = F.when(F.col(year).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (now - F.col(year)) / 10)))
    cited = F.least(F.lit(1.0), F.log1p(F.greatest(F.coalesce(F.col(citations), F.lit(0)), F.lit(0))) / F.log1p(F.lit(1000.0)))
    return records.withColumn("matched", hits).withColumn("score", F.when(hits == 0, 0.0).otherwise(70 * hits / len(keywords) + 20 * recent + 10 * cited))


def compare_field(supplied: Column, canonical: Column, normal=lambda c: c) -> Column:
    """Status of one supplied field against the canonical one."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    return F.when(blank(supplied), "not_supplied").when(blank(canonical), "source_missing").when(normal(supplied.cast("string")) == normal(canonical.cast("string")), "match").otherwise("needs_review")


def author_line(authors: Column, sep: str) -> Column:
    """``family, given`` of each author, joined."""
    one = F.transform(F.filter(authors, lambda a: F.coalesce(a["family"], F.lit("")) != ""), lambda a: F.regexp_replace(F.concat_ws(", ", a["family"], F.nullif(a["given"], F.lit(""))), "[, ]+$", ""))
    return F.array_join(one, sep)


def record_url(doi: Column, identifiers: Column) -> Column:
    """The address of a record by its preprint, DOI or PubMed id."""
    at = lambda k: F.nullif(identifiers[k], F.lit(""))
    return F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), at("arxiv")), F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit(""))), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), at("pmid"), F.lit("/")), F.lit(""))


def export_lines(records: DataFrame, fmt: str, key: str = "rec_no", record: str = "record_id") -> DataFrame:
    """``key, entry``: each record as ``ris``, ``enw``, ``bib``, ``rdf`` or ``csv`` text.

    Needs title, authors, year, journal, doi, identifiers and the record id; empty fields are left out.
    """
    c = F.col
    some = lambda name, value: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(name), squeeze(value.cast("string"))))
    names = F.filter(c("authors"), lambda a: F.coalesce(a["family"], F.lit("")) != "")
    full = lambda a: F.regexp_replace(F.concat_ws(", ", a["family"], F.nullif(a["given"], F.lit(""))), "[, ]+$", "")
    other = [(k, c("identifiers")[k]) for k in ("arxiv", "pmid", "pmcid")]
    if fmt in ("ris", "enw"):
        ris = fmt == "ris"
        tag = lambda a, b: f"{a}  - " if ris else f"%{b} "
        kind = F.when(F.coalesce(c("journal"), F.lit("")) != "", "TY  - JOUR" if ris else "%0 Journal Article").otherwise("TY  - GEN" if ris else "%0 Generic")
        lines = [F.array(kind), F.transform(F.coalesce(names, F.expr("array()").cast(records.schema["authors"].dataType)), lambda a: F.concat(F.lit(tag("AU", "A")), squeeze(full(a))))]
        lines.append(F.array(some(tag("TI", "T"), c("title")), some(tag("PY", "D"), c("year")), some(tag("JO", "J"), c("journal")), some(tag("DO", "R"), c("doi"))))
        lines.append(F.array(*([some("ID  - ", c(record))] if ris else []), *[some(tag("N1", "Z") + k + ":", v) for k, v in other], *([F.lit("ER  - ")] if ris else [])))
        return records.select(key, F.array_join(F.array_compact(F.concat(*lines)), "\n").alias("entry"))
    if fmt == "bib":
        esc = lambda v: F.regexp_replace(v.cast("string"), r"([{}%&_])", r"\\$1")
        field = lambda name, v: F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), esc(v), F.lit("}")))
        # a name that is not stated in parts is kept whole by braces
        whole = lambda a: (F.coalesce(a["given"], F.lit("")) == "") & ~a["family"].contains(",")
        written_ = F.array_join(F.transform(names, lambda a: F.when(whole(a), F.concat(F.lit("{"), esc(full(a)), F.lit("}"))).otherwise(esc(full(a)))), " and ")
        people = F.when(F.size(names) > 0, F.concat(F.lit("  author = {"), written_, F.lit("}")))
        body = F.array_compact(F.array(field("title", c("title")), field("year", c("year")), field("journal", c("journal")), field("doi", c("doi")), people, field("eprint", c("identifiers")["arxiv"]), field("pmid", c("identifiers")["pmid"])))
        kind = F.when(F.coalesce(c("journal"), F.lit("")) != "", "@article{r").otherwise("@misc{r")
        return records.select(key, F.concat(kind, c(key).cast("string"), F.lit(",\n"), F.array_join(body, ",\n"), F.lit("\n}")).alias("entry"))
    if fmt == "rdf":
        esc = lambda v: F.replace(F.replace(F.replace(v.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        el = lambda name, v: F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"<dc:{name}>"), esc(v), F.lit(f"</dc:{name}>")))
        people = F.transform(names, lambda a: el("creator", full(a)))
        parts = F.concat(F.array(el("title", c("title")), el("date", c("year")), el("source", c("journal"))), F.coalesce(people, F.array().cast("array<string>")), F.array(*[el("identifier", F.concat(F.lit(k + ":"), v)) for k, v in (("doi", c("doi")), *other)]))
        return records.select(key, F.concat(F.lit('<rdf:Description rdf:about="urn:record:'), esc(c(record)), F.lit('">'), F.array_join(F.array_compact(parts), ""), F.lit("</rdf:Description>")).alias("entry"))
    if fmt == "csv":
        quote = lambda v: F.when(v.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
        more = [c(x) if x in records.columns else F.lit("") for x in ("volume", "issue", "pages", "article_number")]
        cells = [c(record), c("title"), author_line(c("authors"), "; "), c("year"), c("journal"), c("doi"), *more, record_url(c("doi"), c("identifiers"))]
        return records.select(key, F.concat_ws(",", *[quote(F.coalesce(x.cast("string"), F.lit(""))) for x in cells]).alias("entry"))
    raise ValueError(f"unknown format {fmt}")

