"""Queries over bibliographic records, ledgers and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions import text as T
from verispan.functions.stats import rounded, rounded_sql
from verispan.operators import documents, ledger, records
from verispan.session import table

KEYWORDS = ("autophagy", "senescence", "knock-in", "aged rats")


def normalize_doi(spark: SparkSession, d: str) -> DataFrame:
    """The bare DOI of each record."""
    return table(spark, d, "records").select("rec_no", T.normalize_doi(F.col("doi")).alias("doi"))


_ENDS = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
_DOI = rf"""regexp_replace(regexp_replace(url_decode(doi), {_ENDS}), '^(?:https?://(?:dx\.)?doi\.org/|doi[\s\p{{Z}}]*:)[\s\p{{Z}}]*', '', 'i')"""
_DOI = rf"lower(regexp_replace({_DOI}, '[.,;]+$', ''))"
_IS_DOI = rf"regexp_full_match({_DOI}, '10\.[0-9]{{4,9}}/[^\s\p{{Z}}]+')"


def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    """The words of each title."""
    return table(spark, d, "records").select("rec_no", T.normalize_title(F.col("title")).alias("title"))


_TITLE = r"""trim(regexp_replace(lower(replace(replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&alpha;', 'α')), '[^\p{L}\p{N}_]+', ' ', 'g'))"""


def _with_ids(spark: SparkSession, d: str) -> DataFrame:
    rec = table(spark, d, "records").withColumn("doi", T.normalize_doi(F.col("doi")))
    return rec.withColumn("record_id", records.record_id(F.col("doi"), F.col("identifiers"), F.concat_ws("|", "title", F.col("year").cast("string"))))


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    """The identity of each record, from its best identifier."""
    return _with_ids(spark, d).select("rec_no", "record_id")


_RID = f"""with n as (select *, case when {_IS_DOI} then {_DOI} end as nd from records),
i as (select rec_no, title, year, journal, authors, nd, identifiers['arxiv'] as arxiv, identifiers['pmid'] as pmid, identifiers['pmcid'] as pmcid, identifiers['openalex'] as openalex, identifiers['s2'] as s2 from n),
r as (select *, coalesce(case when regexp_matches(arxiv, 'v[0-9]+$') then 'arxiv:' || arxiv end, 'doi:' || nd, 'pmid:' || nullif(pmid, ''), 'pmcid:' || nullif(pmcid, ''), 'arxiv:' || nullif(arxiv, ''), 'openalex:' || nullif(openalex, ''), 's2:' || nullif(s2, ''), 'rec:' || substr(sha256(concat_ws('|', title, cast(year as varchar))), 1, 20)) as record_id from i)"""


def dedupe_map(rec: DataFrame) -> DataFrame:
    """``rec_no, kept_order, merged`` of records with their DOI."""
    first = F.get("authors", F.lit(0))
    name = F.concat_ws(" ", first["given"], first["family"])
    return records.deduplicate(rec, "rec_no", F.col("doi"), F.col("identifiers"), "title", "year", name)


def record_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Which earlier record each record is merged into, in the order of rec_no."""
    return dedupe_map(_with_ids(spark, d))


def prioritize_records(spark: SparkSession, d: str) -> DataFrame:
    """Records ranked by keywords, recency and citations."""
    out = records.prioritize(table(spark, d, "records"), KEYWORDS, ["title"], "year", "citation_count", 2026)
    return rounded(out.select("rec_no", "matched", "score"), "score")


_HIT = " + ".join(f"cast(contains(lower(coalesce(title, '')), '{k}') as int)" for k in KEYWORDS)


def author_parts(spark: SparkSession, d: str) -> DataFrame:
    """Names with a comma split into family and given name."""
    names = table(spark, d, "records").select("rec_no", F.posexplode("authors").alias("i", "a")).filter(F.col("a.family").isNotNull())
    parts = T.author_parts(F.col("a.family"))
    return names.select("rec_no", "i", parts["family"].alias("family"), parts["given"].alias("given"), parts["unparsed"].alias("unparsed"))


def compare_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title, year and journal of each record against the first record of the same pmid."""
    rec = table(spark, d, "records").withColumn("pmid", F.col("identifiers")["pmid"]).filter("pmid is not null").select("rec_no", "pmid", "title", "year", "journal")
    first = rec.groupBy("pmid").agg(F.min_by(F.struct("rec_no", "title", "year", "journal"), "rec_no").alias("c"))
    rows = rec.join(first, "pmid").filter("rec_no <> c.rec_no")
    normal = {"title": T.normalize_title, "year": lambda c: c, "journal": T.normalize_title}
    checks = F.array(*[F.struct(F.lit(f).alias("field"), records.compare_field(F.col(f), F.col(f"c.{f}"), n).alias("status")) for f, n in normal.items()])
    return rows.select("rec_no", F.col("c.rec_no").alias("canonical"), F.explode(checks).alias("k")).select("rec_no", "canonical", "k.field", "k.status")


def _norm(c: str) -> str:
    return _TITLE.replace("title", c)


def _cmp(f: str, normal: bool) -> str:
    a, b = f"cast(r.{f} as varchar)", f"cast(c.{f} as varchar)"
    same = f"{_norm(a)} = {_norm(b)}" if normal else f"{a} = {b}"
    return f"select r.rec_no, c.rec_no as canonical, '{f}' as field, case when coalesce({a}, '') = '' then 'not_supplied' when coalesce({b}, '') = '' then 'source_missing' when {same} then 'match' else 'needs_review' end as status from r join c using (pmid) where r.rec_no <> c.rec_no"


def export_ris(spark: SparkSession, d: str) -> DataFrame:
    """Each record as an RIS entry."""
    return records.export_lines(_with_ids(spark, d), "ris")


def export_csv(spark: SparkSession, d: str) -> DataFrame:
    """Each record as a CSV line."""
    return records.export_lines(_with_ids(spark, d), "csv")


def export_enw(spark: SparkSession, d: str) -> DataFrame:
    """Each record as a percent-tagged entry."""
    return records.export_lines(_with_ids(spark, d), "enw")


def export_bibtex(spark: SparkSession, d: str) -> DataFrame:
    """Each record as a BibTeX entry."""
    return records.export_lines(_with_ids(spark, d), "bib")


def export_rdf(spark: SparkSession, d: str) -> DataFrame:
    """Each record as an RDF description."""
    return records.export_lines(_with_ids(spark, d), "rdf")


_SQZ = lambda c: rf"trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'))"
_FULL = "regexp_replace(concat_ws(', ', a.family, nullif(a.given, '')), '[, ]+$', '')"
_ESC = lambda x: rf"regexp_replace({x}, '([{{}}%&_])', '\\\1', 'g')"
_XML = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_NAMES = "list_filter(authors, lambda a: coalesce(a.family, '') <> '')"


def import_references(spark: SparkSession, d: str) -> DataFrame:
    """Entries as received parsed into title, year, DOI and identifiers."""
    from verispan.sources.references import parse_entries

    raw = table(spark, d, "records").filter("raw_entry is not null").select("rec_no", "raw_entry")
    return parse_entries(raw, "rec_no", "raw_entry")


def _screening(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rec = table(spark, d, "records").withColumn("pmid", F.col("identifiers")["pmid"]).select("rec_no", "pmid", "record_type", "year", "citation_count")
    first = rec.filter("pmid is not null").groupBy("pmid").agg(F.min("rec_no").alias("first"))
    rows = rec.join(first, "pmid", "left")
    return rows.select(
        c("rec_no"), c("rec_no").cast("string").alias("record_id"), F.when(c("first") != c("rec_no"), c("first").cast("string")).alias("duplicate_of"),
        F.when(c("record_type") == "review", "exclude").when(c("year").isNull(), None).otherwise("include").alias("title_abstract_decision"),
        F.when(c("rec_no") % 97 != 0, F.concat(F.lit("rep"), (c("rec_no") / 3).cast("long").cast("string"))).alias("report_id"),
        F.when(c("rec_no") % 11 == 0, "not_retrieved").when(c("rec_no") % 13 == 0, None).otherwise("retrieved").alias("retrieval"),
        F.when(c("rec_no") % 5 == 0, "exclude").otherwise("include").alias("fulltext_decision"),
        F.when((c("rec_no") % 5 == 0) & (c("rec_no") % 7 != 0), F.concat(F.lit("reason"), (c("rec_no") % 4).cast("string"))).alias("exclusion_reason"),
        F.concat(F.lit("st"), (c("rec_no") / 9).cast("long").cast("string")).alias("study_id"),
    )


_LEDGER = """with f as (select identifiers['pmid'] as pmid, min(rec_no) as first from records where identifiers['pmid'] is not null group by 1),
l as (select rec_no, cast(rec_no as varchar) as record_id, case when first <> rec_no then cast(first as varchar) end as duplicate_of, case when record_type = 'review' then 'exclude' when year is null then null else 'include' end as title_abstract_decision,
 case when rec_no % 97 <> 0 then 'rep' || (rec_no // 3) end as report_id, case when rec_no % 11 = 0 then 'not_retrieved' when rec_no % 13 = 0 then null else 'retrieved' end as retrieval, case when rec_no % 5 = 0 then 'exclude' else 'include' end as fulltext_decision,
 case when rec_no % 5 = 0 and rec_no % 7 <> 0 then 'reason' || (rec_no % 4) end as exclusion_reason, 'st' || (rec_no // 9) as study_id from records left join f on f.pmid = identifiers['pmid']),
s as (select * from l where duplicate_of is null and title_abstract_decision = 'include' and report_id is not null),
p as (select report_id, arg_min(struct_pack(a := retrieval, b := fulltext_decision, c := exclusion_reason, d := study_id), rec_no) as x, count(distinct concat_ws('|', coalesce(retrieval, '-'), fulltext_decision, coalesce(exclusion_reason, '-'), study_id)) as v from s group by 1)"""


def screening_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flow counts of a screening ledger over the records."""
    return ledger.screening_flow(_screening(spark, d), "rec_no")


def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Full-text exclusions by reason."""
    return ledger.exclusion_reasons(_screening(spark, d), "rec_no")


def init_claims(spark: SparkSession, d: str) -> DataFrame:
    """Each paragraph of the documents as a pending claim."""
    return ledger.init_claims(table(spark, d, "documents"), "doc_id", "text")


def numeric_check(spark: SparkSession, d: str) -> DataFrame:
    """Discounts and taxes of line items stated in percent, exactly and rounded."""
    items = table(spark, d, "lineitem")
    reported = F.round(F.col("l_discount") * 100, 0) + F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)
    unit = F.when(F.col("l_linenumber") % 5 == 0, "mg").otherwise("%")
    status = ledger.numeric_status(reported.cast("decimal(20,9)"), unit, F.col("l_discount").cast("decimal(20,9)"), F.lit("fraction"), F.lit(0))
    return items.select(status.alias("status"), "l_linenumber").groupBy("l_linenumber", "status").agg(F.count("*").alias("n"))


def anchored_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Quotes cut out of one block and looked up in the block that they name."""
    blocks = table(spark, d, "doc_blocks")
    quotes = blocks.select("source_id", F.format_string("B%05d", F.col("ordinal") - F.col("ordinal") % 4 + 1).alias("block_id"), F.substring("original", 3, 40).alias("quote"), "ordinal")
    return ledger.anchored(quotes, blocks, ["source_id", "block_id"], "quote", "original").select("source_id", "ordinal", "block_id", "found")


def reader_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Blocks without a translation and translations without a block."""
    blocks = table(spark, d, "doc_blocks")
    translated = blocks.filter("ordinal % 5 <> 0").select("source_id", F.when(F.col("ordinal") % 7 == 0, F.concat("block_id", F.lit("x"))).otherwise(F.col("block_id")).alias("block_id"))
    return ledger.coverage(blocks, translated, ["source_id", "block_id"])


def publication_month(spark: SparkSession, d: str) -> DataFrame:
    """The month of first publication by the order of date kinds."""
    return ledger.date_evidence_month(table(spark, d, "date_evidence").filter("rec_no is not null"), "rec_no", "basis", "date_parts")


def month_merge(spark: SparkSession, d: str) -> DataFrame:
    """Records of one month, with those whose dates conflict or are missing."""
    ev = table(spark, d, "date_evidence").filter("rec_no is not null")
    first = F.get("date_parts", F.lit(0))
    month = F.when(F.get(first, F.lit(1)).between(1, 12), F.format_string("%04d-%02d", F.get(first, F.lit(0)), F.get(first, F.lit(1))))
    return ledger.month_merge(ev.withColumn("month", month), "rec_no", "month", "2024-05")


def independent_support(spark: SparkSession, d: str) -> DataFrame:
    """Journals with at least two distinct primary studies."""
    rec = table(spark, d, "records").filter("journal is not null")
    return ledger.independent_support(rec.withColumn("study", F.concat_ws("/", "provider", F.col("year").cast("string"))), "journal", "study", F.col("record_type") == "article")


def json_select(spark: SparkSession, d: str) -> DataFrame:
    """Dotted paths of answers of databases."""
    v = lambda p: F.get_json_object("body", p)
    return table(spark, d, "database_checks").select("check_id", v("$.provider").alias("provider"), v("$.request.params.query").alias("query"), v("$.request.max_items").alias("max_items"), v("$.response.status_code").alias("status_code"), v("$.response.sources[0].level").alias("level"))


def json_compact(spark: SparkSession, d: str) -> DataFrame:
    """Answers with lists, depth and texts cut to bounds, and the paths that were cut."""
    return documents.compact_json(table(spark, d, "database_checks"), "check_id", "body", max_items=2, max_depth=6)


def redact_url(spark: SparkSession, d: str) -> DataFrame:
    """Request addresses without the values of secret parameters."""
    url = F.concat(F.lit("https://api.example/"), "provider", F.lit("?q="), F.col("check_id").cast("string"), F.lit("&api_key=k"), F.col("check_id").cast("string"), F.lit("&email=a@b.c#top"))
    return table(spark, d, "database_checks").select("check_id", T.redact_url(url).alias("url"))


def math_structure(spark: SparkSession, d: str) -> DataFrame:
    """Unbalanced math delimiters in documents that open with a formula."""
    opening = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents.math_issues(table(spark, d, "documents").select("doc_id", F.concat(opening, "text").alias("text")), "doc_id", "text")


OPENINGS = ("\\(a $b$ \\]\n", "$$c$$ % $\n```\n$\n```\n", "\\begin{x}\n\\$ \\end{y}\n")


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents split into located blocks."""
    return documents.text_blocks(table(spark, d, "documents"), "doc_id", "text")


def local_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty observations of a feature within the first fifty thousand rows, with how far the scan went."""
    return documents.bounded_scan(table(spark, d, "observations").select("obs_id", "feature", "group_name", "value"), "obs_id", {"feature": "HKG1", "group_name": "treated"}, 20, 50_000)


QUERIES = {
    f.__name__: f
    for f in (
        normalize_doi, normalize_title, record_ids, record_dedupe, prioritize_records, author_parts, compare_metadata, export_ris, export_csv, export_enw, export_bibtex, export_rdf, import_references,
        screening_flow, exclusion_reasons, init_claims, numeric_check, anchored_evidence, reader_coverage, publication_month, month_merge, independent_support, json_select, json_compact, redact_url,
        math_structure, text_blocks, local_scan,
    )
}
_BLOCKS = r"""with b as (select doc_id, regexp_split_to_array(text, '\n\s*\n') as parts from documents where text is not null),
e as (select doc_id, generate_subscripts(parts, 1) as i, unnest(parts) as p from b), t as (select doc_id, i, regexp_replace(p, '^\s+|\s+$', '', 'g') as p from e)"""
SQL = {
    "normalize_doi": f"select rec_no, case when {_IS_DOI} then {_DOI} end as doi from records",
    "normalize_title": f"select rec_no, {_TITLE} as title from records",
    "record_ids": f"{_RID} select rec_no, record_id from r",
    "prioritize_records": f"select rec_no, {_HIT} as matched, round(case when {_HIT} = 0 then 0 else 70.0::double * ({_HIT}) / {len(KEYWORDS)} + 20 * (case when year is null then 0 else greatest(0, least(1, 1 - (2026 - year)::double / 10)) end) + 10 * least(1, ln(1 + greatest(coalesce(citation_count, 0), 0)) / ln(1001)) end, 6) as score from records",
    "author_parts": "with a as (select rec_no, unnest(authors) as a, generate_subscripts(authors, 1) - 1 as i from records) select rec_no, i, case when contains(a.family, ',') then trim(split_part(a.family, ',', 1)) end as family, case when contains(a.family, ',') then trim(substr(a.family, strpos(a.family, ',') + 1)) end as given, not contains(a.family, ',') as unparsed from a where a.family is not null",
    "compare_metadata": f"with r as (select rec_no, identifiers['pmid'] as pmid, title, year, journal from records where identifiers['pmid'] is not null), c as (select * from r qualify row_number() over (partition by pmid order by rec_no) = 1) {_cmp('title', True)} union all {_cmp('year', False)} union all {_cmp('journal', True)}",
    "export_ris": f"""{_RID} select rec_no, concat_ws(chr(10), case when coalesce(journal, '') <> '' then 'TY  - JOUR' else 'TY  - GEN' end, nullif(array_to_string(list_transform({_NAMES}, lambda a: 'AU  - ' || {_SQZ(_FULL)}), chr(10)), ''),
 'TI  - ' || case when title <> '' then {_SQZ('title')} end, 'PY  - ' || cast(year as varchar), 'JO  - ' || case when journal <> '' then {_SQZ('journal')} end, 'DO  - ' || nd, 'ID  - ' || {_SQZ('record_id')}, 'N1  - arxiv:' || nullif(arxiv, ''), 'N1  - pmid:' || nullif(pmid, ''), 'N1  - pmcid:' || nullif(pmcid, ''), 'ER  - ') as entry from r""",
    "export_csv": "%s select rec_no, concat_ws(',', %s) as entry from r"
    % (_RID, ", ".join(f"""case when regexp_matches({v}, '[",\\n\\r]') then '"' || replace({v}, '"', '""') || '"' else {v} end""" for v in ("record_id", "coalesce(title, '')", f"coalesce(array_to_string(list_transform({_NAMES}, lambda a: {_FULL}), '; '), '')", "coalesce(cast(year as varchar), '')", "coalesce(journal, '')", "coalesce(nd, '')", "''", "''", "''", "''", "coalesce('https://arxiv.org/abs/' || nullif(arxiv, ''), 'https://doi.org/' || nd, 'https://pubmed.ncbi.nlm.nih.gov/' || nullif(pmid, '') || '/', '')"))),
    "export_enw": f"""{_RID} select rec_no, concat_ws(chr(10), case when coalesce(journal, '') <> '' then '%0 Journal Article' else '%0 Generic' end, nullif(array_to_string(list_transform({_NAMES}, lambda a: '%A ' || {_SQZ(_FULL)}), chr(10)), ''),
 '%T ' || case when title <> '' then {_SQZ('title')} end, '%D ' || cast(year as varchar), '%J ' || case when journal <> '' then {_SQZ('journal')} end, '%R ' || nd, '%Z arxiv:' || nullif(arxiv, ''), '%Z pmid:' || nullif(pmid, ''), '%Z pmcid:' || nullif(pmcid, '')) as entry from r""",
    "export_bibtex": f"""{_RID} select rec_no, case when coalesce(journal, '') <> '' then '@article{{r' else '@misc{{r' end || rec_no || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{' || {_ESC("nullif(title, '')")} || '}}', '  year = {{' || year || '}}', '  journal = {{' || {_ESC("nullif(journal, '')")} || '}}', '  doi = {{' || {_ESC('nd')} || '}}',
 case when len({_NAMES}) > 0 then '  author = {{' || array_to_string(list_transform({_NAMES}, lambda a: case when coalesce(a.given, '') = '' and not contains(a.family, ',') then '{{' || {_ESC(_FULL)} || '}}' else {_ESC(_FULL)} end), ' and ') || '}}' end, '  eprint = {{' || {_ESC("nullif(arxiv, '')")} || '}}', '  pmid = {{' || nullif(pmid, '') || '}}') || chr(10) || '}}' as entry from r""",
    "export_rdf": f"""{_RID} select rec_no, '<rdf:Description rdf:about="urn:record:' || {_XML('record_id')} || '">' || concat('<dc:title>' || {_XML("nullif(title, '')")} || '</dc:title>', '<dc:date>' || year || '</dc:date>', '<dc:source>' || {_XML("nullif(journal, '')")} || '</dc:source>', array_to_string(list_transform(list_filter(list_transform({_NAMES}, lambda a: {_FULL}), lambda x: x <> ''), lambda x: '<dc:creator>' || {_XML('x')} || '</dc:creator>'), ''),
 '<dc:identifier>doi:' || {_XML('nd')} || '</dc:identifier>', '<dc:identifier>arxiv:' || {_XML("nullif(arxiv, '')")} || '</dc:identifier>', '<dc:identifier>pmid:' || nullif(pmid, '') || '</dc:identifier>', '<dc:identifier>pmcid:' || nullif(pmcid, '') || '</dc:identifier>') || '</rdf:Description>' as entry from r""",
    "text_blocks": r"""with b as (select doc_id, regexp_split_to_array(text, '\n\s*\n') as parts, regexp_extract_all(text, '\n\s*\n') as seps from documents where text is not null and text <> ''),
e as (select doc_id, generate_subscripts(parts, 1) as i, unnest(parts) as p, unnest(list_append(seps, '')) as s from b),
n as (select *, length(p || s) - length(replace(p || s, chr(10), '')) as lines from e), l as (select doc_id, i, regexp_replace(p, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as original, 1 + coalesce(sum(lines) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as line from n)
select doc_id, cast(k as int) as ordinal, printf('B%05d', k) as block_id, 'line ' || line as locator, 'text' as kind, original from (select *, row_number() over (partition by doc_id order by i) as k from l where original <> '')""".replace("\\\\", "\\"),
    "screening_flow": f"""{_LEDGER}, h as (select count(*) as records_identified, count(duplicate_of) as duplicate_records_removed, count(*) filter (where duplicate_of is null and title_abstract_decision is not null) as records_screened, count(*) filter (where duplicate_of is null and title_abstract_decision = 'exclude') as records_excluded_title_abstract,
 count(*) filter (where duplicate_of is null) as u, count(*) filter (where duplicate_of is null and title_abstract_decision = 'include' and report_id is null) as e1 from l),
t as (select count(*) as reports_sought, count(*) filter (where x.a = 'not_retrieved') as reports_not_retrieved, count(*) filter (where x.a = 'retrieved') as reports_retrieved, count(*) filter (where x.a = 'retrieved' and x.b = 'exclude') as reports_excluded_fulltext, count(*) filter (where x.a = 'retrieved' and x.b = 'include') as reports_included,
 count(distinct case when x.a = 'retrieved' and x.b = 'include' then x.d end) as studies_included, count(*) filter (where x.a is null) as reports_unresolved, count(*) filter (where v > 1) as e2, count(*) filter (where x.a = 'retrieved' and x.b = 'exclude' and x.c is null) as e3 from p)
select records_identified, duplicate_records_removed, records_screened, records_excluded_title_abstract, reports_sought, reports_not_retrieved, reports_retrieved, reports_excluded_fulltext, reports_included, studies_included, reports_unresolved, u - records_screened as records_pending_screening, e1 + e2 + e3 as errors, e1 + e2 + e3 = 0 as valid, (u = records_screened and reports_unresolved = 0 and e1 + e2 + e3 = 0) as complete from h, t""",
    "exclusion_reasons": f"{_LEDGER} select x.c as exclusion_reason, count(*) as reports from p where x.a = 'retrieved' and x.b = 'exclude' and x.c is not null group by 1",
    "init_claims": f"{_BLOCKS}, k as (select doc_id, i, p, row_number() over (partition by doc_id order by i) as n from t where p <> '') select doc_id, 'C' || lpad(cast(n as varchar), greatest(4, length(cast(n as varchar)))::int, '0') as claim_id, p as text, 'pending' as status from k",
    "numeric_check": "with x as (select l_linenumber, cast(round(l_discount * 100, 0) + case when l_linenumber % 3 = 0 then 1 else 0 end as decimal(20, 9)) as r, cast(l_discount as decimal(20, 9)) as s from lineitem) select l_linenumber, case when l_linenumber % 5 = 0 then 'incompatible_units' when r = s * 100 then 'exact_or_unit_equivalent' when r = round(s * 100, 0) then 'compatible_with_declared_rounding' else 'numeric_mismatch' end as status, count(*) as n from x group by all",
    "anchored_evidence": f"with q as (select source_id, ordinal, printf('B%05d', ordinal - ordinal % 4 + 1) as block_id, substr(original, 3, 40) as quote from doc_blocks) select q.source_id, q.ordinal, q.block_id, coalesce(contains({_SQZ('b.original')}, {_SQZ('q.quote')}), false) as found from q left join doc_blocks b on b.source_id = q.source_id and b.block_id = q.block_id",
    "reader_coverage": "with a as (select distinct source_id, block_id from doc_blocks), b as (select distinct source_id, case when ordinal % 7 = 0 then block_id || 'x' else block_id end as block_id from doc_blocks where ordinal % 5 <> 0) select source_id, block_id, 'not_translated' as side from (select * from a except select * from b) union all select source_id, block_id, 'not_in_source' from (select * from b except select * from a)",
    "publication_month": """with k as (select rec_no, list_position(['published-online', 'published', 'issued', 'published-print'], basis) as r, basis, date_parts[1][1] as y, date_parts[1][2] as m from date_evidence where rec_no is not null),
b as (select * from k where r > 0 and y is not null qualify row_number() over (partition by rec_no order by r, y, coalesce(m, 0)) = 1)
select rec_no, basis, case when m between 1 and 12 then printf('%04d-%02d', y, m) end as month from b""",
    "month_merge": """with k as (select rec_no, case when date_parts[1][2] between 1 and 12 then printf('%04d-%02d', date_parts[1][1], date_parts[1][2]) end as month from date_evidence where rec_no is not null),
g as (select rec_no, count(distinct month) as months, count(*) as evidence, coalesce(bool_or(month = '2024-05'), false) as hit from k group by 1)
select rec_no, months, evidence, case when months = 0 then 'unresolved' when months > 1 then 'conflicting_dates' else 'in_month' end as status from g where hit or months = 0""",
    "independent_support": "select journal, count(distinct case when record_type = 'article' then concat_ws('/', provider, cast(year as varchar)) end) as primary_studies, count(*) as papers, count(distinct case when record_type = 'article' then concat_ws('/', provider, cast(year as varchar)) end) >= 2 as supported from records where journal is not null group by 1",
    "json_select": "select check_id, json_extract_string(body, '$.provider') as provider, json_extract_string(body, '$.request.params.query') as query, json_extract_string(body, '$.request.max_items') as max_items, json_extract_string(body, '$.response.status_code') as status_code, json_extract_string(body, '$.response.sources[0].level') as level from database_checks",
    "redact_url": "select check_id, 'https://api.example/' || provider || '?q=' || check_id || '&api_key=REDACTED&email=REDACTED#top' as url from database_checks",
    "local_scan": """with o as (select *, row_number() over (order by obs_id) as rn from observations), h as (select obs_id, feature, group_name, value, rn from o where rn <= 50000 and feature = 'HKG1' and group_name = 'treated' order by rn limit 20)
select obs_id, feature, group_name, value, case when (select count(*) from h) = 20 then (select max(rn) from h) else least(50000, (select count(*) from o)) end as scanned_rows, (select count(*) from h) = 20 or (select count(*) from o) >= 50000 as truncated from h""",
    "math_structure": "select doc_id, line, issue, token from (values (0, 1, 'unmatched_close', '\\]'), (0, 1, 'unclosed', '\\('), (2, 2, 'unmatched_close', '\\end{y}'), (2, 1, 'unclosed', '\\begin{x}')) v(k, line, issue, token) join documents on doc_id % 3 = k where text is not null",
}
SQL = {k: rounded_sql(v) for k, v in SQL.items()}
