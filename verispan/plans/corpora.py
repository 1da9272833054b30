"""Queries over corpora of records, searches and variants, with their SQL. Where the tables lack a field, it is derived from a key so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.stats import rounded, rounded_sql
from verispan.operators import corpus, enrichment, followup, qc, records
from verispan.operators import units as U
from verispan.plans.evidence import _with_ids, dedupe_map
from verispan.session import table

c = F.col
IDS = ("pmid", "pmcid", "arxiv", "openalex", "s2")
_MONTH = "case when date_parts[1][2] is not null then printf('%04d-%02d', date_parts[1][1], date_parts[1][2]) else cast(date_parts[1][1] as varchar) end"


def _month() -> F.Column:
    first = F.get("date_parts", F.lit(0))
    y, m = F.get(first, F.lit(0)), F.get(first, F.lit(1))
    return F.when(m.isNotNull(), F.format_string("%04d-%02d", y, m)).otherwise(y.cast("string"))


def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated records with the fields and identifiers of the records merged into them."""
    rec = _with_ids(spark, d).select("rec_no", "record_id", "doi", "title", "year", "journal", "authors", "identifiers", "citation_count")
    out = corpus.merged_records(rec, dedupe_map(rec), "rec_no", IDS)
    again = records.record_id(c("doi"), c("identifiers"), c("record_id"))
    return out.withColumns({"record_id": again, "authors": F.to_json("authors"), "identifiers": F.to_json("identifiers")})


def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Titles, years and authors of merged records that differ from the kept ones."""
    rec = _with_ids(spark, d).select("rec_no", "record_id", "doi", "title", "year", "journal", "authors", "identifiers", "citation_count")
    mapping = dedupe_map(rec)
    return corpus.merge_conflicts(rec, mapping, corpus.merged_records(rec, mapping, "rec_no", IDS), "rec_no")


def screening_start(spark: SparkSession, d: str) -> DataFrame:
    """A pending ledger of the deduplicated records."""
    rec = _with_ids(spark, d)
    kept = rec.join(dedupe_map(rec).filter("not merged").select("rec_no"), "rec_no")
    return corpus.screening_ledger(kept)


def scope_and_years(spark: SparkSession, d: str) -> DataFrame:
    """Records of three scopes within and without a range of years, over journals of every kind."""
    names = F.array(*[F.lit(x) for x in ("Nature", " npj  Aging ", "Cell", "TRENDS IN  Genetics", "Science Advances", "Communications Biology", "Immunity", "Scientific Reports")])
    rec = table(spark, d, "records").select("rec_no", "year", F.coalesce(F.get(names, (c("rec_no") % 11).cast("int")), c("journal")).alias("journal"))
    parts = [corpus.select_records(rec, s, a, b).agg(F.count("*").alias("n"), F.coalesce(F.sum("rec_no"), F.lit(0)).alias("sum")).select(F.lit(s).alias("scope"), F.lit(a is not None).alias("bounded"), "n", "sum") for s in ("all", "flagship", "nature", "cns") for a, b in ((None, None), (2005, 2018))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_J = "j as (select rec_no, year, lower(trim(regexp_replace(coalesce(case rec_no % 11 when 0 then 'Nature' when 1 then ' npj  Aging ' when 2 then 'Cell' when 3 then 'TRENDS IN  Genetics' when 4 then 'Science Advances' when 5 then 'Communications Biology' when 6 then 'Immunity' when 7 then 'Scientific Reports' else journal end, ''), '\\s+', ' ', 'g'))) as j from records)"
_NAT = "(j in ('nature', 'nature communications', 'scientific reports') or j like 'nature %' or j like 'npj %' or j like 'communications %')"
_SCOPES = {"all": "true", "flagship": "j in ('nature', 'science', 'cell')", "nature": _NAT, "cns": f"({_NAT} or j in ('cell', 'science advances', 'immunity') or j like 'trends in %')"}


def search_log(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval of evidence as a paged search per provider."""
    ev = table(spark, d, "date_evidence")
    log = ev.select("provider", (c("evidence_id") % 7).alias("page"), F.lit(1).alias("rows"), F.lit(300).alias("total"), F.when((c("evidence_id") % 97 == 0) & c("provider").contains("e"), "timeout").alias("failure"))
    return corpus.search_counters(log, ["provider"], 100)


def name_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Authors whose names are not stated apart."""
    return corpus.name_warnings(table(spark, d, "records"), "rec_no")


def compare_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record against the first of its pmid: fields, further publication years and author lists."""
    rec = table(spark, d, "records").withColumn("pmid", c("identifiers")["pmid"]).filter("pmid is not null")
    names = F.transform("authors", lambda a: F.coalesce(a["family"], F.lit("")))
    years = table(spark, d, "date_evidence").filter("rec_no is not null").select("rec_no", F.get(F.get("date_parts", F.lit(0)), F.lit(0)).alias("y")).groupBy("rec_no").agg(F.collect_set("y").alias("years"))
    rec = rec.join(years, "rec_no", "left").select("pmid", "rec_no", F.struct("title", "year", "journal", names.alias("authors"), "years").alias("r"))
    first = rec.groupBy("pmid").agg(F.min_by(F.struct("rec_no", "r"), "rec_no").alias("k"))
    pairs = rec.join(first, "pmid").filter("rec_no <> k.rec_no").select("rec_no", c("k.rec_no").alias("canonical_no"), c("r").alias("supplied"), c("k.r").alias("canonical"))
    return corpus.compare_records(pairs, ["rec_no", "canonical_no"])


_T = lambda x: rf"trim(regexp_replace(lower(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&alpha;', 'α')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_FIELD = lambda f, more="": f"select rec_no, canonical_no, '{f}' as field, case when coalesce(cast(s.{f} as varchar), '') = '' then 'not_supplied' when coalesce(cast(k.{f} as varchar), '') = '' then 'source_missing' when {_T(f'cast(s.{f} as varchar)')} = {_T(f'cast(k.{f} as varchar)')} then 'match' {more} else 'needs_review' end as status from p"
_PLAIN = r"array_to_string(list_transform({}, lambda n: trim(regexp_replace(lower(n), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))), chr(31))"


def month_windows(spark: SparkSession, d: str) -> DataFrame:
    """The days of each stated month that is complete."""
    months = table(spark, d, "date_evidence").select(_month().alias("month")).distinct()
    w = corpus.month_window(c("month"), F.lit("2024-05-15").cast("date"))
    return months.select("month", w["first"].cast("string").alias("first"), w["last"].cast("string").alias("last"), w["status"].alias("status"))


def journal_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records of a journal by ISSN or by name."""
    n = c("rec_no")
    issns = F.when(n % 5 == 0, F.array(F.lit("1234-5678"), F.lit(""))).when(n % 5 == 1, F.array(F.lit(None).cast("string")))
    name = F.when(n % 7 == 0, " Science (New York, N.Y.)").otherwise(c("journal"))
    wanted = F.when(n % 2 == 0, F.upper("journal")).otherwise("Science")
    known = F.when(n % 10 == 0, F.array(F.lit("1234-5678"))).otherwise(F.array(F.lit("0000-0000")))
    return table(spark, d, "records").select("rec_no", corpus.of_journal(issns, name, wanted, known, {"Science": ["science (new york, n.y.)"]}).alias("of_journal"))


def monthly_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The records of a month with their united evidence."""
    ev = table(spark, d, "date_evidence").filter("rec_no is not null")
    rec = table(spark, d, "records").select("rec_no", "journal", "title", "identifiers")
    month = F.when(_month().rlike("^[0-9]{4}-(?:0[1-9]|1[0-2])$"), _month())
    rows = ev.join(rec, "rec_no").select("rec_no", "evidence_id", "journal", F.when(c("evidence_id") % 3 == 0, c("title")).alias("abstract"), (c("evidence_id") % 50 == 0).alias("retraction_notice_flag"), "provider", month.alias("month"), "basis", "identifiers")
    out = corpus.corpus_order(corpus.monthly_records(rows, "rec_no", "evidence_id", "2024-05", IDS), "rec_no")
    return out.select("rec_no", "journal", "abstract", "retraction_notice_flag", F.size("evidence").alias("statements"), "month_status", "access_level", c("identifiers")["pmid"].alias("pmid"))


def figure_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation and standard error of the units of each group; the interval needs t quantiles and is tested apart."""
    units = U.technical_aggregate(table(spark, d, "observations"), ["run_id", "feature", "group_name", "unit"])
    return rounded(U.figure_summary(units, ["run_id", "feature", "group_name"]).select("run_id", "feature", "group_name", "n", "mean", "sd", "sem"), "mean", "sd", "sem")


def figure_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same with the 95 % interval of the mean."""
    units = U.technical_aggregate(table(spark, d, "observations"), ["run_id", "feature", "group_name", "unit"])
    return rounded(U.figure_summary(units, ["run_id", "feature", "group_name"]), "mean", "sd", "sem", "ci_low", "ci_high")


def open_locations(spark: SparkSession, d: str) -> DataFrame:
    """Open locations of two services by year, as if a year were a DOI."""
    rec = table(spark, d, "records").filter("year is not null")
    part = lambda m, src: rec.filter(c("rec_no") % 2 == m).select(c("year").alias("doi"), c("rec_no").alias("place"), F.when(c("rec_no") % 13 != 0, F.concat(F.lit("https://oa.example/"), (c("rec_no") % 40).cast("string"))).alias("url"), F.when(c("rec_no") % 3 == 0, "pdf").otherwise("html").alias("format"), F.lit(src).alias("source"), c("provider").alias("license"), c("record_type").alias("version"))
    out = corpus.open_locations(part(0, "a"), part(1, "b"))
    return out.select("doi", "url", "format", "source", "license", "version", c("rank.other").alias("behind_pdf"))


def citation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for the first claims: evaluation items as claims, records as what was found."""
    items = table(spark, d, "eval_items").select(F.format_string("C%04d", "item_id").alias("claim_id"), "text")
    found = table(spark, d, "records").select(F.format_string("C%04d", c("rec_no") % 40).alias("claim_id"), c("rec_no").alias("place"), c("rec_no").cast("string").alias("record_id"))
    return corpus.citation_candidates(items, found, 20).withColumn("candidate_ids", F.array_join("candidate_ids", ";"))


def _variant_text() -> F.Column:
    base = lambda n: F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), 1)
    chrom = F.when(c("l_linenumber") == 7, "X").otherwise((c("l_linenumber") * 4).cast("string"))
    return F.concat(F.when(c("l_orderkey") % 2 == 0, "chr").otherwise(""), chrom, F.lit(":"), c("l_partkey").cast("string"), F.when(c("l_orderkey") % 9 == 0, "?").otherwise("-"), base(c("l_partkey")), F.lit("/"), base(c("l_suppkey")), F.when(c("l_orderkey") % 5 == 0, "t").otherwise(""))


def variant_parse(spark: SparkSession, d: str) -> DataFrame:
    """Variant texts as chromosome, position and alleles, or what is wrong with them."""
    return corpus.parse_variant(table(spark, d, "lineitem"), _variant_text()).select("l_orderkey", "l_linenumber", "chrom", "pos", "ref", "alt", "status")


def variant_lift(spark: SparkSession, d: str) -> DataFrame:
    """Parsed variants on the target assembly."""
    items = corpus.parse_variant(table(spark, d, "lineitem"), _variant_text()).filter("status = 'ok'")
    items = items.select(F.struct("l_orderkey", "l_linenumber").alias("k"), "chrom", "pos", "ref", "alt", F.when(c("l_suppkey") % 3 == 0, "GRCh38").otherwise("GRCh37").alias("assembly"))
    part = table(spark, d, "part")
    maps = part.select(F.lit("8").alias("chrom"), c("p_partkey").alias("pos"), F.lit("8").alias("to_chrom"), (c("p_partkey") + 100).alias("to_pos"), F.when(c("p_size") % 5 == 0, -1).otherwise(1).alias("strand"))
    bases = part.select(F.lit("8").alias("chrom"), (c("p_partkey") + 100).alias("pos"), F.substring(F.lit("ACGT"), (c("p_partkey") % 4 + F.when(c("p_size") % 7 == 0, 2).otherwise(1)).cast("int"), 1).alias("base"))
    out = corpus.lift_variants(items, maps, bases, "k", "GRCh38")
    return out.select("k.l_orderkey", "k.l_linenumber", "canonical", "variant_id", "status")


_V = """t as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when l_linenumber = 7 then 'X' else cast(l_linenumber * 4 as varchar) end as ch, substr('ACGT', l_partkey % 4 + 1, 1) as r, substr('ACGT', l_suppkey % 4 + 1, 1) || case when l_orderkey % 5 = 0 then 'T' else '' end as a, l_orderkey % 9 = 0 or l_partkey = 0 as broken from lineitem),
v as (select *, case when broken then 'malformed' when ch <> 'X' and try_cast(ch as int) not between 1 and 22 then 'bad_chromosome' when r = a then 'same_alleles' else 'ok' end as status from t)"""


def clinical_rows(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a code search as rows: the parts of each brand and size."""
    part = table(spark, d, "part")
    one = part.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(F.struct(c("p_partkey").alias("k"), c("p_type").alias("t"), c("p_name").alias("x")))).alias("a"))
    j = lambda x: F.to_json(x)
    body = F.concat(F.lit("["), F.size("a").cast("string"), F.lit(","), j(F.transform("a", lambda e: e["k"].cast("string"))), F.lit(',{"box":'), j(F.transform("a", lambda e: e["x"])), F.lit("},"), j(F.transform("a", lambda e: F.array(e["t"]))), F.lit("]"))
    rows = corpus.clinical_rows(one.select(F.concat_ws("/", "p_brand", c("p_size").cast("string")).alias("search"), body.alias("body")), "search", "body")
    return rows.select("search", "total", "n", "code", F.array_join("display", "|").alias("display"), c("extra")["box"].alias("box"))


def qc_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The gates over annotations: a feature of several symbols, units with conflicting pairs or accessions."""
    n = c("obs_id")
    obs = table(spark, d, "observations").withColumns({"symbol": F.when(n % 500 == 0, "OTHER").otherwise(c("feature")), "accession": F.when(n % 7 == 0, "A1"), "pair": F.when(n % 3 == 0, "p1").when(n % 3 == 1, "p2")})
    return qc.issues(obs, "run_id", "feature", "group_name", "unit", "technical", "batch", "value", "mean", True, annotations=["pair", "symbol", "accession"])


def outside_universe(spark: SparkSession, d: str) -> DataFrame:
    """Ordered parts that are not among the small ones."""
    items, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return enrichment.outside_universe(items.filter("l_quantity >= 49").select(c("l_partkey").alias("gene")), part.filter("p_size < 40").select(c("p_partkey").alias("gene")))


def followup_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The status of follow-ups of each kind."""
    ev = table(spark, d, "date_evidence").select(F.when(c("evidence_id") % 2 == 0, "ok").otherwise("failed").alias("status"))
    parts = [(n, followup.rollup(q, *o)) for n, q, o in (("mixed", ev, ()), ("good", ev.filter("status = 'ok'"), ()), ("lost", ev.filter("status = 'failed'"), ()), ("none", ev.limit(0), ()), ("blocked", ev, (True,)), ("offline", ev, (False, True)), ("short", ev.select(F.lit("budget_exhausted").alias("status")), ()))]
    out = None
    for name, p in parts:
        p = p.select(F.lit(name).alias("case"), "status")
        out = p if out is None else out.unionByName(p)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        merged_records, merge_conflicts, screening_start, scope_and_years, search_log, name_warnings, compare_records, month_windows, journal_filter, monthly_corpus, figure_summary, figure_intervals, open_locations,
        citation_candidates, variant_parse, variant_lift, clinical_rows, qc_annotations, outside_universe, followup_rollup,
    )
}
_KEY = "run_id, feature, group_name, unit"
_OBS = "o as (select *, case when obs_id % 500 = 0 then 'OTHER' else feature end as symbol, case when obs_id % 7 = 0 then 'A1' end as accession, case obs_id % 3 when 0 then 'p1' when 1 then 'p2' end as pair from observations)"
SQL = {
    "scope_and_years": f"with {_J} " + " union all ".join(f"select '{s}' as scope, {str(b).lower()} as bounded, count(*) as n, coalesce(sum(rec_no), 0)::bigint as sum from j where {cond}{' and year between 2005 and 2018' if b else ''}" for s, cond in _SCOPES.items() for b in (False, True)),
    "search_log": "with g as (select provider, 300 as expected_total, count(*) as retrieved, count(distinct evidence_id % 7) as pages, max(case when evidence_id % 97 = 0 and contains(provider, 'e') then 'timeout' end) as failure from date_evidence group by 1) select *, retrieved >= 300 and failure is null as complete_for_query, case when failure is not null then 'partial' else 'ok' end as status, case when failure is not null then 'provider_failure' when retrieved >= 300 then 'exhausted' when retrieved >= 100 then 'requested_limit' else 'provider_or_page_limit' end as stop_reason from g",
    "name_warnings": "with a as (select rec_no, list_filter(authors, lambda a: coalesce(a.family, '') <> '') as l from records), u as (select rec_no, generate_subscripts(l, 1) - 1 as place, unnest(l) as a from a) select rec_no, place, 'authors' as field, 'display name retained; family/given not inferred' as issue from u where not contains(a.family, ',') and coalesce(a.given, '') = ''",
    "compare_records": f"""with y as (select rec_no, list(distinct date_parts[1][1]) as years from date_evidence where rec_no is not null group by 1), r as (select rec_no, identifiers['pmid'] as pmid, title, year, journal, list_transform(authors, lambda a: coalesce(a.family, '')) as authors, years, null::varchar as volume, null::varchar as issue, null::varchar as pages, null::varchar as article_number from records left join y using (rec_no) where identifiers['pmid'] is not null),
f as (select * from r qualify row_number() over (partition by pmid order by rec_no) = 1), p as (select r.rec_no, f.rec_no as canonical_no, r as s, f as k from r join f using (pmid) where r.rec_no <> f.rec_no)
{' union all '.join(_FIELD(f, "when coalesce(list_contains(k.years, s.year), false) then 'matches_alternate_publication_date'" if f == 'year' else '') for f in corpus.COMPARED)}
union all select rec_no, canonical_no, 'authors', case when coalesce(len(s.authors), 0) = 0 then 'not_supplied' when coalesce(len(k.authors), 0) = 0 then 'source_missing' when len(list_filter(s.authors, lambda n: regexp_matches(n, '(?i)et\\s*al|等'))) > 0 then 'truncated_presentation_needs_style_check' when {_PLAIN.format('s.authors')} = {_PLAIN.format('k.authors')} then 'match' else 'needs_review' end from p""",
    "month_windows": f"""with m as (select distinct {_MONTH} as month from date_evidence), n as (select month, coalesce(month, '2024-04') as x from m), k as (select month, regexp_full_match(x, '[0-9]{{4}}-(0[1-9]|1[0-2])') as ok, try_cast(x || '-01' as date) as f from n)
select month, case when ok and f < date '2024-05-01' then cast(f as varchar) end as first, case when ok and f < date '2024-05-01' then cast(last_day(f) as varchar) end as last, case when not ok or f is null then 'malformed' when f < date '2024-05-01' then 'completed' else 'not_completed' end as status from k""",
    "journal_filter": "with n as (select rec_no, case when rec_no % 7 = 0 then 'science (new york, n.y.)' else lower(trim(coalesce(journal, ''))) end as name, case when rec_no % 2 = 0 then upper(journal) else 'Science' end as w from records) select rec_no, coalesce(case when rec_no % 5 = 0 then rec_no % 10 = 0 else name = lower(w) or (w = 'Science' and name = 'science (new york, n.y.)') end, false) as of_journal from n",
    "monthly_corpus": f"""with e as (select d.*, r.journal, r.title, r.identifiers['pmid'] as pm, case when regexp_full_match({_MONTH}, '[0-9]{{4}}-(0[1-9]|1[0-2])') then {_MONTH} end as month from date_evidence d join records r using (rec_no)),
g as (select rec_no, arg_min(journal, evidence_id) as journal, arg_min(title, evidence_id) filter (where evidence_id % 3 = 0 and title <> '') as abstract, bool_or(evidence_id % 50 = 0) as retraction_notice_flag, count(distinct concat_ws('|', provider, coalesce(month, '-'), coalesce(basis, '-'))) as statements, count(distinct month) as months, coalesce(bool_or(month = '2024-05'), false) as hit, max(nullif(pm, '')) as pmid from e group by 1)
select rec_no, journal, abstract, retraction_notice_flag, statements, case when months = 0 then 'unresolved' when months > 1 then 'conflicting_dates' else 'in_month' end as month_status, case when abstract is null then 'metadata' else 'abstract' end as access_level, pmid from g where hit or months = 0""",
    "figure_summary": "with u as (select run_id, feature, group_name, unit, avg(value) as value from observations group by all) select run_id, feature, group_name, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(stddev_samp(value) / sqrt(count(value)), 6) as sem from u group by all having count(value) > 0",
    "open_locations": "with l as (select year as doi, rec_no % 2 as s, rec_no as place, 'https://oa.example/' || (rec_no % 40) as url, case when rec_no % 3 = 0 then 'pdf' else 'html' end as format, case when rec_no % 2 = 0 then 'a' else 'b' end as source, provider as license, record_type as version from records where year is not null and rec_no % 13 <> 0) select doi, url, format, source, license, version, format <> 'pdf' as behind_pdf from l qualify row_number() over (partition by doi, url order by s desc, place desc) = 1",
    "citation_candidates": "with k as (select printf('C%04d', item_id) as claim_id, text from eval_items order by claim_id limit 20), f as (select printf('C%04d', rec_no % 40) as claim_id, string_agg(cast(rec_no as varchar), ';' order by rec_no) as ids from records group by 1) select claim_id, text, coalesce(ids, '') as candidate_ids, 'not_assessed' as claim_support from k left join f using (claim_id)",
    "variant_parse": f"with {_V} select l_orderkey, l_linenumber, case when status = 'ok' then ch end as chrom, case when status = 'ok' then l_partkey end as pos, case when status = 'ok' then r end as ref, case when status = 'ok' then a end as alt, status from v",
    "variant_lift": f"""with {_V}, m as (select p_partkey, p_size % 5 <> 0 as up, substr('ACGT', p_partkey % 4 + case when p_size % 7 = 0 then 2 else 1 end, 1) as base from part),
x as (select v.*, m.up, m.base, case when l_suppkey % 3 = 0 then 'given' when length(a) <> 1 then 'indel_not_lifted' when ch <> '8' or not coalesce(up, false) then 'no_unique_mapping' when coalesce(base, '') <> r then 'reference_differs' else 'lifted' end as st from v left join m on m.p_partkey = v.l_partkey where status = 'ok'),
y as (select *, l_partkey + case when st = 'lifted' then 100 else 0 end as p from x)
select l_orderkey, l_linenumber, case when st in ('given', 'lifted') then ch || ':' || p || '-' || r || '-' || a end as canonical, case when st in ('given', 'lifted') then 'chr' || ch || '_' || p || '_' || r || '_' || a || '_b38' end as variant_id, st as status from y""",
    "clinical_rows": "select p_brand || '/' || p_size as search, count(*) over w as total, row_number() over (partition by p_brand, p_size order by p_partkey) - 1 as n, cast(p_partkey as varchar) as code, p_type as display, p_name as box from part window w as (partition by p_brand, p_size)",
    "qc_annotations": f"""with {_OBS}, fl as (select run_id, count(value) as n, min(value) as floor, count(*) filter (where value = m) as at_floor from (select run_id, value, min(value) over (partition by run_id) as m from observations where value is not null) group by run_id)
select * from (select 'blocking' as severity, 'unit_cross_group' as code, count(*) as cases from (select 1 from o group by run_id, unit having count(distinct group_name) > 1) union all select 'blocking', 'conflicting_batch', count(*) from (select 1 from o group by {_KEY} having count(distinct batch) > 1)
 union all select 'warning', 'repeated_floor', count(*) from fl where n >= 20 and at_floor >= greatest(4, 0.15 * n) union all select 'blocking', 'batch_group_confounding', count(*) from (select run_id from (select run_id, batch, count(distinct group_name) as g from o where batch is not null group by all) group by run_id having count(*) > 1 and max(g) = 1)
 {' '.join(f"union all select 'blocking', 'conflicting_{x}', count(*) from (select 1 from o group by {_KEY} having count(distinct {x}) > 1)" for x in ('pair', 'symbol', 'accession'))}
 union all select 'blocking', 'feature_identity_conflict', count(*) from (select 1 from o group by feature having greatest(count(distinct symbol), count(distinct accession)) > 1)) where cases > 0""",
    "outside_universe": "select distinct l_partkey as gene from lineitem where l_quantity >= 49 and l_partkey not in (select p_partkey from part where p_size < 40)",
    "followup_rollup": "select * from (values ('mixed', 'retrieval_partial_requires_evidence_reading'), ('good', 'retrieval_completed_requires_evidence_reading'), ('lost', 'retrieval_failed'), ('none', 'no_eligible_signal'), ('blocked', 'qc_blocked'), ('offline', 'pending_offline'), ('short', 'budget_exhausted')) v(\"case\", status)",
}
SQL = {k: rounded_sql(v) for k, v in SQL.items()}
