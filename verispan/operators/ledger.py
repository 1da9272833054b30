"""Evidence ledgers: screening flow, claims, numeric checks, coverage, monthly corpora, review packets.

Each rule is a filter; the issues of a ledger are the union of its rules.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions.text import paragraphs, squeeze

# Claim statuses, and units with dimension and factor.
STATUSES = ("pending", "supported", "partially_supported", "contradicted", "not_found", "insufficient_access", "not_assessable")
JUDGED = ("supported", "partially_supported", "contradicted")
UNITS = {
    "number": ("number", "1"), "fraction": ("ratio", "1"), "%": ("ratio", "0.01"), "percent": ("ratio", "0.01"), "percentage_point": ("percentage_point", "1"),
    "mg": ("mass", "0.001"), "g": ("mass", "1"), "ug": ("mass", "0.000001"), "μg": ("mass", "0.000001"), "µg": ("mass", "0.000001"), "ng": ("mass", "0.000000001"),
    "mL": ("volume", "0.001"), "L": ("volume", "1"), "uL": ("volume", "0.000001"), "μL": ("volume", "0.000001"), "s": ("time", "1"), "min": ("time", "60"), "h": ("time", "3600"),
}


def screening_flow(ledger: DataFrame, order: str) -> DataFrame:
    """One row of flow counts, errors and whether the flow is valid and complete.

    ``ledger`` has record_id, duplicate_of, title_abstract_decision, report_id, retrieval,
    fulltext_decision, exclusion_reason, study_id. The first row of a report, by ``order``, decides
    for it; rows of a report that disagree are an error.
    """
    c = F.col
    unique = c("duplicate_of").isNull()
    heads = ledger.agg(
        F.count("*").alias("records_identified"), F.count_if(~unique).alias("duplicate_records_removed"), F.count_if(unique & c("title_abstract_decision").isin("include", "exclude")).alias("records_screened"),
        F.count_if(unique).alias("__unique"), F.count_if(unique & (c("title_abstract_decision") == "exclude")).alias("records_excluded_title_abstract"),
        F.count_if(unique & (c("title_abstract_decision") == "include") & c("report_id").isNull()).alias("__no_report"), F.count_if(c("record_id").isNull()).alias("__no_id"),
    )
    repeated = ledger.filter(c("record_id").isNotNull()).groupBy("record_id").count().agg(F.coalesce(F.sum(c("count") - 1), F.lit(0)).alias("__repeated"))
    known = ledger.groupBy(c("record_id").alias("duplicate_of")).agg(F.lit(True).alias("__known"), F.max(c("duplicate_of").isNotNull()).alias("__chained"))
    dup = ledger.filter(~unique).select("record_id", "duplicate_of").join(known, "duplicate_of", "left")
    dup = dup.agg(F.count_if(F.coalesce(~c("__known"), F.lit(True)) | (c("record_id") == c("duplicate_of")) | F.coalesce(c("__chained"), F.lit(False))).alias("__bad_duplicates"))
    decision = F.struct("retrieval", "fulltext_decision", "exclusion_reason", "study_id")
    seeking = ledger.filter(unique & (c("title_abstract_decision") == "include") & c("report_id").isNotNull())
    reports = seeking.groupBy("report_id").agg(F.min_by(decision, order).alias("d"), F.min(F.to_json(decision)).alias("a"), F.max(F.to_json(decision)).alias("b"))
    got = F.coalesce(c("d.retrieval") == "retrieved", F.lit(False))
    lost = F.coalesce(c("d.retrieval") == "not_retrieved", F.lit(False))
    into = got & F.coalesce(c("d.fulltext_decision") == "include", F.lit(False))
    out = got & F.coalesce(c("d.fulltext_decision") == "exclude", F.lit(False))
    tail = reports.agg(
        F.count("*").alias("reports_sought"), F.count_if(lost).alias("reports_not_retrieved"), F.count_if(got).alias("reports_retrieved"), F.count_if(out).alias("reports_excluded_fulltext"), F.count_if(into).alias("reports_included"),
        F.countDistinct(F.when(into, c("d.study_id"))).alias("studies_included"), F.count_if(~lost & ~into & ~out).alias("reports_unresolved"),
        F.count_if(c("a") != c("b")).alias("__conflicts"), F.count_if(out & c("d.exclusion_reason").isNull()).alias("__no_reason"), F.count_if(into & c("d.study_id").isNull()).alias("__no_study"),
    )
    row = heads.crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(tail))  # one row each
    errors = c("__no_report") + c("__no_id") + c("__repeated") + c("__bad_duplicates") + c("__conflicts") + c("__no_reason") + c("__no_study")
    row = row.withColumns({"records_pending_screening": c("__unique") - c("records_screened"), "errors": errors})
    row = row.withColumns({"valid": c("errors") == 0, "complete": (c("records_pending_screening") == 0) & (c("reports_unresolved") == 0) & (c("errors") == 0)})
    return row.drop(*[x for x in row.columns if x.startswith("__")])


def exclusion_reasons(ledger: DataFrame, order: str) -> DataFrame:
    """Full-text exclusions by reason, one per report."""
    seeking = ledger.filter("duplicate_of is null and title_abstract_decision = 'include' and report_id is not null")
    first = seeking.groupBy("report_id").agg(F.min_by(F.struct("retrieval", "fulltext_decision", "exclusion_reason"), order).alias("d")).select("d.*")
    return first.filter("retrieval = 'retrieved' and fulltext_decision = 'exclude' and exclusion_reason is not null").groupBy("exclusion_reason").agg(F.count("*").alias("reports"))


def numeric_status(reported: Column, reported_unit: Column, source: Column, source_unit: Column, places: Column) -> Column:
    """Whether a reported number states a source number: exactly, after unit conversion, or rounded half up to the declared places."""
    dims = F.create_map(*[F.lit(x) for k, (d, _) in UNITS.items() for x in (k, d)])
    factor = F.create_map(*[x for k, (_, f) in UNITS.items() for x in (F.lit(k), F.lit(f).cast("decimal(20,9)"))])
    a, b = F.try_element_at(dims, reported_unit), F.try_element_at(dims, source_unit)
    actual = reported.cast("decimal(38,18)")
    # compare reported * its factor with source * its factor, so that no division loses digits
    left = (reported.cast("decimal(20,9)") * F.try_element_at(factor, reported_unit)).cast("decimal(38,18)")
    right = (source.cast("decimal(20,9)") * F.try_element_at(factor, source_unit)).cast("decimal(38,18)")
    ratio = (right / F.try_element_at(factor, reported_unit)).cast("decimal(38,12)")
    rounded = F.lit(False)
    for p in range(13):
        rounded = F.when(places == p, F.round(ratio, p).cast("decimal(38,18)") == actual).otherwise(rounded)
    return F.when(a.isNull() | b.isNull(), "unsupported_unit").when(a != b, "incompatible_units").when(left == right, "exact_or_unit_equivalent").when(F.coalesce(rounded, F.lit(False)), "compatible_with_declared_rounding").otherwise("numeric_mismatch")


def init_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Each paragraph as a pending claim ``C0001`` within its text."""
    rows = texts.select(key, F.posexplode(paragraphs(F.col(text))).alias("i", "text"))
    n = (F.col("i") + 1).cast("string")
    return rows.select(key, F.concat(F.lit("C"), F.lpad(n, F.greatest(F.length(n), F.lit(4)), F.lit("0"))).alias("claim_id"), "text", F.lit("pending").alias("status"))


def validate_claims(claims: DataFrame, sources: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``claim_id, code``: every rule a claim breaks.

    ``claims``: claim_id, status, text, assessor, rationale, evidence_type. ``sources``: claim_id,
    path, url, locator, excerpt, source_sha256. ``texts``: path, text, sha256 of local sources.
    """
    c = F.col
    judged = F.coalesce(c("status").isin(*JUDGED), F.lit(False))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    issue = lambda df, code: df.select("claim_id", F.lit(code).alias("code"))
    dup = claims.groupBy("claim_id").count().filter("count > 1 or claim_id is null")
    parts = [
        issue(dup, "id"), issue(claims.filter(~F.coalesce(c("status").isin(*STATUSES), F.lit(False))), "status"), issue(claims.filter(blank(c("text"))), "text"),
        issue(claims.filter(judged).join(sources, "claim_id", "left_anti"), "source"), issue(claims.filter(judged & (blank(c("assessor")) | blank(c("rationale")))), "semantic_review"),
        issue(claims.filter(judged & (blank(c("evidence_type")) | (c("evidence_type") == "unassessed"))), "evidence_type"),
    ]
    both = sources.join(claims.select("claim_id", judged.alias("judged")), "claim_id")
    parts += [issue(both.filter(blank(c("locator"))), "locator"), issue(both.filter(c("judged") & blank(c("excerpt"))), "excerpt"), issue(both.filter(blank(c("path")) & blank(c("url"))), "source")]
    parts.append(issue(both.filter(~blank(c("path")) & blank(c("source_sha256"))), "source_hash"))
    if texts is not None:
        local = both.filter(~blank(c("path"))).join(texts, "path", "left")
        parts += [issue(local.filter(c("sha256").isNull()), "path"), issue(local.filter(c("sha256") != c("source_sha256")), "source_hash")]
        parts.append(issue(local.filter(c("sha256").isNotNull() & ~blank(c("excerpt")) & ~squeeze(c("text")).contains(squeeze(c("excerpt")))), "excerpt"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def anchored(evidence: DataFrame, blocks: DataFrame, keys: list[str], quote: str, text: str) -> DataFrame:
    """``evidence`` with ``found``: its block exists and holds the quote, white space aside."""
    held = blocks.select(*keys, F.col(text).alias("__text"))
    out = evidence.join(held, keys, "left")
    return out.withColumn("found", F.coalesce(squeeze(F.col("__text")).contains(squeeze(F.col(quote))), F.lit(False))).drop("__text")


def coverage(source: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks on one side only: ``keys, side``."""
    a, b = source.select(*keys).distinct().withColumn("__a", F.lit(1)), translated.select(*keys).distinct().withColumn("__b", F.lit(1))
    out = a.join(b, keys, "full_outer").filter("__a is null or __b is null")
    return out.select(*keys, F.when(F.col("__a").isNull(), "not_in_source").otherwise("not_translated").alias("side"))


def date_evidence_month(rows: DataFrame, key: str, basis: str, parts: str, order: tuple[str, ...] = ("published-online", "published", "issued", "published-print")) -> DataFrame:
    """The month of first publication of each record: the first basis with any parts decides; a year alone leaves it unresolved."""
    rank = F.create_map(*[F.lit(x) for i, b in enumerate(order) for x in (b, i)])
    first = F.get(F.col(parts), F.lit(0))
    year, month = F.get(first, F.lit(0)), F.get(first, F.lit(1))
    live = rows.filter(F.col(basis).isin(*order) & year.isNotNull()).select(key, F.try_element_at(rank, F.col(basis)).alias("r"), year.alias("y"), month.alias("m"))
    best = live.groupBy(key).agg(F.min(F.struct("r", "y", F.coalesce("m", F.lit(0)).alias("m"))).alias("b"))
    ok = F.col("b.m").between(1, 12)
    return best.select(key, F.element_at(F.array(*[F.lit(x) for x in order]), F.col("b.r") + 1).alias("basis"), F.when(ok, F.concat_ws("-", F.lpad(F.col("b.y").cast("string"), 4, "0"), F.lpad(F.col("b.m").cast("string"), 2, "0"))).alias("month"))


def month_merge(dates: DataFrame, key: str, month: str, wanted: str) -> DataFrame:
    """Records whose dated months include ``wanted`` or that have none: ``status`` in_month, conflicting_dates or unresolved."""
    months = dates.groupBy(key).agg(F.countDistinct(month).alias("months"), F.coalesce(F.bool_or(F.col(month) == wanted), F.lit(False)).alias("hit"), F.count("*").alias("evidence"))
    months = months.filter("hit or months = 0")
    return months.select(key, "months", "evidence", F.when(F.col("months") == 0, "unresolved").when(F.col("months") > 1, "conflicting_dates").otherwise("in_month").alias("status"))


def independent_support(claims: DataFrame, trend: str, study: str, primary: Column, least: int = 2) -> DataFrame:
    """Distinct primary studies behind each trend and whether they are enough."""
    out = claims.groupBy(trend).agg(F.countDistinct(F.when(primary, F.col(study))).alias("primary_studies"), F.count("*").alias("papers"))
    return out.withColumn("supported", F.col("primary_studies") >= least)


def collect_reviews(reports: DataFrame, packet_sha256: str, reviewers: int) -> DataFrame:
    """One row: whether the reports of a frozen packet are ready to be compared.

    ``reports``: reviewer, context, status, packet_sha256.
    """
    one = reports.agg(
        F.count("*").alias("reports"), F.countDistinct("reviewer").alias("reviewers"), F.countDistinct("context").alias("contexts"),
        F.count_if(F.coalesce(F.col("status") != "complete", F.lit(True))).alias("incomplete"), F.count_if(F.coalesce(F.col("packet_sha256") != packet_sha256, F.lit(True))).alias("stale"),
    )
    ok = (F.col("reports") == reviewers) & (F.col("reviewers") == reviewers) & (F.col("contexts") == reviewers) & (F.col("incomplete") == 0) & (F.col("stale") == 0)
    return one.withColumn("ready", ok)


def required_fields(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """``key, field`` for every rule (field name -> condition that must hold) a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return rows.select(key, F.explode(broken).alias("field"))
