"""Corpora of records: merged records, searches, months of journals, open-access locations, citation candidates.

Every merge is a grouped aggregate with bounded state (first non-empty values, sets of distinct
evidence), so a record with many copies costs no task its whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions.text import in_scope, normalize_title, squeeze
from verispan.scale import attach, fenced

COMPARED = ("title", "year", "journal", "volume", "issue", "pages", "article_number")
CONFLICTS = ("title", "year", "authors")


def filled(value: Column, kind: str) -> Column:
    """Whether a field of the given type has a value: no null, empty text, empty list or zero."""
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(value != 0, F.lit(False)) if kind in ("int", "bigint", "double", "smallint") else value.isNotNull()


def merged_records(records: DataFrame, mapping: DataFrame, order: str, ids: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """One row per kept record of ``mapping`` (order, kept_order): fields that were empty filled from the records merged into it.

    The first non-empty value by ``order`` stays. ``identifiers`` gain the names they lacked,
    ``lists`` are united, ``merged_from`` counts the records.
    """
    kinds = dict(records.dtypes)
    rows = records.join(mapping.select(order, "kept_order"), order)
    own = [c for c in records.columns if c not in (order, "identifiers", *lists)]
    first = lambda c, kind, v: F.min_by(v, F.when(filled(v, kind), F.col(order))).alias(c)
    aggs = [first(c, kinds[c], F.col(c)) for c in own]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    aggs += [first(f"__id_{k}", "string", F.col("identifiers")[k]) for k in ids]
    out = rows.groupBy("kept_order").agg(*aggs, F.count("*").alias("merged_from"))
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"__id_{k}").alias("value")) for k in ids]), lambda p: filled(p["value"], "string"))
    return out.withColumn("identifiers", F.map_from_entries(pairs)).drop(*[f"__id_{k}" for k in ids]).withColumnRenamed("kept_order", order)


def merge_conflicts(records: DataFrame, mapping: DataFrame, merged: DataFrame, order: str, fields: Sequence[str] = CONFLICTS) -> DataFrame:
    """``kept_order, order, field, kept, alternative``: values of merged records that differ from the kept ones."""
    kinds = dict(records.dtypes)
    text = lambda c: F.col(c).cast("string") if not kinds[c].startswith("array") else F.to_json(c)
    mine = F.array(*[F.struct(F.lit(f).alias("field"), F.when(filled(F.col(f), kinds[f]), text(f)).alias("alternative")) for f in fields])
    rows = records.join(mapping.filter("merged"), order).select("kept_order", order, F.explode(mine).alias("x")).select("kept_order", order, "x.*").filter("alternative is not null")
    kept = merged.select(F.col(order).alias("kept_order"), *[text(f).alias(f"__{f}") for f in fields])
    rows = attach(rows, kept, ["kept_order"])
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(f"__{f}")) for f in fields])
    return rows.withColumn("kept", value).filter("kept <> alternative").select("kept_order", order, "field", "kept", "alternative")


def in_years(year: Column, first: int | None = None, last: int | None = None) -> Column:
    """Whether a year lies in the range; without a year only if there is no bound."""
    keep = F.lit(True)
    if first is not None:
        keep = keep & (year >= first)
    if last is not None:
        keep = keep & (year <= last)
    return F.coalesce(keep, F.lit(False))


def select_records(merged: DataFrame, scope: str = "all", first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Merged search results within a journal scope and a range of years, filtered after retrieval."""
    return merged.filter(in_scope(F.col("journal"), scope) & in_years(F.col("year"), first_year, last_year))


def search_counters(log: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    """Per search: expected, retrieved, pages, whether it is complete, its status and why it stopped.

    ``log`` has one row per page: page, rows, total, failure.
    """
    out = log.groupBy(*key).agg(F.max("total").alias("expected_total"), F.coalesce(F.sum("rows"), F.lit(0)).alias("retrieved"), F.countDistinct("page").alias("pages"), F.max("failure").alias("failure"))
    failed = F.col("failure").isNotNull()
    out = out.withColumn("complete_for_query", F.coalesce((F.col("retrieved") >= F.col("expected_total")) & ~failed, F.lit(False)))
    status = F.when(failed & (F.col("retrieved") > 0), "partial").when(failed, "failed").otherwise("ok")
    stop = F.when(failed, "provider_failure").when(F.col("complete_for_query"), "exhausted").when(F.col("retrieved") >= limit, "requested_limit").otherwise("provider_or_page_limit")
    return out.withColumns({"status": status, "stop_reason": stop})


def name_warnings(records: DataFrame, key: str, unparsed=lambda a: ~F.coalesce(a["family"], F.lit("")).contains(",") & (F.coalesce(a["given"], F.lit("")) == "")) -> DataFrame:
    """One warning per author whose display name was kept because family and given name are not stated apart."""
    rows = records.select(key, F.posexplode(F.filter("authors", lambda a: F.coalesce(a["family"], F.lit("")) != "")).alias("place", "a"))
    return rows.filter(unparsed(F.col("a"))).select(key, "place", F.lit("authors").alias("field"), F.lit("display name retained; family/given not inferred").alias("issue"))


def compare_records(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, field, status`` of ``pairs`` with structs ``supplied`` and ``canonical``: the fields of ``COMPARED`` they have, and authors.

    ``canonical.years`` may hold further publication years. Author lists are arrays of display names.
    """
    have = lambda side: {f.name for f in pairs.schema[side].dataType.fields}
    part = lambda side, f: F.col(f"{side}.{f}").cast("string") if f in have(side) else F.lit(None).cast("string")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = []
    for f in COMPARED:
        a, b = part("supplied", f), part("canonical", f)
        status = F.when(blank(a), "not_supplied").when(blank(b), "source_missing").when(normalize_title(a) == normalize_title(b), "match")
        if f == "year" and "years" in have("canonical"):
            status = status.when(F.coalesce(F.array_contains("canonical.years", F.col("supplied.year")), F.lit(False)), "matches_alternate_publication_date")
        checks.append(F.struct(F.lit(f).alias("field"), status.otherwise("needs_review").alias("status")))
    if "authors" in have("supplied") and "authors" in have("canonical"):
        a, b = F.col("supplied.authors"), F.col("canonical.authors")
        none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
        plain = lambda x: F.array_join(F.transform(x, lambda n: F.trim(F.regexp_replace(F.lower(n), r"[^\p{L}\p{N}_]+", " "))), "\x1f", "")
        cut = F.exists(a, lambda n: F.coalesce(n.rlike(r"(?i)et\s*al|等"), F.lit(False)))
        status = F.when(none(a), "not_supplied").when(none(b), "source_missing").when(cut, "truncated_presentation_needs_style_check").when(plain(a) == plain(b), "match").otherwise("needs_review")
        checks.append(F.struct(F.lit("authors").alias("field"), status.alias("status")))
    return pairs.select(*key, F.explode(F.array(*checks)).alias("__check")).select(*key, "__check.field", "__check.status")


def screening_ledger(kept: DataFrame, record: str = "record_id") -> DataFrame:
    """A pending screening ledger of deduplicated records."""
    none = F.lit(None).cast("string")
    return kept.select(F.col(record).alias("record_id"), none.alias("duplicate_of"), F.lit("pending").alias("title_abstract_decision"), none.alias("report_id"), F.lit("pending").alias("retrieval"), F.lit("pending").alias("fulltext_decision"), none.alias("exclusion_reason"), none.alias("study_id"))


def month_window(month: Column, today: Column) -> Column:
    """``first, last, status`` of a completed month ``yyyy-MM``; null stands for the month before ``today``."""
    text = F.coalesce(month, F.date_format(F.add_months(F.trunc(today, "month"), -1), "yyyy-MM"))
    ok = text.rlike(r"^[0-9]{4}-(?:0[1-9]|1[0-2])$")
    first = F.when(ok, F.concat(text, F.lit("-01"))).try_cast("date")
    over = first < F.trunc(today, "month")
    status = F.when(~ok | first.isNull(), "malformed").when(over, "completed").otherwise("not_completed")
    return F.struct(F.when(over, first).alias("first"), F.when(over, F.last_day(first)).alias("last"), status.alias("status"))


def of_journal(issns: Column, name: Column, journal: Column, known: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Whether a record is of ``journal``: by an ISSN among the ``known`` ones, or by its exact name if it states none."""
    stated = F.filter(issns, lambda x: F.coalesce(x, F.lit("")) != "")
    names = F.array(F.lower(journal))
    for j, more in aliases.items():
        names = F.when(journal == j, F.concat(F.array(F.lower(journal)), F.array(*[F.lit(m) for m in more]))).otherwise(names)
    by_name = F.array_contains(names, F.lower(F.trim(F.coalesce(name, F.lit("")))))
    return F.coalesce(F.when(F.coalesce(F.size(stated), F.lit(0)) > 0, F.arrays_overlap(stated, known)).otherwise(by_name), F.lit(False))


def monthly_records(rows: DataFrame, key: str, order: str, month: str, ids: Sequence[str] = ()) -> DataFrame:
    """The records of a month: one row per ``key`` with united evidence, the first abstract, and whether any source flags a retraction.

    ``rows``: key, order, journal, abstract, retraction_notice_flag, provider, month, basis,
    identifiers. A record with dated months but not this one is left out. ``evidence`` holds each
    distinct statement once. Sort the result by ``corpus_order``.
    """
    last = lambda k: F.max_by(F.col("identifiers")[k], F.when(filled(F.col("identifiers")[k], "string"), F.col(order))).alias(f"__id_{k}")
    out = rows.groupBy(key).agg(
        F.min_by("journal", order).alias("journal"), F.min_by("abstract", F.when(filled(F.col("abstract"), "string"), F.col(order))).alias("abstract"),
        F.coalesce(F.bool_or("retraction_notice_flag"), F.lit(False)).alias("retraction_notice_flag"), F.array_sort(F.collect_set(F.struct("provider", "month", "basis"))).alias("evidence"), *[last(k) for k in ids],
    )
    months = F.array_distinct(F.filter(F.transform("evidence", lambda e: e["month"]), lambda m: m.isNotNull()))
    out = out.withColumn("months", months).filter((F.size("months") == 0) | F.array_contains("months", month))
    status = F.when(F.size("months") == 0, "unresolved").when(F.size("months") > 1, "conflicting_dates").otherwise("in_month")
    out = out.withColumns({"month_status": status, "access_level": F.when(filled(F.col("abstract"), "string"), "abstract").otherwise("metadata")})
    if ids:
        pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"__id_{k}").alias("value")) for k in ids]), lambda p: p["value"].isNotNull())
        out = out.withColumn("identifiers", F.map_from_entries(pairs)).drop(*[f"__id_{k}" for k in ids])
    return out.drop("months")


def corpus_order(records: DataFrame, key: str) -> DataFrame:
    """A corpus by journal and record."""
    return records.orderBy("journal", key)


def open_locations(first: DataFrame, second: DataFrame, key: str = "doi") -> DataFrame:
    """``key`` with the open locations of two services: one per address, its last statement at the place of its first, PDF first.

    Both have key, place, url, format, source, license, version.
    """
    fields = ["format", "source", "license", "version"]
    rows = first.withColumn("__s", F.lit(0)).unionByName(second.withColumn("__s", F.lit(1))).filter(F.coalesce("url", F.lit("")) != "")
    at = F.struct("__s", "place")
    out = rows.groupBy(key, "url").agg(F.min(at).alias("__at"), F.max_by(F.struct(*fields), at).alias("l"))
    out = out.select(key, "url", "l.*", "__at").withColumn("rank", F.struct((F.coalesce("format", F.lit("")) != "pdf").alias("other"), "__at"))
    return out.drop("__at")


def citation_candidates(claims: DataFrame, found: DataFrame, most_claims: int = 5) -> DataFrame:
    """``claim_id, text, candidate_ids, claim_support`` for the first claims of a text: what a search found for each, in order.

    ``claims``: claim_id, text; ``found``: claim_id, place, record_id, at most a page of results per claim.
    """
    if not 1 <= most_claims <= 20:
        raise ValueError("1 to 20 claims")
    some = claims.orderBy("claim_id").limit(most_claims)
    ids = found.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("place", "record_id"))).alias("f"))
    ids = ids.select("claim_id", F.col("f.record_id").alias("candidate_ids"))
    return some.join(ids, "claim_id", "left").select("claim_id", "text", F.coalesce("candidate_ids", F.array().cast("array<string>")).alias("candidate_ids"), F.lit("not_assessed").alias("claim_support"))


def metadata_listing(records: DataFrame, most: int) -> DataFrame:
    """The first records of a digest: identity, title, year, journal and DOI; a top-k by year and record."""
    return records.select("record_id", squeeze(F.col("title")).alias("title"), "year", "journal", "doi").orderBy(F.desc_nulls_last("year"), "record_id").limit(most)


VARIANT = r"(?i)^(?:chr)?([0-9]{1,2}|X|Y|MT)[\s:_/-]+([1-9][0-9]*)[\s:_/-]+([ACGT]+)[\s:_/-]+([ACGT]+)$"


def parse_variant(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``chrom, pos, ref, alt, status`` of a variant text: ``ok``, ``malformed``, ``bad_chromosome`` or ``same_alleles``."""
    cut = F.split(F.regexp_replace(F.trim(text), VARIANT, "\x1f$1\x1f$2\x1f$3\x1f$4"), "\x1f")
    df = fenced(df, {"__g": cut})
    g = lambda i: F.upper(F.get("__g", F.lit(i)))
    number = g(1).try_cast("int")
    status = F.when(F.coalesce(F.size("__g"), F.lit(0)) != 5, "malformed").when(number.isNotNull() & ~number.between(1, 22), "bad_chromosome").when(g(3) == g(4), "same_alleles").otherwise("ok")
    df = fenced(df, {"status": status})
    ok = lambda c: F.when(F.col("status") == "ok", c)
    return df.withColumns({"chrom": ok(g(1)), "pos": ok(g(2).try_cast("bigint")), "ref": ok(g(3)), "alt": ok(g(4))}).drop("__g")


def lift_variants(variants: DataFrame, mappings: DataFrame, bases: DataFrame, key: str, target: str) -> DataFrame:
    """``key, canonical, variant_id, status`` of parsed variants (chrom, pos, ref, alt, assembly) on the assembly ``target``.

    Only single bases are lifted: by the one mapping on the same strand (``mappings``: chrom, pos,
    to_chrom, to_pos, strand), and only if the base there (``bases``: chrom, pos, base) is the reference.
    """
    one = mappings.filter("strand = 1").groupBy("chrom", "pos").agg(F.count("*").alias("maps"), F.min("to_chrom").alias("to_chrom"), F.min("to_pos").alias("to_pos"))
    there = bases.select(F.col("chrom").alias("to_chrom"), F.col("pos").alias("to_pos"), F.upper("base").alias("base"))
    rows = variants.join(one, ["chrom", "pos"], "left").join(there, ["to_chrom", "to_pos"], "left")
    same = F.col("assembly") == target
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    status = F.when(same, "given").when(~snv, "indel_not_lifted").when(F.coalesce(F.col("maps") != 1, F.lit(True)), "no_unique_mapping").when(F.coalesce(F.col("base") != F.col("ref"), F.lit(True)), "reference_differs").otherwise("lifted")
    rows = rows.withColumn("status", status).withColumns({"c": F.when(same, F.col("chrom")).otherwise(F.col("to_chrom")), "p": F.when(same, F.col("pos")).otherwise(F.col("to_pos"))})
    ok = F.col("status").isin("given", "lifted")
    canonical = F.when(ok, F.format_string("%s:%d-%s-%s", "c", "p", "ref", "alt"))
    named = F.when(ok, F.format_string(f"chr%s_%d_%s_%s_b{target[-2:]}", "c", "p", "ref", "alt"))
    return rows.select(key, canonical.alias("canonical"), named.alias("variant_id"), "status")


def clinical_rows(answers: DataFrame, key: str, body: str) -> DataFrame:
    """``key, total, n, code, display, extra`` of answers ``[total, codes, extra fields, rows]``; another shape has no rows."""
    part = lambda i, kind: F.from_json(F.get_json_object(body, f"$[{i}]"), kind)
    rows = answers.select(key, F.get_json_object(body, "$[0]").try_cast("bigint").alias("total"), part(1, "array<string>").alias("codes"), part(2, "map<string,array<string>>").alias("more"), part(3, "array<array<string>>").alias("shown"))
    pairs = F.slice(F.arrays_zip("codes", "shown"), 1, F.least(F.size("codes"), F.size("shown")))
    rows = rows.filter("codes is not null and shown is not null").select(key, "total", "more", F.posexplode(pairs).alias("n", "p"))
    extra = F.transform_values(F.coalesce("more", F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")), lambda k, v: F.get(v, F.col("n")))
    return rows.select(key, "total", "n", F.col("p.codes").alias("code"), F.col("p.shown").alias("display"), extra.alias("extra"))
