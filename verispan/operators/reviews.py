"""Checks of reconstructed evidence graphs and monthly syntheses: rules as joins and filters, issues as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.operators.ledger import STATUSES, anchored

KINDS = ("observation", "author_interpretation", "inference")
JUDGEMENT = ("rationale", "boundary", "decisive_test")
EXPERIMENT = ("question", "model", "groups", "biological_unit", "sample_size", "intervention", "readout", "statistics", "outcome")
PAPER = ("finding", "methods", "limitations", "source_locator", "study_key")
PLAN = (
    "question", "hypothesis", "model", "biological_unit", "primary_outcome", "measurement_time", "intervention", "randomization", "blinding", "exclusion_rule", "analysis_plan", "missing_data_rule",
    "multiplicity_rule", "success_criterion", "falsifying_result", "minimal_pilot", "stop_rule",
)


def blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def found(df: DataFrame, key: str, code: str | Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("item"), (F.lit(code) if isinstance(code, str) else code).alias("issue"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_fields(df: DataFrame, key: str, fields: tuple[str, ...], unless: Column | None = None) -> DataFrame:
    """One issue per blank field of a row; ``unless`` is an array column of excused fields."""
    excused = lambda f: F.coalesce(F.array_contains(unless, f), F.lit(False)) if unless is not None else F.lit(False)
    gone = F.array_compact(F.array(*[F.when(blank(f) & ~excused(f), F.lit(f"missing_{f}")) for f in fields]))
    return df.select(F.col(key).cast("string").alias("item"), F.explode(gone).alias("issue"))


def repeated(df: DataFrame, key: str, code: str) -> DataFrame:
    return found(df.groupBy(key).count().filter((F.col("count") > 1) | blank(F.col(key).cast("string"))), key, code)


def reconstruction_issues(sources: DataFrame, blocks: DataFrame, evidence: DataFrame, anchors: DataFrame, claims: DataFrame, experiments: DataFrame) -> DataFrame:
    """``item, issue`` for a graph sources - blocks - evidence - claims and experiments.

    ``sources``: source_id; ``blocks``: source_id, block_id, original; ``evidence``: evidence_id,
    statement, kind; ``anchors``: evidence_id, source_id, block_id, quote, page, visual_description,
    visual_checked; ``claims``: claim_id, text, status, rationale, boundary, decisive_test,
    alternative_explanations, evidence_ids; ``experiments``: experiment_id, the reported fields,
    not_reported, evidence_ids.
    """
    quoted = anchors.filter(~blank("block_id"))
    seen = anchored(quoted, blocks, ["source_id", "block_id"], "quote", "original")
    visual = anchors.filter(blank("block_id") & F.col("page").isNotNull())
    parts = [
        repeated(sources, "source_id", "repeated_source"), repeated(evidence, "evidence_id", "repeated_evidence"),
        found(evidence.filter(blank("statement") | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))), "evidence_id", "undescribed_evidence"),
        found(evidence.join(anchors.select("evidence_id").distinct(), "evidence_id", "left_anti"), "evidence_id", "no_anchor"),
        found(anchors.join(sources.select("source_id").distinct(), "source_id", "left_anti"), "evidence_id", "unknown_source"),
        found(seen.filter(~F.col("found") | blank("quote")), "evidence_id", "excerpt_absent"),
        found(visual.filter(blank("visual_description") | ~F.coalesce(F.col("visual_checked"), F.lit(False))), "evidence_id", "visual_unchecked"),
        found(anchors.filter(blank("block_id") & F.col("page").isNull()), "evidence_id", "no_place"),
    ]
    for df, key in ((claims, "claim_id"), (experiments, "experiment_id")):
        refs = df.select(F.col(key), F.explode_outer("evidence_ids").alias("evidence_id"))
        known = evidence.select("evidence_id").distinct()
        parts += [repeated(df, key, f"repeated_{key}"), found(refs.join(known, "evidence_id", "left_anti").select(key).distinct(), key, "unknown_evidence")]
    parts += [
        found(claims.filter(blank("text") | ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "claim_id", "no_judgement"), found(claims.filter("status = 'pending'"), "claim_id", "pending"),
        missing_fields(claims, "claim_id", JUDGEMENT), found(claims.filter(F.coalesce(F.size("alternative_explanations"), F.lit(0)) <= 0), "claim_id", "no_alternatives"), missing_fields(experiments, "experiment_id", EXPERIMENT, F.col("not_reported")),
    ]
    direct = claims.select("claim_id", "status", F.explode_outer("evidence_ids").alias("evidence_id")).filter("status = 'supported'").join(evidence.select("evidence_id", "kind"), "evidence_id", "left")
    direct = direct.groupBy("claim_id").agg(F.max(F.coalesce(F.col("kind") == "observation", F.lit(False))).alias("seen")).filter("not seen")
    parts.append(found(direct, "claim_id", "interpretation_only"))
    return union(parts)


def month_issues(corpus: DataFrame, papers: DataFrame, trends: DataFrame) -> DataFrame:
    """``item, issue`` for a screened month and its synthesis.

    ``corpus``: record_id, abstract, retraction_notice_flag; ``papers``: record_id, include, reason,
    life_sciences, month_verified, article_type, reading_level and the fields of ``PAPER``;
    ``trends``: trend_id, title, finding, limitations, next_experiment, kind, paper_ids.
    """
    ids = corpus.select("record_id").distinct()
    into = papers.filter(F.coalesce(F.col("include"), F.lit(False))).join(corpus.select("record_id", "abstract", "retraction_notice_flag"), "record_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    refs = trends.select("trend_id", F.explode_outer("paper_ids").alias("record_id"))
    of = refs.join(into.select("record_id", "article_type", "study_key"), "record_id", "left")
    support = of.groupBy("trend_id").agg(
        F.countDistinct(F.when(F.col("article_type") == "primary_research", F.col("study_key"))).alias("studies"), F.count_if(F.col("article_type").isNull()).alias("unknown"),
        F.count("*").alias("refs"), F.countDistinct("record_id").alias("distinct_refs"),
    )
    return union([
        found(papers.join(ids, "record_id", "left_anti"), "record_id", "not_in_corpus"), found(ids.join(papers, "record_id", "left_anti"), "record_id", "not_screened"), repeated(papers, "record_id", "screened_twice"),
        found(papers.filter(F.col("include").isNull() | blank("reason")), "record_id", "no_decision"), found(into.filter(no("life_sciences") | no("month_verified")), "record_id", "unverified"),
        found(into.filter(~F.coalesce(F.col("article_type").isin("primary_research", "review"), F.lit(False))), "record_id", "wrong_type"), found(into.filter(~F.coalesce(F.col("reading_level").isin("abstract", "fulltext"), F.lit(False))), "record_id", "not_read"),
        found(into.filter((F.col("reading_level") == "abstract") & blank("abstract")), "record_id", "no_abstract"), found(into.filter(F.coalesce(F.col("retraction_notice_flag"), F.lit(False))), "record_id", "retracted"), missing_fields(into, "record_id", PAPER),
        found(support.filter("studies < 2"), "trend_id", "needs_two_studies"), found(support.filter("unknown > 0 or refs <> distinct_refs"), "trend_id", "bad_references"),
        found(trends.filter(~F.coalesce(F.col("kind").isin("monthly_signal", "change_over_baseline"), F.lit(False))), "trend_id", "no_kind"), missing_fields(trends, "trend_id", ("title", "finding", "limitations", "next_experiment")),
    ])


def plan_issues(plans: DataFrame, key: str = "plan_id") -> DataFrame:
    """``item, issue`` for study plans: every decision is stated, n is at least 2 and its reasons are given, a review is recorded."""
    stand_in = lambda f: F.lower(F.trim(F.col(f))).isin("todo", "tbd")
    open_ = F.array_compact(F.array(*[F.when(blank(f) | F.coalesce(stand_in(f), F.lit(False)), F.lit(f"missing_{f}")) for f in PLAN]))
    lists = [found(plans.filter(F.coalesce(F.size(f), F.lit(0)) <= 0), key, f"missing_{f}") for f in ("comparators", "alternative_explanations")]
    n = found(plans.filter(~F.coalesce(F.col("n_per_group") >= 2, F.lit(False)) | blank("sample_rationale")), key, "sample_size")
    review = found(plans.filter(~F.coalesce(F.col("review_status") == "reviewed", F.lit(False)) | blank("assessor")), key, "not_reviewed")
    return union([plans.select(F.col(key).cast("string").alias("item"), F.explode(open_).alias("issue")), *lists, n, review])


def unused_claims(sections: DataFrame, claims: DataFrame) -> DataFrame:
    """``item, issue``: claims named by no section, and sections naming unknown claims or none."""
    refs = sections.select("section", F.explode_outer("claim_ids").alias("claim_id"))
    return union([
        found(claims.join(refs, "claim_id", "left_anti"), "claim_id", "unused_claim"), found(refs.filter("claim_id is not null").join(claims, "claim_id", "left_anti"), "claim_id", "unknown_claim"),
        found(refs.filter("claim_id is null"), "section", "section_without_claims"),
    ])
