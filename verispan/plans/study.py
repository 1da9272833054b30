"""A whole study from one configuration: mapping, gates, units, contrasts, correlations, trends, signals.

The configuration is a dictionary with the sections ``study``, ``columns``, ``comparisons``,
``analysis`` and, as needed, ``qpcr``, ``normalization``, ``correlations``, ``reversal``. Blocking
issues never stop the description; they only turn every test into ``qc_blocked``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.operators import contrasts as C
from verispan.operators import kernels as K
from verispan.operators import qc
from verispan.operators import units as U

FIELDS = ("feature", "sample", "group", "unit", "value")
OPTIONAL = ("technical", "pair", "batch", "time")
DESIGNS = ("independent", "paired", "longitudinal")
NORMAL_95 = 1.959963984540054
SCALES = ("log2", "linear", "ct", "raw_counts")


@dataclass
class Study:
    """The results of a study: small tables of issues and rows, and the units they stand on."""

    scale: str
    blocked: bool
    issues: DataFrame
    units: DataFrame
    detection: DataFrame
    contrasts: DataFrame
    correlations: DataFrame | None = None
    trends: DataFrame | None = None
    reversal: DataFrame | None = None
    warnings: int = 0
    options: dict = field(default_factory=dict)


def check_config(config: Mapping) -> dict:
    """The analysis options with their defaults; refuses what no analysis can be made of."""
    study, analysis = config.get("study", {}), dict(config.get("analysis", {}))
    if study.get("design", "independent") not in DESIGNS or study.get("data_scale") not in SCALES:
        raise ValueError("design or data scale is not known")
    pairs = [(c.get("test"), c.get("reference")) for c in config.get("comparisons", [])]
    if not pairs or len(set(pairs)) < len(pairs) or any(not t or not r or t == r for t, r in pairs):
        raise ValueError("comparisons must be given, distinct and between two groups")
    how = analysis.get("technical_aggregation")
    if how not in (None, "mean", "median", "sum") or (how == "sum" and study["data_scale"] != "raw_counts"):
        raise ValueError("technical aggregation must be mean or median, or sum for counts")
    if study["data_scale"] == "ct" and not (config.get("qpcr", {}).get("reference_features") and config["qpcr"].get("equal_efficiency_confirmed")):
        raise ValueError("cycle values need reference features and confirmed equal efficiency")
    if config.get("normalization") and study["data_scale"] != "linear":
        raise ValueError("ratios need the linear scale")
    allowed = ("paired_t", "wilcoxon") if study.get("design") == "paired" else ("welch", "mannwhitney", "ols")
    if analysis.get("test", allowed[0]) not in allowed:
        raise ValueError(f"this design is tested by {' or '.join(allowed)}")
    if analysis.get("transform") == "log2" and study["data_scale"] != "linear":
        raise ValueError("log2 needs the linear scale")
    return {"alpha": 0.05, "min_n": 3, "minimum_effect": 0.0, "min_detection": 0.7, "fdr_family": "all", "adjust_batch": False, "missing_values": [], "transform": None, "test": allowed[0], **analysis, "pairs": pairs, "aggregation": how}


def tidy(observations: DataFrame, config: Mapping, missing: list) -> DataFrame:
    """Canonical columns of the observations: names mapped, ids trimmed, sentinels null, values numeric.

    Refuses missing columns, blank ids, values that are no finite numbers and repeated measurements.
    """
    names = {c: config.get("columns", {}).get(c, c) for c in (*FIELDS, *OPTIONAL)}
    gone = [c for c in FIELDS if names[c] not in observations.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    text = lambda c: F.trim(F.col(names[c]).cast("string"))
    raw = F.trim(F.col(names["value"]).cast("string"))
    raw = F.when(~raw.isin("", "NaN", *[str(m) for m in missing]), raw)
    have = [c for c in OPTIONAL if names[c] in observations.columns]
    rows = observations.select(*[text(c).alias(c) for c in ("feature", "sample", "group", "unit")], raw.alias("__raw"), *[text(c).alias(c) for c in have])
    rows = rows.withColumn("value", F.expr("try_cast(__raw as double)"))
    ids = F.lit(False)
    for c in ("feature", "sample", "group", "unit"):
        ids = ids | (F.coalesce(c, F.lit("")) == "")
    bad = F.col("__raw").isNotNull() & (F.col("value").isNull() | (F.abs("value") == float("inf")))
    key = ["sample", "feature", *[c for c in ("technical", "time") if c in have]]
    twice = rows.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("n"))
    n = rows.agg(F.count("*").alias("rows"), F.count_if(ids).alias("ids"), F.count_if(bad).alias("bad")).first()
    if not n["rows"]:
        raise ValueError("no measurements")
    if n["ids"] or n["bad"] or twice.first()["n"]:
        raise ValueError("blank ids, values that are no finite numbers, or repeated measurements")
    if "time" in have:
        rows = rows.withColumn("time", F.col("time").cast("double"))
    return rows.drop("__raw")


def stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def each_contrast(pairs: list[tuple[str, str]], make) -> DataFrame:
    """The rows of ``make(test, reference)`` of every contrast with its name."""
    return stacked([make(t, r).withColumn("contrast", F.lit(f"{t}_vs_{r}")) for t, r in pairs])


def replaced(tests: DataFrame, other: DataFrame, strata: list[str], columns: list[str]) -> DataFrame:
    """``tests`` with a p-value (and further columns) of another test where its status allows one; without a p it is not estimable."""
    names = [c for c in ("p_value", *columns) if c in other.columns]
    right = other.select(*strata, "contrast", *[F.col(c).alias(f"__{c}") for c in names])
    out = tests.drop("p_value", "statistic", "df").join(right, [*strata, "contrast"], "left")
    open_ = F.col("status").isin("tested", "not_estimable")
    out = out.withColumns({c: F.coalesce(F.when(open_, F.col(f"__{c}")), F.col(c)) if c in tests.columns and c != "p_value" else F.when(open_, F.col(f"__{c}")) for c in names})
    return out.withColumn("status", F.when(open_, F.when(F.col("p_value").isNull(), "not_estimable").otherwise("tested")).otherwise(F.col("status"))).drop(*[f"__{c}" for c in names])


def independent_tests(units: DataFrame, strata: list[str], o: dict, method: str, blocked: bool) -> DataFrame:
    """Welch, Mann-Whitney or least squares with HC3 errors, with intervals where the test has one."""
    tests = C.welch(C.two_sided(units, strata, "group", o["pairs"]), o["min_n"], blocked)
    if method == "mannwhitney":
        tests = replaced(tests, each_contrast(o["pairs"], lambda t, r: K.rank_tests(units, strata, "group", t, r)), strata, ["rank_biserial"])
    elif method == "ols":
        batch = "batch" if o["adjust_batch"] else "__none"
        rows = units.withColumn("__none", F.lit(None).cast("string"))
        tests = replaced(tests, each_contrast(o["pairs"], lambda t, r: K.adjusted_contrast(rows, strata, "group", t, r, batch)), strata, ["effect", "standard_error"])
        tests = tests.withColumns({"ci_low": F.col("effect") - NORMAL_95 * F.col("standard_error"), "ci_high": F.col("effect") + NORMAL_95 * F.col("standard_error")})
    else:
        tests = K.with_interval(tests)
    return tests.withColumn("method", F.when(F.col("status") == "tested", method))


def paired_tests(units: DataFrame, strata: list[str], o: dict, method: str, blocked: str | None) -> DataFrame:
    """Paired t with its interval or signed rank over complete pairs."""
    tests = each_contrast(o["pairs"], lambda t, r: C.paired_t(units, strata, "pair", "group", t, r, min_n=o["min_n"], error="__se"))
    if method == "wilcoxon":
        ranks = each_contrast(o["pairs"], lambda t, r: K.signed_rank_tests(C.paired_differences(units, strata, "pair", "group", t, r), strata, "d"))
        tests = replaced(tests, ranks, strata, [])
    else:
        tests = K.with_interval(tests, error=F.col("__se"))
    tests = tests.drop("__se")
    if blocked:
        tests = tests.withColumns({"status": F.lit(blocked), "p_value": F.lit(None).cast("double")})
    return tests.withColumn("method", F.when(F.col("status") == "tested", method))


def count_tests(units: DataFrame, tests: DataFrame, o: dict) -> DataFrame:
    """Negative-binomial tests of raw counts in place of ``tests``; features below the least total keep no test."""
    rows = units.withColumn("sample_key", F.concat_ws("\x1f", "unit", "group"))
    fits = each_contrast(o["pairs"], lambda t, r: K.count_contrasts(rows, "feature", "sample_key", "group", t, r, min_genes=10))
    fits = fits.select(F.col("gene").alias("feature"), "contrast", "p_value", F.col("log2fc").alias("effect"), "standard_error")
    known = fits.select("feature", "contrast", F.lit(True).alias("__fitted"))
    tests = tests.join(known, ["feature", "contrast"], "left").withColumns({"effect": F.lit(None).cast("double"), "status": F.when(F.col("__fitted"), "tested").otherwise("filtered_low_total_count")}).drop("__fitted")
    tests = replaced(tests, fits, ["feature"], ["effect", "standard_error"])
    return tests.withColumns({"ci_low": F.col("effect") - 1.96 * F.col("standard_error"), "ci_high": F.col("effect") + 1.96 * F.col("standard_error"), "method": F.lit("negative binomial")})


def analyse(observations: DataFrame, config: Mapping) -> Study:
    """The study of ``observations`` as the configuration prescribes it."""
    o = check_config(config)
    study = config["study"]
    rows = tidy(observations, config, o["missing_values"]).withColumn("run", F.lit("study"))
    for c in ("technical", "batch"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    scale = study["data_scale"]
    issues = qc.issues(rows, "run", "feature", "group", "unit", "technical", "batch", "value", o["aggregation"], o["adjust_batch"], scale == "raw_counts")
    confirmed = rows.limit(1).filter(F.lit(not study.get("independent_units_confirmed", False))).select(F.lit("blocking").alias("severity"), F.lit("unit_definition").alias("code"), F.lit(1).cast("long").alias("cases"))
    issues = issues.unionByName(confirmed)
    found = issues.collect()
    blocked, warnings = any(r.severity == "blocking" for r in found), sum(r.severity == "warning" for r in found)
    keys = ["feature", "group", "unit", *(["time"] if "time" in rows.columns else [])]
    extra = [c for c in ("pair", "batch") if c in rows.columns]
    units = U.technical_aggregate(rows, keys, how=o["aggregation"] or "mean", annotations=extra, order="sample")
    by = [k for k in keys if k != "feature"]
    if scale == "ct":
        units, scale = U.reference_normalise(units, by, "feature", config["qpcr"]["reference_features"], "delta_ct"), "log2"
    elif config.get("normalization"):
        units = U.reference_normalise(units, by, "feature", config["normalization"]["reference_features"], "ratio")
    if "complete" in units.columns and units.filter(~F.col("complete")).limit(1).count():
        raise ValueError("a unit lacks a reference feature")
    if o["transform"] == "log2":
        units, scale = U.log2_values(units), "log2"
    strata = ["feature", *(["time"] if "time" in keys else [])]
    seen = U.detection(units, [s for s in strata if s == "time"], "group", "unit", "feature")
    family = ["contrast"] if o["fdr_family"] == "contrast" else []
    batches = o["adjust_batch"] and units.select("batch").filter("batch is not null").distinct().limit(2).count() > 1
    paired = study.get("design") == "paired"
    if paired and scale != "raw_counts":
        if "pair" not in units.columns:
            units = units.withColumn("pair", F.col("unit"))
        tests = paired_tests(units, strata, o, o["test"], "qc_blocked" if blocked else "requires_custom_paired_batch_model" if batches else None)
    else:
        tests = independent_tests(units, strata, o, "ols" if batches else o["test"] if not paired else "welch", blocked or scale == "raw_counts")
    if scale == "raw_counts" and not blocked:
        try:
            if "time" in keys or paired or batches:
                raise ValueError("counts with times, pairs or batches need a model of their own")
            tests = count_tests(units, tests, o)
        except ValueError as e:
            issues = issues.unionByName(qc.count_model_issue(issues.sparkSession, str(e)).drop("detail"))
            blocked = True
    tests = C.bh_adjust(tests, family)
    if "low_test" in tests.columns and scale != "raw_counts":
        tests = C.classify(tests, o["alpha"], o["minimum_effect"], o["min_detection"])
    else:
        hit = (F.col("status") == "tested") & (F.col("q_value") <= o["alpha"]) & (F.abs("effect") >= o["minimum_effect"])
        tests = tests.withColumn("signal_class", F.when(hit, "statistical_signal").otherwise("descriptive_or_uncertain"))
    if "mean_test" in tests.columns and scale != "raw_counts":
        ratio = F.when((F.col("mean_test") > 0) & (F.col("mean_reference") > 0), F.log2(F.col("mean_test") / F.col("mean_reference")))
        tests = tests.withColumn("log2fc", F.col("effect") if scale == "log2" else ratio)
    out = Study(scale, blocked, issues, units, seen, tests, warnings=warnings, options=o)
    if config.get("correlations", {}).get("features") and not blocked and scale != "raw_counts":
        out.correlations = C.bh_adjust(C.spearman(units, ["group", *[s for s in strata if s == "time"]], "unit", "feature", config["correlations"]["features"], min_n=o["min_n"]), [])
    if "time" in keys and not blocked and scale != "raw_counts":
        trends = K.mixed_trend(units, ["feature", "group"], "unit", "time", "batch" if "batch" in units.columns else None)
        out.trends = C.bh_adjust(trends, [])
    if config.get("reversal"):
        r = config["reversal"]
        out.reversal = C.reversal(tests, strata, r["model"], r["treatment"], r["residual"])
    return out


def analysis_identity(config: Mapping, sources: DataFrame, version: str) -> str:
    """A digest of the configuration, the digests of the source files (``path, sha256``) and the version of the code."""
    files = sorted((r.path.rsplit("/", 1)[-1], r.sha256) for r in sources.collect())
    return hashlib.sha256(json.dumps([config, files, version], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def integrity_issues(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """``path, issue`` of files that are ``missing``, ``changed`` or ``unexpected`` against the recorded manifest (path, sha256)."""
    now = present.select("path", F.col("sha256").alias("__now"))
    both = recorded.select("path", "sha256").join(now, "path", "full_outer")
    issue = F.when(F.col("__now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("sha256") != F.col("__now"), "changed")
    return both.select("path", issue.alias("issue")).filter("issue is not null")


def write_study(study: Study, folder: str) -> list[str]:
    """The tables of a study as CSV folders, lists as JSON texts; the names of what was written."""
    done = []
    for name in ("issues", "units", "detection", "contrasts", "correlations", "trends", "reversal"):
        df = getattr(study, name)
        if df is None:
            continue
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        done.append(name)
    return done
