"""Prespecified group contrasts: moments, Welch and paired t, rank tests, FDR, stability, classification.

Everything a test needs is a bounded set of moments per stratum and group, so one partial aggregate
over the units feeds all contrasts; no group of values is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verispan.functions.stats import normal_pvalue, t_pvalue
from verispan.scale import attach, written

FAMILY_BUCKETS = 1024


def bh_adjust(df: DataFrame, family: Sequence[str], p: str = "p_value", q: str = "q_value", tests: str = "tests_in_family") -> DataFrame:
    """``df`` with Benjamini-Hochberg ``q`` and the number of ``tests`` of its family; null p gives null q.

    A family may be all rows, so ranks are not taken in one window: p falls into buckets that keep
    its order, counts and minima of the buckets are chained over at most ``FAMILY_BUCKETS`` rows, and
    windows only run inside a bucket.
    """
    fam = list(family)
    df = written(df, "fdr-family")  # read twice below; the tests themselves run once
    live = df.filter(F.col(p).isNotNull())
    # rank tests give many equal p; from here on a p is one row with its count
    levels = live.groupBy(*fam, p).agg(F.count("*").alias("__n"))
    levels = levels.withColumn("__b", F.least(F.floor(F.pow(F.greatest(F.col(p), F.lit(0.0)), F.lit(0.25)) * FAMILY_BUCKETS), F.lit(FAMILY_BUCKETS - 1)).cast("int"))
    counts = levels.groupBy(*fam, "__b").agg(F.sum("__n").alias("__rows"))
    up = W.partitionBy(*fam).orderBy("__b")
    counts = counts.withColumns({"__before": F.sum("__rows").over(up) - F.col("__rows"), "__m": F.sum("__rows").over(W.partitionBy(*fam))})
    key = [*fam, "__b"]

    def same(a: DataFrame, b: DataFrame) -> Column:
        cond = F.lit(True)
        for k in key:
            cond = cond & a[k].eqNullSafe(b[f"__k_{k}"])
        return cond

    def keyed(x: DataFrame, *cols: str) -> DataFrame:
        return x.select(*[F.col(k).alias(f"__k_{k}") for k in key], *cols)

    c = keyed(counts, "__before", "__m")
    levels = levels.join(c, same(levels, c)).drop(*[f"__k_{k}" for k in key])
    inside = W.partitionBy(*key).orderBy(p)
    levels = levels.withColumn("__raw", F.col(p) * F.col("__m") / (F.col("__before") + F.sum("__n").over(inside)))
    lows = levels.groupBy(*key).agg(F.min("__raw").alias("__low"))
    down = W.partitionBy(*fam).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    lows = keyed(lows.withColumn("__later", F.min("__low").over(down)), "__later")
    levels = levels.join(lows, same(levels, lows)).drop(*[f"__k_{k}" for k in key])
    back = W.partitionBy(*key).orderBy(F.desc(p))
    levels = levels.select(*fam, p, "__n", F.least(F.lit(1.0), F.min("__raw").over(back), F.col("__later")).alias(q), F.col("__m").alias(tests))
    out = [*df.columns, q, tests]
    rest = df.filter(F.col(p).isNull()).withColumns({q: F.lit(None).cast("double"), tests: F.lit(None).cast("long")})
    return attach(live, levels, [*fam, p], "inner", weight="__n").select(*out).unionByName(rest.select(*out))


def moments(units: DataFrame, strata: Sequence[str], group: str, value: str = "value") -> DataFrame:
    """n, mean, variance, least and greatest value per stratum and group; nulls are skipped."""
    return units.groupBy(*strata, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def two_sided(units: DataFrame, strata: Sequence[str], group: str, contrasts: Sequence[tuple[str, str]], value: str = "value") -> DataFrame:
    """Every contrast (test, reference) in every stratum, also where a group is absent, with both sides' moments."""
    m = moments(units, strata, group, value)
    names = F.array(*[F.struct(F.lit(f"{t}_vs_{r}").alias("contrast"), F.lit(t).alias("test"), F.lit(r).alias("reference")) for t, r in contrasts])
    # a contrast is a pair of conditional aggregates over the few group rows of the stratum
    each = m.withColumn("c", F.explode(names))
    side = lambda which, col: F.max(F.when(F.col(group) == F.col(f"c.{which}"), F.col(col))).alias(f"{col}_{which}")
    out = each.groupBy(*strata, F.col("c.contrast").alias("contrast")).agg(*[side(w, c) for w in ("test", "reference") for c in ("n", "mean", "var", "low", "high")])
    return out.withColumns({f"n_{w}": F.coalesce(f"n_{w}", F.lit(0)) for w in ("test", "reference")})


def welch(pairs: DataFrame, min_n: int = 3, blocked: bool = False) -> DataFrame:
    """Status, effect, statistic, df and p of each contrast row.

    Precedence: blocked, too few units, no variance; a missing p stays null.
    """
    small = F.least("n_test", "n_reference") < max(2, min_n)
    vt, vr = F.col("var_test") / F.col("n_test"), F.col("var_reference") / F.col("n_reference")
    flat = (vt + vr) == 0
    status = F.when(F.lit(blocked), "qc_blocked").when(small, "descriptive_small_n").when(flat, "not_estimable").otherwise("tested")
    df = pairs.withColumns({"effect": F.col("mean_test") - F.col("mean_reference"), "status": status})
    ok = F.col("status") == "tested"
    df = df.withColumns({"statistic": F.when(ok, F.try_divide("effect", F.sqrt(vt + vr))), "df": F.when(ok, F.try_divide((vt + vr) ** 2, F.try_divide(vt**2, F.col("n_test") - 1) + F.try_divide(vr**2, F.col("n_reference") - 1)))})
    return df.withColumn("p_value", t_pvalue("statistic", "df"))


def stable_direction(pairs: DataFrame) -> Column:
    """Whether the sign of the effect survives leaving out any one unit.

    The extreme leave-one-out differences are those without the least or greatest unit of a side.
    """
    loo = lambda w, x: F.try_divide(F.col(f"n_{w}") * F.col(f"mean_{w}") - F.col(x), F.col(f"n_{w}") - 1)
    diffs = [loo("test", f"{x}_test") - F.col("mean_reference") for x in ("low", "high")] + [F.col("mean_test") - loo("reference", f"{x}_reference") for x in ("low", "high")]
    s = F.signum("effect")
    cond = F.lit(True)
    for x in diffs:
        cond = cond & (F.signum(x) == s)
    return cond


def classify(rows: DataFrame, alpha: float = 0.05, minimum_effect: float = 0.0, min_detection: float = 0.7, detection: tuple[str, str] | None = None) -> DataFrame:
    """``flags`` and ``signal_class`` of tested rows."""
    tested = F.col("status") == "tested"
    flags = [F.when(tested & ~stable_direction(rows), F.lit("single_unit_direction_sensitivity"))]
    if detection:
        flags.insert(0, F.when(tested & (F.least(*detection) < min_detection), F.lit("low_detection")))
    rows = rows.withColumn("flags", F.array_compact(F.array(*flags)))
    hit = tested & (F.col("q_value") <= alpha) & (F.abs("effect") >= minimum_effect)
    return rows.withColumn("signal_class", F.when(hit & (F.size("flags") == 0), "statistical_signal").when(hit, "quality_limited_signal").otherwise("descriptive_or_uncertain"))


def paired_t(units: DataFrame, strata: Sequence[str], pair: str, group: str, test: str, reference: str, value: str = "value", min_n: int = 3, error: str | None = None) -> DataFrame:
    """Paired t per stratum over complete pairs; a pair with several units of a group makes the stratum ambiguous.

    ``error`` names a further column that holds the standard error of the effect.
    """
    side = lambda g, a: F.max(F.when(F.col(group) == g, F.col(value))).alias(a)
    n = lambda g, a: F.count_if((F.col(group) == g) & F.col(value).isNotNull()).alias(a)
    both = units.filter(F.col(pair).isNotNull() & F.col(group).isin(test, reference)).groupBy(*strata, pair).agg(side(test, "t"), side(reference, "r"), n(test, "nt"), n(reference, "nr"))
    d = F.when((F.col("nt") == 1) & (F.col("nr") == 1), F.col("t") - F.col("r"))
    out = both.groupBy(*strata).agg(
        F.count(d).alias("n_matched_pairs"), F.count_if((F.col("nt") == 0) | (F.col("nr") == 0)).alias("unmatched_units"), F.count_if((F.col("nt") > 1) | (F.col("nr") > 1)).alias("ambiguous"), F.avg(d).alias("effect"), F.var_samp(d).alias("var")
    )
    status = F.when(F.col("ambiguous") > 0, "ambiguous_pairing").when(F.col("n_matched_pairs") < max(2, min_n), "descriptive_small_n").when(F.col("var") == 0, "not_estimable").otherwise("tested")
    out = out.withColumn("status", status)
    ok = F.col("status") == "tested"
    if error:
        out = out.withColumn(error, F.sqrt(F.try_divide("var", "n_matched_pairs")))
    out = out.withColumns({"statistic": F.when(ok, F.try_divide("effect", F.sqrt(F.try_divide("var", "n_matched_pairs")))), "df": F.when(ok, (F.col("n_matched_pairs") - 1).cast("double"))})
    return out.withColumn("p_value", t_pvalue("statistic", "df")).drop("var", "ambiguous")


def paired_differences(units: DataFrame, strata: Sequence[str], pair: str, group: str, test: str, reference: str, value: str = "value") -> DataFrame:
    """``strata, pair, d``: test minus reference of each pair that has exactly one unit of either."""
    side = lambda g, a: F.max(F.when(F.col(group) == g, F.col(value))).alias(a)
    n = lambda g: F.count_if((F.col(group) == g) & F.col(value).isNotNull())
    both = units.filter(F.col(pair).isNotNull() & F.col(group).isin(test, reference)).groupBy(*strata, pair).agg(side(test, "t"), side(reference, "r"), n(test).alias("nt"), n(reference).alias("nr"))
    return both.filter("nt = 1 and nr = 1").select(*strata, pair, (F.col("t") - F.col("r")).alias("d"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with average ranks (ties share their mean rank) of ``value`` within ``by``, a bounded stratum."""
    w = W.partitionBy(*by).orderBy(value)
    ties = W.partitionBy(*by, value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def mann_whitney(units: DataFrame, strata: Sequence[str], group: str, test: str, reference: str, value: str = "value") -> DataFrame:
    """U of ``test`` with the tie-corrected normal p (continuity 0.5) and the rank-biserial effect."""
    live = units.filter(F.col(value).isNotNull() & F.col(group).isin(test, reference))
    r = average_ranks(live, strata, value, "__r")
    ties = r.groupBy(*strata, value).agg(F.count("*").alias("t"), F.count_if(F.col(group) == test).alias("a"), F.count_if(F.col(group) == reference).alias("b"), F.sum(F.when(F.col(group) == test, F.col("__r"))).alias("rs"))
    out = ties.groupBy(*strata).agg(F.sum("a").alias("n_test"), F.sum("b").alias("n_reference"), F.sum("rs").alias("rs"), F.sum(F.col("t") ** 3 - F.col("t")).alias("tie"))
    n1, n2 = F.col("n_test"), F.col("n_reference")
    n = n1 + n2
    out = out.filter((n1 > 0) & (n2 > 0)).withColumn("u", F.col("rs") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1))))
    z = F.when(sd > 0, (F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0))) / sd)
    out = out.withColumn("z", z).withColumn("rank_biserial", F.try_divide(2 * F.col("u"), n1 * n2) - 1)
    return out.withColumn("p_value", normal_pvalue("z")).drop("rs", "tie")


def reversal(contrasts: DataFrame, strata: Sequence[str], model: str, treatment: str, residual: str) -> DataFrame:
    """Strata whose treatment effect points against the model effect, and whether the residual is smaller."""
    eff = lambda c, a: F.max(F.when(F.col("contrast") == c, F.col("effect"))).alias(a)
    out = contrasts.groupBy(*strata).agg(eff(model, "model_effect"), eff(treatment, "treatment_effect"), eff(residual, "residual_effect")).dropna()
    opposite = F.signum("model_effect") * F.signum("treatment_effect") < 0
    closer = F.abs("residual_effect") < F.abs("model_effect")
    return out.withColumn("pattern", F.when(opposite & closer, "opposite_and_closer").when(opposite, "opposite").otherwise("not_opposite"))


def spearman(units: DataFrame, strata: Sequence[str], unit: str, feature: str, features: Sequence[str], value: str = "value", min_n: int = 4) -> DataFrame:
    """Spearman correlation of each pair of the given features (at most 50) within each stratum, over complete units."""
    names = sorted(set(features))
    if len(names) > 50:
        raise ValueError("at most 50 features")
    wide = units.filter(F.col(feature).isin(names) & F.col(value).isNotNull())
    a = wide.select(*strata, unit, F.col(feature).alias("feature_a"), F.col(value).alias("a"))
    b = wide.select(*strata, unit, F.col(feature).alias("feature_b"), F.col(value).alias("b"))
    pairs = a.join(b, [*strata, unit]).filter("feature_a < feature_b")
    by = [*strata, "feature_a", "feature_b"]
    ranked = average_ranks(average_ranks(pairs, by, "a", "ra"), by, "b", "rb")
    # moments instead of corr(), which divides by zero on constant ranks
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("ra", "rb").alias("cov"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    out = out.withColumn("rho", F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb")))).drop("cov", "va", "vb")
    flat = (F.col("a0") == F.col("a1")) | (F.col("b0") == F.col("b1"))
    out = out.withColumn("status", F.when((F.col("n") < max(4, min_n)) | flat, "descriptive_small_n").otherwise("tested"))
    ok = F.col("status") == "tested"
    rho = F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rho"))))
    out = out.withColumn("rho", rho).withColumns({"df": F.when(ok, (F.col("n") - 2).cast("double")), "t": F.when(ok, F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") ** 2, F.lit(1e-300))))})
    return out.withColumn("p_value", t_pvalue("t", "df")).drop("a0", "a1", "b0", "b1", "t", "df")


def time_trend(units: DataFrame, strata: Sequence[str], unit: str, time: str, value: str = "value") -> DataFrame:
    """Least-squares slope over time per stratum with at least 4 units and 3 times; null keys are left out."""
    live = units.dropna(subset=[*strata, unit, time, value])
    out = live.groupBy(*strata).agg(F.countDistinct(unit).alias("units"), F.countDistinct(time).alias("times"), F.count("*").alias("n"), F.regr_slope(value, time).alias("slope"))
    return out.withColumn("status", F.when((F.col("units") >= 4) & (F.col("times") >= 3), "estimated").otherwise("descriptive_small_n")).withColumn("slope", F.when(F.col("status") == "estimated", F.col("slope")))
