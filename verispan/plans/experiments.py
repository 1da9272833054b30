"""Queries over measurements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.stats import normal_pvalue_sql, rounded, rounded_sql, t_pvalue_sql
from verispan.operators import contrasts as C
from verispan.operators import enrichment, followup, kernels, qc
from verispan.operators import units as U
from verispan.scale import new_path
from verispan.session import table
from verispan.streaming.technical import stream_units

CONTRASTS = (("treated", "control"), ("rescue", "control"), ("rescue", "treated"))
KEYS = ["run_id", "feature", "group_name", "unit"]


def _units(spark: SparkSession, d: str) -> DataFrame:
    return U.technical_aggregate(table(spark, d, "observations"), KEYS)


UNITS = "units as (select run_id, feature, group_name, unit, avg(value) as value, count(value) as observed_technical_n, count(*) as technical_rows from observations group by all)"


def technical_aggregation(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median of technical replicates per unit."""
    obs = table(spark, d, "observations")
    mean = U.technical_aggregate(obs, KEYS, lists=["sample"])
    median = U.technical_aggregate(obs, KEYS, how="median").select(*KEYS, F.col("value").alias("median_value"))
    out = mean.join(median, KEYS).withColumnRenamed("value", "mean_value").withColumn("samples", F.array_join("sample_list", ";")).drop("sample_list")
    return rounded(out, "mean_value", "median_value")


def detection_table(spark: SparkSession, d: str) -> DataFrame:
    """Observed against expected units per feature and group of a run."""
    return rounded(U.detection(_units(spark, d), ["run_id"], "group_name", "unit", "feature"), "detection")


def _contrast_rows(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    rows = C.welch(C.two_sided(units, ["run_id", "feature"], "group_name", CONTRASTS))
    seen = U.detection(units, ["run_id"], "group_name", "unit", "feature")
    side = lambda w: seen.select("run_id", "feature", F.col("group_name").alias(f"__{w}"), F.col("detection").alias(f"detection_{w}"))
    rows = rows.withColumns({"__test": F.split("contrast", "_vs_")[0], "__reference": F.split("contrast", "_vs_")[1]})
    for w in ("test", "reference"):
        rows = rows.join(side(w), ["run_id", "feature", f"__{w}"], "left").withColumn(f"detection_{w}", F.coalesce(f"detection_{w}", F.lit(0.0)))
    return rows


def contrast_welch_bh(spark: SparkSession, d: str) -> DataFrame:
    """Prespecified Welch contrasts with one FDR family per contrast, quality flags and signal classes."""
    rows = C.bh_adjust(_contrast_rows(spark, d), ["contrast"])
    rows = C.classify(rows, detection=("detection_test", "detection_reference"))
    out = rows.select(
        "run_id", "feature", "contrast", "n_test", "n_reference", "detection_test", "detection_reference", "effect", "statistic", "df", "p_value", "q_value",
        "tests_in_family", "status", F.array_join("flags", ";").alias("flags"), "signal_class",
    )
    return rounded(out, "detection_test", "detection_reference", "effect", "statistic", "df", "p_value", "q_value")


_MOMENTS = f"""{UNITS},
m as (select run_id, feature, group_name as g, count(value) as n, avg(value) as mean, var_samp(value) as var, min(value) as low, max(value) as high from units group by all),
c as (select * from (values ('treated', 'control'), ('rescue', 'control'), ('rescue', 'treated')) v(t, r)),
s as (select distinct run_id, feature from units),
rows0 as (select s.run_id, s.feature, t || '_vs_' || r as contrast, t, r, coalesce(a.n, 0) as n_test, coalesce(b.n, 0) as n_reference, a.mean as m1, b.mean as m2, a.var / a.n as v1, b.var / b.n as v2, a.low as l1, a.high as h1, b.low as l2, b.high as h2
  from s cross join c left join m a on a.run_id = s.run_id and a.feature = s.feature and a.g = t left join m b on b.run_id = s.run_id and b.feature = s.feature and b.g = r),
rows1 as (select *, m1 - m2 as effect, case when least(n_test, n_reference) < 3 then 'descriptive_small_n' when v1 + v2 = 0 then 'not_estimable' else 'tested' end as status from rows0),
rows2 as (select *, case when status = 'tested' then effect / sqrt(v1 + v2) end as statistic, case when status = 'tested' then (v1 + v2) ** 2 / (v1 ** 2 / (n_test - 1) + v2 ** 2 / (n_reference - 1)) end as df from rows1),
rows3 as (select *, {t_pvalue_sql('statistic', 'df')} as p_value from rows2)"""


def _bh(source: str, family: str, p: str = "p_value") -> str:
    """CTEs that add q_value and tests_in_family to a relation."""
    fam = f"partition by {family} " if family else ""
    return f"""ranked as (select *, case when {p} is not null then {p} * (count({p}) over ({fam})) / rank_hi end as raw_q, case when {p} is not null then count({p}) over ({fam}) end as tests_in_family
  from (select *, count({p}) over ({fam}order by {p} nulls last range between unbounded preceding and current row) as rank_hi from {source})),
adjusted as (select *, case when {p} is not null then least(1.0, min(raw_q) over ({fam}order by {p} desc nulls last range between unbounded preceding and current row)) end as q_value from ranked)"""


_LOO = " and ".join(
    f"sign({x}) = sign(effect)"
    for x in (
        "(n_test * m1 - l1) / (n_test - 1) - m2", "(n_test * m1 - h1) / (n_test - 1) - m2",
        "m1 - (n_reference * m2 - l2) / (n_reference - 1)", "m1 - (n_reference * m2 - h2) / (n_reference - 1)",
    )
)
_DET = """e as (select run_id, group_name, count(distinct unit) as x from units group by all),
o as (select run_id, feature, group_name, count(distinct case when value is not null then unit end) as n from units group by all),
det as (select o.run_id, feature, o.group_name, n / x as detection from o join e on o.run_id = e.run_id and o.group_name = e.group_name)"""
CONTRAST_SQL = f"""with {_MOMENTS}, {_bh('rows3', 'contrast')}, {_DET},
f as (select a.*, coalesce(x.detection, 0) as dt, coalesce(y.detection, 0) as dr from adjusted a left join det x on x.run_id = a.run_id and x.feature = a.feature and x.group_name = t left join det y on y.run_id = a.run_id and y.feature = a.feature and y.group_name = r),
g as (select *, case when status = 'tested' then concat_ws(';', case when least(dt, dr) < 0.7 then 'low_detection' end, case when not ({_LOO}) then 'single_unit_direction_sensitivity' end) else '' end as flags from f)
select run_id, feature, contrast, n_test, n_reference, round(dt, 6) as detection_test, round(dr, 6) as detection_reference, round(effect, 6) as effect, round(statistic, 6) as statistic, round(df, 6) as df,
  round(p_value, 6) as p_value, round(q_value, 6) as q_value, tests_in_family, status, flags,
  case when status = 'tested' and q_value <= 0.05 and flags = '' then 'statistical_signal' when status = 'tested' and q_value <= 0.05 then 'quality_limited_signal' else 'descriptive_or_uncertain' end as signal_class from g"""


def bh_all(spark: SparkSession, d: str) -> DataFrame:
    """One FDR family over all contrasts."""
    out = C.bh_adjust(_contrast_rows(spark, d), []).select("run_id", "feature", "contrast", "p_value", "q_value", "tests_in_family")
    return rounded(out, "p_value", "q_value")


def leave_one_out_stability(spark: SparkSession, d: str) -> DataFrame:
    """Whether each tested effect keeps its sign without any one unit."""
    rows = _contrast_rows(spark, d).filter("status = 'tested'")
    return rounded(rows.select("run_id", "feature", "contrast", "effect", C.stable_direction(rows).alias("stable")), "effect")


def qc_issues(spark: SparkSession, d: str) -> DataFrame:
    """All quality gates over the observations."""
    return qc.issues(table(spark, d, "observations"), "run_id", "feature", "group_name", "unit", "technical", "batch", "value", None)


def qc_raw_counts(spark: SparkSession, d: str) -> DataFrame:
    """The gates as they stand for raw counts, with an aggregation declared."""
    return qc.issues(table(spark, d, "observations"), "run_id", "feature", "group_name", "unit", "technical", "batch", "value", "sum", adjust_batch=True, counts=True)


_FLOOR = "fl as (select run_id, count(value) as n, min(value) as floor, count(*) filter (where value = m) as at_floor from (select run_id, value, min(value) over (partition by run_id) as m from observations where value is not null) group by run_id)"
_QC = f"""select 'blocking' as severity, 'unit_cross_group' as code, count(*) as cases from (select 1 from observations group by run_id, unit having count(distinct group_name) > 1)
union all select 'blocking', 'conflicting_batch', count(*) from (select 1 from observations group by run_id, feature, group_name, unit having count(distinct batch) > 1)
union all select 'warning', 'repeated_floor', count(*) from fl where n >= 20 and at_floor >= greatest(4, 0.15 * n)
union all select 'blocking', 'batch_group_confounding', count(*) from (select run_id from (select run_id, batch, count(distinct group_name) as g from observations where batch is not null group by all) group by run_id having count(*) > 1 and max(g) = 1)"""


def repeated_floor(spark: SparkSession, d: str) -> DataFrame:
    """Whether the minimum of a run looks like a detection floor."""
    return qc.repeated_floor(table(spark, d, "observations"), ["run_id"])


def batch_confounding(spark: SparkSession, d: str) -> DataFrame:
    """Whether order status and priority, as group and batch, can be told apart per clerk year."""
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return qc.batch_confounding(orders, ["year"], "o_orderpriority", "o_orderstatus")


def ratio_normalization(spark: SparkSession, d: str) -> DataFrame:
    """Values relative to the housekeeping feature of the same unit."""
    out = U.reference_normalise(_units(spark, d), ["run_id", "group_name", "unit"], "feature", ["HKG1"], "ratio")
    return rounded(out.select("run_id", "feature", "group_name", "unit", "value", "reference_mean", "complete"), "value", "reference_mean")


def delta_ct(spark: SparkSession, d: str) -> DataFrame:
    """Negative delta Ct against the housekeeping feature."""
    out = U.reference_normalise(_units(spark, d), ["run_id", "group_name", "unit"], "feature", ["HKG1"], "delta_ct")
    return rounded(out.select("run_id", "feature", "group_name", "unit", "value", "delta_ct", "complete"), "value", "delta_ct")


_REF = f"""with {UNITS}, ref as (select run_id, group_name, unit, avg(value) as reference_mean, count(distinct case when value is not null then feature end) as reference_n from units where feature = 'HKG1' group by all),
j as (select u.*, reference_mean, coalesce(reference_n = 1, false) as complete from units u left join ref using (run_id, group_name, unit) where feature <> 'HKG1')"""


def paired_t(spark: SparkSession, d: str) -> DataFrame:
    """Mean order value of finished against open orders, paired by customer, per nation."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    units = U.technical_aggregate(orders, ["c_nationkey", "o_custkey", "o_orderstatus"], "o_totalprice")
    out = C.paired_t(units, ["c_nationkey"], "o_custkey", "o_orderstatus", "F", "O", "o_totalprice")
    return rounded(out, "effect", "statistic", "df", "p_value")


def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    """Rank test of treated against control units per run and feature."""
    out = C.mann_whitney(_units(spark, d), ["run_id", "feature"], "group_name", "treated", "control")
    return rounded(out, "u", "z", "rank_biserial", "p_value")


_MW = f"""with {UNITS}, l as (select * from units where value is not null and group_name in ('treated', 'control')),
r as (select *, rank() over (partition by run_id, feature order by value) + (count(*) over (partition by run_id, feature, value) - 1) / 2 as rk, count(*) over (partition by run_id, feature, value) as t from l),
a as (select run_id, feature, count(*) filter (where group_name = 'treated') as n_test, count(*) filter (where group_name = 'control') as n_reference, sum(rk) filter (where group_name = 'treated') as rs, sum(t * t - 1) as tie from r group by all),
b as (select *, rs - n_test * (n_test + 1) / 2 as u, n_test + n_reference as n from a where n_test > 0 and n_reference > 0),
c as (select *, sqrt(n_test * n_reference / 12 * ((n + 1) - tie / (n * (n - 1)))) as sd from b),
d as (select *, case when sd > 0 then greatest(abs(u - n_test * n_reference / 2) - 0.5, 0) / sd end as z from c)
select run_id, feature, n_test, n_reference, round(u, 6) as u, round(z, 6) as z, round(2 * u / (n_test * n_reference) - 1, 6) as rank_biserial, round({normal_pvalue_sql('z')}, 6) as p_value from d"""


def spearman_within_group(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of the named features over units, within run and group, with one FDR family."""
    names = ["HKG1", "RZMQ17", "NBTAQ12", "MNEPQ8", "KHZQ23"]
    out = C.bh_adjust(C.spearman(_units(spark, d), ["run_id", "group_name"], "unit", "feature", names), [])
    return rounded(out, "rho", "p_value", "q_value")


_SP = f"""with {UNITS}, w as (select * from units where feature in ('HKG1', 'RZMQ17', 'NBTAQ12', 'MNEPQ8', 'KHZQ23') and value is not null),
p as (select a.run_id, a.group_name, a.feature as feature_a, b.feature as feature_b, a.value as a, b.value as b from w a join w b on a.run_id = b.run_id and a.group_name = b.group_name and a.unit = b.unit and a.feature < b.feature),
k as (select *, rank() over (partition by run_id, group_name, feature_a, feature_b order by a) + (count(*) over (partition by run_id, group_name, feature_a, feature_b, a) - 1) / 2 as ra,
  rank() over (partition by run_id, group_name, feature_a, feature_b order by b) + (count(*) over (partition by run_id, group_name, feature_a, feature_b, b) - 1) / 2 as rb from p),
s as (select run_id, group_name, feature_a, feature_b, count(*) as n, case when min(a) = max(a) or min(b) = max(b) then null else corr(ra, rb) end as rho0, min(a) = max(a) or min(b) = max(b) as flat from k group by all),
t as (select *, case when n < 4 or flat then 'descriptive_small_n' else 'tested' end as status from s),
v as (select *, case when status = 'tested' then greatest(-1, least(1, rho0)) end as rho from t),
x as (select *, case when status = 'tested' then n - 2.0 end as df, case when status = 'tested' then rho * sqrt((n - 2) / greatest(1 - rho ** 2, 1e-300)) end as tt from v),
y as (select *, {t_pvalue_sql('tt', 'df')} as p_value from x), {_bh('y', '')}
select run_id, group_name, feature_a, feature_b, n, round(rho, 6) as rho, status, round(p_value, 6) as p_value, round(q_value, 6) as q_value, tests_in_family from adjusted"""


def reversal_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Features whose rescue points against the treatment effect."""
    rows = C.two_sided(_units(spark, d), ["run_id", "feature"], "group_name", CONTRASTS).withColumn("effect", F.col("mean_test") - F.col("mean_reference"))
    out = C.reversal(rows, ["run_id", "feature"], "treated_vs_control", "rescue_vs_treated", "rescue_vs_control")
    return rounded(out, "model_effect", "treatment_effect", "residual_effect")


def time_trend_slope(spark: SparkSession, d: str) -> DataFrame:
    """Slope over time per feature and group."""
    units = U.technical_aggregate(table(spark, d, "observations"), ["feature", "group_name", "run_id", "unit", "time_h"])
    units = units.withColumn("run_unit", F.concat_ws("/", "run_id", "unit"))
    return rounded(C.time_trend(units, ["feature", "group_name"], "run_unit", "time_h"), "slope")


def gene_set_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Brands and types of parts as sets, ordered parts as the universe, parts in large orders as the selection."""
    items = table(spark, d, "lineitem")
    universe = items.select(F.col("l_partkey").alias("gene"))
    selected = items.filter("l_quantity >= 49").select(F.col("l_partkey").alias("gene"))
    part = table(spark, d, "part")
    sets = part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene")).union(part.select("p_type", "p_partkey"))
    return rounded(enrichment.enrich(selected, universe, sets), "p_value", "q_value")


_EN = f"""with uni as (select distinct l_partkey as gene from lineitem), sel as (select distinct l_partkey as gene from lineitem where l_quantity >= 49),
sets as (select p_brand as term, p_partkey as gene from part union select p_type, p_partkey from part),
c as (select term, count(*) as term_n, count(sel.gene) as overlap, (select count(*) from sel) as selected_n, (select count(*) from uni) as universe_n from sets join uni using (gene) left join sel using (gene) group by term),
p as (select *, case when overlap = 0 then 1.0 else least(1.0, list_sum(list_transform(range(greatest(overlap, term_n + selected_n - universe_n), least(term_n, selected_n) + 1), lambda x:
  exp(lgamma(term_n + 1) - lgamma(x + 1) - lgamma(term_n - x + 1) + lgamma(universe_n - term_n + 1) - lgamma(selected_n - x + 1) - lgamma(universe_n - term_n - selected_n + x + 1) - lgamma(universe_n + 1) + lgamma(selected_n + 1) + lgamma(universe_n - selected_n + 1))))) end as p_value from c),
{_bh('p', '')} select term, term_n, overlap, selected_n, universe_n, round(p_value, 6) as p_value, round(q_value, 6) as q_value, tests_in_family from adjusted"""


def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    """Order totals as a matrix of priorities and back to one value per row."""
    wide = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return rounded(U.melt(wide, ["o_custkey"], ["F", "O", "P"], "o_orderstatus", "total").filter("total is not null"), "total")


def table_profile(spark: SparkSession, d: str) -> DataFrame:
    """Missing, distinct and numeric values per customer column."""
    return U.profile(table(spark, d, "customer"))


_PROFILE = " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as missing, count(distinct cast({c} as varchar)) as distinct_values, count(try_cast(cast({c} as varchar) as double)) as numeric_values, (select count(*) from customer) - (select count(*) from (select distinct * from customer)) as duplicate_rows from customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
)


def metadata_join_checks(spark: SparkSession, d: str) -> DataFrame:
    """Assertions before joining events to customers as their metadata."""
    events = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return U.metadata_join_checks(events, table(spark, d, "customer"), "c_custkey")


def signals_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest signals, one per feature, in the order q, kind, feature."""
    rows = C.classify(C.bh_adjust(_contrast_rows(spark, d), ["contrast"]), detection=("detection_test", "detection_reference"))
    return followup.choose_signals(rounded(rows, "q_value").select("feature", "q_value", "signal_class"), most=10)


def rank_tests_exact(spark: SparkSession, d: str) -> DataFrame:
    """Mann-Whitney of treated against control with the exact distribution where it applies."""
    return rounded(kernels.rank_tests(_units(spark, d), ["run_id", "feature"], "group_name", "treated", "control"), "u", "rank_biserial", "p_value")


def signed_rank(spark: SparkSession, d: str) -> DataFrame:
    """Wilcoxon signed rank of treated minus control means of the features of a run."""
    m = C.moments(_units(spark, d), ["run_id", "feature"], "group_name")
    both = m.groupBy("run_id", "feature").agg(*[F.max(F.when(F.col("group_name") == g, F.col("mean"))).alias(g) for g in ("treated", "control")])
    return rounded(kernels.signed_rank_tests(both.withColumn("d", F.round(F.col("treated") - F.col("control"), 9)), ["run_id"], "d"), "w", "p_value")


def batch_adjusted_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Treated against control per feature over all runs, adjusted for the run as batch, with robust errors."""
    out = C.bh_adjust(kernels.adjusted_contrast(_units(spark, d), ["feature"], "group_name", "treated", "control", "run_id"), [])
    return rounded(out, "effect", "standard_error", "p_value", "q_value")


def mixed_time_trend(spark: SparkSession, d: str) -> DataFrame:
    """Slopes over time with random intercepts of units, per feature and group."""
    units = U.technical_aggregate(table(spark, d, "observations"), ["feature", "group_name", "run_id", "unit", "time_h"])
    units = units.withColumn("run_unit", F.concat_ws("/", "run_id", "unit"))
    return rounded(kernels.mixed_trend(units, ["feature", "group_name"], "run_unit", "time_h"), "slope", "standard_error", "p_value")


def count_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Items per part type and ship month, a complete count matrix, between two years' months."""
    items = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    counts = items.filter(F.year("l_shipdate").isin(1994, 1996)).groupBy("p_brand", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("value"))
    grid = counts.select("p_brand").distinct().crossJoin(F.broadcast(counts.select("month").distinct()))  # at most 24 months
    full = grid.join(counts, ["p_brand", "month"], "left").fillna(0).withColumn("year", F.substring("month", 1, 4))
    return rounded(kernels.count_contrasts(full, "p_brand", "month", "year", "1996", "1994"), "log2fc", "standard_error", "p_value", "dispersion")


def contrast_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Welch contrasts with 95 % intervals."""
    rows = C.welch(C.two_sided(_units(spark, d), ["run_id", "feature"], "group_name", CONTRASTS)).filter("status = 'tested'")
    return rounded(kernels.with_interval(rows).select("run_id", "feature", "contrast", "effect", "ci_low", "ci_high"), "effect", "ci_low", "ci_high")


def streamed_units(spark: SparkSession, d: str) -> DataFrame:
    """Technical aggregation of the observations read as a stream of files, by day of loading; the stream ends with what is there."""
    schema = table(spark, d, "observations").schema
    # as a pattern the table may be one file or a folder of them; a plain path of a stream must be a folder
    source = spark.readStream.schema(schema).parquet(f"{d}/observations.parque[t]")
    units = stream_units(source, "loaded_at", KEYS, window="1 day", late="36500 days").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
    path = new_path(spark, "stream-units")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    units.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{path}/table"), "value")


QUERIES = {
    f.__name__: f
    for f in (
        contrast_welch_bh, technical_aggregation, detection_table, bh_all, leave_one_out_stability, qc_issues, qc_raw_counts, repeated_floor, batch_confounding, ratio_normalization, delta_ct,
        paired_t, mann_whitney, spearman_within_group, reversal_patterns, time_trend_slope, gene_set_enrichment, wide_to_long, table_profile, metadata_join_checks, signals_topk,
        rank_tests_exact, signed_rank, batch_adjusted_contrast, mixed_time_trend, count_contrasts, contrast_intervals, streamed_units,
    )
}
SQL = {
    "streamed_units": "select strftime(date_trunc('day', loaded_at), '%Y-%m-%d') as window_start, run_id, feature, group_name, unit, round(avg(value), 6) as value, count(value) as observed_technical_n, count(*) as technical_rows from observations where loaded_at is not null group by all",
    "contrast_welch_bh": CONTRAST_SQL,
    "technical_aggregation": "select run_id, feature, group_name, unit, round(avg(value), 6) as mean_value, round(median(value), 6) as median_value, count(value) as observed_technical_n, count(*) as technical_rows, string_agg(distinct sample, ';' order by sample) as samples from observations group by all",
    "detection_table": f"with {UNITS}, {_DET} select d.run_id, d.feature, d.group_name, o.n as observed_units, e.x as expected_units, round(detection, 6) as detection from det d join o using (run_id, feature, group_name) join e using (run_id, group_name)",
    "bh_all": f"with {_MOMENTS}, {_bh('rows3', '')} select run_id, feature, contrast, round(p_value, 6) as p_value, round(q_value, 6) as q_value, tests_in_family from adjusted",
    "leave_one_out_stability": f"with {_MOMENTS} select run_id, feature, contrast, round(effect, 6) as effect, {_LOO} as stable from rows3 where status = 'tested'",
    "qc_issues": f"with {_FLOOR} select * from ({_QC} union all select 'blocking', 'technical_replicates', count(*) from (select 1 from observations group by run_id, feature, group_name, unit having count(*) > 1) union all select 'blocking', 'batch_unadjusted', count(*) from (select 1 from observations group by run_id having count(distinct batch) > 1)) where cases > 0",
    "qc_raw_counts": f"with {_FLOOR} select * from ({_QC} union all select 'blocking', 'invalid_raw_count_cells', count(*) from observations where value is null or value < 0 or value <> floor(value)) where cases > 0",
    "repeated_floor": f"with {_FLOOR} select *, n >= 20 and at_floor >= greatest(4, 0.15 * n) as repeated_floor from fl",
    "batch_confounding": "with p as (select year(o_orderdate) as year, o_orderpriority, count(distinct o_orderstatus) as g from orders where o_orderpriority is not null group by all) select year, count(*) as batches, count(*) filter (where g = 1) as single_group_batches, count(*) > 1 and count(*) = count(*) filter (where g = 1) as confounded from p group by year",
    "ratio_normalization": f"{_REF} select run_id, feature, group_name, unit, round(case when complete and reference_mean > 0 then value / reference_mean end, 6) as value, round(reference_mean, 6) as reference_mean, complete from j",
    "delta_ct": f"{_REF} select run_id, feature, group_name, unit, round(case when complete then reference_mean - value end, 6) as value, round(case when complete then value - reference_mean end, 6) as delta_ct, complete from j",
    "paired_t": f"""with u as (select c_nationkey, o_custkey, o_orderstatus, avg(o_totalprice) as v from orders join customer on o_custkey = c_custkey where o_orderstatus in ('F', 'O') group by all),
p as (select c_nationkey, o_custkey, max(v) filter (where o_orderstatus = 'F') - max(v) filter (where o_orderstatus = 'O') as d from u group by all),
s as (select c_nationkey, count(d) as n_matched_pairs, count(*) - count(d) as unmatched_units, avg(d) as effect, var_samp(d) as var from p group by all),
t as (select *, case when n_matched_pairs < 3 then 'descriptive_small_n' when var = 0 then 'not_estimable' else 'tested' end as status from s),
x as (select *, case when status = 'tested' then effect / sqrt(var / n_matched_pairs) end as statistic, case when status = 'tested' then n_matched_pairs - 1.0 end as df from t)
select c_nationkey, n_matched_pairs, unmatched_units, round(effect, 6) as effect, status, round(statistic, 6) as statistic, round(cast(df as double), 6) as df, round({t_pvalue_sql('statistic', 'df')}, 6) as p_value from x""",
    "mann_whitney": _MW,
    "spearman_within_group": _SP,
    "reversal_patterns": f"""with {_MOMENTS}, w as (select run_id, feature, max(effect) filter (where contrast = 'treated_vs_control') as a, max(effect) filter (where contrast = 'rescue_vs_treated') as b, max(effect) filter (where contrast = 'rescue_vs_control') as c from rows1 group by all)
select run_id, feature, round(a, 6) as model_effect, round(b, 6) as treatment_effect, round(c, 6) as residual_effect, case when sign(a) * sign(b) < 0 and abs(c) < abs(a) then 'opposite_and_closer' when sign(a) * sign(b) < 0 then 'opposite' else 'not_opposite' end as pattern from w where a is not null and b is not null and c is not null""",
    "time_trend_slope": """with u as (select feature, group_name, run_id || '/' || unit as ru, time_h, run_id, unit, avg(value) as value from observations group by all),
s as (select feature, group_name, count(distinct ru) as units, count(distinct time_h) as times, count(*) as n, regr_slope(value, time_h) as sl from u where feature is not null and group_name is not null and time_h is not null and value is not null group by all)
select feature, group_name, units, times, n, round(case when units >= 4 and times >= 3 then sl end, 6) as slope, case when units >= 4 and times >= 3 then 'estimated' else 'descriptive_small_n' end as status from s""",
    "batch_adjusted_contrast": f"""with {UNITS}, m as (select feature, run_id as b, cast(group_name = 'treated' as int) as x, count(*) as k, avg(value) as y, var_pop(value) as v from units where value is not null and group_name in ('treated', 'control') group by all),
b1 as (select *, sum(k) over w as nb, x - sum(k * x) over w / sum(k) over w as xt, y - sum(k * y) over w / sum(k) over w as yt from m window w as (partition by feature, b)),
b2 as (select *, sum(k * xt * xt) over f as sxx, sum(k * xt * yt) over f as sxy from b1 window f as (partition by feature)),
b3 as (select *, case when sxx > 0 then sxy / sxx end as beta, 1 / nb + case when sxx > 0 then xt * xt / sxx end as h from b2),
b4 as (select feature, sum(k)::bigint as n, count(distinct b) as batches, max(h) as h, max(beta) as beta, max(sxx) as sxx, sqrt(sum(case when h < 1 then xt * xt * k * (v + (yt - beta * xt) ** 2) / (1 - h) ** 2 end)) as meat from b3 group by 1),
b5 as (select *, coalesce(n > batches + 2 and sxx > 1e-9 and h <= 1 - 1e-12 and meat / sxx > 0, false) as ok from b4),
b6 as (select feature, n, case when ok then beta end as effect, case when ok then meat / sxx end as standard_error, case when ok then 'tested' else 'not_estimable' end as status, case when ok then beta / (meat / sxx) end as z from b5),
b7 as (select *, {normal_pvalue_sql('z')} as p_value from b6), {_bh('b7', '')} select feature, n, round(effect, 6) as effect, round(standard_error, 6) as standard_error, round(p_value, 6) as p_value, status, round(q_value, 6) as q_value, tests_in_family from adjusted""",
    "gene_set_enrichment": _EN,
    "wide_to_long": "select o_custkey, o_orderstatus, round(sum(o_totalprice), 6) as total from orders where o_orderstatus in ('F', 'O', 'P') group by all",
    "table_profile": _PROFILE,
    "metadata_join_checks": "select (select count(*) from events where user_id not in (select c_custkey from customer)) as rows_without_metadata, (select count(distinct user_id) from events where user_id not in (select c_custkey from customer)) as keys_without_metadata, (select count(*) from customer where c_custkey not in (select user_id from events)) as metadata_without_rows, (select count(*) from (select 1 from customer group by c_custkey having count(*) > 1)) as duplicate_metadata_keys",
    "signals_topk": f"with c as ({CONTRAST_SQL}) select 'differential' as kind, feature, q_value from c where signal_class = 'statistical_signal' qualify row_number() over (partition by feature order by q_value) = 1 order by q_value, feature limit 10",
}
SQL = {k: rounded_sql(v) for k, v in SQL.items()}
