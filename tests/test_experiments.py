"""Contrasts, kernels and gates on small designs with known answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispan.functions.stats import normal_pvalue, t_pvalue
from verispan.operators import contrasts, kernels, qc, units


def base(n=5, technical=1, lift=3.0):
    return [("GPX4", f"{g}{i}-{t}", f"{g}{i}", g, t, 0.1 * i + (1 if g == "A" else 1 + lift)) for g in "AB" for i in range(n) for t in range(technical)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "feature string, sample string, unit string, group_name string, technical int, value double")


def contrast(spark, rows, **kw):
    u = units.technical_aggregate(frame(spark, rows), ["feature", "group_name", "unit"])
    return contrasts.welch(contrasts.two_sided(u, ["feature"], "group_name", [("B", "A")]), **kw)


def test_technical_copies_do_not_inflate_n(spark):
    one, three = (contrast(spark, base(technical=k)).first() for k in (1, 3))
    assert one.effect == pytest.approx(3) and (one.n_test, one.n_reference) == (three.n_test, three.n_reference) == (5, 5)
    assert one.p_value == pytest.approx(three.p_value)


def test_missing_is_not_zero(spark):
    rows = base()
    rows[0] = (*rows[0][:5], None)
    got = contrast(spark, rows).first()
    assert got.n_reference == 4
    u = units.technical_aggregate(frame(spark, rows), ["feature", "group_name", "unit"])
    d = {r.group_name: r.detection for r in units.detection(u, [], "group_name", "unit", "feature").collect()}
    assert d == {"A": 0.8, "B": 1.0}


def test_status_precedence(spark):
    assert contrast(spark, base(2)).first().status == "descriptive_small_n"
    assert contrast(spark, base(2), blocked=True).first().status == "qc_blocked"
    flat = [(f, s, u, g, t, 1.0) for f, s, u, g, t, _ in base()]
    got = contrast(spark, flat).first()
    assert got.status == "not_estimable" and got.p_value is None


def test_p_values_against_incomplete_beta(spark):
    grid = [(t, v) for t in (0.0, 0.05, 0.7, 2.0, 5.0, 12.0) for v in (1.0, 1.05, 2.2, 2.99, 3.0, 8.5, 60.0, 5000.0, 1e6)]
    df = spark.createDataFrame(grid, "t double, v double").withColumn("p", t_pvalue("t", "v"))
    for r in df.collect():
        assert r.p == pytest.approx(float(kernels.t_two_sided(r.t, r.v)), rel=2e-6, abs=1e-15)
    z = spark.createDataFrame([(0.0,), (1.0,), (-2.5,), (6.0,)], "z double").withColumn("p", normal_pvalue("z"))
    for r in z.collect():
        assert r.p == pytest.approx(kernels.normal_two_sided(r.z), rel=1e-8)
    q = kernels.t_quantile(0.95, np.array([1.0, 10.0, 1e6]))
    assert q == pytest.approx([12.7062047, 2.2281389, 1.9599664], rel=1e-6)


def test_family_spans_contrasts(spark):
    rows = [("one", 0.01), ("two", 0.04), ("two", 0.9), ("three", None)]
    df = spark.createDataFrame(rows, "contrast string, p_value double")
    got = {(r.contrast, r.p_value): r for r in contrasts.bh_adjust(df, []).collect()}
    assert got["one", 0.01].q_value == pytest.approx(0.03) and got["one", 0.01].tests_in_family == 3
    assert got["three", None].q_value is None and got["three", None].tests_in_family is None


def test_fdr_against_brute_force(spark):
    rnd = random.Random(3)
    ps = [(i % 3, round(rnd.random() ** 3, 2) if i % 4 else 10 ** -rnd.randint(1, 12)) for i in range(300)]
    got = contrasts.bh_adjust(spark.createDataFrame(ps, "f int, p_value double"), ["f"]).collect()
    for fam in range(3):
        p = sorted(x for f, x in ps if f == fam)
        want = {x: min(1.0, min(y * len(p) / (j + 1) for j, y in enumerate(p) if y >= x)) for x in set(p)}
        assert all(r.q_value == pytest.approx(want[r.p_value]) for r in got if r.f == fam)


def test_pairs_by_key(spark):
    rows = [(i, g, 0.1 * i + (0 if g == "A" else 3 + (0, 0.1, -0.1, 0.2, -0.2)[i])) for i in range(5) for g in "AB"]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "pair int, g string, value double").withColumn("s", F.lit(1))
    got = contrasts.paired_t(df, ["s"], "pair", "g", "B", "A").first()
    assert (got.n_matched_pairs, got.status) == (5, "tested") and got.effect == pytest.approx(3)
    assert contrasts.paired_t(df.union(df.limit(1)), ["s"], "pair", "g", "B", "A").first().status == "ambiguous_pairing"


def test_leave_one_out(spark):
    rows = [("x", g, v) for g, vs in (("A", (1.0, 1.1, 0.9)), ("B", (1.0, 1.05, 5.0))) for v in vs]
    df = spark.createDataFrame(rows, "s string, g string, value double")
    pairs = contrasts.welch(contrasts.two_sided(df, ["s"], "g", [("B", "A")]))
    a, b = ([v for _, g, v in rows if g == k] for k in "AB")
    drops = [np.mean(b) - np.mean(a[:i] + a[i + 1 :]) for i in range(3)] + [np.mean(b[:i] + b[i + 1 :]) - np.mean(a) for i in range(3)]
    assert pairs.select(contrasts.stable_direction(pairs).alias("s")).first().s == all(x > 0 for x in drops)


def test_reference_normalisation(spark):
    rows = [(f, "s", f"{g}{i}", g, 1, v) for g in "AB" for i in range(5) for f, v in (("GPX4", 20 - (0.1 * i + (1 if g == "A" else 4))), ("ACTB", 15.0))]
    rows.append(("GPX4", "s", "C9", "B", 1, 20.0))
    out = units.reference_normalise(frame(spark, rows), ["group_name", "unit"], "feature", ["ACTB"], "delta_ct")
    got = {(r.group_name, r.unit): r for r in out.collect()}
    assert len(got) == 11 and not got["B", "C9"].complete and got["B", "C9"].value is None
    mean = lambda g: np.mean([r.value for (k, _), r in got.items() if k == g and r.complete])
    assert mean("B") - mean("A") == pytest.approx(3)
    with pytest.raises(ValueError):
        units.log2_values(frame(spark, [("f", "s", "u", "A", 1, 0.0)]))


def test_gates(spark):
    rows = [("r", "f", "A", "u1", 1, "b1", 1.0), ("r", "f", "B", "u1", 1, "b2", 2.5), ("r", "f", "A", "u1", 2, "b1", None)]
    df = spark.createDataFrame(rows, "run string, feature string, g string, unit string, technical int, batch string, value double")
    codes = {r.code for r in qc.issues(df, "run", "feature", "g", "unit", "technical", "batch", "value", None, counts=True).collect()}
    assert codes == {"unit_cross_group", "batch_group_confounding", "technical_replicates", "batch_unadjusted", "invalid_raw_count_cells"}
    assert qc.issues(df.limit(0), "run", "feature", "g", "unit", "technical", "batch", "value", None).collect() == []


def test_exact_rank_distributions():
    x, y = [1.5, 2.5, 7.0], [0.5, 3.0, 4.0, 8.0]
    pool = x + y
    u = sum(a > b for a in x for b in y)
    all_u = [sum(a > b for a in c for b in set(pool) - set(c)) for c in itertools.combinations(pool, 3)]
    hi = max(u, 12 - u)
    want = min(1.0, 2 * sum(v >= hi for v in all_u) / len(all_u))
    assert kernels.mann_whitney(np.array(x), np.array(y))[:2] == (u, pytest.approx(want))
    d = np.array([1.0, -2.0, 3.5, 4.0, 5.0])
    signs = [sum(i + 1 for i in range(5) if s >> i & 1) for s in range(32)]
    w, p = kernels.wilcoxon(d)
    assert w == 2 and p == pytest.approx(2 * sum(v <= 2 for v in signs) / 32)
    assert kernels.wilcoxon(np.zeros(3)) == (0.0, 1.0) and kernels.mann_whitney(np.ones(3), np.ones(4))[1] == 1.0


def test_batch_adjusted_effect(spark):
    rows = [("GPX4", f"{g}{i}", g, ("one", "two")[i % 2], 0.1 * i + (1 if g == "A" else 4) + 5 * (i % 2)) for g in "AB" for i in range(8)]
    df = spark.createDataFrame(rows, "feature string, unit string, g string, batch string, value double")
    got = kernels.adjusted_contrast(df, ["feature"], "g", "B", "A", "batch").first()
    assert got.effect == pytest.approx(3) and got.status == "tested"
    assert kernels.adjusted_contrast(df.limit(3), ["feature"], "g", "B", "A", "batch").first().status == "not_estimable"


def test_mixed_trend(spark):
    rnd = np.random.default_rng(5)
    rows = [("f", f"u{u}", float(t), float(2 * t + b + rnd.normal(0, 0.2))) for u in range(6) for b in [rnd.normal(0, 1)] for t in (0, 1, 2)]
    df = spark.createDataFrame(rows, "feature string, unit string, time double, value double")
    got = kernels.mixed_trend(df, ["feature"], "unit", "time").first()
    assert got.method == "mixed_model" and 1.8 < got.slope < 2.2 and got.p_value < 1e-6
    assert kernels.mixed_trend(df.filter("time < 2"), ["feature"], "unit", "time").first().method == "descriptive_small_n"


def test_count_model_recovers_fold_changes(spark):
    rnd = np.random.default_rng(112)
    rows = []
    for s in range(12):
        g, lib = "AB"[s // 6], rnd.uniform(0.7, 1.5)
        for k in range(60):
            mu = lib * (50 + 5 * k) * (4 if g == "B" and k < 4 else 1)
            rows.append((f"G{k}", f"s{s}", g, float(rnd.negative_binomial(10, 10 / (10 + mu)))))
    df = spark.createDataFrame(rows, "gene string, sample string, g string, value double")
    got = {r.gene: r for r in kernels.count_contrasts(df, "gene", "sample", "g", "B", "A").collect()}
    assert all(got[f"G{k}"].log2fc > 1 and got[f"G{k}"].p_value < 1e-3 for k in range(4))
    assert sum(r.p_value < 0.01 for g, r in got.items() if int(g[1:]) > 3) <= 3
    with pytest.raises(ValueError):
        kernels.count_contrasts(df.withColumn("value", F.lit(1.5)), "gene", "sample", "g", "B", "A")


def test_intervals(spark):
    rows = contrast(spark, base())
    got = kernels.with_interval(rows).first()
    assert got.ci_low < 3 < got.ci_high
    se = math.sqrt(got.var_test / 5 + got.var_reference / 5)
    assert got.ci_high - 3 == pytest.approx(se * float(kernels.t_quantile(0.95, np.array([got.df]))[0]))


def test_interval_of_no_effect(spark):
    rows = [("GPX4", f"{g}{i}-0", f"{g}{i}", g, 0, float(i)) for g in "AB" for i in range(5)]
    got = kernels.with_interval(contrast(spark, rows)).first()
    assert got.status == "tested" and got.effect == 0 and got.statistic == 0
    half = math.sqrt(got.var_test / 5 + got.var_reference / 5) * float(kernels.t_quantile(0.95, np.array([got.df]))[0])
    assert (got.ci_low, got.ci_high) == (pytest.approx(-half), pytest.approx(half)) and half > 0
    few = kernels.with_interval(contrast(spark, base(n=1))).first()
    assert few.status == "descriptive_small_n" and few.ci_low is None and few.ci_high is None


def test_interval_of_no_paired_effect(spark):
    from verispan.plans.study import paired_tests

    rows = [("f", f"{g}{i}", g, f"p{i}", 1.0 * i + (d if g == "B" else 0.0)) for g in "AB" for i, d in enumerate((1.0, -1.0, 2.0, -2.0))]
    df = spark.createDataFrame(rows, "feature string, unit string, group string, pair string, value double")
    got = paired_tests(df, ["feature"], {"pairs": [("B", "A")], "min_n": 3}, "paired_t", None).first()
    half = math.sqrt(10 / 3 / 4) * float(kernels.t_quantile(0.95, np.array([3.0]))[0])
    assert got.effect == 0 and (got.ci_low, got.ci_high) == (pytest.approx(-half), pytest.approx(half)) and "__se" not in got


def test_streamed_table_of_many_files(spark, data, tmp_path):
    from verispan.plans.experiments import streamed_units

    rows = spark.read.parquet(f"{data}/observations.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "observations.parquet"))
    rows.limit(1).write.parquet(str(tmp_path / "observations.parquet.old"))
    one, many = (streamed_units(spark, d) for d in (data, str(tmp_path)))
    assert many.count() == one.count() > 0 and one.exceptAll(many).count() == 0


def test_rank_tests_without_a_call_per_stratum(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(120):
        for g, n in (("B", rnd.choice((0, 1, 3, 9, 12))), ("A", rnd.choice((0, 2, 5, 10)))):
            rows += [(k if k else None, g, rnd.choice((-0.0, 0.0, 1.0, 2.0, None)) if k % 3 == 0 else rnd.random()) for _ in range(n)]
    out = kernels.rank_tests(spark.createDataFrame(rows, "s long, g string, v double"), ["s"], "g", "B", "A", "v")
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.s: r for r in out.collect()}
    seen = {s for s, _, v in rows if v is not None}
    assert set(got) == seen
    for s in seen:
        x, y = (np.array([v for t, h, v in rows if t == s and h == g and v is not None]) for g in "BA")
        r = got[s]
        assert (r.n_test, r.n_reference) == (len(x), len(y))
        if not (len(x) and len(y)):
            assert r.u is None and r.rank_biserial is None and r.p_value is None
            continue
        pool = np.concatenate([x, y])
        u = sum((a > b) + (a == b) / 2 for a in x for b in y)
        ties = np.unique(pool, return_counts=True)[1]
        n, m, k = len(x), len(y), len(pool)
        if min(n, m) <= 8 and ties.max() == 1:
            p = min(1.0, 2 * sum(kernels.u_counts(n, m)[int(max(u, n * m - u)) :]) / math.comb(k, n))
        else:
            sd = math.sqrt(n * m / 12 * (k + 1 - (ties**3 - ties).sum() / (k * (k - 1))))
            p = min(1.0, math.erfc(max(0.0, abs(u - n * m / 2) - 0.5) / sd / math.sqrt(2))) if sd else 1.0
        assert (r.u, r.rank_biserial, r.p_value) == (u, pytest.approx(2 * u / (n * m) - 1), pytest.approx(p))
