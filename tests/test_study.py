"""Whole studies from a configuration."""

import pytest
from pyspark.sql import functions as F

from verispan.plans.study import analyse, check_config

CONFIG = {
    "study": {"design": "independent", "data_scale": "log2", "independent_units_confirmed": True},
    "columns": {"feature": "Gene", "sample": "Well", "unit": "BiologicalUnit", "group": "Group", "value": "Log2"},
    "comparisons": [{"test": "B", "reference": "A"}],
    "analysis": {"technical_aggregation": "mean"},
}


def frame(spark, n=5, copies=1, lift=3.0, extra=()):
    rows = [(g_, f"{g}{i}-{t}", f"{g}{i}", g, str(t), str(round(base + 0.1 * i + (1 if g == "A" else 1 + lift), 3))) for g_, base in (("GPX4", 0), *extra) for g in "AB" for i in range(n) for t in range(copies)]
    return spark.createDataFrame(rows, "Gene string, Well string, BiologicalUnit string, Group string, technical string, Log2 string")


def test_a_study(spark):
    s = analyse(frame(spark, copies=2), CONFIG)
    (row,) = s.contrasts.collect()
    assert not s.blocked and row.effect == pytest.approx(3) and (row.n_test, row.n_reference) == (5, 5) and row.signal_class == "statistical_signal" and row.log2fc == row.effect
    assert s.issues.collect() == [] and s.units.count() == 10 and {r.detection for r in s.detection.collect()} == {1.0}


def test_gates_block_but_describe(spark):
    config = {**CONFIG, "study": {**CONFIG["study"], "independent_units_confirmed": False}, "analysis": {}}
    s = analyse(frame(spark, copies=2), config)
    (row,) = s.contrasts.collect()
    assert s.blocked and {r.code for r in s.issues.collect()} == {"unit_definition", "technical_replicates"}
    assert row.status == "qc_blocked" and row.p_value is None and row.q_value is None and row.effect == pytest.approx(3)


def test_cycle_values_and_scales(spark):
    ct = frame(spark, extra=[("ACTB", 0)]).withColumn("Log2", F.when(F.col("Gene") == "ACTB", "15").otherwise((20 - F.col("Log2").cast("double")).cast("string")))
    config = {**CONFIG, "study": {**CONFIG["study"], "data_scale": "ct"}, "qpcr": {"reference_features": ["ACTB"], "equal_efficiency_confirmed": True}}
    s = analyse(ct, config)
    (row,) = s.contrasts.collect()
    assert s.scale == "log2" and row.feature == "GPX4" and row.effect == pytest.approx(3)
    linear = {**CONFIG, "study": {**CONFIG["study"], "data_scale": "linear"}}
    assert analyse(frame(spark), linear).contrasts.first().log2fc == pytest.approx(__import__("math").log2(4.2 / 1.2))
    counts = {**CONFIG, "study": {**CONFIG["study"], "data_scale": "raw_counts"}, "analysis": {"technical_aggregation": "sum"}}
    few = analyse(frame(spark).withColumn("Log2", F.lit("4")), counts)  # too few genes for a count model
    assert few.contrasts.first().status == "qc_blocked" and few.blocked and "count_model_unavailable" in {r.code for r in few.issues.collect()}
    for bad in ({**config, "qpcr": {}}, {**CONFIG, "comparisons": []}, {**CONFIG, "study": {"data_scale": "odd"}}, {**CONFIG, "analysis": {"technical_aggregation": "sum"}}):
        with pytest.raises(ValueError):
            check_config(bad)


def test_refusals(spark):
    for bad in (frame(spark).drop("Gene"), frame(spark).withColumn("Log2", F.lit("x")), frame(spark).withColumn("Well", F.lit("")), frame(spark).union(frame(spark)), frame(spark).limit(0)):
        with pytest.raises(ValueError):
            analyse(bad, CONFIG)
    s = analyse(frame(spark).withColumn("Log2", F.when(F.col("Well") == "A0-0", "ND").otherwise(F.col("Log2"))), {**CONFIG, "analysis": {"missing_values": ["ND"], "technical_aggregation": "mean"}})
    assert s.contrasts.first().n_reference == 4


def test_pairs_trends_and_correlations(spark):
    rows = [(f, f"{g}{i}-{t}", f"{g}{i}", g, float(t), f"p{i}", 1.0 * i + t + (3 + 0.1 * ((i * 7) % 5) if g == "B" else 0) * (1 if f == "X" else -1)) for f in "XY" for g in "AB" for i in range(5) for t in (0, 1, 2)]
    df = spark.createDataFrame(rows, "feature string, sample string, unit string, group string, time double, pair string, value double")
    config = {"study": {"design": "paired", "data_scale": "log2", "independent_units_confirmed": True}, "comparisons": CONFIG["comparisons"], "analysis": {"technical_aggregation": "mean"}, "correlations": {"features": ["X", "Y"]}}
    s = analyse(df, config)
    got = {(r.feature, r.time): r for r in s.contrasts.collect()}
    assert len(got) == 6 and all(r.status == "tested" and r.n_matched_pairs == 5 for r in got.values()) and got["X", 0.0].effect > 3 > -3 > got["Y", 0.0].effect
    assert s.correlations.count() == 6 and {round(r.slope, 6) for r in s.trends.collect()} == {1.0}
