"""The join on hot keys equals a plain join, whatever the keys."""

import pytest
from pyspark.sql import functions as F

from verispan import scale


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("weighted", [False, True])
def test_attach(spark, how, weighted, monkeypatch):
    monkeypatch.setattr(scale, "HOT_KEYS", 2)
    keys = [1] * 40 + [None] * 30 + [2] * 5 + [3] * 4 + ([9] * 35 + [8] if not weighted else [])
    big = spark.createDataFrame([(i, k, "x" if k != 3 else None) for i, k in enumerate(keys)], "n long, k int, s string")
    small = big.filter("k is null or k < 8").groupBy("k", "s").agg(F.count("*").alias("w")).withColumn("v", F.coalesce(F.col("k"), F.lit(-1)) * 10)
    small = small if weighted else small.drop("w")
    got = {(r.n, r.k, r.v) for r in scale.attach(big, small, ["k", "s"], how, "w" if weighted else None).collect()}
    want = {(i, k, (-1 if k is None else k) * 10 if k is None or k < 8 else None) for i, k in enumerate(keys)}
    assert got == (want if how == "left" else {x for x in want if x[2] is not None})
    assert scale.attach(big.limit(0), small, ["k", "s"], how, "w" if weighted else None).collect() == []


def test_written_and_spread(spark):
    df = spark.range(100).withColumn("x", F.lit(None).cast("string"))
    assert scale.written(df, "t").schema == df.schema or scale.written(df, "t").count() == 100
    assert scale.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() > 1
