"""Quality gates over observations: one row per issue found, computed as small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _issue(severity: str, code: str, n: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), n.cast("long").alias("cases")]


def conflicts(obs: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys with more than one non-null value of a column."""
    return obs.groupBy(*keys).agg(F.countDistinct(column).alias("n")).filter("n > 1")


def repeated_floor(obs: DataFrame, scope: Sequence[str], value: str = "value", least: int = 20, share: float = 0.15) -> DataFrame:
    """Per scope: values, the minimum and how often it occurs, and whether that looks like a floor."""
    counts = obs.filter(F.col(value).isNotNull()).groupBy(*scope, value).count()
    out = counts.groupBy(*scope).agg(F.sum("count").alias("n"), F.min(value).alias("floor"), F.min_by("count", value).alias("at_floor"))
    hit = (F.col("n") >= least) & (F.col("at_floor") >= F.greatest(F.lit(4.0), share * F.col("n")))
    return out.withColumn("repeated_floor", hit)


def batch_confounding(obs: DataFrame, scope: Sequence[str], batch: str, group: str) -> DataFrame:
    """Per scope: batches, batches with exactly one group, and whether batch and group cannot be told apart."""
    per = obs.filter(F.col(batch).isNotNull()).groupBy(*scope, batch).agg(F.countDistinct(group).alias("groups"))
    out = per.groupBy(*scope).agg(F.count("*").alias("batches"), F.count_if(F.col("groups") == 1).alias("single_group_batches"))
    return out.withColumn("confounded", (F.col("batches") > 1) & (F.col("batches") == F.col("single_group_batches")))


def issues(obs: DataFrame, run: str, feature: str, group: str, unit: str, technical: str, batch: str, value: str, aggregation: str | None, adjust_batch: bool = False, counts: bool = False, annotations: Sequence[str] = ()) -> DataFrame:
    """``severity, code, cases`` of each gate that fires; cases counts what broke it.

    ``annotations`` are further columns that must not differ within a unit (pair, symbol,
    accession); symbol and accession must not differ within a feature either.
    """
    key = [run, feature, group, unit]
    parts = [
        conflicts(obs, [run, unit], group).agg(*_issue("blocking", "unit_cross_group", F.count("*"))),
        conflicts(obs, key, batch).agg(*_issue("blocking", "conflicting_batch", F.count("*"))),
        repeated_floor(obs, [run], value).filter("repeated_floor").agg(*_issue("warning", "repeated_floor", F.count("*"))),
        batch_confounding(obs, [run], batch, group).filter("confounded").agg(*_issue("blocking", "batch_group_confounding", F.count("*"))),
    ]
    parts += [conflicts(obs, key, c).agg(*_issue("blocking", f"conflicting_{c}", F.count("*"))) for c in annotations]
    named = [c for c in annotations if c in ("symbol", "accession")]
    if named:
        many = F.greatest(*[F.countDistinct(c) for c in named], F.lit(0)).alias("n")
        parts.append(obs.groupBy(feature).agg(many).filter("n > 1").agg(*_issue("blocking", "feature_identity_conflict", F.count("*"))))
    if aggregation is None:
        parts.append(obs.groupBy(*key).count().filter("count > 1").agg(*_issue("blocking", "technical_replicates", F.count("*"))))
    if not adjust_batch:
        parts.append(conflicts(obs, [run], batch).agg(*_issue("blocking", "batch_unadjusted", F.count("*"))))
    if counts:
        bad = F.col(value).isNull() | (F.col(value) < 0) | (F.col(value) != F.floor(value))
        parts.append(obs.filter(bad).agg(*_issue("blocking", "invalid_raw_count_cells", F.count("*"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("cases > 0")


def count_model_issue(spark: SparkSession, reason: str) -> DataFrame:
    """The issue of counts for which no model could be fitted."""
    return spark.range(1).select(*_issue("blocking", "count_model_unavailable", F.lit(1)), F.lit(reason).alias("detail"))
