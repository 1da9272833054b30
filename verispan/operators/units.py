"""From tidy observations to biological units: technical aggregation, detection, reference normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.operators.kernels import t_margin


def technical_aggregate(obs: DataFrame, keys: Sequence[str], value: str = "value", how: str = "mean", annotations: Sequence[str] = (), order: str | None = None, lists: Sequence[str] = ()) -> DataFrame:
    """One row per unit key: the aggregated value, the number of observed technical values, rows.

    Nulls are skipped and an all-null unit stays null. ``annotations`` keep the first non-null value
    by ``order``; ``lists`` keep the distinct values sorted.
    """
    agg = {"mean": F.avg, "median": F.median, "sum": F.sum}[how]
    first = [F.min_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in annotations]
    some = [F.array_sort(F.collect_set(c)).alias(f"{c}_list") for c in lists]
    return obs.groupBy(*keys).agg(agg(value).alias(value), F.count(value).alias("observed_technical_n"), F.count("*").alias("technical_rows"), *first, *some)


def detection(units: DataFrame, scope: Sequence[str], group: str, unit: str, feature: str, value: str = "value") -> DataFrame:
    """Observed against expected units per feature and group; expected counts units over all features of the scope."""
    expected = units.groupBy(*scope, group).agg(F.countDistinct(unit).alias("expected_units"))
    seen = units.groupBy(*scope, feature, group).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(unit))).alias("observed_units"))
    return seen.join(expected, [*scope, group]).withColumn("detection", F.try_divide("observed_units", "expected_units"))


def reference_normalise(units: DataFrame, keys: Sequence[str], feature: str, references: Sequence[str], mode: str, value: str = "value") -> DataFrame:
    """Each target value against the mean of the reference features of the same unit.

    ``delta_ct`` gives ``delta_ct`` and its negative as the value (log2 scale); ``ratio`` divides by
    a positive reference mean. A target whose unit lacks a reference has a null result and
    ``complete`` false. Null keys match. Reference features are left out of the result.
    """
    is_ref = F.col(feature).isin(list(references))
    refs = units.filter(is_ref).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.avg(value).alias("reference_mean"), F.countDistinct(F.when(F.col(value).isNotNull(), F.col(feature))).alias("reference_n"))
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = units.filter(~F.coalesce(is_ref, F.lit(False))).join(refs, on, "left").drop(*[f"__{k}" for k in keys])
    complete = F.coalesce(F.col("reference_n") == len(references), F.lit(False))
    if mode == "delta_ct":
        delta = F.when(complete, F.col(value) - F.col("reference_mean"))
        return out.withColumns({"complete": complete, "delta_ct": delta, value: -delta})
    return out.withColumns({"complete": complete, value: F.when(complete & (F.col("reference_mean") > 0), F.col(value) / F.col("reference_mean"))})


def log2_values(units: DataFrame, value: str = "value") -> DataFrame:
    """``value`` on the log2 scale; refuses non-positive values, for which no pseudocount is made up."""
    bad = units.filter(F.col(value) <= 0).limit(1).count()
    if bad:
        raise ValueError("log2 needs positive values")
    return units.withColumn(value, F.log2(value))


def melt(df: DataFrame, ids: Sequence[str], samples: Sequence[str], sample: str = "sample", value: str = "value") -> DataFrame:
    """A wide matrix as one measurement per row."""
    return df.unpivot(list(ids), list(samples), sample, value)


def profile(df: DataFrame) -> DataFrame:
    """Per column: missing, distinct and numeric values; ``duplicate_rows`` counts the further copies of whole rows."""
    parts = []
    for c, kind in df.dtypes:
        text = F.col(c).cast("string") if not kind.startswith(("array", "map", "struct")) else F.to_json(F.struct(c))
        number = F.expr(f"try_cast(cast(`{c}` as string) as double)") if not kind.startswith(("array", "map", "struct")) else F.lit(None)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("missing"), F.countDistinct(text).alias("distinct_values"), F.count(number).alias("numeric_values")))
    one = df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)])
    rows = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(parts))])).alias("p")).select("p.*")
    whole = [F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)]
    copies = df.groupBy(*whole).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    return rows.crossJoin(F.broadcast(copies))  # one row


def figure_summary(units: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """What a figure shows per group (and time): n, mean, standard deviation, standard error and the 95 % interval of the mean."""
    out = units.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).filter("n > 0")
    out = out.withColumn("sem", F.col("sd") / F.sqrt("n"))
    half = F.when(F.col("n") > 1, t_margin(F.when(F.col("n") > 1, (F.col("n") - 1).cast("double"))) * F.col("sem"))
    return out.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def metadata_join_checks(obs: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """One row of assertion counts before a many-to-one metadata join."""
    left, right = obs.select(key), meta.select(key)
    a = left.join(right, key, "left_anti").agg(F.count("*").alias("rows_without_metadata"), F.countDistinct(key).alias("keys_without_metadata"))
    b = right.join(left, key, "left_anti").agg(F.count("*").alias("metadata_without_rows"))
    c = right.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_metadata_keys"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
