"""Technical aggregation over a stream of observations (an extension: the batch operators have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_units(observations: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "2 hours", value: str = "value") -> DataFrame:
    """Mean and counts per unit key and event-time window; rows later than ``late`` are left out of closed windows."""
    rows = observations.withWatermark(time, late)
    out = rows.groupBy(F.window(time, window), *keys).agg(F.avg(value).alias(value), F.count(value).alias("observed_technical_n"), F.count("*").alias("technical_rows"))
    return out.select(F.col("window.start").alias("window_start"), *keys, value, "observed_technical_n", "technical_rows")
