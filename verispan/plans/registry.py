"""All queries outside the subpackage for text corpora, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verispan.plans import corpora, evidence, experiments, problems

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**experiments.QUERIES, **evidence.QUERIES, **corpora.QUERIES, **problems.QUERIES}
SQL: dict[str, str] = {**experiments.SQL, **evidence.SQL, **corpora.SQL, **problems.SQL}
