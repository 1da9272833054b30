"""From results to bounded, resumable follow-up queries, and the library that keeps what they return."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATE = "query_sha256 string, kind string, payload string, status string, attempts int, result string"
NAME = "^[A-Za-z0-9_.-]{1,80}$"


def feature_term(feature: Column, namespace: str, symbol: Column | None = None) -> Column:
    """The public search term of a feature, null where its namespace allows none."""
    own = feature if namespace == "gene_symbol" else F.lit(None).cast("string")
    named = F.coalesce(symbol, own) if symbol is not None else own
    other = feature if namespace in ("uniprot", "ensembl_gene") else F.lit(None).cast("string")
    return F.coalesce(F.when(named.rlike(NAME), named), F.when(other.rlike(NAME), other))


def choose_signals(contrasts: DataFrame, trends: DataFrame | None = None, correlations: DataFrame | None = None, warnings: int = 0, alpha: float = 0.05, min_abs_rho: float = 0.6, most: int = 3) -> DataFrame:
    """The strongest signal of each feature by (q, kind, feature), at most ``most`` (1 to 10).

    ``contrasts``: feature, q_value, signal_class; ``trends``: feature, q_value; ``correlations``:
    feature_a, feature_b, n, rho, q_value. Trends and correlations are left out if there is any warning.
    """
    parts = [contrasts.filter("signal_class = 'statistical_signal'").select(F.lit("differential").alias("kind"), "feature", "q_value")]
    if not warnings:
        if trends is not None:
            parts.append(trends.filter(F.col("q_value") <= alpha).select(F.lit("time_trend").alias("kind"), "feature", "q_value"))
        if correlations is not None:
            live = correlations.filter((F.col("q_value") <= alpha) & (F.col("n") >= 8) & (F.abs("rho") >= min_abs_rho))
            parts.append(live.select(F.lit("correlation").alias("kind"), F.concat_ws(" | ", "feature_a", "feature_b").alias("feature"), "q_value"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = rows.withColumn("__n", F.row_number().over(W.partitionBy("feature").orderBy("q_value", "kind"))).filter("__n = 1").drop("__n")
    return first.orderBy("q_value", "kind", "feature").limit(max(1, min(10, most)))


def run_queries(spark: SparkSession, wanted: list[tuple[str, Mapping]], perform: Callable[[str, Mapping], object], state: str, budget: int = 12, retry_failed: bool = False) -> tuple[str, DataFrame]:
    """(status, state): at most ``budget`` (1 to 50) queries, none of them twice over all runs.

    A query is known by the digest of its kind and payload. The attempt is written to the table at
    ``state`` before the call, so a crash never repeats it unseen. Calls have side effects and run on
    the driver, one by one.
    """
    if not 1 <= budget <= 50:
        raise ValueError("the budget is 1 to 50 queries")
    log: dict[str, tuple] = {}
    try:
        log = {r.query_sha256: tuple(r) for r in latest_state(spark, state).collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise

    def note(row: tuple) -> None:
        log[row[0]] = row
        spark.createDataFrame([row], STATE).withColumn("noted_at", F.current_timestamp()).write.mode("append").parquet(state)

    used, short, done, failed = 0, False, 0, 0
    for kind, payload in wanted:
        text = json.dumps(payload, sort_keys=True, ensure_ascii=False)
        sha = hashlib.sha256(f"{kind}\n{text}".encode()).hexdigest()
        old = log.get(sha)
        if old and (old[3] == "ok" or not retry_failed):
            done += old[3] == "ok"
            failed += old[3] != "ok"
            continue
        if used >= budget:
            short = True
            break
        used += 1
        n = (old[4] if old else 0) + 1
        note((sha, kind, text, "attempted", n, None))
        try:
            note((sha, kind, text, "ok", n, json.dumps(perform(kind, payload), ensure_ascii=False)))
            done += 1
        except Exception as e:
            note((sha, kind, text, "failed", n, f"{type(e).__name__}: {e}"[:300]))
            failed += 1
    status = "budget_exhausted" if short else "failed" if failed and not done else "partial" if failed else "complete"
    rows = latest_state(spark, state) if log else spark.createDataFrame([], STATE)
    return status, rows


def latest_state(spark: SparkSession, state: str) -> DataFrame:
    """The last noted row of each query."""
    order = {"attempted": 0, "failed": 1, "ok": 2}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("status")]
    names = [x.split(" ")[0] for x in STATE.split(", ")]
    rows = spark.read.parquet(state).withColumn("__r", rank)
    return rows.groupBy("query_sha256").agg(F.max_by(F.struct(*names[1:]), F.struct("attempts", "__r")).alias("s")).select("query_sha256", "s.*")


def archive(spark: SparkSession, library: str, new: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` joined into the library: one row per key, the first by ``order`` of old rows before new ones; older states stay as snapshots.

    Each state is a folder ``state=<n>`` under ``library``; the highest one counts.
    """
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    root = jvm.org.apache.hadoop.fs.Path(library)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    states = [int(p.getPath().getName().split("=")[1]) for p in fs.listStatus(root)] if fs.exists(root) else []
    rows = new.withColumn("__age", F.lit(1))
    if states:
        rows = spark.read.parquet(f"{library}/state={max(states)}").withColumn("__age", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in (key, "__age")]
    kept = rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("__age", order)).alias("r")).select(key, "r.*")
    path = f"{library}/state={max(states, default=0) + 1}"
    kept.write.parquet(path)
    return spark.read.parquet(path)


def rollup(queries: DataFrame, blocked: bool = False, offline: bool = False) -> DataFrame:
    """The status of a follow-up over its ``queries`` (status): blocked, without signals, offline and out of budget come before the outcome."""
    c = lambda *s: F.count_if(F.col("status").isin(*s))
    one = queries.agg(F.count("*").alias("n"), c("budget_exhausted").alias("short"), c("failed").alias("failed"), c("failed", "partial").alias("worse"))
    status = (
        F.when(F.lit(blocked), "qc_blocked").when(F.col("n") == 0, "no_eligible_signal").when(F.lit(offline), "pending_offline").when(F.col("short") > 0, "budget_exhausted")
        .when(F.col("failed") == F.col("n"), "retrieval_failed").when(F.col("worse") > 0, "retrieval_partial_requires_evidence_reading").otherwise("retrieval_completed_requires_evidence_reading")
    )
    return one.select("n", status.alias("status"))
