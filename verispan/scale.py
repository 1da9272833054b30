"""Helpers that keep plans sound at scale: shared folders, lineage cuts, hot keys, split counts.

Everything here is data-size neutral: a helper never drops or samples rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 256
"""At most so many keys are treated as hot; this bounds every broadcast made by ``attach``."""

SMALL_BYTES = 4 * 1024 * 1024
"""A side is broadcast whole only if the files it is read from hold at most so many bytes."""
TRACKED = 8192
"""Counters of the sketch that finds hot keys; a key of more than about 1 / TRACKED of all rows is never missed."""

_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a ``local[...]`` session names none, one folder of this machine serves the application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="verispan-")
        folder = _local[app]
    return folder


def new_path(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/verispan/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already
            return


atexit.register(_remove_written)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle ``df`` over all cores only if its scan has fewer splits than the cluster has cores.

    Meant before CPU-heavy map stages over tables stored in a few large row groups. Splits are
    counted from the planned scan; no job runs. A plan with a shuffle of its own is returned as it
    is: adaptive execution keeps at least as many partitions as there are cores.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or "Exchange" in plan.toString():
        return df
    if plan.execute().getNumPartitions() >= cores:
        return df
    n = max(cores * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def fenced(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that are computed once, behind a generator.

    Long chains of expressions end up in one generated method, which the JVM does not compile beyond
    8,000 bytes, and filters pull them apart. A generator of one row ends the method and stops the filter.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("__fenced")
    return df.select("*", one).select(*[c for c in df.columns if c not in cols], *[F.col(f"__fenced.{n}").alias(n) for n in cols])


def proven_small(df: DataFrame) -> bool:
    """Whether ``df`` only selects or groups tables whose files hold at most ``SMALL_BYTES``; no job runs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in ("LogicalRelation", "LocalRelation", "Project", "Filter", "Aggregate", "SubqueryAlias"):
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return int(str(plan.stats().sizeInBytes())) <= SMALL_BYTES


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", weight: str | None = None) -> DataFrame:
    """Join ``big`` to the unique rows of ``small`` on ``keys`` though a few keys may hold most rows of ``big``.

    A ``small`` of proven size is broadcast. Otherwise a sketch of bounded size finds the
    ``HOT_KEYS`` most frequent keys of ``big``; their rows of ``small`` are broadcast, at most
    ``HOT_KEYS``. In the shuffle join that serves the rest, rows with a hot key carry a salt instead
    of their key, so they spread evenly and match nothing. What the sketch finds only decides which
    way a row goes, never its result. ``weight`` names a column of ``small`` that counts the rows of
    ``big`` per key, which spares the sketch; then every key of ``big`` must be in ``small``. Null
    keys match null keys. ``how`` is ``left`` or ``inner``. Columns of ``small`` other than the keys
    are added. ``big`` is read once besides the sketch; no job runs here.
    """
    keys = list(keys)
    added = [c for c in small.columns if c not in keys and c != weight]
    names = [f"__k{i}" for i in range(len(keys))]
    space = 1 << 62

    def as_keys(df: DataFrame, *rest: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *rest)

    def same(a: DataFrame, an: Sequence[str], b: DataFrame, bn: Sequence[str]) -> Column:
        cond = a[an[0]].eqNullSafe(b[bn[0]])
        for x, y in zip(an[1:], bn[1:]):
            cond = cond & a[x].eqNullSafe(b[y])
        return cond

    values = lambda tag: [F.col(c).alias(f"__{tag}_{c}") for c in added]
    if proven_small(small):
        all_ = F.broadcast(as_keys(small, *values("hot")))
        out = big.join(all_, same(big, keys, all_, names), how)
        return out.select(*big.columns, *[F.col(f"__hot_{c}").alias(c) for c in added])
    found = as_keys(small, *values("hot"), F.lit(True).alias("__matched"), F.xxhash64(*keys).alias("__h"), *([F.col(weight).alias("__w")] if weight else []))
    if weight is not None:
        found = found.orderBy(F.desc_nulls_last("__w"), *names).limit(HOT_KEYS)
        warm = big.join(F.broadcast(found), same(big, keys, found, names), "left").withColumn("__is_hot", F.col("__matched"))
    else:
        top = big.select(F.xxhash64(*keys).alias("__h")).agg(F.expr(f"approx_top_k(__h, {HOT_KEYS}, {TRACKED})").alias("t"))
        top = top.select(F.explode("t.item").alias("__h")).distinct()
        found = found.join(F.broadcast(top), "__h", "left_semi").drop("__h")
        # also a frequent key without a counterpart must not meet in one task
        flag = top.withColumnsRenamed({"__h": "__top"}).withColumn("__is_hot", F.lit(True))
        warm = big.withColumn("__h", F.xxhash64(*keys))
        warm = warm.join(F.broadcast(flag), warm["__h"] == flag["__top"], "left")
        warm = warm.join(F.broadcast(found), same(warm, keys, found, names), "left")
    warm = warm.drop(*names, "__w", "__top", "__h")
    atoms = [c for c, t in big.dtypes if not t.startswith(("map", "struct", "array", "variant"))]
    salt = F.lit(-1) - F.pmod(F.xxhash64(F.spark_partition_id(), *atoms), F.lit(space))
    warm = warm.withColumn("__at", F.when(F.col("__is_hot"), salt).otherwise(F.pmod(F.xxhash64(*keys), F.lit(space))))
    rest = as_keys(small, *values("rest"), F.pmod(F.xxhash64(*keys), F.lit(space)).alias("__to"), F.lit(True).alias("__is_rest"))
    out = warm.join(rest, (warm["__at"] == rest["__to"]) & same(warm, keys, rest, names), "left")
    if how == "inner":
        out = out.filter(F.coalesce("__matched", "__is_rest", F.lit(False)))
    return out.select(*big.columns, *[F.coalesce(f"__hot_{c}", f"__rest_{c}").alias(c) for c in added])
