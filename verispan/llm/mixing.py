"""A mix of sources by target shares of tokens.

Budgets are set on the small tree domain -> language -> source: weights become token budgets, a
source that cannot fill its budget within its repeat cap passes the shortage to its siblings first
and then up the tree. Each source's budget is filled by whole epochs over its texts and a prefix of
one more epoch in a seeded order; the prefix is found by bucketed partial sums, never by one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verispan.llm.tokens import DEFAULT, tokenizer
from verispan.scale import attach, spread, written

BUCKETS = 4096
"""Parts of the seeded order of a source for which token sums are kept."""
MOST_SOURCES = 100_000
"""The tree of sources is handled on the driver; more sources than this are refused."""


def token_counts(rows: DataFrame, text: str, tokens: str = DEFAULT) -> DataFrame:
    """``rows`` with ``n_tokens`` in place of the ``text``, which never leaves the task that read it."""
    keep = [c for c in rows.columns if c != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(tokens)
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [tok.count(t) for t in pdf[text]]
            yield out

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(count, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")


def plan_budgets(leaves: list[Mapping], total: float | None) -> dict[str, float]:
    """Token budgets of the sources.

    ``leaves`` have source, domain, language, share and capacity (tokens times the repeat cap).
    Without ``total`` it is the largest total of which every source with any capacity can hold its
    share, where the share of sources without capacity has gone to others as below. With a total
    the budgets of full sources are capped and their shortage goes, by share, to siblings under the
    same language and domain while these have room, then to the domain, then to all.
    """
    live = [x for x in leaves if x["share"] > 0]
    if not any(x["capacity"] > 0 for x in live):
        return {x["source"]: 0.0 for x in leaves}
    whole = sum(x["share"] for x in live)
    if total is None:
        scale = 1e9
        passed = plan_budgets([x | {"capacity": float("inf") if x["capacity"] > 0 else 0.0} for x in live], scale)
        total = min(x["capacity"] / (passed[x["source"]] / scale) for x in live if x["capacity"] > 0)
    budget = {x["source"]: 0.0 for x in leaves}

    def pour(group: list[Mapping], amount: float) -> float:
        """Spread ``amount`` over the leaves of a group by share within their room; what is left."""
        while amount > 1e-6:
            room = [x for x in group if x["capacity"] - budget[x["source"]] > 1e-6]
            if not room:
                return amount
            share = sum(x["share"] for x in room)
            part = min(1.0, min((x["capacity"] - budget[x["source"]]) * share / (x["share"] * amount) for x in room))
            for x in room:
                budget[x["source"]] += amount * part * x["share"] / share
            amount *= 1 - part
        return 0.0

    tree: dict = defaultdict(lambda: defaultdict(list))
    for x in live:
        tree[x["domain"]][x["language"]].append(x)
    left_all = 0.0
    for languages in tree.values():
        left_domain = 0.0
        for group in languages.values():
            left = 0.0
            for x in group:
                want = total * x["share"] / whole
                budget[x["source"]] += min(want, x["capacity"])
                left += max(0.0, want - x["capacity"])
            left_domain += pour(group, left)
        left_all += pour([x for g in languages.values() for x in g], left_domain)
    pour(live, left_all)
    return budget


def owned_texts(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, tokens: str) -> DataFrame:
    """One row per distinct non-empty text of the sources in ``targets``: ``text_id, key, source, n_tokens``.

    A text that several sources hold belongs to the one with the smallest name, so that the repeat
    cap holds for texts, not only for documents.
    """
    known = targets.groupBy(source).agg(F.max("target_share").alias("__share"))
    rows = spread(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(source).alias(source)))
    rows = attach(rows.filter(F.col(source).isNotNull() & (F.length("__text") > 0)), known, [source], "inner").drop("__share")
    counts = token_counts(rows.withColumn("text_id", F.sha2("__text", 256)), "__text", tokens)
    best = counts.groupBy("text_id").agg(F.min(F.struct(source, "__key")).alias("own"), F.min("n_tokens").alias("n_tokens"))
    return written(best.select("text_id", F.col("own.__key").alias(key), F.col(f"own.{source}").alias(source), "n_tokens"), "mix-tokens")


def source_tree(docs: DataFrame, source: str, domain: str, language: str) -> DataFrame:
    """``source, domain, language``: the most frequent kind and the most frequent language of each source."""
    rows = docs.filter(F.col(source).isNotNull()).select(source, F.coalesce(F.lower(F.trim(F.col(language))), F.lit("und")).alias("language"), F.coalesce(F.col(domain), F.lit("")).alias("domain"))
    n = rows.groupBy(source, "domain", "language").count()
    lang = n.groupBy(source, "language").agg(F.sum("count").alias("n")).groupBy(source).agg(F.max(F.struct("n", "language")).alias("l"))
    kind = n.groupBy(source, "domain").agg(F.sum("count").alias("n")).groupBy(source).agg(F.max(F.struct("n", "domain")).alias("d"))
    return lang.join(kind, source).select(source, F.col("d.domain").alias("domain"), F.col("l.language").alias("language"))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    domain: str = "doc_kind",
    language: str = "lang",
    seed: int = 7,
    tokens: str = DEFAULT,
    of_available: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): one row per use of a text (``key, source, epoch, n_tokens``), and the shares reached.

    ``total_tokens`` None: the largest total at which every source that has room has its share; ``of_available``
    sets the total as a multiple of the tokens of all texts that may be used. The prefix of the last
    epoch ends before or after the text that would exceed the budget, whichever is nearer, so a
    source misses its budget by at most half a text. ``shares`` has a row for each source of ``targets``.

    Defined cases: documents without a source, of a source without target, or with a null or empty
    text take no part; exact copies of a text count as one text; a target source without texts has
    no room, so its share goes to others, with a total or without; a null or negative repeat cap
    counts as 0, which leaves no room either; repeated targets are one (largest share and cap); empty
    tables give an empty mix.
    """
    spark = docs.sparkSession
    aims = targets.filter(F.col(source).isNotNull()).groupBy(source).agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    owned = owned_texts(docs, targets, key, text, source, tokens)
    held = owned.groupBy(source).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    leaves = aims.join(held, source, "left").join(source_tree(docs, source, domain, language), source, "left").limit(MOST_SOURCES + 1).collect()
    if len(leaves) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if of_available is not None:
        if total_tokens is not None:
            raise ValueError("give total_tokens or of_available, not both")
        total_tokens = int(of_available * sum(r["tokens"] or 0 for r in leaves if r["target_share"] > 0 and r["max_repeats"] > 0))
    budget = plan_budgets(
        [
            {"source": r[source], "domain": r["domain"], "language": r["language"], "share": r["target_share"], "capacity": (r["tokens"] or 0) * r["max_repeats"]}
            for r in leaves
        ],
        total_tokens,
    )
    rows = []
    for r in leaves:
        have = r["tokens"] or 0
        full = min(int(budget[r[source]] // have), r["max_repeats"]) if have else 0
        rest = int(budget[r[source]] - full * have) if full < r["max_repeats"] else 0
        rows.append((r[source], r["target_share"], r["max_repeats"], have, int(budget[r[source]]), full, rest))
    plan = spark.createDataFrame(rows, f"`{source}` string, target_share double, max_repeats int, available_tokens long, budget_tokens long, full_epochs int, rest_tokens long")
    # the last epoch: a seeded order, token sums per bucket of it, and exact sums inside the one bucket where the budget ends
    place = F.xxhash64(F.lit(seed), "text_id")
    few = plan.select(source, "full_epochs", "rest_tokens")  # at most MOST_SOURCES rows
    rows_ = owned.join(F.broadcast(few), source).withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int"))
    sums = rows_.filter("rest_tokens > 0").groupBy(source, "bucket").agg(F.sum("n_tokens").alias("t"))
    upto = W.partitionBy(source).orderBy("bucket")  # at most BUCKETS rows of a source
    ends = sums.withColumn("before", F.sum("t").over(upto) - F.col("t")).select(source, "bucket", "before", (F.col("before") + F.col("t")).alias("after"))
    ranked = rows_.join(ends, [source, "bucket"], "left")
    inside = ranked.filter((F.col("before") < F.col("rest_tokens")) & (F.col("after") > F.col("rest_tokens")))
    run = W.partitionBy(source).orderBy("place", "text_id")
    # the text over which the budget ends goes in if that misses the budget by less
    inside = inside.withColumn("sum", F.col("before") + F.sum("n_tokens").over(run)).filter("2 * sum - n_tokens < 2 * rest_tokens").drop("sum")
    part = ranked.filter(F.col("after") <= F.col("rest_tokens")).unionByName(inside).select(key, source, F.col("full_epochs").alias("epoch"), "n_tokens")
    full = rows_.filter("full_epochs > 0").select(key, source, F.explode(F.sequence(F.lit(0), F.col("full_epochs") - 1)).alias("epoch"), "n_tokens")
    mix = full.unionByName(part)
    got = mix.groupBy(source).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("epoch").alias("last"))
    shares = plan.join(got, source, "left").select(
        source, "target_share", "max_repeats", "available_tokens", "budget_tokens",
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce(F.col("last") + 1, F.lit(0)).alias("epochs"),
    )
    share = F.try_divide("tokens", F.sum("tokens").over(W.partitionBy()))  # one row a source
    return mix, shares.withColumn("share", F.coalesce(share, F.lit(0.0)))
