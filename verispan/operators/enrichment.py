"""Gene-set enrichment over a measured universe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.operators.contrasts import bh_adjust
from verispan.scale import written

EXACT = 16
"""Log factorials below it are literals; from it on the series is exact to the last digits of a double."""

PIECE = 4096
"""So many terms of a tail are summed where they are made, so no array grows with a set."""


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: a literal for small ones, else Stirling's series."""
    x = F.greatest(n, F.lit(EXACT)).cast("double")
    r = F.lit(1.0) / (x * x)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * F.lit(1 / 1188))))) / x
    small = F.element_at(F.array(*[F.lit(math.log(math.factorial(k))) for k in range(EXACT)]), F.least(n + 1, F.lit(EXACT)).cast("int"))
    return F.when(n < EXACT, small).otherwise(x * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + F.log(x) / 2 + series)


def enrich(selected: DataFrame, universe: DataFrame, sets: DataFrame) -> DataFrame:
    """Hypergeometric P(X >= overlap) per set; ``selected`` and ``universe`` have ``gene``, ``sets`` has ``term, gene``.

    Only measured genes count; there may be any number of them. A tail is a row per ``PIECE`` of its
    terms, each a closed expression of the sizes, and sets of the same size and overlap share it.
    """
    uni = universe.select("gene").distinct()
    sel = selected.select("gene").distinct().join(uni, "gene", "left_semi")
    members = sets.select("term", "gene").distinct().join(uni, "gene", "left_semi")
    hits = members.join(sel.withColumn("hit", F.lit(1)), "gene", "left")
    rows = hits.groupBy("term").agg(F.count("*").alias("term_n"), F.count("hit").alias("overlap"))
    sizes = uni.agg(F.count("*").alias("universe_n")).crossJoin(F.broadcast(sel.agg(F.count("*").alias("selected_n"))))
    rows = written(rows.crossJoin(F.broadcast(sizes)), "set-sizes")  # one row of sizes; read twice below
    c = F.col
    by = ["term_n", "overlap", "selected_n", "universe_n"]
    outside = c("universe_n") - c("term_n")
    fixed = log_factorial(c("term_n")) + log_factorial(outside) + log_factorial(c("selected_n")) + log_factorial(c("universe_n") - c("selected_n")) - log_factorial(c("universe_n"))
    tails = rows.filter("overlap > 0").select(*by).distinct()
    tails = tails.select(*by, fixed.alias("fixed"), F.explode(F.sequence(F.greatest(c("overlap"), c("term_n") + c("selected_n") - c("universe_n")), F.least("term_n", "selected_n"), F.lit(PIECE).cast("long"))).alias("start"))
    tails = tails.withColumn("x", F.explode(F.sequence("start", F.least(c("start") + (PIECE - 1), c("term_n"), c("selected_n")))))
    rest = c("selected_n") - c("x")
    varying = log_factorial(c("x")) + log_factorial(c("term_n") - c("x")) + log_factorial(rest) + log_factorial(outside - rest)
    terms = tails.select(*by, "start", F.exp(c("fixed") - varying).alias("v"))
    p = terms.groupBy(*by, "start").agg(F.sum("v").alias("v")).groupBy(*by).agg(F.least(F.lit(1.0), F.sum("v")).alias("__p"))
    out = rows.join(p, by, "left").withColumn("p_value", F.coalesce("__p", F.lit(1.0))).drop("__p")
    return bh_adjust(out, [], "p_value")


def outside_universe(selected: DataFrame, universe: DataFrame) -> DataFrame:
    """The distinct selected genes that were not measured."""
    return selected.select("gene").distinct().join(universe.select("gene").distinct(), "gene", "left_anti")
