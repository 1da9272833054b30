"""The best representative of each group of duplicate records, chosen field by field.

Records of a group are compared on three axes: completeness (the set of fields with a usable value),
trust, and recency (the later one; at the same time the smaller key). A record dominates another if
it has every usable field of the other, is trusted no less and is the more recent. Layer 1 holds the
undominated records, each further layer what only the layers before dominate. A field takes its
value from the first layer that has it usable, by (trust, recency) within the layer.

The winner of a field by (trust, recency, key) is never dominated: a dominating record would have
the field, too, and come before it. So layer 1 of whole records holds all winners and the later
layers are asked only for fields that no record of layer 1 has.

A group may hold a third of all rows, so rows are first reduced to cells: of all records of a group
with the same usable fields and the same trust the most recent dominates all others. A group has at
most (2 ** fields) * (distinct trust ranks) cells, and the skyline works on these.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.scale import attach, written

# Texts that stand for a missing value, and names that stand for further authors.
STAND_INS = (
    "na", "n a", "none", "null", "nil", "nan", "unknown", "not available", "not applicable", "not known", "not specified", "unspecified",
    "undefined", "missing", "pending", "tbd", "tba", "to be determined", "to be announced", "in press", "forthcoming", "no journal", "untitled", "anonymous",
)
FURTHER = r"(?i)(^|[\s,;])(et\.?\s*al(ii|ia|\.)?|(and|&)?\s*(others|colleagues|coworkers|co-workers)|further authors)[\s.]*$|^[.…\s]+$"
DOI = r"(?<![0-9.])10\.[0-9]{4,9}(?:\.[0-9]+)*(?:/|%2[fF])\S*[\p{L}\p{N}]"


def stated(text: Column) -> Column:
    """Whether a text is present and no stand-in for a missing value."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce((words != "") & ~words.isin(*STAND_INS), F.lit(False))


def usable_fields(journal: str = "journal", year: str = "year", authors: str = "authors", doi: str = "doi", first_year: int = 1950, last_year: int = 2026) -> dict[str, Column]:
    """Field name -> whether its value is usable, never null."""
    people = F.col(authors)
    named = F.forall(people, lambda a: a.isNotNull() & stated(a["family"]) & ~F.coalesce(a["family"].rlike(FURTHER), F.lit(False)))
    return {
        "journal": stated(F.col(journal)),
        "year": F.coalesce(F.col(year).between(first_year, last_year), F.lit(False)),
        "authors": F.coalesce((F.size(people) > 0) & named, F.lit(False)),
        "doi": F.coalesce(F.col(doi).rlike(DOI), F.lit(False)),
    }


def group_cells(df: DataFrame, group: Column, fields: Mapping[str, Column], trust: str, recency: str, key: str) -> DataFrame:
    """One row per group: its number of records and its cells (mask, trust, at, key)."""
    mask = F.lit(0)
    for i, usable in enumerate(fields.values()):
        mask = mask + F.when(usable, 1 << i).otherwise(0)
    rows = df.select(group.alias("group_id"), mask.alias("mask"), F.col(trust).alias("trust"), F.col(recency).alias("at"), F.col(key).alias("key"))
    rows = rows.filter(F.col("group_id").isNotNull())
    # the latest record of a cell, of equal ones that with the smallest key; nulls count as oldest and least trusted
    rows = rows.withColumns({"trust": F.coalesce(F.col("trust").cast("long"), F.lit(2**62)), "at": F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(2**62)))})
    cells = rows.groupBy("group_id", "mask", "trust").agg(F.min(F.struct((-F.col("at")).alias("age"), "key")).alias("best"), F.count("*").alias("n"))
    return cells.groupBy("group_id").agg(F.sum("n").alias("records"), F.collect_list(F.struct("mask", "trust", "best.age", "best.key")).alias("cells"))


def dominates(o: Column, c: Column) -> Column:
    """Whether cell ``o`` has every usable field of ``c``, is trusted no less and is the more recent."""
    later = (o["age"] < c["age"]) | ((o["age"] == c["age"]) & (o["key"] < c["key"]))
    return (o["mask"].bitwiseAND(c["mask"]) == c["mask"]) & (o["trust"] <= c["trust"]) & later


def layered_cells(groups: DataFrame) -> DataFrame:
    """``group_cells`` with ``cells`` sorted by recency, each with its dominance ``layer``."""
    by_age = F.array_sort(F.transform("cells", lambda c: F.struct(c["age"], c["key"], c["trust"], c["mask"])))
    key = groups.schema["cells"].dataType.elementType["key"].dataType.simpleString()
    none = F.array().cast(f"array<struct<age:bigint,key:{key},trust:bigint,mask:int,layer:int>>")

    def add(done: Column, c: Column) -> Column:
        above = F.array_max(F.transform(F.filter(done, lambda o: dominates(o, c)), lambda o: o["layer"]))
        return F.concat(done, F.array(F.struct(c["age"].alias("age"), c["key"].alias("key"), c["trust"].alias("trust"), c["mask"].alias("mask"), (F.coalesce(above, F.lit(0)) + 1).alias("layer"))))

    return groups.withColumn("cells", F.aggregate(by_age, none, add))


def surviving_fields(df: DataFrame, group: Column, fields: Mapping[str, Column], trust: str, recency: str, key: str, least: int = 2) -> DataFrame:
    """``group_id, field_name, key``: the record whose value survives, for groups of at least ``least`` records.

    Defined cases: a null group id is no group; a field that no record of the group has in a usable
    form gives no row; equal trust and recency are resolved by the smallest key; repeated rows count
    as records; an empty table gives an empty result.
    """
    groups = layered_cells(group_cells(df, group, fields, trust, recency, key).filter(F.col("records") >= least))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(1 << i).alias("bit")) for i, n in enumerate(fields)]))
    each = groups.select("group_id", "cells", names.alias("f"))
    usable = F.filter("cells", lambda c: c["mask"].bitwiseAND(F.col("f.bit")) != 0)
    pick = F.array_min(F.transform(usable, lambda c: F.struct(c["layer"].alias("layer"), c["trust"].alias("trust"), c["age"].alias("age"), c["key"].alias("key"))))
    return each.select("group_id", "f.field_name", pick.alias("p")).filter("p is not null").select("group_id", "field_name", F.col("p.key").alias("key"))


def covers(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether (mask, trust) ``a`` has every field of ``b`` and is trusted no less."""
    return a[0] & b[0] == b[0] and a[1] <= b[1]


def chain_layers(masks: Sequence[int], trusts: Sequence[int], top: dict[tuple[int, int], int]) -> list[int]:
    """The layers of points sorted by (age, lack, trust); ``top`` holds the deepest layer so far of each (mask, trust).

    A point can only be dominated by an earlier one whose (mask, trust) covers its own.
    """
    out = []
    for at in zip(masks, trusts):
        top[at] = 1 + max((v for x, v in top.items() if covers(x, at)), default=0)
        out.append(top[at])
    return out


def chain_lengths(masks: Sequence[int], trusts: Sequence[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The distinct (mask, trust) of sorted points, and the longest chain that starts at one and ends at another (0: none)."""
    pairs = sorted(set(zip(masks, trusts)))
    place = {x: i for i, x in enumerate(pairs)}
    above = [np.array([i for i, o in enumerate(pairs) if covers(o, x)]) for x in pairs]
    longest = np.zeros((len(pairs), len(pairs)), dtype=np.int64)  # row: end, column: start
    for x in zip(masks, trusts):
        i = place[x]
        before = longest[above[i]].max(axis=0)
        longest[i] = np.where(before > 0, before + 1, 0)
        longest[i, i] = max(longest[i, i], 1)
    return pairs, longest


def pass_on(top: dict[tuple[int, int], int], pairs: list[tuple[int, int]], longest: np.ndarray) -> dict[tuple[int, int], int]:
    """``top`` after the points that ``chain_lengths`` summed up."""
    into = np.array([max((v for o, v in top.items() if covers(o, x)), default=0) for x in pairs])
    reached = np.where(longest > 0, longest + into, 0).max(axis=1)
    return top | {x: max(int(n), top.get(x, 0)) for x, n in zip(pairs, reached)}


def candidate_rows(df: DataFrame, group: Column, fields: Mapping[str, Column], trust: str, recency: str, *more: Column) -> DataFrame:
    """``group_id, mask, trust, age`` of each record of a group; nulls count as oldest and least trusted."""
    mask = F.lit(0)
    for i, usable in enumerate(fields.values()):
        mask = mask + F.when(usable, 1 << i).otherwise(0)
    at = F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(-(2**62)))
    rows = df.select(group.alias("group_id"), mask.alias("mask"), F.coalesce(F.col(trust).cast("long"), F.lit(2**62)).alias("trust"), (-at).alias("age"), *more)
    return rows.filter(F.col("group_id").isNotNull())


def layered_points(df: DataFrame, group: Column, fields: Mapping[str, Column], trust: str, recency: str, least: int = 2) -> DataFrame:
    """``group_id, records, mask, trust, age, n, layer``: all records of groups of at least ``least``, exact ties as one row with their number ``n``.

    The points are range-partitioned by group and age, so a group of any size is spread over parts
    of consecutive ages. Only groups at the edges of a part can continue in another one: for these
    each part sums up the chains through it, the driver passes the deepest layers on from part to
    part (at most two groups a part), and every part then layers its own points. Cost grows with
    the points times the distinct (mask, trust) of their group.
    """
    points = candidate_rows(df, group, fields, trust, recency).groupBy("group_id", "mask", "trust", "age").agg(F.count("*").alias("n"))
    parts = written(points.repartitionByRange("group_id", "age").withColumns({"part": F.spark_partition_id(), "lack": -F.bit_count("mask")}), "layer-points")
    kind = dict(parts.dtypes)["group_id"]
    order = ["age", "lack", "trust"]
    ends = sorted(tuple(r) for r in parts.groupBy("part").agg(F.min("group_id"), F.max("group_id")).collect())
    cut = sorted({a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]})

    def sum_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pairs, longest = chain_lengths(pdf["mask"].tolist(), pdf["trust"].tolist())
        return pd.DataFrame({"group_id": [key[0]], "part": [key[1]], "n": [int(pdf["n"].sum())], "masks": [[x[0] for x in pairs]], "trusts": [[x[1] for x in pairs]], "longest": [longest.ravel().tolist()]})

    start: dict[tuple, dict[tuple[int, int], int]] = {}
    size: dict = {}
    if cut:
        edge = F.broadcast(parts.sparkSession.createDataFrame([(x,) for x in cut], f"group_id {kind}"))
        sums = parts.join(edge, "group_id", "left_semi").groupBy("group_id", "part").applyInPandas(sum_up, f"group_id {kind}, part int, n long, masks array<int>, trusts array<long>, longest array<long>")
        top: dict = defaultdict(dict)
        for r in sorted(sums.collect(), key=lambda r: r["part"]):
            g, pairs = r["group_id"], list(zip(r["masks"], r["trusts"]))
            start[g, r["part"]] = top[g]
            size[g] = size.get(g, 0) + r["n"]
            top[g] = pass_on(top[g], pairs, np.array(r["longest"]).reshape(len(pairs), len(pairs)))

    def layer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_id", *order]).reset_index(drop=True)
        pdf["records"] = pdf.groupby("group_id")["n"].transform("sum")
        if size:
            pdf["records"] = pdf["group_id"].map(size).fillna(pdf["records"]).astype("int64")
        pdf = pdf[pdf["records"] >= least].reset_index(drop=True)
        groups, masks, trusts, layers = pdf["group_id"].tolist(), pdf["mask"].tolist(), pdf["trust"].tolist(), []
        edges = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]]
        for a, b in zip(edges, [*edges[1:], len(groups)]):
            layers += chain_layers(masks[a:b], trusts[a:b], dict(start.get((groups[a], key[0]), {})))
        pdf["layer"] = pd.Series(layers, dtype="int32")
        return pdf[["group_id", "records", "mask", "trust", "age", "n", "layer"]]

    return parts.groupBy("part").applyInPandas(layer, f"group_id {kind}, records long, mask int, trust long, age long, n long, layer int")


def dominance_layers(df: DataFrame, group: Column, fields: Mapping[str, Column], trust: str, recency: str, key: str, least: int = 2) -> DataFrame:
    """``group_id, records, key, layer``: each record with its dominance layer over (set of usable fields, recency, trust).

    A record of layer 1 is dominated by none; the layer of another is one more than the deepest
    record that dominates it. Exact ties share a layer; repeated rows count as records; a null group
    id is no group; an empty table gives an empty result.
    """
    points = layered_points(df, group, fields, trust, recency, least)
    rows = candidate_rows(df, group, fields, trust, recency, F.col(key).alias("key"))
    return attach(rows, points.drop("n"), ["group_id", "mask", "trust", "age"], "inner").select("group_id", "records", "key", "layer")


def with_trust(records: DataFrame, feeds: DataFrame, provider: str = "provider") -> DataFrame:
    """``records`` with ``trust_rank`` of their provider (null if unknown)."""
    ranks = feeds.groupBy(provider).agg(F.min("trust_rank").alias("trust_rank"))
    return attach(records.drop("trust_rank"), ranks, [provider])
