"""Deeply nested semi-structured records as related flat tables.

Objects get Merkle identities: a body is parsed once per distinct text, every object and list entry
is reduced bottom-up to canonical scalars plus the identities of its children, and the digest of
that is its identity. Identical objects are stored once in ``objects``; every occurrence is kept as
a row of ``bridge`` (parent identity, branch, ordinal, key, child identity) and of ``roots``
(source row, root identity).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.scale import attach, spread, written

NODE = "body_id binary, copies long, node_id string, content string"
CONTENT = "struct<a:map<string,string>,e:array<struct<branch:string,ordinal:int,key:string,child_id:string>>>"


ENCODE = json.JSONEncoder(separators=(",", ":"), check_circular=False).encode


class Shape(NamedTuple):
    """What the entries of a branch look like, so that a map by key can be told from one object."""

    key: str  # the field that a map by key leaves out
    fields: frozenset[str]  # the fields that an entry may have
    halves: tuple[str, str] | None = None  # the fields that a text ``a:b`` abbreviates


Shapes = Mapping[str, Shape]


def scalar(value) -> str | None:
    """The one text form of a JSON scalar: numbers and strings of the same digits are the same."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return repr(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)


def _opened(value):
    """A branch stored as a JSON text is the branch itself."""
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in ("{", "["):
            try:
                return json.loads(text)
            except ValueError:
                return value
    return value


def entries(branch: str, value, shapes: Shapes) -> list[tuple[str | None, object]]:
    """The entries of a branch in order, whatever shape it is stored in: list, one object, map by key, or scalar."""
    value = _opened(value)
    if value is None:
        return []
    if isinstance(value, list):
        return [(None, _opened(x)) for x in value if x is not None]
    if isinstance(value, dict) and branch in shapes:
        name, own, _ = shapes[branch]
        if not (own & value.keys()) and value and all(isinstance(x, dict) or x is None for x in value.values()):
            return [(k, {name: k, **x}) for k, x in value.items() if x is not None]
    return [(None, value)]


def shred(body: str, shapes: Shapes) -> list[tuple[str, str]]:
    """The distinct objects of one JSON text as (identity, canonical content), children first, the root last.

    Arrays and objects become children under their field name; scalars become attributes. A scalar
    entry of a list becomes an object with the attribute ``value``; where the shape of a branch has
    halves, a text ``a:b`` becomes the object it abbreviates.
    """
    nodes: dict[str, str] = {}

    def identity(attributes: dict, edges: list) -> str:
        text = ENCODE({"a": attributes, "e": edges})
        node = hashlib.sha256(text.encode()).hexdigest()[:32]
        nodes.setdefault(node, text)
        return node

    def build(branch: str, value) -> str:
        if not isinstance(value, dict):
            halves = shapes[branch].halves if branch in shapes else None
            if isinstance(value, list):
                value = {"items": value}
            elif halves and isinstance(value, str) and ":" in value:
                value = dict(zip(halves, value.split(":", 1)))
            else:
                return identity({"value": scalar(value)}, [])
        attributes, edges = {}, []
        for name in sorted(value):
            x = _opened(value[name])
            if isinstance(x, (dict, list)) or (x is not None and name in shapes):
                edges += [{"branch": name, "ordinal": i, "key": k, "child_id": build(name, y)} for i, (k, y) in enumerate(entries(name, x, shapes))]
            else:
                attributes[name] = scalar(x)
        return identity(attributes, edges)

    try:
        value = json.loads(body)
    except (ValueError, RecursionError):
        return []
    if not isinstance(value, dict):
        value = {"items": value}
    try:
        root = build("", value)
    except RecursionError:
        return []
    last = nodes.pop(root)
    return [*nodes.items(), (root, last)]


def _shredder(shapes: Shapes):
    """A map over batches (body_id, body, copies): one row per object, and one per body that names its root (null if it is broken).

    An object that a task has written before is not written again; the memory for that is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            ids, copies, nodes, contents = [], [], [], []
            for body_id, body, n in zip(*(batch.column(c).to_pylist() for c in ("body_id", "body", "copies"))):
                found = shred(body, shapes)
                for node, content in found:
                    if node not in seen:
                        ids.append(None), copies.append(None), nodes.append(node), contents.append(content)
                seen.update(node for node, _ in found)
                ids.append(body_id), copies.append(n), nodes.append(found[-1][0] if found else None), contents.append(None)
                if len(seen) > 1_000_000:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(copies, pa.int64()), pa.array(nodes, pa.string()), pa.array(contents, pa.string())], names=["body_id", "copies", "node_id", "content"])

    return run


class Flat(NamedTuple):
    """The flat tables of nested bodies."""

    roots: DataFrame  # source key, root_id (null where the body is null or no JSON)
    objects: DataFrame  # node_id, attributes
    bridge: DataFrame  # parent_id, branch, ordinal, key, child_id


def flatten(df: DataFrame, key: str, body: str = "body", shapes: Shapes | None = None) -> Flat:
    """Bodies as ``roots``, ``objects`` and ``bridge``; ``shapes`` describes branches that may be stored in several ways.

    Defined cases: a null, empty or broken body, or one nested too deeply to parse, has a root row
    with a null ``root_id`` and no objects; identical bodies and identical objects are stored once;
    nulls among list entries are skipped but keep no ordinal; an empty table gives empty tables.
    Only ``key`` and ``body`` are read.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(body).alias("body")).withColumn("body_id", F.unhex(F.substring(F.sha2("body", 256), 1, 32)))
    distinct = rows.filter(F.col("body").isNotNull()).groupBy("body_id").agg(F.min("body").alias("body"), F.count("*").alias("copies"))
    nodes = written(spread(distinct).mapInArrow(_shredder(shapes or {}), NODE), "nested-nodes")
    objects = nodes.filter("content is not null").groupBy("node_id").agg(F.any_value("content").alias("content"))
    objects = objects.select("node_id", F.from_json("content", CONTENT).alias("c")).select("node_id", F.col("c.a").alias("attributes"), F.col("c.e").alias("edges"))
    objects = written(objects, "nested-objects")
    root_of = nodes.filter("body_id is not null").select("body_id", F.col("node_id").alias("root_id"), "copies")
    roots = attach(rows.filter("body_id is not null").select("__key", "body_id"), root_of, ["body_id"], weight="copies").select("__key", "root_id")
    roots = roots.unionByName(rows.filter("body_id is null").select("__key", F.lit(None).cast("string").alias("root_id"))).withColumnRenamed("__key", key)
    bridge = objects.select(F.col("node_id").alias("parent_id"), F.inline("edges"))
    return Flat(roots, objects.select("node_id", "attributes"), bridge)


def gathered(flat: Flat, branches: list[str], kids: DataFrame, entry: Column, name: str) -> DataFrame:
    """``node_id`` and one array per branch of the ``entry`` of each child: a level of the tree, resolved once per distinct parent.

    ``kids`` has unique ``node_id``; a child may be shared by any number of parents. The arrays are
    no longer than the body that holds the parent.
    """
    edges = flat.bridge.filter(F.col("branch").isin(branches)).select(F.col("parent_id").alias("__p"), F.col("branch").alias("__b"), F.col("child_id").alias("node_id"))
    rows = attach(edges, kids, ["node_id"]).select("__p", "__b", entry.alias("__e"))
    out = rows.groupBy(F.col("__p").alias("node_id")).agg(*[F.collect_list(F.when(F.col("__b") == b, F.col("__e"))).alias(f"{name}_{b}") for b in branches])
    return written(out, "nested-level")  # the next level reads it twice


def branch_paths(flat: Flat, key: str) -> DataFrame:
    """One row per cross-reference and per hit of every source row, each with the names of its parents.

    Names are gathered from the leaves upwards over the bridge, so an object that many bodies share
    is resolved once; the source rows take the paths of their root last.
    """
    a = lambda n: F.col("attributes")[n]
    own = flat.objects
    leaf = own.select("node_id", F.concat_ws(":", a("db"), a("id")).alias("ref"), a("hit").alias("hit"), a("path").alias("path"))
    low = gathered(flat, ["xrefs", "hits", "request"], leaf, F.struct("ref", "hit", "path"), "of")
    mid = own.join(low, "node_id").select("node_id", F.struct(a("symbol").alias("gene"), a("track").alias("track"), F.col("of_xrefs.ref").alias("refs"), F.col("of_hits.hit").alias("hits")).alias("m"))
    mids = gathered(flat, ["genes", "tracks"], mid, F.col("m"), "of")
    top = own.join(mids, "node_id").select("node_id", a("accession").alias("accession"), a("name").alias("name"), "of_genes", "of_tracks")
    tops = gathered(flat, ["records", "regions"], top, F.struct("accession", "name", "of_genes", "of_tracks"), "of")
    details = gathered(flat, ["details"], tops, F.col("of_regions"), "of").select("node_id", F.flatten("of_details").alias("regions"))
    answer = tops.select("node_id", F.col("of_records").alias("records")).join(details, "node_id", "full_outer")
    answers = gathered(flat, ["response"], answer, F.struct("records", "regions"), "of")
    paths = low.select("node_id", F.array_max(F.col("of_request.path")).alias("request_path")).join(answers, "node_id", "right")
    paths = written(paths, "nested-paths")
    roots = attach(flat.roots.filter(F.col("root_id").isNotNull()), paths.withColumnRenamed("node_id", "root_id"), ["root_id"], "inner")
    whole = roots.select(key, F.coalesce("request_path", F.lit("")).alias("request_path"), F.explode("of_response").alias("r"))
    record = whole.select(key, "request_path", F.lit("records").alias("branch"), F.explode("r.records").alias("t")).select(key, "request_path", "branch", F.col("t.accession").alias("parent_key"), F.explode("t.of_genes").alias("m"))
    region = whole.select(key, "request_path", F.lit("details").alias("branch"), F.explode("r.regions").alias("t")).select(key, "request_path", "branch", F.col("t.name").alias("parent_key"), F.explode("t.of_tracks").alias("m"))
    record = record.select(key, "request_path", "branch", "parent_key", F.col("m.gene").alias("mid_key"), F.explode("m.refs").alias("child_key"))
    region = region.select(key, "request_path", "branch", "parent_key", F.col("m.track").alias("mid_key"), F.explode("m.hits").alias("child_key"))
    return record.unionByName(region)
