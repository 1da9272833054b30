"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.operators.nested import Shape, branch_paths, flatten
from verispan.operators.rejects import parse_lines
from verispan.operators.timestamps import normalise_dates
from verispan.session import table


# The branches of database_checks that hold entries.
SHAPES = {
    "records": Shape("accession", frozenset({"accession", "genes", "organism", "comments"})),
    "genes": Shape("symbol", frozenset({"symbol", "synonyms", "xrefs"})),
    "xrefs": Shape("id", frozenset({"db", "id", "quality"}), ("db", "id")),
    "regions": Shape("name", frozenset({"name", "tracks"})),
    "tracks": Shape("track", frozenset({"track", "hits"})),
    "hits": Shape("hit", frozenset({"hit", "p_value", "extra"})),
}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that fail to parse, with the first reason that holds."""
    return parse_lines(table(spark, d, "assay_lines")).filter(F.col("reason").isNotNull()).select("line_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed rows."""
    return parse_lines(table(spark, d, "assay_lines")).filter(F.col("reason").isNull()).select("line_id", "feature", "sample", "value")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Rejects by reason and first broken field."""
    lines = parse_lines(table(spark, d, "assay_lines"))
    return lines.filter(F.col("reason").isNotNull()).groupBy("reason", "broken_field").agg(F.count("*").alias("lines"), F.countDistinct("source_file").alias("files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Publication dates in one unambiguous form."""
    out = normalise_dates(table(spark, d, "date_evidence"), table(spark, d, "feeds"), "evidence_id", "first_publication_date", "date_parts", "provider")
    return out.filter(F.col("normal_form").isNotNull())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Cross-references and hits of nested answers with the names of their parents."""
    return branch_paths(flatten(table(spark, d, "database_checks"), "check_id", shapes=SHAPES), "check_id")


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    """How often each distinct object is used: the saving of storing identical objects once."""
    flat = flatten(table(spark, d, "database_checks"), "check_id", shapes=SHAPES)
    return flat.bridge.groupBy("branch").agg(F.count("*").alias("uses"), F.countDistinct("child_id").alias("objects"))


QUERIES = {f.__name__: f for f in (p3_found, p3_loaded, p3_report, p5_found, p6_found, p6_objects)}
_FIELD = {s: rf'(?:"(?:[^"]|"")*"|[^"{s}]*)' for s in (",", "\t")}
_BARE = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_VALUE = lambda name: f"case when starts_with(f[list_position(hdr, '{name}')], '\"') then replace(substr(f[list_position(hdr, '{name}')], 2, length(f[list_position(hdr, '{name}')]) - 2), '\"\"', '\"') else f[list_position(hdr, '{name}')] end"
_LINES = rf"""with h as (select source_file, case when source_file like '%.tsv' then chr(9) else ',' end as sep, list_transform(string_split(raw_line, case when source_file like '%.tsv' then chr(9) else ',' end), lambda x: trim(x, ' "')) as hdr from assay_lines where line_no = 1),
l as (select line_id, raw_line, sep, hdr from assay_lines join h using (source_file) where line_no <> 1),
g as (select *, case when sep = ',' then regexp_full_match(raw_line, '{_FIELD[","]}(?:,{_FIELD[","]})*') else regexp_full_match(raw_line, '{_FIELD[chr(9)]}(?:\t{_FIELD[chr(9)]})*') end as ok,
  case when sep = ',' then regexp_extract_all(',' || raw_line, ',({_FIELD[","]})', 1) else regexp_extract_all(chr(9) || raw_line, '\t({_FIELD[chr(9)]})', 1) end as f from l),
v as (select line_id, ok, len(f) as n, {_VALUE("feature")} as feature, {_VALUE("sample")} as sample, {_BARE(_VALUE("value"))} as v from g),
r as (select *, case when not ok then 'quoting' when n <> 6 then 'column_count' when {_BARE("feature")} = '' or {_BARE("sample")} = '' or not (v = '' or (regexp_full_match(v, '[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') and coalesce(isfinite(try_cast(v as double)), false))) then 'invalid_value' end as reason from v)"""
SQL = {
    "p3_found": f"{_LINES} select line_id, reason from r where reason is not null",
    "p3_loaded": f"{_LINES} select line_id, feature, sample, try_cast(nullif(v, '') as double) as value from r where reason is null",
}
