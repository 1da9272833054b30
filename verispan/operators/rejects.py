"""Rows that fail to parse: delimited lines split into typed rows and rejects with a reason.

One anchored pattern per schema accepts a whole valid row. A schema is the separator plus the order
of the fields, both of which come from the data (file suffix and header line), so the pattern is a
column built by string expressions. Only lines that the row pattern refuses run through the cheaper
tests: the grammar of the separator (``quoting``), the number of fields (``column_count``) and the
incremental field-prefix patterns, of which the first that does not match names the broken field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.scale import attach

FIELDS = ("feature", "sample", "unit", "group", "technical", "value")
NUMBER = r"[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
BLANK = r"[\s\p{Z}]"
MARK = "\x1f"


def _field(sep: str) -> str:
    """A field of the grammar: wholly quoted with doubled quotes inside, or free of quotes."""
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"(?={sep}|\z)|[^"{sep}]*+)'


def _typed(sep: str, kind: str) -> str:
    """A field of a kind; group 1 is its content if it is quoted (quotes still doubled), group 2 if it is not."""
    blank = rf"[\s\p{{Z}}&&[^{sep}]]*+"
    if kind == "number":  # empty or a number, blanks around it ignored
        return rf'(?:"{BLANK}*+({NUMBER})?+{BLANK}*+"|{blank}({NUMBER})?+{blank})(?={sep}|\z)'
    filled = rf'(?!{blank}(?:{sep}|\z))(?!"{BLANK}*+"(?:{sep}|\z))' if kind == "text" else ""
    return rf'{filled}(?:"([^"]*+(?:""[^"]*+)*+)"(?={sep}|\z)|([^"{sep}]*+))'


def file_schemas(lines: DataFrame, file: str, line_no: str, raw: str, fields: Sequence[str]) -> DataFrame:
    """``file, schema``: separator and field order of each file as one short text; null where line 1 is no permutation of ``fields``."""
    sep = F.when(F.lower(F.col(file)).endswith(".tsv"), F.lit("\t")).otherwise(F.lit(","))
    head = lines.filter(F.col(line_no) == 1).groupBy(file).agg(F.min(F.regexp_replace(raw, "^﻿", "")).alias("__head"))
    names = F.transform(F.split("__head", sep), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))
    known = F.array_sort(names) == F.array(*[F.lit(f) for f in sorted(fields)])
    return head.select(file, F.when(known, F.concat(sep, F.array_join(names, "\x1f"))).alias("schema"))


def schema_patterns(schemas: DataFrame, fields: Sequence[str], text: Sequence[str], number: Sequence[str]) -> DataFrame:
    """Per distinct schema: field order, the row pattern, what it leaves of a row, and the field-prefix patterns.

    There are at most two separators times the permutations of the fields, whatever the number of files.
    """
    kinds = {f: "text" if f in text else "number" if f in number else "any" for f in fields}
    head = schemas.filter("schema is not null").select("schema").distinct()
    head = head.withColumns({"__sep": F.substring("schema", 1, 1), "order": F.split(F.expr("substring(schema, 2)"), "\x1f")})

    def patterns(s: str) -> Column:
        part = F.create_map(*[F.lit(x) for f in fields for x in (f, _typed(s, kinds[f]))])
        return F.transform("order", lambda f: part[f])

    head = head.withColumn("parts", F.when(F.col("__sep") == "\t", patterns("\t")).otherwise(patterns(",")))
    joined = lambda a: F.concat(F.lit(r"\A"), F.call_function("array_join", a, F.col("__sep")))
    # the groups of the wanted fields, each after a mark
    group = lambda f, k: (F.array_position("order", f) * 2 - k).cast("string")
    wanted = [x for f in (*text, *number) for x in (F.lit(MARK + "$"), group(f, 1), F.lit("$"), group(f, 0))]
    groups = F.array(*[F.concat_ws(",", group(f, 1), group(f, 0)) for f in (*text, *number)])
    end = F.concat(F.lit("(?:"), F.col("__sep"), F.lit(r"|\z)"))
    return head.select(
        "schema",
        "order",
        F.concat(joined(F.col("parts")), F.lit(r"\z")).alias("row_pattern"),
        F.concat(*wanted).alias("left"),
        groups.alias("groups"),
        F.transform(F.sequence(F.lit(1), F.lit(len(fields))), lambda k: F.concat(joined(F.slice("parts", 1, k)), end)).alias("prefix_patterns"),
    )


def parse_lines(
    lines: DataFrame,
    key: str = "line_id",
    file: str = "source_file",
    line_no: str = "line_no",
    raw: str = "raw_line",
    fields: Sequence[str] = FIELDS,
    text: Sequence[str] = ("feature", "sample"),
    number: Sequence[str] = ("value",),
) -> DataFrame:
    """Every data line (all but line 1 of a file) as a typed row, or with the reason it failed.

    Result: ``key, file, line_no, raw``, one column per text field and number field, ``reason``
    (null for a valid line), ``broken_field`` (the first field that does not fit, null for a valid
    line or if the line merely has more fields than the schema). Extra columns of ``lines``, whatever their names, are left out.

    Defined cases: a null line fails with ``column_count``; a null ``line_no`` is a data line; a line
    of a file without a usable header fails with ``no_schema`` unless its quoting fails; an empty
    number is null, not a failure; a number beyond the range of a double is ``invalid_value``;
    repeated lines give repeated rows; an empty table gives an empty result.
    """
    width = len(fields)
    base = lines.select(key, file, line_no, raw)
    files = file_schemas(base, file, line_no, raw, fields)
    df = attach(base.filter(F.coalesce(F.col(line_no) != 1, F.lit(True))), files, [file])
    # a bounded map of schemas; lines of one schema follow each other, so that its pattern is compiled once for all
    of_schema = ["order", "row_pattern", "left", "groups", "prefix_patterns"]
    patterns = schema_patterns(files, fields, text, number).select("schema", F.struct(*of_schema).alias("p"))
    patterns = patterns.agg(F.map_from_entries(F.collect_list(F.struct("schema", "p"))).alias("m")).scalar()
    df = df.sortWithinPartitions("schema").withColumn("__p", F.when(F.col("schema").isNotNull(), F.try_element_at(patterns, "schema")))
    df = df.select(*base.columns, *[F.col(f"__p.{c}").alias(f"__{c}") for c in of_schema])
    # one match of the row pattern cuts a valid line into its fields; other lines stay one part
    cut = F.split(F.replace(F.expr(f"regexp_replace(`{raw}`, __row_pattern, __left)"), F.lit('""'), F.lit('"')), MARK, -1)
    one = f"concat(regexp_extract(`{raw}`, __row_pattern, cast(split(g, ',')[0] as int)), regexp_extract(`{raw}`, __row_pattern, cast(split(g, ',')[1] as int)))"
    each = F.expr(f"concat(array(''), transform(__groups, g -> replace({one}, '\"\"', '\"')))")
    cut = F.when(F.col("__row_pattern").isNull() | F.col(raw).isNull(), F.lit(None)).when(F.col(raw).contains(MARK), F.when(F.expr(f"`{raw}` rlike __row_pattern"), each)).otherwise(cut)
    # generators are fences: a later filter must neither match a line again nor blow the generated code up
    df = df.select("*", F.explode(F.array(cut)).alias("__cut"))
    cells = {f: F.get("__cut", F.lit(i + 1)) for i, f in enumerate((*text, *number))}
    df = df.withColumns({"__fits": F.coalesce(F.size("__cut") == len(cells) + 1, F.lit(False)), **{f"__n_{f}": F.nullif(cells[f], F.lit("")).try_cast("double") for f in number}})
    good = F.col("__fits")
    for f in number:
        good = good & ((cells[f] == "") | F.coalesce(F.abs(f"__n_{f}") < float("inf"), F.lit(False)))

    # lines of files without any header line have a separator as well
    tabs = F.lower(F.col(file)).endswith(".tsv")

    def by_sep(make) -> Column:
        return F.when(tabs, make("\t")).otherwise(make(","))

    grammar = by_sep(lambda s: F.col(raw).rlike(rf"\A{_field(s)}(?:{s}{_field(s)})*+\z"))
    count = by_sep(lambda s: F.regexp_count(F.concat(F.lit(s), F.col(raw)), F.lit(s + _field(s))))
    reason = (
        F.when(good, F.lit(None).cast("string"))
        .when(F.col(raw).isNull(), "column_count")
        .when(~grammar, "quoting")
        .when(F.col("__row_pattern").isNull(), "no_schema")
        .when(count != width, "column_count")
        .otherwise("invalid_value")
    )
    df = df.select("*", F.explode(F.array(reason)).alias("reason"))
    broken = F.expr(f"element_at(__order, cast(nullif(coalesce(array_position(transform(__prefix_patterns, p -> `{raw}` rlike p), false), 0), 0) as int))")
    over = F.lit(None).cast("string")
    for f in reversed(number):
        over = F.when((cells[f] != "") & ~F.coalesce(F.abs(f"__n_{f}") < float("inf"), F.lit(False)), f).otherwise(over)
    valid = F.col("reason").isNull()
    where = F.when(valid, F.lit(None).cast("string")).when(F.col("__fits"), over).otherwise(broken)
    values = [F.when(valid, cells[f]).alias(f) for f in text] + [F.when(valid, F.col(f"__n_{f}")).alias(f) for f in number]
    return df.select(key, file, line_no, raw, *values, "reason", where.alias("broken_field"))
