"""Mixed date and time texts in one unambiguous form.

Distinct (text, zone, day order) triples form a dictionary that is parsed once by string and
``timestamp_ntz`` expressions, kept as a table that later runs only extend by unseen triples, and
joined back to the rows. Nothing depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.scale import attach, fenced, new_path, spread, written

# Zone abbreviations with their offset, month names.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "JST": "+09:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\.?"
WEEKDAY = "(?:mon|tues?|wed(?:nes)?|thur?s?|fri|sat(?:ur)?|sun)(?:day)?"

TAIL = (
    r"(?i)^([^:]*[^\s,t:])(?:\s*,\s*|\s+|t)([0-9]{1,2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?|([0-9]{2})([0-9]{2})(?:[.,][0-9]+)?)"
    r"(?:\s*([ap])\.?m\.?(?![a-z]))?\s*(z|[a-z]{2,4}|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}|\[?[a-z]+(?:/[a-z0-9_+-]+)+\]?|\[[a-z]{1,4}\])?$"
)
"""Groups: 1 date, 2 hour, 3 minute, 4 second, 5 and 6 compact minute and second, 7 a or p, 8 zone."""

LAYOUTS = {
    **{f"Y{c}n{c}n": "012" for c in "-/. "}, **{f"Y{c}n": "01" for c in "-/."}, "Y": "0", "C": "compact", "Y-j": "ordinal", "Yj": "ordinal",
    **{f"n{c}n{c}Y": "feed" for c in "-/. "},
    "n M Y": "1m0", "n-M-Y": "1m0", "nM Y": "1m0", "n M, Y": "1m0", "M n Y": "0m1", "M n, Y": "0m1", "Y M n": "ym1", "Y-M-n": "ym1", "M Y": "m0", "M, Y": "m0", "M-Y": "m0", "Y M": "m0", "Y-M": "m0",
}
"""Where year, month and day stand in a date of the given shape: n one or two digits, j three, Y four, C eight, M a month name."""


def zone_names(spark: SparkSession) -> list[str]:
    """The region names that the JVM knows, as a bounded list to guard the zone conversion."""
    names = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()
    return sorted(x for x in names if "/" in x or x == "UTC")


def _int(text: Column) -> Column:
    return F.when(text != "", text).cast("int")


def _month(text: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(text, 1, 3)).cast("int")


def _last_day(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _stamp(y: Column, m: Column, d: Column) -> Column:
    """The normal form of a date as precise as its non-null parts; null if no such date exists."""
    ok_y, ok_m = y.between(1, 9999), m.between(1, 12)
    ok_d = d.between(1, _last_day(y, m))
    yy = F.lpad(y.cast("string"), 4, "0")
    mm, dd = F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")
    return (
        F.when(y.isNull() | ~ok_y, None)
        .when(m.isNull(), yy)
        .when(~ok_m, None)
        .when(d.isNull(), F.concat_ws("-", yy, mm))
        .when(ok_d, F.concat_ws("-", yy, mm, dd))
    )


def _dated(df: DataFrame, text: str, day_first: str, out: str) -> DataFrame:
    """``df`` with the normal form of the date ``text`` (no time of day) in the column ``out``."""
    cols = df.columns
    name = F.lower(F.regexp_extract(text, rf"(?i)(?<![a-z])({MONTH})(?![a-z])", 1))
    df = df.withColumn("__month", F.when(name != "", _month(name)))
    shape = F.regexp_replace(text, rf"(?i)(?<![a-z]){MONTH}(?![a-z])", "M")
    shape = F.regexp_replace(shape, r"(?i)(?<![0-9])([0-9]{1,2})(?:st|nd|rd|th)(?![a-z])\.?|(?<![0-9])([0-9]{1,2})\.(?= M)", "$1$2")
    for n, mark in (("8", "C"), ("7", "Yj"), ("4", "Y"), ("3", "j"), ("1,2", "n")):
        shape = F.regexp_replace(shape, rf"(?<![0-9])[0-9]{{{n}}}(?![0-9])", mark)
    layouts = F.create_map(*[F.lit(x) for kv in LAYOUTS.items() for x in kv])
    df = fenced(df, {"__shape": shape, "__num": F.transform(F.regexp_extract_all(F.col(text), F.lit("[0-9]{1,8}"), F.lit(0)), lambda x: x.cast("int"))})
    df = df.withColumn("__layout", F.try_element_at(layouts, F.col("__shape")))
    n = lambda i: F.get("__num", F.lit(i))
    is_ = lambda *x: F.col("__layout").isin(*x)
    none = F.lit(None).cast("int")
    eight = n(0)
    seven = F.when(F.col("__shape") == "Yj", n(0))
    year = (
        F.when(is_("compact"), (eight / 10000).cast("int"))
        .when(seven.isNotNull(), (seven / 1000).cast("int"))
        .when(is_("feed"), n(2))
        .when(is_("1m0", "0m1"), n(1))
        .otherwise(n(0))
    )
    month = (
        F.when(is_("compact"), (eight / 100).cast("int") % 100)
        .when(is_("feed"), F.when(F.col(day_first), n(1)).when(~F.col(day_first), n(0)).otherwise(0))
        .when(is_("1m0", "0m1", "ym1", "m0"), F.col("__month"))
        .when(is_("012", "01"), n(1))
        .otherwise(none)
    )
    day = (
        F.when(is_("compact"), eight % 100)
        .when(is_("feed"), F.when(F.col(day_first), n(0)).otherwise(n(1)))
        .when(is_("1m0", "0m1"), n(0))
        .when(is_("ym1"), n(1))
        .when(is_("012"), n(2))
        .otherwise(none)
    )
    df = fenced(df, {"__y": year, "__mo": month, "__d": day, "__j": F.when(seven.isNotNull(), seven % 1000).otherwise(n(1))})
    first = F.when(F.col("__y").between(1, 9999), F.make_date(F.when(F.col("__y").between(1, 9999), F.col("__y")), F.lit(1), F.lit(1)))
    at = F.date_add(first, F.when(F.col("__j").between(1, 366), F.col("__j")) - 1)
    form = (
        F.when(F.col("__layout").isNull(), F.lit(None).cast("string"))
        .when(F.col("__layout") == "ordinal", F.when(F.year(at) == F.col("__y"), at.cast("string")))
        .otherwise(_stamp(F.col("__y"), F.col("__mo"), F.col("__d")))
    )
    return fenced(df.select(*cols, form.alias(out)), {out: F.col(out)})


def squeezed(text: Column) -> Column:
    """``text`` with single blanks and none at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s\p{Z}]+", " "), r"^[ ﻿]+| +$", "")


def parse_texts(distinct: DataFrame, text: str, zone: str, day_first: str) -> DataFrame:
    """``distinct`` with ``normal_form``: a UTC instant, a date as precise as given, or null.

    With a time of day the result is ``yyyy-MM-ddTHH:mm:ssZ``, fractions cut off; an offset, zone
    name or abbreviation in the text wins over the ``zone`` column; a repeated wall time is the
    first one and a skipped one takes the offset before the jump. Ten or thirteen digits are epoch
    seconds or milliseconds. Impossible dates, times, zones and any other text give null.
    """
    zones = ",".join(f"'{z}'" for z in zone_names(distinct.sparkSession))
    known = lambda c: F.expr(f"`{c}` in ({zones})")  # noqa: E731  (a set of some 600 literals)
    cols = distinct.columns
    df = distinct.withColumn("__s", F.regexp_replace(squeezed(F.col(text)), rf"(?i)^{WEEKDAY}\.?,? ", ""))
    # one match cuts the text into its groups
    cut = F.split(F.regexp_replace("__s", TAIL, "\x1f$1\x1f$2\x1f$3\x1f$4\x1f$5\x1f$6\x1f$7\x1f$8"), "\x1f")
    df = fenced(df, {"__g": cut}).withColumn("__timed", F.size("__g") == 9)
    c = lambda i: F.get("__g", F.lit(i))
    df = fenced(df, {"__text": F.when(F.col("__timed"), F.trim(c(1))).otherwise(F.col("__s")), "__hour": _int(c(2)), "__pm": F.lower(c(7)), "__z": F.regexp_replace(c(8), r"[\[\]]", "")})
    df = _dated(df, "__text", day_first, "__day")
    hour = F.when(F.col("__pm") == "", F.col("__hour")).when(F.col("__hour").between(1, 12), F.col("__hour") % 12 + F.when(F.col("__pm") == "p", 12).otherwise(0))
    minute = F.when(c(3) != "", _int(c(3))).otherwise(_int(c(5)))
    second = F.when(c(4) != "", _int(c(4))).when(c(6) != "", _int(c(6))).otherwise(F.lit(0))
    z = F.col("__z")
    abbr = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    tail = F.substring(F.regexp_replace(z, ":", ""), 4, 2)
    offset = F.when(
        (F.substring(z, 2, 2).cast("int") < 18) & (F.when(tail == "", "00").otherwise(tail).cast("int") < 60),
        F.concat(F.substring(z, 1, 3), F.lit(":"), F.when(tail == "", "00").otherwise(tail)),
    )
    at = (
        F.when(z == "", F.when(known(zone), F.col(zone)))
        .when(z.rlike(r"^[+-]"), offset)
        .when(z.contains("/"), F.when(known("__z"), z))
        .otherwise(F.try_element_at(abbr, F.upper(z)))
    )
    df = fenced(df, {"__zone": at, "__h": hour, "__m": minute, "__x": second})
    whole = (F.length("__day") == 10) & F.col("__h").between(0, 23) & F.col("__m").between(0, 59) & F.col("__x").between(0, 59) & F.col("__zone").isNotNull()
    two = lambda n: F.lpad(F.col(n).cast("string"), 2, "0")
    df = fenced(df, {"__wall": F.when(F.col("__timed") & whole, F.concat_ws(" ", "__day", F.concat_ws(":", two("__h"), two("__m"), two("__x")))).cast("timestamp_ntz")})
    instant = F.convert_timezone(F.when(F.col("__wall").isNotNull(), F.col("__zone")), F.lit("UTC"), F.col("__wall"))
    epoch = F.col("__s").rlike(r"^[0-9]{10}$|^[0-9]{13}$")
    seconds = F.when(epoch, F.substring("__s", 1, 10).cast("long"))
    from_epoch = F.timestamp_add("SECOND", (seconds % 86400).cast("int"), F.timestamp_add("DAY", (seconds / 86400).cast("int"), F.lit("1970-01-01").cast("timestamp_ntz")))
    iso = lambda t: F.concat(F.replace(F.substring(t.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))
    form = F.when(epoch, iso(from_epoch)).when(F.col("__timed"), iso(instant)).otherwise(F.col("__day"))
    return df.select(*cols, form.alias("normal_form"))


def parts_text(parts: Column) -> Column:
    """The first element of nested date parts as a key like ``2024,5,``; null where it holds no number."""
    first = F.get(parts, F.lit(0))
    part = lambda i: F.coalesce(F.get(first, F.lit(i)).cast("string"), F.lit(""))
    return F.nullif(F.concat_ws(",", part(0), part(1), part(2)), F.lit(",,"))


def parts_form(text: Column) -> Column:
    """The date of a key of ``parts_text``: null parts are absent, and so is a day without a month."""
    part = lambda i: _int(F.get(F.split(text, ","), F.lit(i)))
    return _stamp(part(0), part(1), F.when(part(1).isNotNull(), part(2)))


KEYS = ["parts", "text", "zone", "day_first"]


def extend_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """``keys`` (``KEYS`` and further columns) with ``normal_form`` from the dictionary at ``path``, which is first extended by those it lacks.

    Each run appends its unseen keys as one table. What a broken run left behind does no harm: the
    dictionary is read grouped by key, so rows appended twice count once.
    """
    spark = keys.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)

    def known() -> DataFrame:
        return spark.read.schema(", ".join(f"{k} {'boolean' if k == 'day_first' else 'string'}" for k in KEYS) + ", normal_form string").parquet(path)

    def same(a: DataFrame, b: DataFrame) -> Column:
        cond = a["text"].eqNullSafe(b["text"])
        for k in KEYS:
            cond = cond & a[k].eqNullSafe(b[k])
        return cond

    unseen = keys.select(*KEYS)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        old = known()
        unseen = unseen.join(old, same(unseen, old), "left_anti")
    form = parse_texts(spread(unseen), "text", "zone", "day_first")
    form.select(*KEYS, F.coalesce(parts_form(F.col("parts")), "normal_form").alias("normal_form")).write.mode("append").parquet(path)
    once = known().groupBy(*KEYS).agg(F.min("normal_form").alias("normal_form"))
    return keys.join(once, same(keys, once)).select(*[keys[c] for c in keys.columns], once["normal_form"])


def normalise_dates(df: DataFrame, feeds: DataFrame, key: str, text: str, parts: str, provider: str, dictionary: str | None = None) -> DataFrame:
    """``key`` and ``normal_form`` (null where no possible date is denoted) for every row of ``df``.

    ``parts`` decides where it gives a date, else ``text``; both are looked up in the dictionary of
    distinct (parts, text, zone, day order). ``dictionary`` is its path, kept between runs; by
    default a new one in the shared folder.

    Defined cases: null, empty and blank texts have no form, nor has any text, however long, that is
    no date once its white space is squeezed; a row of an unknown provider has no zone and no day
    order, so only texts that need neither are read; repeated rows keep their own key; an empty
    table gives an empty result; other columns are ignored.
    """
    path = dictionary or new_path(df.sparkSession, "dates")
    sources = feeds.groupBy(provider).agg(F.min("zone").alias("zone"), F.min("day_first").alias("day_first"))
    rows = df.select(F.col(key).alias("__key"), parts_text(F.col(parts)).alias("parts"), F.nullif(squeezed(F.col(text)), F.lit("")).alias("text"), F.col(provider).alias(provider))
    # few providers, each of which may hold a third of the rows
    rows = attach(rows, sources, [provider])
    needs = F.col("text").isNotNull()  # parts have no zone and no order
    rows = rows.withColumns({"zone": F.when(needs, F.col("zone")), "day_first": F.when(needs, F.col("day_first"))})
    dated = F.col("parts").isNotNull() | needs
    keys = written(rows.filter(dated).groupBy(*KEYS).agg(F.count("*").alias("n")), "date-keys")
    named = written(extend_dictionary(keys, path), "date-forms")
    out = attach(rows.filter(dated), named, KEYS, weight="n").select("__key", "normal_form")
    out = out.unionByName(rows.filter(~dated).select("__key", F.lit(None).cast("string").alias("normal_form")))
    return out.withColumnRenamed("__key", key)
