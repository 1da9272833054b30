"""Text functions on columns: identifiers, titles, authors, journal scopes, secrets, white space."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Journals by scope, and the names of query parameters that hold secrets.
FLAGSHIP = ("nature", "science", "cell")
NATURE = ("nature", "nature communications", "scientific reports")
NATURE_PREFIXES = ("nature ", "npj ", "communications ")
SCIENCE = ("science", "science advances", "science immunology", "science robotics", "science signaling", "science translational medicine")
CELL = (
    "cell", "cancer cell", "cell stem cell", "cell metabolism", "cell host & microbe", "cell reports", "cell reports medicine", "cell systems", "cell chemical biology", "molecular cell", "developmental cell",
    "immunity", "neuron", "current biology", "structure", "joule", "chem", "matter", "one earth", "iscience", "med", "device", "cell genomics",
)
CELL_PREFIXES = ("trends in ",)
SECRETS = ("api_key", "apikey", "key", "token", "access_token", "email", "mailto", "password", "secret", "authorization")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character entities resolved; null stays null."""
    return text.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def normalize_doi(text: Column) -> Column:
    """The bare lower-case DOI, or null if the text is none; parentheses are kept."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    ends = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(decoded, text), ends, ""), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi[\s\p{Z}]*:)[\s\p{Z}]*", "")
    bare = F.lower(F.regexp_replace(bare, r"[.,;]+$", ""))
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/[^\s\p{Z}]+$"), bare)


def normalize_title(text: Column) -> Column:
    """Words of a title without markup, entities, punctuation and case."""
    return F.trim(F.regexp_replace(F.lower(unescape(F.regexp_replace(text, "<[^>]+>", " "))), r"[^\p{L}\p{N}_]+", " "))


def author_parts(display: Column) -> Column:
    """``family, given, unparsed`` of a display name: a comma splits, other names stay as they are."""
    comma = display.contains(",")
    return F.struct(
        F.when(comma, F.trim(F.split(display, ",", 2)[0])).alias("family"), F.when(comma, F.trim(F.split(display, ",", 2)[1])).alias("given"), (~comma).alias("unparsed")
    )


def in_scope(journal: Column, scope: str) -> Column:
    """Whether a journal belongs to ``all``, ``flagship``, ``nature`` or ``cns``."""
    j = F.lower(squeeze(F.coalesce(journal, F.lit(""))))
    starts = lambda prefixes: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: j.startswith(p))
    nature = j.isin(*NATURE) | starts(NATURE_PREFIXES)
    if scope == "all":
        return F.lit(True)
    if scope == "flagship":
        return j.isin(*FLAGSHIP)
    if scope == "nature":
        return nature
    if scope == "cns":
        return nature | j.isin(*SCIENCE) | j.isin(*CELL) | starts(CELL_PREFIXES)
    raise ValueError(f"unknown scope {scope}")


def redact_url(url: Column) -> Column:
    """The values of secret query parameters replaced."""
    return F.regexp_replace(url, rf"(?i)([?&](?:{'|'.join(SECRETS)})=)[^&#]*", "$1REDACTED")


def paragraphs(text: Column) -> Column:
    """The non-blank paragraphs of a text, trimmed."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
