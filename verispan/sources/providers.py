"""Answers of literature services as records: column mappings for JSON pages, parsers for XML pages, request guards.

Each mapping takes a JSON text column and gives the fields of ``RECORD``; nothing is inferred.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ("title", "year", "journal", "abstract", "record_type", "citation_count", "identifiers", "authors")
PEOPLE = "array<struct<given:string,family:string,display:string,orcid:string>>"
# Order of dates for the year of a record, and request parts that would change data.
YEAR_ORDER = ("published-print", "published", "issued", "published-online")
WRITES = re.compile(r"\b(insert|delete|load|clear|drop|create|add|move|copy|service)\b", re.I)


def _ids(**ids: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in ids.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))


def _people(raw: Column, schema: str, make) -> Column:
    return F.coalesce(F.transform(F.from_json(raw, f"array<{schema}>"), make), F.lit(None).cast(PEOPLE))


def _person(given=None, family=None, display=None, orcid=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*[(none if c is None else c).alias(n) for n, c in (("given", given), ("family", family), ("display", display), ("orcid", orcid))])


def crossref(j: Column) -> dict[str, Column]:
    g = lambda p: F.get_json_object(j, p)
    year = F.coalesce(*[g(f"$.{k}.date-parts[0][0]") for k in YEAR_ORDER])
    return {
        "title": g("$.title[0]"), "year": year.cast("int"), "journal": g("$.container-title[0]"), "abstract": F.trim(F.regexp_replace(g("$.abstract"), "<[^>]+>", " ")), "record_type": F.coalesce(g("$.type"), F.lit("article")),
        "citation_count": g("$.is-referenced-by-count").cast("int"), "identifiers": _ids(doi=F.lower(g("$.DOI"))),
        "authors": _people(g("$.author"), "struct<given:string,family:string,name:string,ORCID:string>", lambda a: _person(a["given"], a["family"], a["name"], a["ORCID"])),
    }


def datacite(j: Column) -> dict[str, Column]:
    root = F.coalesce(F.get_json_object(j, "$.data.attributes"), F.get_json_object(j, "$.attributes"))
    g = lambda p: F.get_json_object(root, p)
    return {
        "title": g("$.titles[0].title"), "year": g("$.publicationYear").cast("int"), "journal": g("$.container.title"), "abstract": F.lit(None).cast("string"), "record_type": F.coalesce(g("$.types.resourceTypeGeneral"), F.lit("other")),
        "citation_count": F.lit(None).cast("int"), "identifiers": _ids(doi=F.lower(g("$.doi"))),
        "authors": _people(g("$.creators"), "struct<givenName:string,familyName:string,name:string>", lambda a: _person(a["givenName"], a["familyName"], F.when(a["familyName"].isNull(), a["name"]))),
    }


def europepmc(j: Column) -> dict[str, Column]:
    g = lambda p: F.get_json_object(j, p)
    return {
        "title": g("$.title"), "year": F.when(g("$.pubYear").rlike("^[0-9]{4}$"), g("$.pubYear")).cast("int"), "journal": F.coalesce(g("$.journalInfo.journal.title"), g("$.journalTitle")), "abstract": g("$.abstractText"),
        "record_type": F.when(g("$.source") == "PPR", "preprint").otherwise("article"), "citation_count": g("$.citedByCount").cast("int"),
        "identifiers": _ids(doi=F.lower(g("$.doi")), pmid=F.when(g("$.source") == "MED", g("$.id")), pmcid=g("$.pmcid"), europepmc=F.concat_ws("/", g("$.source"), g("$.id"))),
        "authors": _people(g("$.authorList.author"), "struct<firstName:string,lastName:string,collectiveName:string,fullName:string>", lambda a: _person(a["firstName"], a["lastName"], F.when(a["lastName"].isNull(), F.coalesce(a["collectiveName"], a["fullName"])))),
    }


def inverted_text(raw: Column) -> Column:
    """The text of an inverted index (word -> positions)."""
    index = F.from_json(raw, "map<string,array<int>>")
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def openalex(j: Column) -> dict[str, Column]:
    g = lambda p: F.get_json_object(j, p)
    tail = lambda p: F.element_at(F.split(g(p), "/"), -1)
    return {
        "title": g("$.display_name"), "year": g("$.publication_year").cast("int"), "journal": g("$.primary_location.source.display_name"), "abstract": inverted_text(g("$.abstract_inverted_index")), "record_type": F.coalesce(g("$.type"), F.lit("article")),
        "citation_count": g("$.cited_by_count").cast("int"), "identifiers": _ids(doi=F.lower(F.regexp_replace(g("$.ids.doi"), "^https?://(dx\\.)?doi\\.org/", "")), pmid=tail("$.ids.pmid"), pmcid=tail("$.ids.pmcid"), openalex=F.coalesce(tail("$.ids.openalex"), tail("$.id"))),
        "authors": _people(g("$.authorships"), "struct<author:struct<display_name:string,orcid:string>>", lambda a: _person(display=a["author"]["display_name"], orcid=a["author"]["orcid"])),
    }


def semantic_scholar(j: Column) -> dict[str, Column]:
    g = lambda p: F.get_json_object(j, p)
    return {
        "title": g("$.title"), "year": g("$.year").cast("int"), "journal": F.coalesce(g("$.journal.name"), g("$.venue")), "abstract": g("$.abstract"), "record_type": F.lit("article"), "citation_count": g("$.citationCount").cast("int"),
        "identifiers": _ids(doi=F.lower(g("$.externalIds.DOI")), pmid=g("$.externalIds.PubMed"), arxiv=g("$.externalIds.ArXiv"), s2=g("$.paperId")), "authors": _people(g("$.authors"), "struct<name:string>", lambda a: _person(display=a["name"])),
    }


MAPPINGS = {"crossref": crossref, "datacite": datacite, "europepmc": europepmc, "openalex": openalex, "s2": semantic_scholar}


def map_records(pages: DataFrame, provider: str, record: str = "record") -> DataFrame:
    """``pages`` with the fields of ``RECORD`` read from the JSON text of a provider."""
    return pages.withColumns(MAPPINGS[provider](F.col(record)))


def atom_entries(xml: str) -> Iterator[dict]:
    """Entries of an Atom feed of preprints; the version stays in the identifier; an error feed is refused."""
    a, x = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"
    for e in ElementTree.fromstring(xml).iter(f"{a}entry"):
        text = lambda tag: " ".join((e.findtext(tag) or "").split())
        if text(f"{a}title").lower() == "error" or "/abs/" not in text(f"{a}id"):
            raise ValueError(f"the service answered with an error: {text(f'{a}summary')[:200]}")
        ids = {"arxiv": text(f"{a}id").rsplit("/abs/", 1)[1], "doi": text(f"{x}doi").lower()}
        year = text(f"{a}published")[:4]
        people = [" ".join((p.findtext(f"{a}name") or "").split()) for p in e.iter(f"{a}author")]
        yield {"title": text(f"{a}title"), "year": int(year) if year.isdigit() else None, "journal": text(f"{x}journal_ref") or None, "abstract": text(f"{a}summary"), "record_type": "preprint", "identifiers": {k: v for k, v in ids.items() if v}, "authors": people}


def pubmed_articles(xml: str) -> Iterator[dict]:
    """Articles of a PubMed answer; the year falls back to the free-text date."""
    for e in ElementTree.fromstring(xml).iter("PubmedArticle"):
        article = e.find(".//Article")
        ids = {"pmid": e.findtext(".//MedlineCitation/PMID")}
        for i in e.iterfind("./PubmedData/ArticleIdList/ArticleId"):
            kind = {"doi": "doi", "pmc": "pmcid"}.get(i.get("IdType"))
            if kind and i.text:
                ids[kind] = i.text.lower() if kind == "doi" else i.text
        date = article.find(".//JournalIssue/PubDate") if article is not None else None
        year = re.search(r"[0-9]{4}", "" if date is None else date.findtext("Year") or date.findtext("MedlineDate") or "")
        whole = lambda node: "" if node is None else " ".join("".join(node.itertext()).split())
        people = [p.findtext("CollectiveName") or ", ".join(x for x in (p.findtext("LastName"), p.findtext("ForeName")) if x) for p in e.iterfind(".//AuthorList/Author")]
        yield {"title": whole(e.find(".//ArticleTitle")), "year": int(year[0]) if year else None, "journal": e.findtext(".//Journal/Title"), "abstract": " ".join(whole(t) for t in e.iterfind(".//Abstract/AbstractText")) or None, "record_type": "article", "identifiers": {k: v for k, v in ids.items() if v}, "authors": people}


def xml_records(pages: DataFrame, key: str, xml: str, kind: str) -> DataFrame:
    """``key, n, error`` and the record fields of XML pages of kind ``atom`` or ``pubmed``; a broken page has one row with its error."""
    parse = {"atom": atom_entries, "pubmed": pubmed_articles}[kind]
    names = ["title", "year", "journal", "abstract", "record_type", "identifiers", "authors"]
    of = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf["__key"], pdf["xml"]):
                try:
                    rows += [(k, i, None, *[r[n] for n in names]) for i, r in enumerate(parse(text))]
                except Exception as e:
                    rows.append((k, None, f"{type(e).__name__}: {e}"[:300], *[None] * len(names)))
            yield pd.DataFrame(rows, columns=["__key", "n", "error", *names]).astype({"year": "Int64", "n": "Int64"})

    schema = f"__key {of}, n int, error string, title string, year int, journal string, abstract string, record_type string, identifiers map<string,string>, authors array<string>"
    return pages.select(F.col(key).alias("__key"), F.col(xml).alias("xml")).mapInPandas(run, schema).withColumnRenamed("__key", key)


def resolve_accession(answers: DataFrame, key: str, body: str, symbol: str, taxon: str) -> DataFrame:
    """``key, status, accession``: the one accession whose primary gene name and organism are those asked for."""
    rows = F.from_json(F.get_json_object(body, "$.results"), "array<struct<primaryAccession:string,organism:struct<taxonId:string>,genes:array<struct<geneName:struct<value:string>>>>>")
    fits = F.filter(rows, lambda r: (r["organism"]["taxonId"] == F.col(taxon).cast("string")) & F.exists(r["genes"], lambda g: F.coalesce(g["geneName"]["value"] == F.col(symbol), F.lit(False))))
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(fits, lambda r: r["primaryAccession"]))))
    n = F.coalesce(F.size(found), F.lit(0))
    status = F.when(rows.isNull(), "lookup_failed").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("not_resolved")
    return answers.select(key, status.alias("status"), F.when(n == 1, F.get(found, F.lit(0))).alias("accession"))


def first_lookup(wanted: DataFrame, lookups: list[tuple[str, DataFrame]], key: str = "doi") -> DataFrame:
    """``wanted`` with the first service, in order, that returned exactly the wanted identifier, and its title."""
    out = wanted
    for name, df in lookups:
        out = out.join(df.groupBy(key).agg(F.min("title").alias(f"__{name}")), key, "left")
    service, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, _ in reversed(lookups):
        service = F.when(F.col(f"__{name}").isNotNull(), name).otherwise(service)
        title = F.coalesce(f"__{name}", title)
    return out.select(*wanted.columns, F.coalesce(service, F.lit("not_found")).alias("service"), title.alias("title"))


def read_only(protocol: str, request: str) -> None:
    """Refuse requests that could change data: GraphQL must be a query, SPARQL has no update and no federation."""
    text = re.sub(r"#[^\n]*", "", request)
    if protocol == "graphql" and re.search(r"\b(mutation|subscription)\b", text):
        raise ValueError("only queries are sent")
    if protocol == "sparql" and (WRITES.search(re.sub(r"<[^>]*>|\"[^\"]*\"", "", text)) or not re.search(r"\b(select|ask|construct|describe)\b", text, re.I)):
        raise ValueError("only reading queries without SERVICE are sent")
    if protocol == "path" and (":" in request or request.startswith("/") or ".." in request.split("/")):
        raise ValueError("only relative paths are sent")
