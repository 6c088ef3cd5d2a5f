"""Records from the JSON pages that literature services return, saved as files or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.text import bare_doi

#: Where each service keeps its list of results and the fields of one result.
SERVICES: dict[str, tuple[str, str, dict[str, str]]] = {
    "openalex": ("$.results", "id string, doi string, title string, publication_year int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, ids map<string,string>, primary_location struct<source:struct<display_name:string>>", {"source_id": "id", "title": "title", "doi": "doi", "year": "publication_year", "journal": "primary_location.source.display_name"}),
    "crossref": ("$.message.items", "DOI string, title array<string>, abstract string, `container-title` array<string>, volume string, issue string, page string, issued struct<`date-parts`:array<array<int>>>, author array<struct<family:string,given:string>>", {"source_id": "DOI", "title": "title[0]", "doi": "DOI", "year": "issued.`date-parts`[0][0]", "journal": "`container-title`[0]"}),
    "europepmc": ("$.resultList.result", "id string, doi string, pmid string, title string, abstractText string, pubYear string, journalTitle string, authorString string", {"source_id": "id", "title": "title", "doi": "doi", "year": "try_cast(pubYear as int)", "journal": "journalTitle"}),
    "semanticscholar": ("$.data", "paperId string, title string, abstract string, year int, venue string, externalIds map<string,string>", {"source_id": "paperId", "title": "title", "doi": "externalIds['DOI']", "year": "year", "journal": "venue"}),
    "core": ("$.results", "id string, title string, abstract string, doi string, yearPublished int, publisher string", {"source_id": "id", "title": "title", "doi": "doi", "year": "yearPublished", "journal": "publisher"}),
    "doaj": ("$.results", "id string, bibjson struct<title:string,abstract:string,year:string,journal:struct<title:string>,identifier:array<struct<type:string,id:string>>>", {"source_id": "id", "title": "bibjson.title", "doi": "filter(bibjson.identifier, x -> lower(x.type) = 'doi')[0].id", "year": "try_cast(bibjson.year as int)", "journal": "bibjson.journal.title"}),
    "clinicaltrials": ("$.studies", "protocolSection struct<identificationModule:struct<nctId:string,officialTitle:string,briefTitle:string>,descriptionModule:struct<briefSummary:string>>", {"source_id": "protocolSection.identificationModule.nctId", "title": "coalesce(protocolSection.identificationModule.officialTitle, protocolSection.identificationModule.briefTitle)", "doi": "cast(null as string)", "year": "cast(null as int)", "journal": "cast(null as string)"}),
}
ABSTRACT = {"crossref": "abstract", "europepmc": "abstractText", "semanticscholar": "abstract", "core": "abstract", "doaj": "bibjson.abstract", "clinicaltrials": "protocolSection.descriptionModule.briefSummary"}


def from_inverted(index: Column) -> Column:
    """The text of a map from words to their positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def records_of(pages: DataFrame, service: str, column: str = "value") -> DataFrame:
    """``source, source_id, title, doi, year, journal, abstract`` of each result with a title; a page that is no JSON gives none."""
    at, fields, names = SERVICES[service]
    schema = f"array<struct<{', '.join(_typed(f) for f in _split(fields))}>>"
    rows = pages.select(F.explode(F.from_json(F.get_json_object(column, at), schema)).alias("r")).select("r.*")
    abstract = from_inverted(F.col("abstract_inverted_index")) if service == "openalex" else F.expr(ABSTRACT[service])
    out = rows.select(F.lit(service).alias("source"), *[F.expr(e).alias(n) for n, e in names.items()], abstract.alias("abstract"))
    return out.withColumn("doi", bare_doi(F.col("doi"))).where("title is not null and title <> ''")


def _split(fields: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def _typed(field: str) -> str:
    name, _, kind = field.strip().partition(" ")
    return f"{name}:{kind}"


#: XML services: the element of one result and the paths of its fields.
XML: dict[str, tuple[str, dict[str, str]]] = {
    "pubmed": ("PubmedArticle", {"source_id": "//MedlineCitation/PMID", "title": "//ArticleTitle", "doi": "//ArticleIdList/ArticleId[@IdType='doi']", "year": "//PubDate/Year", "journal": "//Journal/Title", "abstract": "//Abstract/AbstractText"}),
    "arxiv": ("entry", {"source_id": "//id", "title": "//title", "doi": "//doi", "year": "//published", "journal": "//journal_ref", "abstract": "//summary"}),
}


def xml_records_of(pages: DataFrame, service: str, column: str = "value") -> DataFrame:
    """As :func:`records_of` for services that answer in XML; namespaces are dropped, parts of an abstract joined by blanks, and pages without results give none."""
    tag, paths = XML[service]
    bare = F.regexp_replace(F.regexp_replace(column, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1")
    each = pages.select(F.explode(F.regexp_extract_all(bare, F.lit(rf"(?s)(<{tag}[\s>].*?</{tag}>)"), F.lit(1))).alias("x"))
    text = lambda path: F.trim(F.regexp_replace(F.array_join(F.xpath("x", F.lit(path + "//text()")), " "), r"\s+", " "))
    got = each.select(F.lit(service).alias("source"), *[text(p).alias(n) for n, p in paths.items()])
    year = F.nullif(F.regexp_extract("year", r"^((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    return got.withColumn("doi", bare_doi(F.col("doi"))).withColumn("year", year).where("title <> ''")


def preprints(records: DataFrame, publisher: str = "publisher") -> DataFrame:
    """The records of a general service that come from the preprint servers bioRxiv and medRxiv."""
    return records.where(F.lower(publisher).rlike("biorxiv|medrxiv|cold spring harbor"))
