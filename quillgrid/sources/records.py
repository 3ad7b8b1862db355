"""Provider records (search, Crossref, OpenAlex, OpenReview, Atom, JATS, landing pages) to flat rows."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.text import first_year
from quillgrid.functions.urls import none_if_empty, normal_doi

SEARCH = """struct<paperId:string,title:string,authors:array<struct<name:string>>,year:int,abstract:string,venue:string,
  externalIds:struct<ArXiv:string,DOI:string>,openAccessPdf:struct<url:string>,isOpenAccess:boolean,citationCount:int>"""


def search_record(json: Column) -> Column:
    """A search or citation-graph record; null without a title. Url: arXiv, then DOI, then open PDF, then page."""
    r = F.from_json(json, SEARCH)
    full = none_if_empty
    url = F.coalesce(
        F.concat(F.lit("https://arxiv.org/abs/"), full(r["externalIds"]["ArXiv"])),
        F.concat(F.lit("https://doi.org/"), full(r["externalIds"]["DOI"])),
        full(r["openAccessPdf"]["url"]),
        F.concat(F.lit("https://www.semanticscholar.org/paper/"), full(r["paperId"])),
    )
    row = F.struct(
        F.coalesce(r["paperId"], F.lit("")).alias("paper_id"),
        r["title"].alias("title"),
        F.coalesce(F.filter(F.transform(r["authors"], lambda a: a["name"]), lambda n: n.isNotNull()), F.array().cast("array<string>")).alias("authors"),
        r["year"].alias("year"),
        r["abstract"].alias("abstract"),
        full(r["venue"]).alias("venue"),
        url.alias("url"),
        r["externalIds"]["ArXiv"].alias("arxiv_id"),
        r["externalIds"]["DOI"].alias("doi"),
        F.coalesce(r["isOpenAccess"], F.lit(False)).alias("is_open_access"),
        r["citationCount"].alias("citation_count"),
    )
    return F.when(full(r["title"]).isNotNull(), row)


def crossref_record(json: Column) -> Column:
    path = lambda p: F.get_json_object(json, p)
    given = F.from_json(path("$.message.author"), "array<struct<given:string,family:string,name:string>>")
    year = F.from_json(path("$.message.issued['date-parts']"), "array<array<int>>")
    return F.struct(
        path("$.message.title[0]").alias("title"),
        F.transform(given, lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"]))).alias("authors"),
        F.get(F.get(year, 0), 0).alias("year"),
        path("$.message['container-title'][0]").alias("venue"),
        normal_doi(path("$.message.DOI")).alias("doi"),
        path("$.message.license[0].URL").alias("license"),
    )


def openalex_record(json: Column) -> Column:
    path = lambda p: F.get_json_object(json, p)
    places = F.from_json(path("$.locations"), "array<struct<pdf_url:string>>")
    more = F.coalesce(F.transform(places, lambda x: x["pdf_url"]), F.array().cast("array<string>"))
    return F.struct(
        path("$.title").alias("title"),
        path("$.publication_year").try_cast("int").alias("year"),
        normal_doi(path("$.doi")).alias("doi"),
        F.coalesce(path("$.best_oa_location.pdf_url"), path("$.open_access.oa_url")).alias("pdf_url"),
        F.array_distinct(F.array_compact(F.concat(F.array(path("$.best_oa_location.pdf_url"), path("$.open_access.oa_url")), more))).alias("pdf_urls"),
        path("$.primary_location.source.display_name").alias("venue"),
        path("$.best_oa_location.license").alias("license"),
    )


def unpaywall_pdf(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.best_oa_location.url_for_pdf"), F.get_json_object(json, "$.best_oa_location.url"))


def graph_record(json: Column) -> Column:
    """A citation graph's answer about one DOI: the open PDF, and the arXiv id if there is a preprint."""
    path = lambda p: none_if_empty(F.get_json_object(json, p))
    return F.struct(
        path("$.title").alias("title"),
        path("$.year").try_cast("int").alias("year"),
        path("$.venue").alias("venue"),
        path("$.abstract").alias("abstract"),
        F.coalesce(path("$.externalIds.ArXiv"), path("$.externalIds.arXiv")).alias("arxiv_id"),
        path("$.openAccessPdf.url").alias("pdf_url"),
    )


def openreview_record(json: Column) -> Column:
    """A note with plain values or values wrapped in ``value``; authors as a list or one line with commas."""
    value = lambda f: F.coalesce(F.get_json_object(json, f"$.content.{f}.value"), F.get_json_object(json, f"$.content.{f}"))
    authors = value("authors")
    listed = F.from_json(F.when(authors.startswith("["), authors), "array<string>")
    return F.struct(
        value("title").alias("title"),
        F.coalesce(listed, F.transform(F.split(authors, ","), lambda a: F.trim(a))).alias("authors"),
        value("abstract").alias("abstract"),
        value("venue").alias("venue"),
    )


def atom_record(xml: Column) -> Column:
    """The first entry of an Atom answer; prefixes and the default namespace are dropped before."""
    plain = F.regexp_replace(F.regexp_replace(xml, r"\sxmlns(?::\w+)?=(\"[^\"]*\"|'[^']*')", ""), r"(</?)\w+:", "$1")
    plain = F.regexp_replace(plain, r"(\s)\w+:(\w+=)", "$1$2")
    at = lambda p: none_if_empty(F.trim(F.regexp_replace(F.xpath_string(plain, F.lit(f"/feed/entry[1]/{p}")), r"\s+", " ")))
    published = at("published")
    return F.struct(
        at("title").alias("title"),
        F.xpath(plain, F.lit("/feed/entry[1]/author/name/text()")).alias("authors"),
        at("summary").alias("abstract"),
        published.alias("published"),
        first_year(published).alias("year"),
        at("doi").alias("doi"),
        F.xpath(plain, F.lit("/feed/entry[1]/category/@term")).alias("categories"),
        at("primary_category/@term").alias("primary_category"),
    )


def jats_record(xml: Column) -> Column:
    at = lambda p: none_if_empty(F.trim(F.xpath_string(xml, F.lit(p))))
    given = F.xpath(xml, F.lit("//contrib[@contrib-type='author']/name/given-names/text()"))
    family = F.xpath(xml, F.lit("//contrib[@contrib-type='author']/name/surname/text()"))
    return F.struct(
        at("//article-meta//article-title").alias("title"),
        F.transform(F.arrays_zip(given.alias("g"), family.alias("f")), lambda a: F.concat_ws(" ", a["g"], a["f"])).alias("authors"),
        F.xpath_string(xml, F.lit("//article-meta/pub-date[1]/year")).try_cast("int").alias("year"),
        at("//journal-title").alias("venue"),
    )


def open_access_links(xml: Column) -> Column:
    """ARRAY<STRUCT(format, href)>, ftp as https."""
    zipped = F.arrays_zip(F.xpath(xml, F.lit("//link/@format")).alias("format"), F.xpath(xml, F.lit("//link/@href")).alias("href"))
    return F.transform(zipped, lambda x: F.struct(x["format"].alias("format"), F.regexp_replace(x["href"], "^ftp://", "https://").alias("href")))


class _Landing(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, list[str]] = {}
        self.pdf_link = self.pdf_anchor = None
        self.scripts: list[str] = []
        self.in_data = False

    def handle_data(self, data: str) -> None:
        if self.in_data:
            self.scripts[-1] += data

    def handle_endtag(self, tag: str) -> None:
        self.in_data = self.in_data and tag != "script"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), []).append(a["content"].strip())
        elif tag == "script":
            self.in_data = a.get("type", "").lower() == "application/ld+json"
            if self.in_data:
                self.scripts.append("")
        elif tag == "link" and a.get("type", "").lower() == "application/pdf" and a.get("href"):
            self.pdf_link = self.pdf_link or a["href"]
        elif tag == "a" and a.get("href", "").split("?")[0].lower().endswith(".pdf"):
            self.pdf_anchor = self.pdf_anchor or a["href"]


LANDING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "doi", "venue", "abstract", "pdf_url")]
    + [T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("year", T.IntegerType())]
)


def _linked_data(scripts: list[str]) -> dict:
    """Title, authors, date, venue, abstract and PDF of the first JSON-LD object of a page that describes an article."""
    for text in scripts:
        try:
            found = json.loads(text)
        except ValueError:
            continue
        items = found if isinstance(found, list) else found.get("@graph", [found]) if isinstance(found, dict) else []
        for x in items if isinstance(items, list) else []:
            kinds = x.get("@type") if isinstance(x, dict) else None
            if not any(str(k).endswith("Article") for k in (kinds if isinstance(kinds, list) else [kinds])):
                continue
            name = lambda v: v.get("name") if isinstance(v, dict) else v if isinstance(v, str) else None
            people = x.get("author") or []
            coded = x.get("encoding") or {}
            return {
                "title": name(x.get("headline")) or name(x.get("name")),
                "authors": [n for n in map(name, people if isinstance(people, list) else [people]) if n],
                "date": str(x.get("datePublished") or ""),
                "venue": name(x.get("isPartOf")),
                "abstract": name(x.get("description")),
                "pdf": coded.get("contentUrl") if isinstance(coded, dict) else None,
            }
    return {}


def read_landing(html: str | None, base_url: str | None) -> tuple:
    """(title, doi, venue, abstract, pdf_url, authors, year) of a landing page's citation metadata."""
    page = _Landing()
    page.feed(html or "")
    one = lambda *names: next((page.meta[n][0] for n in names if page.meta.get(n)), None)
    data = _linked_data(page.scripts)
    pdf = one("citation_pdf_url") or page.pdf_link or page.pdf_anchor or data.get("pdf")
    year = "".join(filter(str.isdigit, (one("citation_publication_date", "citation_date", "citation_year") or data.get("date") or "")[:4]))
    return (
        one("citation_title", "og:title") or data.get("title"),
        one("citation_doi"),
        one("citation_journal_title", "citation_conference_title") or data.get("venue"),
        one("citation_abstract", "og:description", "description") or data.get("abstract"),
        urljoin(base_url or "", pdf) if pdf else None,
        page.meta.get("citation_author") or data.get("authors") or [],
        int(year) if len(year) == 4 else None,
    )


@F.pandas_udf(LANDING)
def landing_record(html: pd.Series, base_url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_landing(h, b) for h, b in zip(html, base_url)], columns=LANDING.names)
