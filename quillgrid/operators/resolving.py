"""Where a paper's text can be had: candidates from its identity and from stored provider records.

Nothing is fetched. Provider answers are rows (key, provider, body) that were stored before; a plan joins them to the
identities once, pivoted to one row per key, and computes candidates, status and merged metadata as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import looks_like_pdf
from quillgrid.functions.urls import host_of, none_if_empty
from quillgrid.sources import records

#: Resolver of each kind of identity; every other kind is a landing page.
RESOLVERS = {
    "arxiv": "arxiv", "doi": "doi", "biorxiv": "preprint", "medrxiv": "preprint", "pmcid": "pmc", "openreview": "openreview",
    "acl": "proceedings", "pmlr": "proceedings", "cvf": "proceedings", "jmlr": "proceedings", "neurips": "proceedings",
}
PROVIDERS = ("crossref", "openalex", "unpaywall", "graph", "landing", "jats", "oa_links", "openreview")


def resolver_of(kind: Column) -> Column:
    chain = None
    for k, name in RESOLVERS.items():
        chain = F.when(kind == k, name) if chain is None else chain.when(kind == k, name)
    return chain.otherwise("generic")


def _pdf(urls: Column, label: str) -> Column:
    """Candidates of an array of URLs: nulls and repeats dropped, priority by place."""
    kept = F.array_distinct(F.array_compact(urls))
    make = lambda u, i: F.struct(F.lit("pdf").alias("kind"), u.alias("url"), F.lit("marker").alias("extractor"), i.cast("int").alias("priority"), F.lit(label).alias("label"))
    return F.transform(kept, make)


def arxiv_candidates(value: Column, version: Column) -> Column:
    """The HTML page first, the PDF well behind it."""
    name = F.concat(value, F.coalesce(version, F.lit("")))
    row = lambda kind, folder, end, extractor, priority, label: F.struct(
        F.lit(kind).alias("kind"), F.concat(F.lit(f"https://arxiv.org/{folder}/"), name, F.lit(end)).alias("url"),
        F.lit(extractor).alias("extractor"), F.lit(priority).alias("priority"), F.lit(label).alias("label"),
    )
    return F.array(row("arxiv_html", "html", "", "arxiv_html", 0, "arXiv HTML"), row("pdf", "pdf", ".pdf", "marker", 10, "arXiv PDF"))


def proceedings_pages(kind: Column, host: Column, value: Column) -> Column:
    """STRUCT(landing, pdfs) of a proceedings identity, from the address patterns of each venue."""
    v = F.regexp_replace(value, "^/+|/+$", "")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    stem = F.regexp_replace(v, "^papers/", "")
    paper = F.replace(F.replace(v, F.lit("/hash/"), F.lit("/file/")), F.lit("-Abstract"), F.lit("-Paper"))
    made = lambda landing, *pdfs: F.struct(landing.alias("landing"), F.array(*pdfs).alias("pdfs"))
    return (
        F.when(kind == "acl", made(text("https://aclanthology.org/", v, "/"), text("https://aclanthology.org/", v, ".pdf")))
        .when(
            kind == "pmlr",
            made(
                text("https://proceedings.mlr.press/", v, ".html"),
                text("https://proceedings.mlr.press/", v, "/", F.substring_index(v, "/", -1), ".pdf"),
                text("https://proceedings.mlr.press/", v, ".pdf"),
            ),
        )
        .when(kind == "cvf", made(text("https://", host, "/", v, ".html"), text("https://", host, "/", F.replace(v, F.lit("/html/"), F.lit("/papers/")), ".pdf")))
        .when(
            kind == "jmlr",
            made(text("https://jmlr.org/papers/", stem, ".html"), text("https://jmlr.org/papers/", stem, ".pdf"), text("https://www.jmlr.org/papers/", stem, ".pdf")),
        )
        .when(
            kind == "neurips",
            made(text("https://proceedings.neurips.cc/", v, ".html"), text("https://proceedings.neurips.cc/", paper, ".pdf"), text("https://proceedings.neurips.cc/", v, ".pdf")),
        )
        .otherwise(made(text("https://", host, "/", v), text("https://", host, "/", v, ".pdf")))
    )


def graph_id(kind: Column, value: Column) -> Column:
    """The name of a paper at the citation graph; an error for identities that it doesn't know."""
    return F.when(kind == "arxiv", F.concat(F.lit("arXiv:"), value)).when(kind == "doi", F.concat(F.lit("DOI:"), value)).otherwise(
        F.raise_error(F.concat(F.lit("the citation graph knows no identities of kind "), F.coalesce(kind, F.lit("null")))).cast("string")
    )


def resolve(identities: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, resolver, status, landing_url, candidates, title, authors, year, venue, license, arxiv_id, notes).

    ``identities``: (key, kind, value, normalized_url, version); ``stored``: (key, provider, body), of which one body a provider
    and key is taken (the greatest). Candidates stand in order of priority; ``status`` is ``ok`` or ``metadata_only``.
    Metadata is filled by precedence: the registry, then open-access indexes, then the citation graph. Missing,
    null and unreadable records leave their fields null. One join, on the key.
    """
    pivot = stored.where(F.col("provider").isin(*PROVIDERS)).groupBy("key").agg(
        *[F.max(F.when(F.col("provider") == p, F.col("body"))).alias(p) for p in PROVIDERS]
    )
    rows = identities.select("key", "kind", "value", "normalized_url", "version").join(pivot, "key", "left")
    rows = rows.withColumns(
        {
            "resolver": resolver_of(F.col("kind")),
            "c": records.crossref_record(F.col("crossref")),
            "a": records.openalex_record(F.col("openalex")),
            "u": records.unpaywall_pdf(F.col("unpaywall")),
            "g": records.graph_record(F.col("graph")),
            "l": records.landing_record(F.col("landing"), F.col("normalized_url")),
            "j": records.jats_record(F.col("jats")),
            "o": records.open_access_links(F.col("oa_links")),
            "n": records.openreview_record(F.col("openreview")),
            "p": proceedings_pages(F.col("kind"), host_of(F.col("normalized_url")), F.col("value")),
        }
    )
    own_pdf = F.when(F.lower("normalized_url").endswith(".pdf"), F.col("normalized_url"))
    preprint = F.when(F.col("g.arxiv_id").isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), F.col("g.arxiv_id")))
    pmc_links = F.transform(F.filter("o", lambda x: (x["format"] == "pdf") | F.lower(x["href"]).endswith(".pdf")), lambda x: x["href"])
    direct = looks_like_pdf(F.regexp_replace("normalized_url", "[?#].*$", ""))
    known = F.array_contains(F.col("p.pdfs"), F.col("normalized_url"))
    is_ = lambda name: F.col("resolver") == name
    none = F.array().cast("array<string>")
    candidates = (
        F.when(is_("arxiv"), arxiv_candidates(F.col("value"), F.col("version")))
        .when(is_("preprint"), _pdf(F.array("normalized_url"), "preprint PDF"))
        .when(is_("doi"), _pdf(F.concat(F.array(preprint), F.coalesce("a.pdf_urls", none), F.array("u", "g.pdf_url")), "Open access PDF"))
        .when(is_("pmc"), F.transform(_pdf(F.coalesce(pmc_links, none), "PMC PDF"), lambda x: x.withField("priority", F.lit(0))))
        .when(is_("openreview"), _pdf(F.array(F.concat(F.lit("https://openreview.net/pdf?id="), F.col("value"))), "OpenReview PDF"))
        .when(is_("proceedings"), _pdf(F.concat(F.array("l.pdf_url", F.when(~known, own_pdf)), F.col("p.pdfs")), "Proceedings PDF"))
        .otherwise(_pdf(F.array(F.when(direct, F.col("normalized_url")).otherwise(F.col("l.pdf_url"))), "PDF"))
    )
    landing = (
        F.when(is_("arxiv"), F.concat(F.lit("https://arxiv.org/abs/"), F.col("value"), F.coalesce("version", F.lit(""))))
        .when(is_("preprint"), F.concat(F.lit("https://www."), F.col("kind"), F.lit(".org/content/"), F.col("value")))
        .when(is_("doi"), F.concat(F.lit("https://doi.org/"), F.col("value")))
        .when(is_("pmc"), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), F.col("value"), F.lit("/")))
        .when(is_("openreview"), F.concat(F.lit("https://openreview.net/forum?id="), F.col("value")))
        .when(is_("proceedings"), F.col("p.landing"))
        .otherwise(F.col("normalized_url"))
    )
    first = lambda field, *sources: F.coalesce(*[none_if_empty(F.col(f"{s}.{field}")) for s in sources])
    notes = F.array_compact(
        F.array(
            F.when(is_("doi") & preprint.isNotNull(), F.concat(F.lit("using the arXiv preprint "), F.col("g.arxiv_id"))),
            F.when(is_("pmc") & F.exists(F.coalesce("o", F.array().cast("array<struct<format:string,href:string>>")), lambda x: x["format"] == "tgz"), "a full-text package is available"),
            F.when(F.size("candidates") == 0, "no PDF found"),
        )
    )
    return rows.withColumn("candidates", candidates).select(
        "key",
        "resolver",
        F.when(F.size("candidates") == 0, "metadata_only").otherwise("ok").alias("status"),
        landing.alias("landing_url"),
        "candidates",
        first("title", "c", "a", "g", "l", "j", "n").alias("title"),
        F.coalesce(*[F.when(F.size(f"{s}.authors") > 0, F.col(f"{s}.authors")) for s in ("c", "l", "j", "n")]).alias("authors"),
        F.coalesce("c.year", "a.year", "g.year", "l.year", "j.year").alias("year"),
        first("venue", "c", "a", "g", "l", "j", "n").alias("venue"),
        first("license", "c", "a").alias("license"),
        F.col("g.arxiv_id").alias("arxiv_id"),
        notes.alias("notes"),
    )


def best_attempt(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """The attempt at a paper's text of the highest coverage; of equal ones the last in ``order``.

    ``attempts`` has ``ratio``, ``empty`` and ``ir_available``; an empty result, one without a structured document, and one
    without a ratio lose to all others. One aggregation, combined on the map side.
    """
    score = F.when(F.coalesce("empty", F.lit(False)) | ~F.coalesce("ir_available", F.lit(True)), -1.0).otherwise(F.coalesce(F.col("ratio").cast("double"), F.lit(-1.0)))
    best = F.max(F.struct(score.alias("score"), F.col(order).alias("__order"), F.struct(*attempts.columns).alias("row")))
    return attempts.groupBy(F.col(key).alias("__key")).agg(best.alias("b")).select("b.row.*", "b.score")
